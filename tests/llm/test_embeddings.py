"""Embedding near-duplicates against brute force."""

import math

import numpy as np

from wavejobs.llm import embeddings

KIND = "vec_id long, embedding array<float>, label int, filter string, rep double"


def test_recall_and_components(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    monkeypatch.setattr(embeddings, "CELL_ROWS", 120)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((500, 64))
    rows = list(base)
    for v in base[:150]:
        for _ in range(3):
            rows.append(v + rng.standard_normal(64) * rng.uniform(0.1, 0.6))
    rows += [base[0]] * 120 + [base[1] + rng.standard_normal(64) * 0.2 for _ in range(150)]
    rows = [np.float32(r).tolist() for r in rows]
    got = {r.vec_id: r for r in embeddings.group(spark.createDataFrame([(i, v, 0, "x", 0.0) for i, v in enumerate(rows)], KIND)).collect()}
    unit = np.array(rows, np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = unit @ unit.T >= 0.9
    np.fill_diagonal(true, False)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= true.sum(1)).all()
    assert found.sum() >= 0.995 * true.sum()
    assert got[0].n_links >= 120 and all(got[i].component_id == got[0].component_id for i in range(950, 1070))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, None, 0, "a", 0.0),
        (2, [0.0] * 4, 0, "a", 0.0),
        (3, [1.0, None, 0.0, 0.0], 0, "a", 0.0),
        (4, [1.0, math.nan, 0.0, 0.0], None, "a", 0.0),
        (5, [math.inf, 1.0, 0.0, 0.0], 0, None, 0.0),
        (6, [], 0, "a", 0.0),
        (8, v, 0, "a", 0.0),
        (7, [2 * x for x in v], 9, "a", 0.0),
        (7, [2 * x for x in v], 9, "a", 0.0),
        (None, v, 0, "a", 0.0),
        (9, [1.0, 2.0], 0, "a", 0.0),
        (10, [1e-30, 2e-30, 3e-30, 4e-30], 0, "a", 0.0),
    ]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.group(spark.createDataFrame(rows, KIND)).collect()]
    assert len(got) == len(rows)
    for i in (1, 2, 3, 4, 5, 6, 9):
        assert (i, 0, i, True) in got
    assert (None, 0, None, False) in got
    assert got.count((7, 3, 7, True)) == 2 and (8, 3, 7, False) in got and (10, 3, 7, False) in got


def test_empty(spark):
    assert embeddings.group(spark.createDataFrame([], KIND)).collect() == []


def test_filters_grow_with_the_input():
    small, large = embeddings.Code(1_000, 64), embeddings.Code(1_000_000, 64)
    assert large.size > small.size and large.alpha > small.alpha


def test_recall_does_not_fall_with_the_input():
    rng = np.random.default_rng(5)
    for n in (10**5, 10**6, 10**7, 10**8):
        code = embeddings.Code(n, 64)
        for cosine in (0.9, 0.92):
            x, y = embeddings.pairs(300, 64, cosine, rng)
            met = sum(bool(np.isin(p, q).any()) for p, q in zip(code.decode(x), code.decode(y)))
            assert met >= 0.985 * 300, (n, cosine, met)


def test_short_vectors(spark):
    rng = np.random.default_rng(6)
    sizes = (1, 2, 3, 6)
    rows = [np.float32(rng.standard_normal(d)).tolist() for d in sizes for _ in range(150)]
    frame = spark.createDataFrame([(i, v, 0, "x", 0.0) for i, v in enumerate(rows)], KIND)
    true = np.concatenate([((u := embeddings.unit(rows[150 * k : 150 * k + 150], 8)) @ u.T >= 0.9).sum(1) - 1 for k in range(len(sizes))])
    found = {r.vec_id: r.n_links for r in embeddings.group(frame).collect()}
    found = np.array([found[i] for i in range(len(rows))])
    assert (found <= true).all() and found.sum() >= 0.98 * true.sum()


def test_recall_just_over_the_cosine(spark):
    rng = np.random.default_rng(7)
    x, y = embeddings.pairs(1000, 64, 0.91, rng)
    noise = rng.standard_normal((3000, 64))
    rows = [v.tolist() for v in np.concatenate([x, y, noise])]
    got = {r.vec_id: r for r in embeddings.group(spark.createDataFrame([(i, v, 0, "x", 0.0) for i, v in enumerate(rows)], KIND.replace("array<float>", "array<double>"))).collect()}
    assert sum(got[i].n_links >= 1 and got[i].component_id == got[i + 1000].component_id for i in range(1000)) >= 985
