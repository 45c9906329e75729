"""Mixing and sharding: their laws, edge cases and plain versions."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from wavejobs.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string, shard string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, "clash", "clash", "clash") for d, t, s in rows], DOCS)


def corpus(n=900):
    rng = random.Random(6)
    rows = [(d, " ".join("w" for _ in range(min(400, int(rng.expovariate(0.02))))), rng.choice(("a", "a", "a", "a", "b", "c", "é", None))) for d in range(n)]
    return rows + [(None, "some words", "b"), (None, None, None), (3, rows[3][1], rows[3][2]), (n, None, "a"), (n + 1, "", "only empty")]


def test_mix(spark):
    rows = corpus()
    got = mixing.mix(docs_of(spark, rows).repartition(4)).collect()
    again = mixing.mix(docs_of(spark, rows[::-1])).collect()
    plain = lambda rs: Counter((r.doc_id, r.source, r["size"], r.taken) for r in rs)
    assert plain(got) == plain(again) and len(got) == len(rows)
    sizes, taken, target, cap = Counter(), Counter(), {}, 2.0
    for r in got:
        assert r["size"] == r.copies * 0 + (r["size"] or 0) and 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(r["size"] for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while True:  # pour, cap what is over, and pour again
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not over:
            want |= {s: level * weights[s] for s in open_}
            break
        want |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 2 * 400
    assert mixing.mix(docs_of(spark, [])).collect() == []
    assert [(r.taken, r.target) for r in mixing.mix(docs_of(spark, [(1, "", "a"), (2, None, None)])).collect()] == [(0, 0.0)] * 2


def test_shards(spark):
    rng = random.Random(2)
    rows = [(d, "x" * rng.randint(0, 300) + str(d % 700), "s") for d in range(4000)] + [(5000 + i, "hot " * 30, "s") for i in range(1500)]
    rows += [(None, "no id", "s"), (None, None, "s"), (7000, None, "s"), (7001, "", "s"), (0, rows[0][1], "s"), (7002, "é" * 10, "s")]
    got = sharding.shard(docs_of(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    text = {d: t for d, t, _ in rows if d is not None}
    total, by, slots = 0, Counter(), defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            t = text[r.doc_id]
            assert r["size"] == len((t or "").encode()) + 16 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert r.law == "bytes" and 0 <= r.shard < 40 and r.grown_shard is None
        total += r["size"]
        by[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(by) == 40 and all(abs(b - total / 40) < 0.14 * total / 40 for b in by.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in got:
        where[text.get(r.doc_id)].add(r.shard)
    assert all(len(s) == 1 for t, s in where.items() if t is not None and not t.startswith("hot") and t != "no id") and len(where["hot " * 30]) > 1
    assert sharding.shard(docs_of(spark, [])).collect() == []


def test_splitters_are_ordered_and_found(spark):
    cuts = [(1, 5), (1, 9), (4, 0)]
    df = spark.createDataFrame([(h, d) for h in range(-1, 6) for d in range(0, 12, 3)], "h long, d long")
    got = sharding.ranged(df, cuts).select("h", "d", F.col("range").alias("r")).collect()
    assert all(r.r == sum(c <= (r.h, r.d) for c in cuts) for r in got)
