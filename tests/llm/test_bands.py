"""Classes of walk fingerprints against all pairs that share a band."""

import random

import numpy as np

from wavejobs.llm import bands, walks

ROWS = "doc_id long, fingerprint string, class_id string, id long, key long, first long"


def near_copies(rng, text, n, edits):
    for _ in range(n):
        own = list(text)
        for _ in range(edits):
            own[rng.randrange(len(own))] = rng.choice("abcdefgh")
        yield "".join(own)


def corpus(seed=1):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choices("abcdefgh ijklm", k=n))
    texts = []
    for n in (3, 20, 120, 700, 3000):
        for _ in range(6):
            base = letters(n)
            texts += [base, *near_copies(rng, base, 6, max(1, n // 250)), base]
    chain = letters(500)
    for _ in range(12):
        texts.append(chain)
        chain = next(near_copies(rng, chain, 1, 12))
    return texts + ["", "", "x", "y"]


def brute(rows, least):
    prints = sorted({p for _, p in rows})
    keys = {p: set(bands.keys(p)) for p in prints}
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if keys[p] & keys[q] and walks.likeness(p, q) >= least:
                label[find(p)] = find(q)
    first = {}
    for d, p in rows:
        if d is not None:
            first[find(p)] = min(d, first.get(find(p), d))
    return sorted(((d, first.get(find(p))) for d, p in rows), key=str)


def test_classes(spark, monkeypatch):
    monkeypatch.setattr(bands, "BLOCK", 5)
    texts = corpus()
    rows = [*enumerate(walks.fingerprints(texts)), (None, walks.fingerprints([texts[3]])[0]), (None, "only here.z"), (3, "0.1")]
    frame = spark.createDataFrame([(d, p, "x", 1, 2, 3) for d, p in rows], ROWS).select("doc_id", "fingerprint", "id", "key").repartition(3)
    for least in (0.8, 0.5):
        got = bands.classes(frame, least)
        assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == brute(rows, least)
        assert got.columns == ["doc_id", "fingerprint", "id", "key", "class_id"]
    assert bands.classes(frame.limit(0)).collect() == []


def test_one_against_all():
    prints = sorted(set(walks.fingerprints(corpus(3)))) + ["a", "abc.", "zz.zz"]
    laid = bands.Laid(prints)
    for x in range(0, len(prints), 7):
        for least in (0.3, 0.8, walks.likeness(prints[x], prints[x - 3])):
            got = laid.near(x, np.arange(len(prints)), least)
            want = [y for y, q in enumerate(prints) if walks.likeness(prints[x], q) >= least or (y == x and prints[x] in ("", "."))]
            assert set(got) | {x} == set(want) | {x}, (prints[x], least)


def test_pairs_that_meet():
    """Of pairs that are alike by 0.8 nearly all share a band, of unrelated ones none."""
    rng = random.Random(5)
    met = alike = 0
    for n in (30, 300, 2000, 9000):
        for _ in range(40):
            text = "".join(rng.choices("abcdefgh ijklm", k=n))
            p, q = walks.fingerprints([text, next(near_copies(rng, text, 1, max(1, n // 60)))])
            if walks.likeness(p, q) >= 0.8:
                alike += 1
                met += bool(set(bands.keys(p)) & set(bands.keys(q)))
    assert alike > 60 and met >= 0.97 * alike
    others = [set(bands.keys(p)) for p in walks.fingerprints(["".join(rng.choices("abcdefgh ijklm", k=500)) for _ in range(60)])]
    assert not any(a & b for i, a in enumerate(others) for b in others[:i])
