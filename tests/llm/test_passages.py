"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from wavejobs.llm import passages

DOCS = "doc_id long, text string, lang string, source string, n_chars long, d long, akey string"


def brute(rows, window):
    place = lambda r: (rows[r][0] is None, rows[r][0] or 0)
    words = [t.split() if t else [] for _, t, *_ in rows]
    first = {}
    for r, w in enumerate(words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (place(r), s)), (place(r), s))
    for r, w in enumerate(words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (place(r), s):
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield rows[r][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)]
    shared = [rng.choices(vocabulary, k=rng.randint(15, 90)) for _ in range(12)]
    rows = []
    for d in range(70):
        text = []
        for _ in range(rng.randint(0, 6)):
            part = list(rng.choice(shared)) if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randint(1, 60))
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "other"
            a = rng.randrange(len(part))
            text += part[a:] if rng.random() < 0.3 else part
        rows.append((d, rng.choice((" ", "\n", "  ")).join(text), "en", "s", 0, 1, "clash"))
    rows += [(200, "a b " * 100, "en", "s", 0, 1, ""), (201, "x " * 20, "en", "s", 0, 1, ""), (202, "x " * 19, "en", "s", 0, 1, "")]
    rows += [(203, None, None, None, None, None, None), (204, "", "en", "s", 0, 1, ""), (None, rows[0][1] + " " + rows[1][1], "en", "s", 0, 1, "")]
    rng.shuffle(rows)
    got = [tuple(r) for r in passages.remove(spark.createDataFrame(rows, DOCS).repartition(3), pattern_bytes=700, stream_bytes=1500).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 20), key=repr)


def test_copies_of_a_row_text_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "s", 0, 1, "")] * 2 + [(2, "start " + text + " end", "en", "s", 0, 1, "")]
    got = sorted(tuple(r) for r in passages.remove(spark.createDataFrame(rows, DOCS), text_out=True).select("doc_id", "n_removed", "kept").collect())
    assert got == [(1, 0, text), (1, 0, text), (2, 30, "start end")]
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(0, text, "en", "s", 0, 1, ""), (1, "lead " + text, "en", "s", 0, 1, ""), (1, other + " " + other, "en", "s", 0, 1, "")]  # an id with two texts
    got = sorted(tuple(r) for r in passages.remove(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_words", "n_removed").collect())
    assert got == [(0, 30, 0), (1, 31, 30), (1, 60, 30)]
    assert passages.remove(spark.createDataFrame([], DOCS)).collect() == []


def test_hot_and_wide(spark, monkeypatch):
    """One passage in most documents, anchors with many contexts, null and repeated ids, and the way for places that don't fit the hash."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    hot, stem = rng.choices(words, k=45), rng.choices(words, k=8)
    rows = []
    for d in range(150):
        text = [*rng.choices(words, k=rng.randint(5, 40)), *(hot if d % 3 else stem), *rng.choices(words, k=30)]
        rows.append((d if d % 5 else None if d % 2 else 7, " ".join(text), "en", "s", 0, 1, ""))
    frame = spark.createDataFrame(rows, DOCS)
    ids = [r[0] for r in rows]
    unique = [r for r in rows if ids.count(r[0]) == 1]
    alone = sorted(tuple(r) for r in passages.remove(spark.createDataFrame(unique, DOCS), pattern_bytes=600, stream_bytes=900).collect())
    assert alone == sorted(brute(unique, 20))
    some = sorted((tuple(r) for r in passages.remove(frame, pattern_bytes=600, stream_bytes=900).collect()), key=repr)
    assert len(some) == 150 and some == sorted((tuple(r) for r in passages.remove(frame).collect()), key=repr)
    several = [[w.encode() for w in rng.choices(words[:9], k=k)] for k in (300, 3, 0, 19, 20, 250)]
    ends = np.cumsum([len(x) for x in several])
    h = passages.Hashes(sum(several, []))
    narrow = passages.anchors(h, ends)
    one_by_one = [passages.anchors(passages.Hashes(x), np.array([len(x)])) for x in several]
    assert all((a == np.concatenate([p[i] for p in one_by_one])).all() for i, a in enumerate(narrow) if i != 2)
    assert (narrow[2] == np.concatenate([p[2] + e - len(x) for p, e, x in zip(one_by_one, ends, several)])).all()
    monkeypatch.setattr(passages, "WIDE", 0)
    assert all((a == b).all() for a, b in zip(narrow, passages.anchors(h, ends)))


def test_small_automata_in_a_shard(spark, monkeypatch, tmp_path):
    """The anchors of a shard are dealt to automata of about CACHED_BYTES, and the result is that of a single one."""
    rng = random.Random(9)
    shared = [[f"p{k}w{i}" for i in range(60)] for k in range(40)]
    rows = [(d, " ".join(w for _ in range(4) for w in rng.choice(shared)[rng.randrange(20) :]), "en", "s", 0, 1, "") for d in range(60)]
    made = str(tmp_path)

    class Counted:
        STORE_ANY, KEY_SEQUENCE = passages.ahocorasick.STORE_ANY, passages.ahocorasick.KEY_SEQUENCE

        @staticmethod
        def Automaton(*how):
            import tempfile

            import ahocorasick

            tempfile.mkstemp(dir=made)
            return ahocorasick.Automaton(*how)

    monkeypatch.setattr(passages, "ahocorasick", Counted)
    monkeypatch.setattr(passages, "CACHED_BYTES", 2000, raising=False)
    got = sorted(tuple(r) for r in passages.remove(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted(brute(rows, 20))
    assert len(list(tmp_path.iterdir())) > 10
