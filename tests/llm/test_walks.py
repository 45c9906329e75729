"""Fingerprints by edit embedding against a plain walk."""

import hashlib
import random

import numpy as np
import pytest

from wavejobs.llm import walks

DOCS = "doc_id long, text string, lang string, h long, m long, part long"


def plain_walk(text, w):
    """The class at every step: a coin for each step and class says whether the walk goes on."""
    coins = walks.coins().reshape(walks.WALKS, walks.CLASSES, walks.PERIOD)
    out = []
    for c in walks.classes(text).tolist():
        for _ in range(int(coins[w, c, len(out) % walks.PERIOD])):
            out.append(c)
    return out


def plain_fingerprint(text):
    steps, letters = walks.sampled()[0], walks._LETTERS.tobytes().decode()
    every = [plain_walk(text, w) for w in range(walks.WALKS)]
    return ".".join("".join(letters[path[s]] for s in steps.tolist() if s < len(path)) for path in every)


def sample(rng, n, alphabet="abcdefgh ij.klé漢\U0001f600"):
    return "".join(rng.choices(alphabet, k=n))


def test_coins():
    coins = walks.coins().reshape(walks.WALKS, walks.CLASSES, walks.PERIOD)
    assert coins.min() == 1 and (coins[:, :, -1] == 1).all()
    longer = coins[:, :, :-1] > 1
    assert (coins[:, :, 1:][longer] == coins[:, :, :-1][longer] - 1).all()  # it goes on where its coin says so
    assert abs(coins.mean() - 2) < 0.05


@pytest.mark.parametrize("few", [walks.FEW, 3])
def test_fingerprints(few, monkeypatch):
    monkeypatch.setattr(walks, "FEW", few)
    rng = random.Random(1)
    texts = ["", "a", "ab", "abc", "aaaa" * 50, "\U0001f600\ud800x"] + [sample(rng, rng.randrange(1, 4000)) for _ in range(40)]
    assert walks.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_edits_go_on_from_the_walk():
    rng = random.Random(2)
    texts = [sample(rng, rng.choice([0, 1, 2, 3, 5, 30, 500, 3000])) for _ in range(60)]
    cases = [(t, (i + 1) % 60, len(t) // 3) for i, t in enumerate(texts)]
    edited = [t[: len(t) - n] + texts[o][:n] for t, o, n in cases]
    assert walks.edited_fingerprints(cases) == list(zip(map(plain_fingerprint, texts), map(plain_fingerprint, edited)))


def test_likeness_follows_edits():
    rng = random.Random(3)
    for n in (40, 400, 4000, 40_000):
        found = []
        for _ in range(12):
            text, other = sample(rng, n), sample(rng, n)
            few = list(text)
            for at in sorted(rng.sample(range(n), max(1, n // 2000)), reverse=True):
                few[at : at + 1] = rng.choice([[], ["x"], [few[at], "y"]])
            cut = text[: n - n // 3] + other[: n // 3]
            own, *others = walks.fingerprints([text, "".join(few), cut, other])
            found.append([walks.likeness(own, x) for x in (own, *others)])
        same, near, third, far = np.array(found).T
        assert (same == 1).all() and near.mean() > 0.8 and 0.4 < third.min() and third.max() < 0.9 and far.max() < 0.4
    assert walks.likeness(".", ".") == 1 and walks.likeness(".", own) == 0 == walks.likeness(own, ".")


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)


def brute(docs):
    order = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        own, other, following = map(plain_fingerprint, (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other, walks.likeness(own, other), walks.likeness(own, following)))
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [walks.AT_ONCE, 500])
def test_documents(spark, at_once, monkeypatch):
    monkeypatch.setattr(walks, "AT_ONCE", at_once)
    rng = random.Random(4)
    docs = [(rng.randrange(-5, 500) * 3 + k % 3, sample(rng, rng.randrange(0, 900))) for k, _ in enumerate(range(90))]
    docs = list({i: (i, t) for i, t in docs}.values()) + [(2000, None), (2001, ""), (2002, sample(rng, 30_000)), (None, "no id at all")]
    docs += [docs[5]] * 2
    frame = spark.createDataFrame([(i, t, "x", 0, None, 7) for i, t in docs], DOCS).repartition(3)
    assert rows(walks.edit_test(frame)) == brute(docs)


def test_passes(spark, monkeypatch):
    """No pass has the texts of over half the documents in its shuffle."""
    held, settle = [], walks.settle

    def counted(df, name="step", **kw):
        out = settle(df, name, **kw)
        if name == "walked":
            held.append(out.where("fingerprint IS NOT NULL OR side = 'last'").count())
        return out

    monkeypatch.setattr(walks, "settle", counted)
    rng = random.Random(6)
    docs = [(rng.randrange(-(1 << 62), 1 << 62), sample(rng, rng.randrange(0, 60))) for _ in range(300)]
    docs += [(None, "no id"), ((1 << 63) - 1, "the largest id"), (-(1 << 63), "the smallest id")]
    frame = spark.createDataFrame([(i, t, "x", 0, None, 7) for i, t in docs], DOCS).repartition(3)
    assert rows(walks.edit_test(frame)) == brute(docs)
    assert sum(held) == len(docs) and max(held) <= len(docs) / 2


def test_ties(spark):
    docs = [(5, "one text of the id"), (5, "another text of the id"), (None, "x" * 40), (None, "y" * 40), (4, "the last")]
    frame = spark.createDataFrame([(i, t, "x", 0, None, 7) for i, t in docs], DOCS)
    got = rows(walks.edit_test(frame))
    assert len(got) == 5 and got == rows(walks.edit_test(frame.repartition(5)))


@pytest.mark.parametrize("one", [None, 7, -(1 << 63)])
def test_one_id(spark, one):
    """A table of one doc_id can't be cut into ranges."""
    docs = [(one, f"text number {k} " * k) for k in range(12)]
    got = rows(walks.edit_test(spark.createDataFrame([(i, t, "x", 0, None, 7) for i, t in docs], DOCS).repartition(3)))
    assert sorted(r[3] for r in got) == sorted(plain_fingerprint(t) for _, t in docs) and {r[0] for r in got} == {one}


def test_ranges(spark):
    ids = spark.range(10).withColumnRenamed("id", "doc_id")
    assert [d.count() for d in walks.by_ranges(ids, 1)] == [10] and [d.count() for d in walks.by_ranges(ids, 2)] == [5, 5]


def test_small_tables(spark):
    frame = lambda docs: spark.createDataFrame([(i, t, "x", 0, None, 7) for i, t in docs], DOCS)
    assert rows(walks.edit_test(frame([]))) == []
    assert rows(walks.edit_test(frame([(1, "only one here")]))) == brute([(1, "only one here")])
    assert rows(walks.edit_test(frame([(1, None)]))) == brute([(1, None)])
