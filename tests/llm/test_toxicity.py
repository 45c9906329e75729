"""Toxic passages: maximal segments against brute force, and held-out accuracy."""

import random

from wavejobs.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxic string, fold double"


def brute(scores):
    """The maximal-scoring segments by their recursive definition: the best one, then the best of what is left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    return brute(scores[:i]) + [(i, j, best[0])] + [(a + j + 1, b + j + 1, s) for a, b, s in brute(scores[j + 1 :])]


def test_segments():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 25)
        hits = {i: rng.uniform(0.2, 2.0) for i in range(n) if rng.random() < 0.4}
        got = toxicity.segments(sorted(hits.items()), 0.3)
        want = brute([hits.get(i, 0.0) - 0.3 for i in range(n)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def corpus(n):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 200))
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(("scum", "vile", "badword" + rng.choice("abcdefgh"))) for _ in range(3)]
        yield i, " ".join(text), "en", "s", 0, "clash", 0.5, int(toxic)


def test_held_out(spark):
    rows = list(corpus(1500))
    docs = spark.createDataFrame([r[:7] for r in rows] + [(None, None, None, None, None, None, None), (1501, "", "en", "s", 0, "", 0.0), (1502, "BADWORDZ vile", "en", None, 0, "", 0.0)], DOCS)
    labels = spark.createDataFrame([(r[0], 1, r[7]) for r in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(rows) + 3
    held = [r for r in rows if got[r[0]].held_out]
    assert 200 < len(held) < 400
    assert sum(got[r[0]].predicted == r[7] for r in held) >= 0.98 * len(held)
    assert got[None].predicted == 0 and got[1501].predicted == 0 and not got[None].held_out and got[1501].words == 0
    toxic = next(r for r in rows if r[7] and got[r[0]].predicted)
    first, last, _ = got[toxic[0]].passages[0]
    assert any(w[:3] in ("scu", "vil", "bad") for w in toxic[1].split()[first : last + 1])


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9, "", 0.0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.score(docs, none).collect()] == [0]
    assert toxicity.score(docs.limit(0), none).collect() == []


def plain_scores(docs, labels):
    """Each document's score, by loops over words: log-odds, the rate of chance segments, and a logistic curve fitted by small steps."""
    import math
    import re
    import zlib
    from collections import Counter

    t = toxicity
    words = {i: re.findall(r"[^\W_]+", text.lower()) for i, text in docs}
    units = lambda w: [w, *(w[:n] + "*" for n in (6, 5, 4) if len(w) > n)]
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in words}
    train = [i for i in labels if fold[i] in (1, 2, 3)]
    counts, in_rows, total = {0: Counter(), 1: Counter()}, Counter(), {0: 0, 1: 0}
    for i in train:
        total[labels[i]] += len(words[i])
        own = [u for w in words[i] for u in units(w)]
        counts[labels[i]].update(own)
        if labels[i]:
            in_rows.update(set(own))
    corpus = Counter(u for ws in words.values() for w in ws for u in units(w))
    everything = sum(map(len, words.values()))
    gains = {}
    for u in {*counts[0], *counts[1]}:
        bad, good = counts[1][u], counts[0][u]
        rough = math.log((bad + 0.5) * total[0] / ((good + 0.5) * total[1]))
        prior = t.PRIOR * corpus[u] / everything + 0.01
        odds = math.log((bad + prior) / (total[1] + t.PRIOR - bad - prior)) - math.log((good + prior) / (total[0] + t.PRIOR - good - prior))
        sure = odds / math.sqrt(1 / (bad + prior) + 1 / (good + prior))
        if in_rows[u] >= t.LEAST_ROWS and rough >= 1.5 and rough >= 2.25 * math.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)) and sure >= t.LEAST_Z and odds >= t.LEAST_ODDS:
            gains[u] = odds

    excess = lambda r: sum(corpus[u] / everything * (math.exp(r * g) - 1) for u, g in gains.items()) + 1 - math.exp(r * t.DRIFT)
    low, high = 1e-6, 1.0
    while excess(high) < 0:
        high *= 2
    for _ in range(100):
        low, high = ((low + high) / 2, high) if excess((low + high) / 2) < 0 else (low, (low + high) / 2)
    found = {i: [s for _, _, s in brute([next((gains[u] for u in units(w) if u in gains), 0.0) - t.DRIFT for w in ws])] for i, ws in words.items()}
    last = [i for i in labels if fold[i] == 4]
    clean = [i for i in last if not labels[i] and words[i]]
    k = len(clean) / sum(len(words[i]) * math.exp(-high * max(found[i], default=0.0)) for i in clean)
    evidence = {i: math.log1p(sum(max(0.0, high * s - math.log(max(k * len(words[i]), 1.0))) for s in found[i]) if words[i] else 0.0) for i in words}
    a = b = 0.0
    for _ in range(200):
        p = {i: 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * evidence[i])))) for i in last}
        g = (sum(labels[i] - p[i] for i in last) - 1e-4 * a, sum((labels[i] - p[i]) * evidence[i] for i in last) - 1e-2 * b)
        v = {i: p[i] * (1 - p[i]) for i in last}
        h = (sum(v.values()) + 1e-4, sum(v[i] * evidence[i] for i in last), sum(v[i] * evidence[i] ** 2 for i in last) + 1e-2)
        det = h[0] * h[2] - h[1] ** 2
        a += max(-5.0, min(5.0, (h[2] * g[0] - h[1] * g[1]) / det))
        b += max(-5.0, min(5.0, (h[0] * g[1] - h[1] * g[0]) / det))
    return {i: 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * evidence[i])))) for i in words}


def test_score_by_loops_over_words(spark):
    rows = [(i, " ".join(text.split()[:60])) for i, text, *_ in corpus(400)]
    labels = {i: int(any(w in text for w in ("scum", "vile", "badword"))) for i, text in rows}
    labels = {i: 1 - y if i % 37 == 0 else y for i, y in labels.items()}  # some are wrong, so that the curve isn't a step
    want = plain_scores(rows, labels)
    docs = spark.createDataFrame([(i, text, "en", "s", 0, "", 0.0) for i, text in rows], DOCS)
    got = toxicity.score(docs, spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int"))
    for r in got.collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == int(want[r.doc_id] >= 0.5)
    assert 0.05 < sum(y > 0.5 for y in want.values()) / len(want) < 0.5
