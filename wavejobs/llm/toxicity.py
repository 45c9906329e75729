"""Toxic passages as maximal-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavejobs.llm.common import settle

#: Labelled rows that the word scores and the calibration are fitted on, at most. Above it, those with the smallest hash.
SAMPLE = 20_000
#: Strength of the Dirichlet prior, in words; its shape is the whole corpus's word counts.
PRIOR = 2_000.0
#: Least z of a word's log-odds, and least number of toxic rows it is in.
LEAST_Z, LEAST_ROWS = 3.0, 4
#: Least log-odds: words that are only somewhat more frequent in toxic texts would blur where a passage ends.
LEAST_ODDS = 2.0
#: What every word costs a segment.
DRIFT = 0.08

_TOKEN = re.compile(r"[^\W_]+")


def folds(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)).cast("int")


#: A word without a score of its own has that of its beginning of so many letters, the longer first.
STEMS = (6, 5, 4)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def units(word: str) -> list[str]:
    """The word, and its beginnings, marked, that words with other endings share."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _tokens(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(tokens)

    return run(text)


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a text, in order, in time linear in its hits.

    hits: (position, score) of the words with a positive score; every word, hits
    included, costs drift, so that between two hits the total falls in proportion.
    Each candidate holds the running total left of it and right of it. A new one
    goes back to the last candidate that began lower; if that one also ended
    lower, the two and all between are one segment, which is tried again.
    """
    found: list[tuple[int, int, float, float]] = []
    total, last = 0.0, -1
    for at, gain in hits:
        left = total - drift * (at - last - 1)
        total = right = left + gain - drift
        first, last = at, at
        if right <= left:
            continue
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k -= 1
            if k < 0 or found[k][3] >= right:
                break
            first, left = found[k][0], found[k][2]
            del found[k:]
        found.append((first, at, left, right))
    return [(a, b, right - left) for a, b, left, right in found]


@dataclass
class Model:
    """Word scores, the Gumbel parameters lam and k, and the logistic calibration of the evidence."""

    scores: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -3.0
    slope: float = 0.0
    drift: float = DRIFT
    starts: set | None = None
    info: dict = field(default_factory=dict)

    def gain(self, word: str) -> float | None:
        for unit in units(word):
            if (s := self.scores.get(unit)) is not None:
                return s
        return None

    def found(self, words: list[str]) -> list[tuple[int, int, float]]:
        known = self.scores
        starts = {u[:4] for u in known if u[-1] == "*"} if self.starts is None else self.starts
        self.starts = starts  # the first letters of all scored beginnings tell most words at once
        return segments([(i, s) for i, w in enumerate(words) if (w in known or w[:4] in starts) and (s := self.gain(w)) is not None], self.drift)

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        return len(words), self.found(words)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """The sum over segments of how far each exceeds what a text of n words has by chance: the logarithm of one over its E-value."""
        if not n:
            return 0.0
        chance = math.log(max(self.k * n, 1.0))
        return sum(max(0.0, self.lam * s - chance) for _, _, s in found)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.intercept + self.slope * math.log1p(evidence)))))


def gumbel_rate(gains: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root of sum(p * exp(lam * s)) = 1, for words that cost drift and gain `gains` with probability `shares`."""

    def excess(lam: float) -> float:
        return float(np.sum(shares * np.exp(np.minimum(lam * gains, 700)))) + 1 - float(shares.sum()) - math.exp(min(lam * drift, 700))

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a weak ridge."""
    a = np.column_stack([np.ones_like(x), x])
    w = np.zeros(2)
    ridge = np.diag([1e-4, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows whose fold isn't 0.

    At most `sample` labelled rows are used, chosen by a hash of the id; they
    bound the words that can get a score. Word
    scores come from folds 1 to 3, the calibration from fold 4, so that it
    sees words as new texts have them. The prior's word counts are those of all
    documents. Only the text is a feature. Rows with a null id, label or text
    are left out. Without both labels the model says that nothing is toxic.
    """
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("fold", folds()).where("fold <> 0").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(rows), "doc_id")  # `sample` rows at most
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.min("fold").alias("fold"))  # of an id with several texts one
    chosen = chosen.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("fold").alias("fold"))  # copies are no further evidence
    chosen = settle(chosen.select("toxic", "fold", _tokens(F.col("text")).alias("words")), "labelled")
    counted = chosen.where("fold <> 4").withColumn("row", F.monotonically_increasing_id())
    ends = [F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in STEMS]
    counted = counted.select("toxic", "row", F.explode("words").alias("w")).select("toxic", "row", F.explode(F.array_compact(F.array("w", *ends))).alias("word"))
    per_row = counted.groupBy("row", "toxic", "word").agg(F.count(F.lit(1)).alias("n"))
    seen = per_row.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("rows"),
    )
    sums = chosen.where("fold <> 4").groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.sum(F.size("words")).alias("n")).collect()
    sums = {r.toxic: r.n for r in sums}
    if not sums.get(True) or not sums.get(False):
        return Model({})
    n_bad, n_good = sums[True], sums[False]
    # words worth a look: in the sample clearly more frequent in toxic rows; the prior only takes from that
    rough = F.log((F.col("bad") + 0.5) * n_good / ((F.col("good") + 0.5) * n_bad))
    hopeful = seen.where((F.col("rows") >= LEAST_ROWS) & (rough >= LEAST_ODDS * 0.75) & (rough >= F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5)) * (LEAST_Z * 0.75)))
    hopeful = {r.word: (r.bad, r.good) for r in hopeful.collect()}

    starts = {u[:4] for u in hopeful if u[-1] == "*"}

    def count(batches):
        for part in batches:
            total, own = 0, {}
            for text in part["text"]:
                words = tokens(text)
                total += len(words)
                for w in words:
                    if w in hopeful or w[:4] in starts:
                        for u in units(w):
                            if u in hopeful:
                                own[u] = own.get(u, 0) + 1
            yield pd.DataFrame({"word": [None, *own], "n": [total, *own.values()]})

    corpus = {r.word: r.n for r in docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    everything = max(corpus.get(None, 0), 1)
    scored = []
    for word, (bad, good) in hopeful.items():
        prior = PRIOR * corpus.get(word, 1) / everything + 0.01
        odds = math.log((bad + prior) / (n_bad + PRIOR - bad - prior)) - math.log((good + prior) / (n_good + PRIOR - good - prior))
        z = odds / math.sqrt(1 / (bad + prior) + 1 / (good + prior))
        if z >= LEAST_Z and odds >= LEAST_ODDS:
            scored.append((z, word, odds))
    scored = sorted(scored, reverse=True)
    model = Model({w: s for _, w, s in scored})
    if not scored:
        return model
    gains = np.array([s for _, _, s in scored])
    shares = np.array([corpus.get(w, 1) / everything for _, w, _ in scored])
    model.lam = gumbel_rate(gains, shares, DRIFT)
    drawn = Model(model.scores)

    def find(batches):
        for part in batches:
            rows = [(len(w), [x for _, _, x in drawn.found(list(w))], int(t == 1)) for w, t in zip(part["words"], part["toxic"])]
            yield pd.DataFrame(rows, columns=["n", "scores", "toxic"])

    held = chosen.where("fold = 4").select("words", "toxic").mapInPandas(find, "n int, scores array<double>, toxic int").collect()  # a fifth of `sample` rows at most
    found = [(r.n, [(0, 0, x) for x in r.scores], r.toxic) for r in held]
    clean = [(n, max((s for _, _, s in f), default=0.0)) for n, f, y in found if y != 1 and n]
    if clean:  # the likelihood's maximum for a Gumbel law with known rate
        model.k = len(clean) / sum(n * math.exp(-model.lam * s) for n, s in clean)
    x = np.array([math.log1p(model.evidence(n, f)) for n, f, _ in found])
    y = np.array([1.0 if t == 1 else 0.0 for _, _, t in found])
    if len(set(y)) == 2:
        model.intercept, model.slope = logistic(x, y)
    model.info = {"words": len(scored), "rows": len(held), "top": [(w, round(s, 2)) for _, w, s in scored[:12]]}
    return model


def judged(model: Model) -> Column:
    """A struct of score, evidence, words and passages (first word, last word, score) for the column text."""

    @F.pandas_udf("score double, evidence double, words int, passages array<struct<first:int,last:int,score:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            n, found = model.passages(text)
            evidence = model.evidence(n, found)
            chance = math.log(max(model.k * n, 1.0)) if n else 0.0
            out.append((model.score(evidence), evidence, n, [{"first": a, "last": b, "score": s} for a, b, s in found if model.lam * s > chance]))
        return pd.DataFrame(out, columns=["score", "evidence", "words", "passages"])

    return run(F.col("text"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, words, passages.

    Every whole text is scored. passages are the segments that a text of its
    length isn't expected to have by chance, as word positions. Null and empty
    texts have no words and the score of a text without evidence; a null doc_id
    isn't held out. Repeated rows stay. An empty table gives no rows, and
    without labels of both kinds nothing is toxic. Other columns than doc_id and
    text are not looked at.
    """
    model = fit(docs, labels)
    found = docs.select("doc_id", judged(model).alias("j"))
    return found.select(
        "doc_id",
        F.coalesce(folds() == 0, F.lit(False)).alias("held_out"),
        "j.score",
        F.when(F.col("j.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "j.words",
        "j.passages",
    )
