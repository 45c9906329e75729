"""Document fingerprints by randomised edit embedding: shared random walks over a text's characters, sampled at shared steps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavejobs.llm.common import let_go, settle

#: Independent walks, and steps that each is sampled at between one power of two and the next.
WALKS = 2
SAMPLES = 32
SEED = 20
#: Classes of characters, written as one letter each, and steps after which a walk's coins repeat.
CLASSES = 64
PERIOD = 1024
_LETTERS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+-", np.uint8)
#: Characters that are walked at once; below so many walks at once, each goes by itself.
AT_ONCE = 6 << 20
FEW = 64
#: Passes over the table; the shuffle of one pass holds the texts of one range of doc_ids.
PASSES = 3


@lru_cache
def coins(walks: int = WALKS) -> np.ndarray:
    """For walk, class and step (modulo PERIOD), as one flat array: for how many steps a character of the class stays."""
    toss = np.random.default_rng(SEED).random((walks, CLASSES, 2 * PERIOD)) < 0.5
    toss[:, :, PERIOD:] = toss[:, :, :PERIOD]
    toss[:, :, PERIOD - 1 :: PERIOD] = True  # so that none stays for ever
    step = np.where(toss, np.arange(2 * PERIOD), 2 * PERIOD)
    ahead = np.minimum.accumulate(step[:, :, ::-1], axis=2)[:, :, ::-1]
    return (ahead - np.arange(2 * PERIOD) + 1)[:, :, :PERIOD].astype(np.int32).ravel()


@lru_cache
def sampled(octaves: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps in order, and how many steps each stands for: all of the first, then SAMPLES between powers of two."""
    rng, steps, weights = np.random.default_rng(SEED + 1), [np.arange(2 * SAMPLES)], [np.ones(2 * SAMPLES)]
    low = 2 * SAMPLES
    while low < 1 << octaves:
        width = low // SAMPLES  # one step from each of SAMPLES equal parts
        steps.append(low + np.arange(SAMPLES) * width + rng.integers(0, width, SAMPLES))
        weights.append(np.full(SAMPLES, float(width)))
        low *= 2
    return np.concatenate(steps), np.concatenate(weights)


def classes(text: str) -> np.ndarray:
    """A class of 0 to CLASSES - 1 for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (points * np.uint32(0x9E3779B1) >> np.uint32(26)).astype(np.uint8)


def walk(chars: list[np.ndarray], tables: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """For each sequence of classes, the step at which the walk leaves each of its characters; tables says which walk's coins it follows.

    All sequences take a character at a time, the longest first, so that those
    still going are a prefix. When few are left, each goes by itself.
    """
    n = np.array([len(c) for c in chars], np.int64)
    order = np.argsort(-n, kind="stable")
    n, coin, mask = n[order], coins(int(tables.max()) + 1 if len(tables) else 1), PERIOD - 1
    flat = np.concatenate([chars[i] for i in order] or [np.zeros(0, np.uint8)]).astype(np.int32) * PERIOD
    start = np.cumsum(n) - n
    base, j, left = tables[order].astype(np.int32) * (CLASSES * PERIOD), begin[order].astype(np.int64), np.empty(len(flat), np.int64)
    rows = int(n[FEW]) if len(n) > FEW else 0
    going = np.searchsorted(-n, -np.arange(rows), side="left")  # sequences longer than the row
    at = start.copy()
    for k in going.tolist():
        place, step = at[:k], j[:k]
        step += coin[flat[place] + base[:k] + (step & mask)]
        left[place] = step
        place += 1
    for i in range(min(len(n), FEW)):
        step, table = int(j[i]), coin[base[i] : base[i] + CLASSES * PERIOD].tolist()
        out = []
        for c in flat[start[i] + rows : start[i] + n[i]].tolist():
            step += table[c + (step & mask)]
            out.append(step)
        left[start[i] + rows : start[i] + n[i]] = out
    found: list = [None] * len(n)
    for k, i in enumerate(order.tolist()):
        found[i] = left[start[k] : start[k] + n[k]]
    return found


def symbols(left: np.ndarray, chars: np.ndarray, begin: int = 0) -> np.ndarray:
    """The letters at the sampled steps from `begin` until the walk's end."""
    steps = sampled()[0]
    a, b = np.searchsorted(steps, [begin, left[-1] if len(left) else begin])
    return _LETTERS[chars[np.searchsorted(left, steps[a:b], side="right")]]


def likeness(x: str, y: str) -> float:
    """How alike two fingerprints are, 0 to 1: of the walk that agrees most, the share of steps that agree beyond chance."""
    if x == y:
        return 1.0
    weights, best = sampled()[1], 0.0
    for p, q in zip(x.split("."), y.split(".")):
        p, q = np.frombuffer(p.encode(), np.uint8), np.frombuffer(q.encode(), np.uint8)
        n, most = min(len(p), len(q)), max(len(p), len(q))
        if not n:
            continue
        share = weights[:n][p[:n] == q[:n]].sum() / weights[:most].sum()
        chance = float(np.bincount(p, minlength=128) @ np.bincount(q, minlength=128)) / (len(p) * len(q))
        best = max(best, (share - chance) / (1 - chance) if chance < 1 else share)
    return float(best)


def fingerprints(texts: list[str], walks: int = WALKS) -> list[str]:
    """The fingerprint of each text: for each walk, the letters at the sampled steps."""
    return [x for x, _ in edited_fingerprints([(t, None, 0) for t in texts], walks)]


def edited_fingerprints(cases: list[tuple[str, int | None, int]], walks: int = WALKS) -> list[tuple[str, str]]:
    """For (text, other, n): the fingerprints of text, and of text with its last n characters replaced by the first n of cases[other].

    The walk over the edited text goes on from where the walk over the text
    reaches the edit.
    """
    chars = [classes(t) for t, _, _ in cases]
    each = [(i, w) for i in range(len(cases)) for w in range(walks)]
    table = np.array([w for _, w in each], np.int64)
    left = walk([chars[i] for i, _ in each], table, np.zeros(len(each), np.int64))
    tails, begin, where = [], [], []
    for k, (i, _) in enumerate(each):
        _, other, n = cases[i]
        if other is not None and n:
            keep = len(chars[i]) - n
            tails.append(chars[other][:n])
            begin.append(int(left[k][keep - 1]) if keep else 0)
            where.append(k)
    more = dict(zip(where, zip(begin, tails, walk(tails, table[where], np.array(begin, np.int64)))))
    out = []
    for i in range(len(cases)):
        own, edited = [], []
        for w in range(walks):
            k = i * walks + w
            own.append(symbols(left[k], chars[i]))
            if k in more:
                at, tail, steps = more[k]
                edited.append(np.concatenate([own[-1][: np.searchsorted(sampled()[0], at)], symbols(steps, tail, at)]))
            else:
                edited.append(own[-1])
        out.append(tuple(b".".join(x.tobytes() for x in side).decode() for side in (own, edited)))
    return out


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(ids: list, texts: list[str], count: int) -> list[tuple]:
    """The rows of the first `count` texts, each of which has its next one behind it; the last text's fingerprint is made as well."""
    cases = [(t, i + 1 if i < count else None, len(t) // 3) for i, t in enumerate(texts)]
    found = edited_fingerprints(cases)
    rows = []
    for i in range(count):
        t, n = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - n] + texts[i + 1][:n]
        own, other = found[i]
        rows.append((ids[i], len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, found[i + 1][0])))
    return rows


def _batch(rows: list[tuple], extra: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in _ROW.split(", ")] + ["part", "side", "text"]
    every = [(*r, None, None, None) for r in rows] + extra
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in every], k) for c, k in enumerate(kinds)], names=names)


def by_ranges(docs: DataFrame, passes: int) -> list[DataFrame]:
    """docs cut into about equal ranges of doc_id by descending doc_id, nulls in the last; rows of one doc_id stay together."""
    cuts = docs.approxQuantile("doc_id", [k / passes for k in range(1, passes)], 0.01) if passes > 1 else []
    cuts = sorted({max(-(1 << 63), min(int(x), (1 << 63) - 1)) for x in cuts}, reverse=True)
    out, rest = [], F.lit(True)
    for x in cuts:
        out.append(docs.where(rest & (F.col("doc_id") > x)))
        rest = (F.col("doc_id") <= x) | F.col("doc_id").isNull()
    return [*out, docs.where(rest)]


def edit_test(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of its characters replaced by the first
    as many of the next document's, by descending doc_id; the first follows the
    last. near_edited and near_next say how like the document's fingerprint is to
    the edited text's and the next document's.

    Null texts are empty, and empty ones have fingerprints that are like each
    other. Null doc_ids come last; repeated ids go by the hash of their text,
    equal rows in any order, which gives the same rows. One document is its own
    next. An empty table gives no rows; other columns aren't looked at. Texts
    are read whole, and a task holds AT_ONCE characters or one text.

    Documents are dealt by ranges of doc_id and walked in order; the first and
    last one of each range are matched afterwards. The table is read PASSES
    times, so that the texts needn't all be in shuffle files at once.
    """
    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("m")]
    def walked_in(turn: int, rows: DataFrame) -> DataFrame:
        keyed = rows.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("m"))
        dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = (turn << 32) + TaskContext.get().partitionId()
            ids, texts, held = [], [], 0
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    t = t.as_py()
                    if not ids:
                        yield _batch([], [(None,) * 7 + (part, "first", t)])
                    ids.append(i)
                    texts.append(t)
                    held += len(t)
                    if held > AT_ONCE and len(ids) > 1:
                        yield _batch(_judged(ids, texts, len(ids) - 1), [])
                        ids, texts, held = ids[-1:], texts[-1:], len(t)
            if ids:
                yield _batch(_judged(ids, texts, len(ids) - 1), [(ids[-1],) + (None,) * 6 + (part, "last", texts[-1])])

        out = settle(dealt.mapInArrow(run, f"{_ROW}, part long, side string, text string"), "walked", dictionary=False, codec="zstd")
        let_go(out.sparkSession)  # before the next pass fills the disk
        return out

    walked = reduce(DataFrame.union, [walked_in(k, rows) for k, rows in enumerate(by_ranges(docs, PASSES))])
    first = walked.where("side = 'first'").select("part", F.col("text").alias("next_text"))
    follows = Window.orderBy("part")  # a row for each range
    parts = first.select("part", F.coalesce(F.lead("part").over(follows), F.first("part").over(follows)).alias("next"))
    edges = walked.where("side = 'last'").select("part", "doc_id", "text").join(parts, "part").join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(_judged([row["doc_id"]], [row["text"], row["next_text"]], 1), [])

    closed = edges.mapInArrow(close, f"{_ROW}, part long, side string, text string")
    return walked.where("side IS NULL").union(closed).drop("part", "side", "text")
