"""Substring dedup: repeated passages, confirmed across documents, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavejobs.llm.common import discard, settle, words_of

WINDOW = 20
#: Words of an anchor: each window is known by the anchor of the least hash in it.
ANCHOR = 6
#: UTF-8 bytes of patterns in one automaton, and of passages that one task streams through it.
PATTERN_BYTES = 4 << 20
STREAM_BYTES = 16 << 20
#: UTF-8 bytes of patterns that a core's cache holds as an automaton: a shard of several anchors has one for about so many.
CACHED_BYTES = 64 << 10
#: Words from which an anchor's place in a text no longer fits the low bits of its hash.
WIDE = 1 << 24
#: Stands for a null doc_id in the order of documents: after all others.
_LAST = (1 << 63) - 1

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2**64


class Hashes:
    """Hashes of runs of words, from prefix sums of word hashes times powers of a base modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: list[bytes]) -> None:
        self.n = len(words)
        self.values = np.fromiter([xxhash.xxh64_intdigest(w, 7) for w in words], np.uint64, len(words))
        self.sums = [self._prefix(b) for b in range(len(_BASES))]

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 12)
            out = []
            for b in (_BASES[base], pow(_BASES[base], -1, 1 << 64)):
                p = np.empty(size, np.uint64)
                p[0] = 1
                filled = 1
                while filled < size:  # doubling
                    step = min(filled, size - filled)
                    p[filled : filled + step] = p[:step] * np.uint64(pow(b, filled, 1 << 64))
                    filled += step
                out.append(p)
            have = cls._powers[base] = tuple(out)
        return have

    def _prefix(self, base: int) -> np.ndarray:
        p, _ = self.powers(base, self.n + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values * p[: self.n], dtype=np.uint64)])

    def runs(self, start: np.ndarray, stop: np.ndarray, base: int = 0) -> np.ndarray:
        """The hashes of words[start:stop]."""
        _, inverse = self.powers(base, self.n + 1)
        return _mix((self.sums[base][stop] - self.sums[base][start]) * inverse[start] + (stop - start).astype(np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def anchors(h: Hashes, ends: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, start, count) of the maximal runs of windows start, ..., start + count - 1 that share their least anchor.

    h holds the words of several texts, one after the other; ends says where
    each ends. Windows and anchors lie within one text. key is the anchor's hash,
    context that of all the words of the run's windows. Which anchor a window has
    depends on its words only: the least hash by its upper 40 bits, the leftmost
    of equals.
    """
    n = h.n - window + 1
    if n < 1:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    at = np.arange(h.n - size + 1)
    keys = h.runs(at, at + size)
    width = window - size + 1
    if h.n < WIDE:
        low = (keys & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
        have = 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        least = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    else:
        parts = [np.lib.stride_tricks.sliding_window_view(keys[a : a + (1 << 20) + width - 1] >> np.uint64(24), width).argmin(1) + np.arange(a, min(a + (1 << 20), n)) for a in range(0, n, 1 << 20)]
        least = np.concatenate(parts)
    text = np.searchsorted(ends, np.arange(n), "right")
    inside = np.flatnonzero(np.arange(n) + window <= ends[np.minimum(text, len(ends) - 1)])
    if not len(inside):
        return keys[:0], keys[:0], inside, inside
    same = (least[inside[1:]] == least[inside[:-1]]) & (text[inside[1:]] == text[inside[:-1]])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    start, count = inside[first], np.diff(np.append(first, len(inside)))
    return keys[least[start]], h.runs(start, start + count - 1 + window, 1), start, count


_ANCHORS = "akey long, ctx long, d long, t long, start int, count int"


def _together(texts: Iterator[tuple], most: int = 100_000) -> Iterator[tuple[list[tuple], list[bytes], np.ndarray]]:
    """Rows (text first), the words of their texts one after the other, and where each text ends, some at a time."""
    rows, words, ends = [], [], []
    for row in texts:
        rows.append(row)
        words += words_of(row[0])
        ends.append(len(words))
        if len(words) > most:
            yield rows, words, np.array(ends, np.int64)
            rows, words, ends = [], [], []
    if rows:
        yield rows, words, np.array(ends, np.int64)


def _rows_of(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    for part in batches:
        yield from zip(*(part[n] for n in names))


def find_anchors(docs: DataFrame, window: int) -> DataFrame:
    """_ANCHORS: the runs of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, words, ends in _together(_rows_of(batches, ["text", "d", "t"])):
            akey, ctx, start, count = anchors(Hashes(words), ends, window)
            which = np.searchsorted(ends, start, "right")
            d, t = (np.array([r[i] for r in rows], np.int64)[which] for i in (1, 2))
            start = start - np.concatenate([[0], ends])[which]
            yield pd.DataFrame({"akey": akey.view(np.int64), "ctx": ctx.view(np.int64), "d": d, "t": t, "start": start.astype(np.int32), "count": count.astype(np.int32)})

    return docs.select("d", "t", "text").mapInPandas(run, _ANCHORS)


def cut_texts(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """akey, ctx, d, start, c, text: the words of each distinct run, from where it starts first."""
    asked = runs.groupBy("d", "t").agg(F.collect_list(F.struct("akey", "ctx", "start", "count", "c")).alias("runs"))

    names = ["akey", "ctx", "d", "start", "c", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for part in batches:
            for d, text, wanted in zip(part["d"], part["text"], part["runs"]):
                words = words_of(text)
                for r in wanted:
                    rows.append((r["akey"], r["ctx"], d, r["start"], r["c"], b" ".join(words[r["start"] : r["start"] + r["count"] - 1 + window]).decode("utf-8", "surrogatepass")))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return docs.join(asked, ["d", "t"]).dropDuplicates(["d", "t"]).select("d", "text", "runs").mapInPandas(run, "akey long, ctx long, d long, start int, c long, text string")


def find_windows(texts: DataFrame, window: int) -> DataFrame:
    """akey, ctx, d, s, o, w1, w2: every window of the runs, with its place in the document and in the run, and two hashes."""
    kept = ["akey", "ctx", "d", "start"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, words, ends in _together(_rows_of(batches, ["text", *kept])):
            begins = np.concatenate([[0], ends[:-1]])
            many = np.maximum(ends - begins - window + 1, 0)
            which = np.repeat(np.arange(len(rows)), many)
            o = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            at, h = begins[which] + o, Hashes(words)
            akey, ctx, d, start = (np.array([r[i] for r in rows], np.int64)[which] for i in range(1, 5))
            hashes = [h.runs(at, at + window, b).view(np.int64) for b in (0, 1)]
            yield pd.DataFrame({"akey": akey, "ctx": ctx, "d": d, "s": (start + o).astype(np.int32), "o": o.astype(np.int32), "w1": hashes[0], "w2": hashes[1]})

    return texts.select(*kept, "text").mapInPandas(run, "akey long, ctx long, d long, s int, o int, w1 long, w2 long")


def confirmed(texts: DataFrame, window: int) -> DataFrame:
    """The patterns: runs that recur whole (c over 1), and in offsets the windows of a run that start first there and recur in other runs."""
    several = settle(texts.groupBy("akey").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1").select("akey"), "several")
    windows = find_windows(texts.join(several, "akey"), window)
    firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("d", "s", "akey", "ctx", "o")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    single = firsts.groupBy("first.akey", "first.ctx").agg(F.collect_set("first.o").alias("offsets"))
    return texts.join(settle(single, "single"), ["akey", "ctx"], "left").where("c > 1 OR offsets IS NOT NULL")


def symbols(ids: list[int] | np.ndarray) -> tuple:
    """Two symbols a word, from two alphabets: nodes of the automaton have few children, and matches begin at words."""
    a = np.asarray(ids, np.int64)
    out = np.empty(2 * len(a), np.int64)
    out[::2], out[1::2] = a >> 8, (a & 255) + (1 << 24)
    return tuple(out.tolist())


def located(texts: DataFrame, patterns: DataFrame, window: int, pattern_bytes: int = PATTERN_BYTES, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """akey, ctx and found (o, first_d, first_s): for each run the windows that an automaton has found in it, and where they start first.

    Runs and patterns are dealt into shards by their anchor. An anchor with more
    patterns than one automaton is meant to hold has several, which all of its
    runs go to; one with more runs than one task is meant to stream has several
    tasks, which all have its patterns.
    """
    bytes_ = lambda df: df.groupBy("akey").agg(F.sum(F.octet_length("text")).alias("n"))
    sizes = bytes_(patterns).withColumnRenamed("n", "own").join(bytes_(texts), "akey")
    sizes = settle(sizes.select("akey", F.ceil(F.col("own") / pattern_bytes).cast("int").alias("parts"), F.ceil(F.col("n") / stream_bytes).cast("int").alias("salts"), "own", "n"), "sizes")
    total = sizes.where("parts = 1 AND salts = 1").agg(F.greatest(F.sum("own") / pattern_bytes, F.sum("n") / stream_bytes)).first()[0]
    shards = max(1, math.ceil(total or 0))
    small = (F.col("parts") == 1) & (F.col("salts") == 1)
    shard = F.when(small, F.pmod(F.xxhash64("akey"), F.lit(shards))).otherwise(F.xxhash64("akey", "part", "salt")).alias("shard")
    dealt = lambda n: F.pmod(F.xxhash64("ctx", F.lit("deal")), F.col(n)).cast("int").alias(n[:-1])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:-1])
    several = sizes.select("akey", "parts", "salts")
    mine = texts.join(several, "akey").select("*", dealt("salts")).select("*", every("parts")).select(shard, "akey", "ctx", "text", F.col("parts"))
    known = patterns.join(several, "akey").select("*", dealt("parts")).select("*", every("salts")).select(shard, "akey", "d", "start", "c", "offsets", "text")

    nothing = pd.DataFrame({"akey": np.zeros(0, np.int64), "ctx": np.zeros(0, np.int64), "whole": np.zeros(0, bool), "o": [], "first_d": [], "first_s": []}).astype({c: object for c in ("o", "first_d", "first_s")})

    def stream(mine: pd.DataFrame, known: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """What scan() finds, by groups of anchors: runs of different anchors have no window in common."""
        groups = max(1, sum(map(len, known["text"])) // CACHED_BYTES)
        by_anchor = lambda df: dict(list(df.groupby(df["akey"].to_numpy(np.int64).view(np.uint64) % np.uint64(groups))))
        runs = by_anchor(mine)
        for group, some in by_anchor(known).items():
            if group in runs:
                yield from scan(runs[group], some)

    def scan(mine: pd.DataFrame, known: pd.DataFrame) -> Iterator[pd.DataFrame]:
        numbers: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        latest: dict[tuple, int] = {}
        firsts: list[tuple[int, int, int]] = []  # of each pattern: its length in words, and where it starts first

        def add(words: tuple, d: int, s: int) -> None:
            old = latest.get(words)
            if old is None or (d, s) < firsts[old][1:]:
                latest[words] = len(firsts)
                automaton.add_word(words, len(firsts))
                firsts.append((len(words) // 2, d, s))

        for rows, words, ends in _together(_rows_of([known], ["text", "d", "start", "c", "offsets"])):
            ids = symbols([numbers.setdefault(w, len(numbers)) for w in words])
            for (_, d, start, c, offsets), a, b in zip(rows, [0, *ends.tolist()], ends.tolist()):
                if c > 1:
                    add(ids[2 * a : 2 * b], d, start)
                for o in offsets if offsets is not None else ():
                    add(ids[2 * (a + o) : 2 * (a + o + window)], d, start + int(o))
        if not firsts:
            return
        automaton.make_automaton()
        length, first_d, first_s = (np.array(x, np.int64) for x in zip(*firsts))
        for rows, words, ends in _together(_rows_of([mine], ["text", "akey", "ctx", "parts"])):
            ids = np.array([numbers.get(w, 0xFFFFFF) for w in words], np.int64)
            ids = np.insert(ids, ends, 0xFFFFFF)  # no pattern reaches from one run into the next
            met = list(automaton.iter(symbols(ids)))
            if not met:
                continue
            end, k = (np.array(x, np.int64) for x in zip(*met))
            at = end // 2 - length[k] + 1
            many = length[k] - window + 1  # a pattern's windows
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at, k = np.repeat(at, many) + step, np.repeat(k, many)
            begins = np.concatenate([[0], ends[:-1]]) + np.arange(len(ends))
            which = np.searchsorted(begins, at, "right") - 1
            d, s = first_d[k], first_s[k] + step
            o = at - begins[which]
            order = np.lexsort((s, d, o, which))
            which, o, d, s = which[order], o[order], d[order], s[order]
            new = np.concatenate([[True], (which[1:] != which[:-1]) | (o[1:] != o[:-1])])
            which, o, d, s = which[new], o[new], d[new], s[new]
            cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            own = which[cuts].tolist()
            parts = [np.split(x, cuts[1:]) for x in (o, d, s)]
            yield pd.DataFrame({"akey": [rows[i][1] for i in own], "ctx": [rows[i][2] for i in own], "whole": [rows[i][3] == 1 for i in own], "o": parts[0], "first_d": parts[1], "first_s": parts[2]})

    found = settle(mine.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(lambda m, k: pd.concat([*stream(m, k), nothing]), "akey long, ctx long, whole boolean, o array<int>, first_d array<long>, first_s array<int>"), "found")
    zipped = found.select("akey", "ctx", "whole", F.arrays_zip("o", "first_d", "first_s").alias("found"))
    # what several automata have found in one run is put together
    pairs = zipped.where("NOT whole").select("akey", "ctx", F.explode("found").alias("x")).groupBy("akey", "ctx", "x.o").agg(F.min(F.struct("x.first_d", "x.first_s")).alias("first"))
    more = pairs.groupBy("akey", "ctx").agg(F.collect_list(F.struct("o", "first.first_d", "first.first_s")).alias("found"))
    return zipped.where("whole").select("akey", "ctx", "found").union(more)


def remove(docs: DataFrame, window: int = WINDOW, text_out: bool = False, pattern_bytes: int = PATTERN_BYTES, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with text_out, kept (the kept words).

    A word goes if a window of `window` words that covers it also starts earlier:
    in a document with a smaller doc_id, or earlier in the same one; windows are
    judged on the input.

    Texts are cut into runs of windows that share their least anchor. Runs whose
    anchor recurs are looked at further. Equal runs, by 128 bits of hashes of
    their words, are one; so copies of any number are streamed once, and what is
    found in a run holds wherever it stands. Passages that recur, whole runs and
    windows that several runs share, are compiled into Aho-Corasick automata
    with the place where they start first, and all runs are streamed through the
    automata of their anchor. There words, not hashes, decide which of a run's
    windows are repeated.

    A null text has no words. Very long texts are cut whole. A null doc_id comes
    after all others. Rows that share a doc_id are one document to the order:
    copies of a whole row don't remove each other. An empty table gives no rows.
    Columns other than doc_id and text aren't looked at.
    """
    if window - ANCHOR + 1 > 62 or window < ANCHOR:
        raise ValueError("a run's windows have to fit into the bits of a long")
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t"), "text")
    found = settle(find_anchors(docs, window), "anchors", dictionary=False)
    # the few keys are written first: only then can Spark split a hot key's rows in the join
    keys = settle(found.groupBy("akey").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("akey"), "keys")
    recurring = settle(found.join(keys, "akey"), "recurring", dictionary=False)
    discard(found, keys)
    runs = recurring.groupBy("akey", "ctx").agg(F.min(F.struct("d", "start", "t", "count")).alias("first"), F.count(F.lit(1)).alias("c")).select("akey", "ctx", "first.*", "c")
    texts = settle(cut_texts(docs, settle(runs, "runs"), window), "texts")
    patterns = settle(confirmed(texts, window), "patterns")
    marks = settle(located(texts, patterns, window, pattern_bytes, stream_bytes), "marks")
    discard(texts, patterns)

    earlier = lambda x: (x["first_d"] < F.col("d")) | ((x["first_d"] == F.col("d")) & (x["first_s"] < F.col("start") + x["o"]))
    bits = F.aggregate(F.filter("found", earlier), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["o"])))
    gone = recurring.join(marks, ["akey", "ctx"]).select("d", "t", "start", bits.alias("bits")).where("bits <> 0")
    gone = settle(gone.groupBy("d", "t").agg(F.collect_set(F.struct("start", "bits")).alias("gone")), "gone")
    discard(recurring, marks)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for doc, text, where in zip(part["doc_id"], part["text"], part["gone"]):
                words = words_of(text)
                cover = np.zeros(len(words) + 1, np.int32)
                for r in where if where is not None else ():
                    for o in range(r["bits"].bit_length()):
                        if r["bits"] >> o & 1:
                            cover[r["start"] + o] += 1
                            cover[r["start"] + o + window] -= 1
                left = np.cumsum(cover[:-1]) == 0
                kept = b" ".join(words if left.all() else [w for w, k in zip(words, left.tolist()) if k])
                out.append((doc, len(words), int((~left).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if text_out else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})[names]

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if text_out else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.join(gone, ["d", "t"], "left").select("doc_id", "text", "gone").mapInPandas(cut, schema)
