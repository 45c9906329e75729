"""Alignment of two tokenizers' tokens, by divide and conquer at shared token ends."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavejobs.llm.common import discard, settle

#: Intervals of up to so many tokens are looked at end by end; of longer ones so many ends about the middle are.
NEAR = 32
#: Bytes of text that are aligned at once. A longer text is on its own.
AT_ONCE = 2 << 20
#: Segments whose tokens a worker keeps.
KEPT = 200_000
#: Pair counts are broadcast up to so many rows of some 40 bytes; more are joined by a shuffle.
BROADCAST_ROWS = 3_000_000
#: How byte-level vocabularies cut a text before merging (a fixed value of these vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_files() -> tuple[str, str]:
    """The files of the two public vocabularies that the query aligns."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """A byte-level BPE vocabulary (tokenizers JSON). Its special tokens' strings are ordinary text."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(data)
        self.whole = Tokenizer.from_str(data.decode())
        self.whole.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        names = self.whole.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(names.values()) + 1)
        special = {x["id"] for x in spec["added_tokens"]}
        for name, i in names.items():
            self.bytes[i] = name.encode() if i in special else bytes(byte[c] for c in name)
        self.quick = self._ranked(spec, special)

    def _ranked(self, spec: dict, special: set[int]):
        """The same vocabulary for a faster library, if ids are in the order of merges and nothing else is done to texts."""
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        halves = (m.split(" ") if isinstance(m, str) else m for m in merges)
        cuts = spec["pre_tokenizer"] or {}
        same = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space") and spec["normalizer"] is None and spec["post_processor"] is None
        if not same or any(vocab["".join(h)] != 256 + k for k, h in enumerate(halves)):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if i not in special}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self.quick is not None:
            try:
                return self.quick.encode_ordinary(text)
            except BaseException as e:  # the faster library panics on very long runs of white space
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece vocabulary, which puts a space before a text by itself."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        # Without pieces that go on after a space, what lies between spaces is merged by itself and can be kept.
        self.apart = not any("▁" in x.lstrip("▁") for x in names) and [names[i] for i in model.encode(" ")] == ["▁▁"] and "▁" in names
        self.space = [names.index("▁")] if self.apart else []
        self.kept: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.apart:
            return self.model.encode(texts, num_threads=1)
        out, kept = [], self.kept
        for t in texts:
            if len(kept) > KEPT:
                kept.clear()
            if "▁" in t:  # it stands for a space in pieces
                out.append(self.model.encode(t))
                continue
            parts = re.findall(" +[^ ]*", " " + t) if t else []
            new = list({p for p in parts if p not in kept})
            for p, ids in zip(new, self.model.encode([p[1:] for p in new], num_threads=1)):
                kept[p] = ids if p != " " else self.space
            ids: list[int] = []
            for p in parts:
                ids += kept[p]
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def loaded(data: bytes) -> ByteLevel | Pieces:
    return ByteLevel(data) if data.lstrip()[:1] == b"{" else Pieces(data)


def held_by(ends: np.ndarray, others: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """For each token end: the number of the other side's token that holds the byte before it, and whether that ends there too.

    Both arrays rise and have their last end in common. An interval between
    shared ends is halved at a shared end near its middle, found by bisection;
    a short one, or one that shares no end about its middle, is looked up end
    by end, which cuts it into its leaves.
    """
    holder, shared = np.empty(len(ends), np.int64), np.zeros(len(ends), bool)
    around = np.arange(near) - near // 2
    around = around[np.argsort(np.abs(around), kind="stable")]
    low, high = np.array([0]), np.array([len(ends)])
    while len(low):
        long_ = high - low > 2 * near
        middle = (low[long_] + high[long_]) // 2
        tried = middle[:, None] + around
        hit = others[np.searchsorted(others, ends[tried])] == ends[tried]
        halved = hit.any(axis=1)
        cut = tried[np.flatnonzero(halved), hit[halved].argmax(axis=1)] + 1
        leaf = ~long_
        leaf[np.flatnonzero(long_)[~halved]] = True
        n = (high - low)[leaf]
        at = np.arange(n.sum()) + np.repeat(low[leaf] - (np.cumsum(n) - n), n)
        holder[at] = np.searchsorted(others, ends[at])
        shared[at] = others[holder[at]] == ends[at]
        low, high = low[~leaf], high[~leaf]
        low, high = np.concatenate([low, cut]), np.concatenate([cut, high])
    return holder, shared


class Aligned:
    """The alignment of some texts, laid end to end. Texts that a vocabulary doesn't give back byte for byte have no tokens."""

    def __init__(self, texts: list[str | None], a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> None:
        full = [i for i, t in enumerate(texts) if t]
        given = [texts[i] for i in full]
        pairs = {}
        for i, t, x, y in zip(full, given, a.encode(given), b.encode(given)):
            want = b" " + t.encode("utf-8", "surrogatepass")
            if b"".join(map(a.bytes.__getitem__, x)) == want == b"".join(map(b.bytes.__getitem__, y)):
                pairs[i] = x, y
        self.whole = list(pairs)
        self.a, self.b = (np.concatenate([np.array(p[k], np.int64) for p in pairs.values()] or [np.zeros(0, np.int64)]) for k in (0, 1))
        self.to_a, self.to_b = (np.cumsum([0] + [len(p[k]) for p in pairs.values()]) for k in (0, 1))
        ends = np.cumsum(_lengths(a)[self.a]) if len(self.a) else self.a
        others = np.cumsum(_lengths(b)[self.b]) if len(self.b) else self.b
        self.ends = ends
        self.holder, self.shared = held_by(ends, others) if len(ends) else (ends, ends.astype(bool))
        first = np.zeros_like(self.holder)  # the first token of b that each token of a overlaps
        first[1:] = self.holder[:-1] + self.shared[:-1]
        self.overlaps = self.holder - first + 1
        self.first = first

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """All overlapping pairs of occurrences, as positions in a and b."""
        n = self.overlaps
        return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(self.first - (np.cumsum(n) - n), n)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per token of a over each text."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.to_a])

    def written(self, names: np.ndarray, a_size: int) -> list[bytes]:
        """Each text's groups, `a1,a2|b1;a3|b2,b3`; names has what to write for an id, before the last of its side of a group and there."""
        last_b = np.zeros(len(self.b), bool)
        last_b[self.holder[self.shared]] = True
        group_a, group_b = np.cumsum(self.shared) - self.shared, np.cumsum(last_b) - last_b
        end_a, end_b = np.flatnonzero(self.shared) + 1, self.holder[self.shared] + 1
        start_b = np.concatenate([[0], end_b[:-1]]) if len(end_b) else end_b
        line = np.empty(len(self.a) + len(self.b), np.int64)
        if len(line):
            line[np.arange(len(self.a)) + start_b[group_a]] = 2 * self.a + self.shared
            line[np.arange(len(self.b)) + end_a[group_b]] = 2 * (a_size + self.b) + last_b
        cuts = self.to_a + self.to_b
        return [b"".join(names[line[i:j]].tolist())[:-1] for i, j in zip(cuts, cuts[1:])]


def _lengths(v: ByteLevel | Pieces) -> np.ndarray:
    if not hasattr(v, "lengths"):
        v.lengths = np.array([len(x) for x in v.bytes], np.int64)
    return v.lengths


@lru_cache(maxsize=4)
def _names(a_size: int, b_size: int) -> np.ndarray:
    out = np.empty(2 * (a_size + b_size), object)
    out[:] = [b"%d%s" % (i, c) for i in range(a_size) for c in (b",", b"|")] + [b"%d%s" % (i, c) for i in range(b_size) for c in (b",", b";")]
    return out


def _parts(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[tuple[list, list]]:
    """Ids and texts, a bounded number of bytes at a time."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py()
            if texts and held + len(t or "") > most:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t or "")
        if ids:
            yield ids, texts


def groups(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """doc_id and the groups of its tokens: end (bytes of space and text before the group's end), a_ids and b_ids of each.

    A text that is null, empty or not given back by a vocabulary has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = loaded(a), loaded(b)
        for ids, texts in _parts(batches):
            al = Aligned(texts, va, vb)
            found = [[] for _ in ids]
            for k, i in enumerate(al.whole):
                at, to, before = al.to_a[k], al.to_b[k], al.ends[al.to_a[k] - 1] if al.to_a[k] else 0
                for e in np.flatnonzero(al.shared[al.to_a[k] : al.to_a[k + 1]]) + al.to_a[k]:
                    found[i].append({"end": al.ends[e] - before, "a_ids": al.a[at : e + 1], "b_ids": al.b[to : al.holder[e] + 1]})
                    at, to = e + 1, al.holder[e] + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], names=["doc_id", "groups"])

    kind = pa.list_(pa.struct([("end", pa.int64()), ("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64()))]))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, groups array<struct<end: long, a_ids: array<long>, b_ids: array<long>>>")


def linked(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """A row per document (key tells rows apart): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times: its linked pairs of ids (a * size of b + b), how often.

    For every part of a table's texts there is a row more, with a null key: the part's pairs and their times.
    """
    sizes = len(loaded(a).bytes), len(loaded(b).bytes)
    kind = "int" if sizes[0] * sizes[1] < 1 << 31 else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb, names = loaded(a), loaded(b), _names(*sizes)
        key = TaskContext.get().partitionId() << 40
        longs, wide = pa.int64(), pa.int32() if kind == "int" else pa.int64()
        for ids, texts in _parts(batches):
            al = Aligned(texts, va, vb)
            n_links = al.per_text(al.overlaps)
            i, j = al.links()
            pair = al.a[i] * sizes[1] + al.b[j]
            space = sizes[0] * sizes[1]
            own, times = np.unique(np.repeat(np.arange(len(n_links)), n_links) * space + pair, return_counts=True)
            where = np.searchsorted(own, np.arange(len(n_links) + 1) * space)
            own %= space
            order = np.argsort(own, kind="stable")
            every, start = np.unique(own[order], return_index=True)
            total = np.add.reduceat(times[order], start) if len(every) else times
            here = np.zeros((len(ids) + 1, 4), np.int64)
            size = np.zeros(len(ids) + 1, np.int64)
            digest = [""] * (len(ids) + 1)
            if al.whole:
                w = np.array(al.whole)
                here[w] = np.stack([np.diff(al.to_a), np.diff(al.to_b), al.per_text(al.shared), n_links], axis=1)
                size[w] = np.diff(where)
                for at, line in zip(al.whole, al.written(names, sizes[0])):
                    digest[at] = hashlib.sha256(line).hexdigest()
            size[-1] = len(every)
            cuts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x), wide)) for x in ((own, every), (times, total))]
            keys = pa.array([*range(key, key + len(ids)), None], longs)
            key += len(ids)
            columns = [keys, pa.array([*ids, None], longs), *(pa.array(here[:, c]) for c in range(4)), pa.array(digest), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select("doc_id", "text").mapInArrow(run, f"key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<{kind}>")


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The text with a space before it is tokenised by both vocabularies; byte
    offsets at which tokens of both end cut it into groups. Tokens link where
    their bytes overlap. A pair's count is how many links of all documents hold
    it; n_best are the links whose count is the highest of their token of b
    (ties count), count_sum adds up the counts.

    The files are read where this is called and go to the tasks. A text that is
    null, empty or not given back byte for byte has zeros and ''. Null and
    repeated ids are rows of their own; an empty table gives no rows. Texts are
    read whole; a task holds one text's tokens. Other columns aren't looked at.
    """
    a, b = (open(x or y, "rb").read() for x, y in zip((a_file, b_file), vocabulary_files()))
    b_size = len(loaded(b).bytes)
    parts = settle(linked(docs, a, b), "linked", dictionary=False)
    each = lambda df, *more: df.select(*more, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(*more, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = settle(each(parts.where("key IS NULL")).groupBy("pair").agg(F.sum("times").alias("count")), "counts")
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("most"))  # a row per id of b at most
    counts = counts.join(F.broadcast(most), F.col("pair") % b_size == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("top"))
    rows = parts.where("key IS NOT NULL")
    side = settle(counts, "counts")
    side = F.broadcast(side) if side.count() <= broadcast_rows else side
    sums = each(rows, "key").join(side, "pair").groupBy("key").agg(F.sum(F.when(F.col("top"), F.col("times"))).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    narrow = rows.drop("pairs", "times").join(sums, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return narrow.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
