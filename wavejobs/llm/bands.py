"""Near-duplicate classes of walk fingerprints: bit-sampled bands, and verification of what meets in one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavejobs.llm.common import settle
from wavejobs.llm.components import Forest, components
from wavejobs.llm.walks import SAMPLES, likeness, sampled

#: Letters of a band, and bands of a walk at each of two levels.
LETTERS = 8
BANDS = 6
LIKENESS = 0.8
#: Fingerprints of a band that one task compares with as many others.
BLOCK = 1000
#: Fingerprints of classes of several that are broadcast, at most; rows of two longs.
BROADCAST_ROWS = 2_000_000


@lru_cache(maxsize=256)
def places(level: int) -> np.ndarray:
    """Which letters each band of a level takes: those of the walk's first 2 ** level steps, in proportion to the steps that they stand for."""
    steps, weights = sampled()
    n = int(np.searchsorted(steps, 1 << level))
    rng = np.random.default_rng(1000 + level)
    return np.sort(rng.choice(n, (BANDS, LETTERS), p=weights[:n] / weights[:n].sum()), axis=1)


def levels(n: int) -> list[int]:
    """The two largest powers of two that n letters reach, as exponents: texts of about one length share one of them."""
    steps = sampled()[0]
    reach = int(steps[n - 1]) + 1 if n <= 2 * SAMPLES else int(steps[n - 1])
    top = max(reach, 1).bit_length() - 1
    return [top, top - 1] if top else [top]


def keys(fingerprint: str) -> list[int]:
    """The hashes of a fingerprint's bands, with walk, level and band in them; an empty walk has none."""
    out = []
    for w, walk in enumerate(fingerprint.split(".")):
        data = np.frombuffer(walk.encode(), np.uint8)
        for level in levels(len(data)) if len(data) else []:
            taken = data[places(level)]
            out += [xxhash.xxh64_intdigest(taken[b].tobytes(), (w * 64 + level) * BANDS + b) - (1 << 63) for b in range(BANDS)]
    return out


class Laid:
    """Fingerprints laid out as matrices, one for each walk, to compare one with all of them."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, weights = texts, sampled()[1]
        parts = [t.split(".") for t in texts]
        self.walks = []
        for w in range(max(map(len, parts), default=0)):
            rows = [np.frombuffer(p[w].encode(), np.uint8) if w < len(p) else np.zeros(0, np.uint8) for p in parts]
            n = np.array([len(r) for r in rows])
            letters = np.zeros((len(rows), max(n.max(), 1)), np.uint8)  # 0 is no letter
            for r, own in zip(rows, letters):
                own[: len(r)] = r
            counts = np.stack([np.bincount(r, minlength=128) for r in rows]).astype(np.float64)
            self.walks.append((letters, n, counts / np.maximum(n, 1)[:, None], np.concatenate([[0.0], np.cumsum(weights[: letters.shape[1]])])))
        self.weights = weights

    def near(self, x: int, others: np.ndarray, least: float) -> np.ndarray:
        """Which of others are alike by least; what is within rounding of it is decided by likeness()."""
        best = np.zeros(len(others))
        for letters, n, shares, upto in self.walks:
            same = (letters[others, : n[x]] == letters[x, : n[x]]) @ self.weights[: n[x]]
            share = same / np.maximum(upto[np.maximum(n[others], n[x])], 1.0)
            chance = shares[others] @ shares[x]
            value = np.where(chance < 1, (share - chance) / np.where(chance < 1, 1 - chance, 1.0), share)
            best = np.maximum(best, np.where((n[others] > 0) & (n[x] > 0), value, 0.0))
        close = np.abs(best - least) < 1e-6
        good = best >= least
        good[close] = [likeness(self.texts[x], self.texts[y]) >= least for y in others[close]]
        return others[good]


def links(prints: DataFrame, least: float = LIKENESS) -> DataFrame:
    """Links a, b between ids of prints (id, fingerprint; each once) whose components are those of all pairs that meet in a band and are alike by `least`.

    All of a band are compared with its smallest id first. Those that aren't
    like it are compared with all others of the band, block by block; what comes
    of a block is a forest, not its pairs.
    """

    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [(k, i) for i, x in zip(part["id"], part["fingerprint"]) for k in set(keys(x))]
            if found:
                yield pd.DataFrame(found, columns=["key", "id"])

    banded = settle(prints.mapInPandas(band, "key long, id long"), "bands", dictionary=False)
    met = banded.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1")
    met = settle(banded.join(met, "key"), "met", dictionary=False)
    text = lambda column, name: prints.select(F.col("id").alias(column), F.col("fingerprint").alias(name))
    alike = F.pandas_udf(lambda x, y: pd.Series([likeness(a, b) for a, b in zip(x, y)]), "double")
    pairs = met.where("id <> first").select("first", "id").distinct().join(text("first", "x"), "first").join(text("id", "y"), "id")
    judged = settle(pairs.select("first", "id", (alike("x", "y") >= least).alias("near")), "judged")

    # Bands in which some aren't like the first: those against all.
    odd = met.join(judged.where("NOT near"), ["first", "id"], "left_semi").select("key", "id", F.lit(True).alias("odd"))
    of_odd = odd.groupBy("key").agg(F.count(F.lit(1)).alias("odd_of"))
    rest = met.where("id <> first AND of > 2").join(of_odd, "key").join(odd, ["key", "id"], "left").select("key", "id", "of", "odd_of", F.coalesce("odd", F.lit(False)).alias("odd"))
    # A cell is a block of a band's members, at home there, and a block of those that aren't like the first, which visit.
    blocks, visits = F.ceil(F.col("of") / BLOCK).cast("int"), F.ceil(F.col("odd_of") / BLOCK).cast("int")
    dealt = lambda n, name: F.pmod(F.xxhash64("id", F.lit(name)), n.cast("long")).cast("int")
    cell = lambda block, visit, home: F.struct(block.alias("block"), visit.alias("visit"), F.lit(home).alias("home"))
    at_home = F.transform(F.sequence(F.lit(0), visits - 1), lambda v: cell(dealt(blocks, "home"), v, True))
    visiting = F.when(F.col("odd"), F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: cell(b, dealt(visits, "visit"), False))).otherwise(F.array().cast("array<struct<block: int, visit: int, home: boolean>>"))
    cells = rest.select("key", "id", "odd", F.explode(F.concat(at_home, visiting)).alias("c")).select("key", "id", "odd", "c.*").join(text("id", "fingerprint"), "id")

    def forest_of(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Links of one cell."""
        ids, odd, home = part["id"].to_numpy(), part["odd"].to_numpy(bool), part["home"].to_numpy(bool)
        if home.all() or not home.any():
            return ids[:0], ids[:0]
        forest, laid, every = Forest(len(ids)), Laid(part["fingerprint"].tolist()), np.arange(len(ids))
        for x in np.flatnonzero(~home):
            open_ = home & (~odd | (ids > ids[x])) & (forest.label != forest.label[x])
            near = laid.near(x, np.flatnonzero(open_), least)
            if len(near):
                forest.join(np.full(len(near), x), near)
        moved = np.flatnonzero(forest.label != every)
        return ids[moved], ids[forest.label[moved]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells one after another, as their rows come; a cell that a batch cuts is held until its end."""
        held = None
        for batch in chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            cell = rows[["key", "block", "visit"]].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1])
            held = None if batch is None else rows.iloc[cuts[-1] :]
            ends = [*cuts[1:], *([len(rows)] if batch is None else [])]
            found = [forest_of(rows.iloc[a:b]) for a, b in zip(cuts, ends)]
            if found:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})

    cells = cells.repartition("key", "block", "visit").sortWithinPartitions("key", "block", "visit")
    others = cells.mapInPandas(compare, "a long, b long")
    return judged.where("near").select(F.col("first").alias("a"), F.col("id").alias("b")).union(others)


def classes(rows: DataFrame, least: float = LIKENESS) -> DataFrame:
    """rows with class_id, the smallest doc_id that is reachable by links between fingerprints, its own included.

    Equal fingerprints are compared once. Fingerprints without letters, of empty
    texts, are a class of their own. A null doc_id gets its fingerprint's class
    but names none. Pairs that share no band aren't looked at: at a likeness of
    0.8 about one of a hundred is missed.
    """
    ident = F.xxhash64("fingerprint")
    nodes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).withColumn("id", ident)
    nodes = settle(nodes, "prints", dictionary=False, codec="zstd")
    linked = components(links(nodes.select("id", "fingerprint"), least))
    rooted = nodes.select("id", "first", "rows").join(linked, nodes.id == linked.node, "left").select("id", "first", "rows", F.coalesce("root", "id").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("rows").alias("of")).where("of > 1")
    side = settle(rooted.join(named, "root").select(F.col("id").alias("f"), "class_id"), "classes", dictionary=False)
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    # A row that is a class by itself isn't in side, so that the wide rows needn't be shuffled.
    return rows.join(side, ident == F.col("f"), "left").withColumn("class_id", F.coalesce("class_id", "doc_id")).drop("f")
