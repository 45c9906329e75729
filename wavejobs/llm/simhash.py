"""SimHash near-duplicates, linked by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavejobs.llm.common import settle
from wavejobs.llm.components import Forest, components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Two fingerprints within RADIUS bits agree to within RADIUS // SEGMENTS bits on one of SEGMENTS runs of bits.
SEGMENTS = 3
#: Fingerprints that a shard of one segment's tree is meant to hold, shards at most, and sampled fingerprints per shard.
PER_SHARD = 2000
MOST_SHARDS = 4096
SAMPLE_PER_SHARD = 32
#: A shard of more rows than this is compared block by block.
BLOCK = 24_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text's k-word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(joined, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    counts, n = np.zeros((8, 256), np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):  # bounded memory for a very long text
        starts = ends[at - 1 : at - 1 + (1 << 16)] if at else [0, *ends[: (1 << 16) - 1]]
        hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[at + k - 1 :])), np.uint64)
        octets = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
        counts += np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
    set_ = (counts @ _BITS).ravel()  # of bit 0 to 63
    return int(np.packbits(set_ * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = np.array([fingerprint(t) for t in part["text"]], np.uint64)
            yield part.drop(columns="text").assign(fp=found.view(np.int64))

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", *keep, "text").mapInPandas(run, "doc_id long, " + "".join(f"{c} {kinds[c]}, " for c in keep) + "fp long")


def masks(segments: int) -> list[int]:
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def distance(values: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((values ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def grow(sample: np.ndarray, mask: int, least: int) -> dict | None:
    """A vantage-point tree over a sample: vantage, threshold, inside and outside; None is a shard.

    The threshold is the median distance. A node whose sample all lies at one
    distance isn't split.
    """
    if len(sample) < 2 * least:
        return None
    vantage = int(sample[0])
    d = distance(sample, vantage, mask)
    at = int(np.median(d))
    if at == d.max():
        at -= 1
    inside = d <= at
    if inside.all() or not inside.any():
        return None
    return {"v": vantage, "t": at, "in": grow(sample[inside][::-1], mask, least), "out": grow(sample[~inside][::-1], mask, least)}


def route(values: np.ndarray, tree: dict | None, mask: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions, at home) for each shard: where each value lives, and where it visits.

    By the triangle inequality a value at distance d of a vantage point has
    partners only at distances d - radius to d + radius. Of a pair on two sides
    of a threshold the outer one visits the inner side; visitors follow the
    bounds from there on.
    """
    stack = [(tree, np.arange(len(values)), np.ones(len(values), bool))]
    number = 0
    while stack:
        node, at, home = stack.pop()
        if node is None:
            yield number, at, home
            number += 1
            continue
        d = distance(values[at], node["v"], mask)
        inner, near = d <= node["t"], d - radius <= node["t"]
        k = (home & ~inner) | (~home & (d + radius > node["t"]))
        stack.append((node["out"], at[k], home[k]))
        stack.append((node["in"], at[near], home[near] & inner[near]))


def pairs_within(values: np.ndarray, home: np.ndarray, mask: int, radius: int, limit: int, forest: Forest, least: int = 128) -> None:
    """Join in forest all pairs of `values`, one of them at home, that are within limit bits; a tree on mask prunes."""
    stack = [(np.arange(len(values)), home)]
    while stack:
        at, own = stack.pop()
        inside = at[own]
        if not len(inside) or len(at) < 2:
            continue
        if len(inside) > least:
            vantage = int(values[inside[0]])
            d = distance(values[at], vantage, mask)
            t = int(np.median(d[own]))
            if t == d[own].max():
                t -= 1
            inner, near = d <= t, d - radius <= t
            if (own & inner).any() and (own & ~inner).any():
                k_in, k_out = near, (own & ~inner) | (~own & (d + radius > t))
                if k_in.sum() * 1.0 * (own & inner).sum() + k_out.sum() * 1.0 * (own & ~inner).sum() < 0.9 * len(at) * len(inside):
                    stack.append((at[k_in], own[k_in] & inner[k_in]))
                    stack.append((at[k_out], own[k_out]))
                    continue
        step = max(1, 2_000_000 // len(at))
        for a in range(0, len(inside), step):
            close = np.bitwise_count(values[inside[a : a + step], None] ^ values[None, at]) <= limit
            i, j = np.nonzero(close)
            forest.join(inside[a + i], at[j])


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Links a, b between distinct fingerprints (a column fp of signed longs) whose components are those of all pairs within radius bits.

    The fingerprints are spread: to full width their distances crowd about 32,
    where a radius of 4 prunes nothing. So trees stand on runs of bits: two
    fingerprints within 4 bits of each other are within 1 bit on one of three
    runs. Each run has a tree grown from a bounded sample. Its leaves are the
    shards; a fingerprint goes to its own shard and to those that its ball
    overlaps. Shards of many rows are cut into blocks that are compared with
    each other, and within a cell another tree prunes the exact comparison.
    What a cell returns is a forest, not its pairs.
    """
    limit, near = radius, radius // segments
    n = fps.count()
    shards = int(min(MOST_SHARDS, max(1, n // PER_SHARD)))
    sample = [r.fp for r in fps.orderBy(F.xxhash64("fp", F.lit("sample"))).limit(shards * SAMPLE_PER_SHARD).collect()]
    sample = np.array(sample, np.int64).view(np.uint64)
    trees = [(m, grow(sample, m, SAMPLE_PER_SHARD)) for m in masks(segments)]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            values = part["fp"].to_numpy(np.int64)
            for s, (mask, tree) in enumerate(trees):
                for shard, at, home in route(values.view(np.uint64), tree, mask, near):
                    if len(at):
                        yield pd.DataFrame({"segment": s, "shard": shard, "home": home, "fp": values[at]})

    sent = settle(fps.mapInPandas(send, "segment int, shard int, home boolean, fp long"), "sent")
    sizes = sent.groupBy("segment", "shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = sent.join(F.broadcast(sizes), ["segment", "shard"])  # a row per shard: SEGMENTS * MOST_SHARDS at most
    block = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = dealt.withColumn("block", block).select(
        "segment",
        "shard",
        "fp",
        F.explode(
            F.concat(
                F.when(F.col("home"), F.transform(every, lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("home")))).otherwise(F.array().cast("array<struct<i:int,j:int,home:boolean>>")),
                F.transform(
                    F.filter(every, lambda i: ~F.col("home") | (i < F.col("block"))),
                    lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("home")),
                ),
            )
        ).alias("cell"),
    )
    runs = masks(segments)

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        segment, _, i, j = key
        home = part["home"].to_numpy(bool)
        values = part["fp"].to_numpy(np.int64)
        own = values.view(np.uint64)
        forest = Forest(len(values))
        if i == j:
            pairs_within(own, home, runs[segment], near, limit, forest)
        elif (~home).any():
            others = np.flatnonzero(~home)
            step = max(1, 2_000_000 // len(others))
            mine = np.flatnonzero(home)
            for a in range(0, len(mine), step):
                x, y = np.nonzero(np.bitwise_count(own[mine[a : a + step], None] ^ own[None, others]) <= limit)
                forest.join(mine[a + x], others[y])
        moved = forest.label != np.arange(len(values))
        return pd.DataFrame({"a": values[moved], "b": values[forest.label[moved]]})

    flat = cells.select("segment", "shard", "cell.i", "cell.j", "cell.home", "fp")
    return flat.groupBy("segment", "shard", "i", "j").applyInPandas(compare, "a long, b long")


def group(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, root.

    Fingerprints link at radius or fewer differing bits; component_id is the
    smallest doc_id reachable, root a fingerprint that names the group (one
    doc_id can be the smallest of two groups). Equal fingerprints are compared once.

    Null and empty texts have fingerprint zero, which links like any other. A
    row with a null doc_id gets the component of its fingerprint but never names
    or bridges one; without other rows its component is null. Repeated rows
    stay. An empty table gives no rows. Very long texts are read whole. Other
    columns are not looked at; those named in keep are passed on.
    """
    fps = settle(fingerprints(docs, keep), "fingerprints")
    nodes = settle(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius, segments))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settle(rooted.join(smallest, "root").select("fp", "component_id", "root"), "components")
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *keep)
