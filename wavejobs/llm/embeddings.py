"""Near-duplicate vectors by spherical-cap filters with structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavejobs.llm.common import discard, settle
from wavejobs.llm.components import Forest, components

COSINE = 0.9
#: Filters of one code that two vectors at the cosine are expected to share.
SHARED = 4.0
#: Part of the pairs at the cosine that may miss each other in all codes. Codes are added until their measured misses multiply to less.
MISS = 0.005
#: Random pairs that a code's misses are measured on.
PAIRS = 400
#: Vectors that a filter is meant to hold.
LOAD = 256
#: Shorter vectors are filled up with zeros to this length, which leaves their cosines.
LEAST_DIMS = 8
SEED = 20240229
#: Filters with one left half that make a cell.
TOGETHER = 16
#: Rows of a group of small cells, and of a block of a cell that has more.
CELL_ROWS = 4000
BLOCK = 2000


def caps(dims: int, cosine: float, part: float) -> tuple[float, float]:
    """(alpha, both): the height of a cap that holds a part of the sphere, and the chance that both of a pair at the cosine are in it.

    By the exact law of a coordinate of a random unit vector. The part grows
    where the pair would be too far apart for its cap.
    """
    t = np.linspace(-1, 1, 40_001)
    density = lambda d: (lambda f: f / f.sum())(np.maximum(1 - t * t, 0) ** ((d - 3) / 2))
    own, rest = density(dims), np.cumsum(density(dims - 1))
    above = np.cumsum(own[::-1])[::-1]
    while True:
        k = min(int(np.searchsorted(-above, -part)), len(t) - 1)
        u = t[k:]
        need = (t[k] - cosine * u) / np.maximum(np.sqrt((1 - cosine * cosine) * (1 - u * u)), 1e-12)
        both = float((own[k:] * (1 - np.interp(need, t, rest))).sum())
        if both >= 0.1 * part or part >= 0.5:
            return float(t[k]), both
        part = min(0.5, 2 * part)


class Code:
    """Independent product codes: a filter is a pair of unit vectors, one for each half of the dimensions of a code's own random rotation.

    A vector is in the cap of filter (i, j) if its inner product with the
    joined, halved vectors is at least alpha. The size follows from the number
    of vectors n: caps hold about LOAD of them, and a code has as many filters
    as give a pair at the cosine SHARED common ones. These come together, as
    filters of a code share their halves, so that some pairs have none. Each
    code is therefore measured on random pairs, and codes are added until few
    enough are expected to be missed by all. The rotations make this hold
    for any pair at the cosine, whatever the vectors are.
    """

    def __init__(self, n: int, dims: int, cosine: float = COSINE, shared: float = SHARED, load: float = LOAD, seed: int = SEED, miss: float = MISS) -> None:
        self.dims, self.half = dims, dims // 2
        self.codes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.alpha, both = caps(dims, cosine, min(0.05, load / max(n, 1)))
        self.size = max(2, math.ceil(math.sqrt(shared / both)))
        rng = np.random.default_rng(seed)
        draw = lambda d: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True) / math.sqrt(2))(rng.standard_normal((self.size, d)))
        left = 1.0
        while left > miss:
            code = (np.linalg.qr(rng.standard_normal((dims, dims)))[0], draw(self.half), draw(dims - self.half))
            x, y = pairs(PAIRS, dims, cosine, rng)
            pair = [r * self.size**2 + i * self.size + j for r, i, j in (self._exceeded(code, v) for v in (x, y))]
            met = np.unique(np.intersect1d(*pair) // self.size**2)
            missed = 1 - len(met) / PAIRS
            left *= min(1.0, missed + 2 * math.sqrt(max(missed, 1 / PAIRS) / PAIRS))  # not less than measured by chance
            self.codes.append(code)

    def _exceeded(self, code: tuple, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, left, right) of all filters that each vector exceeds, by row."""
        turn, left, right = code
        turned = vectors @ turn
        a, b = turned[:, : self.half] @ left.T, turned[:, self.half :] @ right.T
        row, i = np.nonzero(a >= self.alpha - b.max(1, keepdims=True))  # those that the best right half can lift over alpha
        found, step = [], max(1, 4_000_000 // self.size)
        for at in range(0, len(row), step):
            r, k = row[at : at + step], i[at : at + step]
            p, j = np.nonzero(a[r, k][:, None] + b[r] >= self.alpha)
            found.append((r[p], k[p], j))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    @property
    def width(self) -> int:
        """Numbers of filters for one left half: its cells are full."""
        return -(-self.size // TOGETHER) * TOGETHER

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, in order, all filters that it exceeds; a filter's number divided by TOGETHER is its cell."""
        parts = [(r, (k * self.size + i) * self.width + j) for k, code in enumerate(self.codes) for r, i, j in [self._exceeded(code, vectors)]]
        row, filters = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((filters, row))
        return np.split(filters[order], np.searchsorted(row[order], np.arange(1, len(vectors))))


def pairs(n: int, dims: int, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors at the cosine."""
    x, y = rng.standard_normal((2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * y


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that can link: a vec_id, and a vector without null, infinite or NaN components and with a length."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def unit(rows: list | pd.Series, dims: int) -> np.ndarray:
    """Unit vectors in double precision, filled up with zeros to dims."""
    v = np.array([np.asarray(x, np.float64) for x in rows])
    v = v / np.abs(v).max(1, keepdims=True)  # lengths neither overflow nor vanish
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.pad(v, ((0, 0), (0, dims - v.shape[1])))


def decoded(classes: DataFrame, code: Code) -> DataFrame:
    """rep, m, embedding (unit vectors) and filters, one row per class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), 1000):
                some = part.iloc[at : at + 1000]
                vectors = unit(some["embedding"], code.dims)
                yield pd.DataFrame({"rep": some["rep"], "m": some["m"], "embedding": some["embedding"], "filters": code.decode(vectors)})

    kind = dict(classes.dtypes)["embedding"]
    return settle(classes.mapInPandas(run, f"rep long, m long, embedding {kind}, filters array<long>"), "decoded")


def count_links(coded: DataFrame, dims: int, cosine: float = COSINE) -> DataFrame:
    """rep, links, root: what each cell has found. A pair counts in the cell of the first filter that both share.

    Only (cell, rep) pairs are dealt out at first; cells with one vector go, and
    large ones are cut into blocks. The vectors then meet them by rep and are
    shuffled to the cells once.
    """
    cells = settle(coded.select("rep", F.explode(F.array_distinct(F.transform("filters", lambda f: F.floor(f / TOGETHER)))).alias("cell")), "cells")
    sizes = settle(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    groups = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // CELL_ROWS)
    blocks = F.when(F.col("n") > CELL_ROWS, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int")
    dealt = cells.join(sizes.select("cell", blocks.alias("blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    # a cut cell's blocks go alone, the other cells many to a group
    placed = dealt.select("rep", "cell", "block", "blocks", F.explode(meets).alias("ij")).select(
        "rep", "cell", "block", "ij.i", "ij.j", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cell"), F.lit(groups))).otherwise(F.xxhash64("cell", "ij.i", "ij.j")).alias("group")
    )
    names = ["group", "cell", "i", "j", "block"]

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        vectors = unit(part["embedding"], dims)
        reps, m, block = part["rep"].to_numpy(), part["m"].to_numpy(), part["block"].to_numpy()
        lists = part["filters"].to_numpy()
        forest, links = Forest(len(part)), np.zeros(len(part), np.int64)
        for (cell, i, j), at in part.groupby(["cell", "i", "j"], sort=False).indices.items():
            if len(at) < 2:
                continue
            at = np.sort(at)
            close = np.triu(vectors[at] @ vectors[at].T >= cosine, 1)
            if i != j:  # within a block is cell (i, i)
                close &= block[at][:, None] != block[at][None, :]
            used = np.flatnonzero(close.any(0) | close.any(1))
            if not len(used):
                continue
            own = [f[np.searchsorted(f, cell * TOGETHER) : np.searchsorted(f, (cell + 1) * TOGETHER)] for f in lists[at[used]]]
            earlier = [f[: np.searchsorted(f, cell * TOGETHER)] for f in lists[at[used]]]
            p, q = np.nonzero(close[np.ix_(used, used)] & shared(own) & ~shared(earlier))
            x, y = at[used[p]], at[used[q]]
            np.add.at(links, x, m[y])
            np.add.at(links, y, m[x])
            forest.join(x, y)
        out = np.flatnonzero(links)
        return pd.DataFrame({"rep": reps[out], "links": links[out], "root": reps[forest.label[out]]})

    wide = placed.join(coded, "rep").select(*names, "rep", "m", "embedding", "filters")
    found = settle(wide.groupBy("group").applyInPandas(compare, "rep long, links long, root long"), "found")
    discard(cells, sizes, coded)
    return found


def shared(lists: list[np.ndarray]) -> np.ndarray:
    """Which of the lists have a number in common, as a square matrix."""
    _, where, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    told = times[where] > 1  # numbers of one list alone say nothing
    place = np.cumsum(times > 1) - 1
    has = np.zeros((len(lists), int((times > 1).sum())), np.float32)
    has[np.repeat(np.arange(len(lists)), [len(f) for f in lists])[told], place[where[told]]] = 1
    return (has @ has.T) > 0


def group(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    All rows are compared whatever their other columns say. Equal vectors are
    collapsed first and count as links of each other. A pair counts if its
    cosine in double precision is at least `cosine`. Each vector is list-decoded
    to all filters of several product codes whose cap it is in, and vectors join
    on filters. Links that share no filter are missed; see MISS. A cell of
    filters with many vectors is compared in blocks, and cells return counts and
    forests, not pairs.

    Vectors that are null, zero, or hold null or non-finite components have no
    links and are their own component. So is a row with a null vec_id: its
    component is null and it isn't kept. Vectors of other lengths than the
    first one's are compared among themselves. An empty table gives no rows.
    """
    classes = usable(vectors).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    classes = settle(classes.withColumn("dims", F.size("embedding")), "classes")
    parts = []
    for row in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy("dims").collect():  # one row per vector length
        dims = max(LEAST_DIMS, row.dims)
        coded = decoded(classes.where(F.col("dims") == row.dims).drop("dims"), Code(row.n, dims, cosine))
        parts.append(count_links(coded, dims, cosine))
    links = classes.select(F.col("rep"), F.lit(0).cast("long").alias("links"), F.col("rep").alias("root"))
    for p in parts:
        links = links.union(p)
    links = settle(links, "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(counts, "rep").join(roots, classes.rep == roots.node, "left")
    named = settle(named.select("embedding", (F.col("links") + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "named")
    mine = F.when(F.col("vec_id").isNotNull(), F.col("component_id"))
    return (
        vectors.select("vec_id", "embedding")
        .join(named, "embedding", "left")
        .select("vec_id", F.when(mine.isNotNull(), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.coalesce(mine, F.col("vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
