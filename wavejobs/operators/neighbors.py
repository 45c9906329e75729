"""Batch encoding, exact nearest neighbours and the labels that follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavejobs.operators.fit import long_form, quantiles

#: Rows of the bank that one task holds at a time.
BANK_BLOCK = 20_000
#: Queries that one task holds at a time.
QUERY_PART = 20_000


def encode(df: DataFrame, encoder: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], samples: str = "samples", row: str = "row") -> DataFrame:
    """row, embedding, reconstruction_mse, status: an encoder maps a matrix to (embeddings, reconstructions). Malformed rows get an error status, the rest still score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            waves = [None if w is None else np.asarray(w, float) for w in part[samples]]
            sizes = [len(w) for w in waves if w is not None and len(w) and np.isfinite(w).all()]
            width = max(set(sizes), key=sizes.count) if sizes else 0
            ok = np.array([w is not None and len(w) == width and bool(np.isfinite(w).all()) for w in waves], bool) & (width > 0)
            emb, mse = [None] * len(waves), [None] * len(waves)
            if ok.any():
                x = np.stack([w for w, k in zip(waves, ok) if k])
                z, back = encoder(x)
                for i, e, m in zip(np.flatnonzero(ok), z, ((x - back) ** 2).mean(1)):
                    emb[i], mse[i] = e, float(m)
            yield pd.DataFrame({row: part[row], "embedding": emb, "reconstruction_mse": mse, "status": np.where(ok, "completed", "error")})

    return df.select(row, samples).mapInPandas(run, f"{row} long, embedding array<double>, reconstruction_mse double, status string")


def linear_encoder(basis: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Projection on the rows of an orthonormal basis, and back."""
    return lambda x: ((z := x @ basis.T), z @ basis)


def standardize(metric: DataFrame, embedding: str = "embedding") -> Column:
    """An embedding in the metric's units; the metric has one row per dimension."""
    rows = metric.orderBy("pos").collect()
    center, scale = F.array(*[F.lit(r["center"]) for r in rows]), F.array(*[F.lit(r["scale"]) for r in rows])
    return F.transform(F.arrays_zip(F.col(embedding).alias("e"), center.alias("c"), scale.alias("s")), lambda t: (t["e"].cast("double") - t["c"]) / t["s"])


def nearest(queries: DataFrame, bank: DataFrame, k: int = 5, row: str = "row", point: str = "point") -> DataFrame:
    """row, neighbor, distance, rank: the k nearest rows of the bank to each query, itself left out, ties by row.

    The bank is cut into blocks and the queries into parts. Each (part, block)
    pair is a task of matrix products, of which k rows a query are left; these
    meet per query. So neither all pairs nor the whole bank nor all queries
    stand anywhere. The products' rounded distances only rule out rows that are
    farther than the k nearest by more than their rounding can be.
    """
    blocks = max(1, -(-bank.count() // BANK_BLOCK))
    parts = max(1, -(-queries.count() // QUERY_PART))
    cut = lambda many: F.pmod(F.xxhash64(row), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    own = (F.col(row).alias("row"), F.col(point).cast("array<double>").alias("point"))
    side = bank.select(cut(blocks).alias("block"), *own).select("*", every(parts).alias("part"))
    asked = queries.select(cut(parts).alias("part"), *own).select("*", every(blocks).alias("block"))

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"row": [], "neighbor": [], "distance": []}).astype({"row": "int64", "neighbor": "int64", "distance": "float64"})
        b = b.sort_values("row")
        names, matrix = b["row"].to_numpy(), np.stack(b["point"].to_numpy())
        out = []
        for at in range(0, len(q), 512):
            some = q.iloc[at : at + 512]
            x = np.stack(some["point"].to_numpy())
            xx, bb = (x * x).sum(1)[:, None], (matrix * matrix).sum(1)
            rough = xx - 2 * x @ matrix.T + bb
            # a sum of d products is off by less than d + 2 roundings of its terms, whose sizes add up to at most 2 (xx + bb)
            off = 2 * (x.shape[1] + 4) * np.finfo(float).eps * (xx + bb)
            take = min(len(names), k + 1)  # the query itself may be one
            limit = np.partition(rough + off, take - 1, 1)[:, take - 1 : take]
            for r, v, may in zip(some["row"], x, rough - off <= limit):
                c = np.flatnonzero(may)
                d = np.sqrt(((matrix[c] - v) ** 2).sum(1))
                order = [i for i in np.lexsort((names[c], d)) if names[c[i]] != r][:k]
                out.append(pd.DataFrame({"row": r, "neighbor": names[c[order]], "distance": d[order]}))
        return pd.concat(out)

    found = asked.groupBy("part", "block").cogroup(side.groupBy("part", "block")).applyInPandas(best, "row long, neighbor long, distance double")
    top = found.groupBy("row").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))), 1, k).alias("n"))
    return top.select(F.col("row").alias(row), F.posexplode("n").alias("rank", "n")).select(row, "n.neighbor", "n.distance", (F.col("rank") + 1).alias("rank"))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (distance + 1.0)


def distance_to_center(point: str = "point") -> Column:
    """The norm of a standardized embedding, where there is no bank."""
    return F.sqrt(F.aggregate(point, F.lit(0.0), lambda a, x: a + x * x))


def label(mse: Column, distance: Column, mse_limits: tuple[float, float], distance_limits: tuple[float, float]) -> Column:
    """The worse of two signals; limits are (suspect, anomaly), and a missing distance doesn't count."""
    high = lambda i: (mse >= mse_limits[i]) | F.coalesce(distance >= distance_limits[i], F.lit(False))
    return F.when(high(1), "anomaly").when(high(0), "suspect").otherwise("normal")


def limits(df: DataFrame, mse: str = "reconstruction_mse", distance: str = "distance", train: Column | None = None) -> DataFrame:
    """One row of thresholds on the training rows: mse p99.5 and p99.9, distance p95 and p99, similarity p05 and p01."""
    rows = df.where(train) if train is not None else df
    far = F.col(distance).cast("double")
    named = rows.select(F.col(mse).cast("double").alias("mse"), far.alias("distance"), similarity(far).alias("similarity"))
    at = {"mse": (0.995, 0.999), "distance": (0.95, 0.99), "similarity": (0.05, 0.01)}
    levels = [x for pair in at.values() for x in pair]
    q = quantiles(long_form(named, list(at)), levels, ["feature"])
    picked = {f"{n}_{w}": F.max(F.when(F.col("feature") == n, F.col("q")[levels.index(at[n][i])])) for n in at for i, w in enumerate(("suspect", "anomaly"))}
    return q.agg(*[c.alias(n) for n, c in picked.items()])
