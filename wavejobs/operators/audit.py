"""Audit of a capture: distributions, switches, statistics, time, worst rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavejobs.functions.columns import micros
from wavejobs.operators.fit import long_form, quantiles
from wavejobs.operators.order import CHUNK, chunked, looking_back


def distributions(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n of every value of each dimension; an array counts once for each element."""
    kinds = dict(df.dtypes)
    each = [F.transform(F.col(d), lambda v: v.cast("string")) if kinds[d].startswith("array") else F.array(F.col(d).cast("string")) for d in dimensions]
    named = lambda d, e: F.transform(e, lambda v: F.struct(F.lit(d).alias("dimension"), v.alias("value")))
    pairs = F.flatten(F.array(*[named(d, e) for d, e in zip(dimensions, each)]))
    return df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def switches(df: DataFrame, columns: list[str], key: str = "serial", ts: str = "ts", tie: str = "id", chunk: int = CHUNK) -> DataFrame:
    """How often each column changes from one frame of a key to the next."""
    own = looking_back(chunked(df, key, ts, tie, chunk), key, 2, chunk, **{f"__was_{i}": (lambda w, c=c: F.lag(c).over(w)) for i, c in enumerate(columns)})
    moved = [((F.col("__index") > 0) & ~F.col(c).eqNullSafe(F.col(f"__was_{i}"))).cast("long") for i, c in enumerate(columns)]
    return own.groupBy(key).agg(*[F.sum(m).alias(f"{c}_changes") for m, c in zip(moved, columns)])


def stats(df: DataFrame, metrics: list[str], keys: list[str] = ()) -> DataFrame:
    """n, min, p05, p50, mean, p95, max of each metric; non-finite values don't count."""
    by = [*keys, "feature"]
    values = long_form(df, metrics, list(keys))
    plain = values.groupBy(*by).agg(F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in by])
    out = plain.join(quantiles(values, [0.05, 0.5, 0.95], by).withColumnsRenamed({k: f"q_{k}" for k in by}), same)
    return out.select(*keys, F.col("feature").alias("metric"), "n", "min", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), "mean", F.col("q")[2].alias("p95"), "max")


def times(df: DataFrame, key: str = "serial", ts: str = "ts", tie: str = "id", chunk: int = CHUNK) -> DataFrame:
    """start, end, duration_s and the least, median and largest seconds between frames of each key."""
    own = looking_back(chunked(df.select(key, ts, tie), key, ts, tie, chunk), key, 2, chunk, s=lambda w: (micros(ts) - micros(F.lag(ts).over(w))) / 1e6)
    plain = own.groupBy(key).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), ((micros(F.max(ts)) - micros(F.min(ts))) / 1e6).alias("duration_s"), F.min("s").alias("min_interval_s"), F.max("s").alias("max_interval_s"))
    middle = quantiles(own, [0.5], [key], "s", few_keys=False).select(F.col(key).alias("__key"), F.col("q")[0].alias("median_interval_s"))
    joined = plain.join(middle, plain[key].eqNullSafe(middle["__key"]), "left")
    return joined.select(key, "start", "end", "duration_s", "min_interval_s", "median_interval_s", "max_interval_s")


def worst(df: DataFrame, n: int = 12, score: str = "score", health: str = "health", row: str = "id") -> DataFrame:
    """The n rows with the largest score and the n with the least health, ties by row; list says which."""
    top = df.orderBy(F.desc(score), row).limit(n).withColumn("list", F.lit("score"))
    return top.unionByName(df.orderBy(health, row).limit(n).withColumn("list", F.lit("health")))
