"""History queries: newest frames, bounded series, events, late enrichment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavejobs.operators.order import numbered

MOST_POINTS = 24 * 1800


def latest(df: DataFrame, key: str = "serial", ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest row of each key: a combinable aggregate, no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("r")).select(key, "r.*")


def series(df: DataFrame, fields: list[str], texts: list[str] = (), max_points: int = MOST_POINTS, key: str = "serial", ts: str = "ts", tie: str = "id") -> DataFrame:
    """At most max_points points per key, each of an equal share of its rows: avg, min, max and latest of each field, count, ts and texts of the last row."""
    most = max(1, min(max_points, MOST_POINTS))
    rows = numbered(df, key, ts, tie)
    cut = F.floor(((F.col("index") + 1) * most - 1) / F.col("total"))
    rows = rows.withColumn("bucket", F.when(F.col("total") <= most, F.col("index")).otherwise(cut).cast("long"))
    place = F.struct(ts, tie)
    aggs: list[Column] = [F.count(F.lit(1)).alias("count"), F.max_by(ts, place).alias(ts)]
    for f in fields:
        ok = F.when(~F.isnan(f) & (F.abs(F.col(f)) < float("inf")), F.col(f))
        aggs += [F.avg(ok).alias(f"{f}_avg"), F.min(ok).alias(f"{f}_min"), F.max(ok).alias(f"{f}_max"), F.max_by(ok, place).alias(f"{f}_latest")]
    return rows.groupBy(key, "bucket").agg(*aggs, *[F.max_by(t, place).alias(t) for t in texts])


def since(df: DataFrame, cutoff: datetime, ts: str = "ts", serial: str | None = None, key: str = "serial") -> DataFrame:
    """Rows at or after cutoff, of one meter if given; both reach the scan. A log's partitions by `date` before the cutoff's day aren't read."""
    df = df.where(F.col(ts) >= F.lit(cutoff))
    if dict(df.dtypes).get("date") == "date" and ts != "date":
        df = df.where(F.col("date") >= F.to_date(F.lit(cutoff)))
    return df if serial is None else df.where(F.col(key) == serial)


def newest(df: DataFrame, n: int, key: str = "serial", ts: str = "ts", tie: str = "id", ascending: bool = False) -> DataFrame:
    """The last n rows of each key. Within days first, so that no key's history meets in one task whole."""
    day = Window.partitionBy(key, F.to_date(ts)).orderBy(F.desc(ts), F.desc(tie))
    part = df.withColumn("__n", F.row_number().over(day)).where(F.col("__n") <= n).drop("__n")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))).where(F.col("rank") <= n)
    return ranked.orderBy(key, F.desc("rank")) if ascending else ranked


def enrich(frames: DataFrame, results: DataFrame, fields: list[str], key: str = "serial", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Late results go to the newest frame of the same key and time; of several results the last (largest `at`) counts."""
    newest_ = frames.groupBy(key, ts).agg(F.max(tie).alias(tie))
    one = results.groupBy(key, ts).agg(F.max_by(F.struct(*fields), "at").alias("__new"))
    where = newest_.join(one, [key, ts])
    joined = frames.join(where, [key, ts, tie], "left")
    kept = [c for c in frames.columns if c not in fields]
    return joined.select(*kept, *[F.coalesce(F.col(f"__new.{f}"), F.col(f)) if f in frames.columns else F.col(f"__new.{f}").alias(f) for f in fields]).toDF(*kept, *fields)
