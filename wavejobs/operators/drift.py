"""Thermal drift: fits of the zero against temperature, its error before and after, and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thermal_fit(df: DataFrame, y: str = "raw_fs_mps", delta: str = "thermal_delta_c", rate: str = "temp_rate_c_per_min", key: str = "serial") -> DataFrame:
    """Per key and branch (heating or cooling by the rate's sign) the least-squares a, b of y = a * delta + b * rate; null where it isn't determined."""
    a, b, t = F.col(delta), F.col(rate), F.col(y)
    s = df.where(a.isNotNull() & b.isNotNull() & t.isNotNull()).groupBy(key, F.when(b < 0, "cooling").otherwise("heating").alias("branch"))
    s = s.agg(F.count(F.lit(1)).alias("n"), F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a * t).alias("at"), F.sum(b * t).alias("bt"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    ok = F.abs(det) > F.col("aa") * F.col("bb") * 1e-12
    return s.select(
        key, "branch", "n",
        F.when(ok, (F.col("at") * F.col("bb") - F.col("bt") * F.col("ab")) / det).alias("delta_coeff"),
        F.when(ok, (F.col("bt") * F.col("aa") - F.col("at") * F.col("ab")) / det).alias("rate_coeff"),
    )


def zero_error(df: DataFrame, raw: str = "raw_fs_mps", corrected: str = "corrected_fs_mps", key: str = "serial") -> DataFrame:
    """Per key the median absolute reading before and after correction, and by what part it fell."""
    m = df.groupBy(key).agg(F.percentile(F.abs(F.col(raw)), F.lit(0.5)).alias("raw_error"), F.percentile(F.abs(F.col(corrected)), F.lit(0.5)).alias("corrected_error"))
    return m.withColumn("improvement", F.when(F.col("raw_error") > 0, 1.0 - F.col("corrected_error") / F.col("raw_error")))


def rollup(df: DataFrame, fields: list[str], width: str = "15 minutes", key: str = "serial", ts: str = "ts") -> DataFrame:
    """Per key and time bucket: rows, and avg, min and max of each field."""
    aggs = [f(x).alias(f"{x}_{n}") for x in fields for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("rows"), *aggs).select(key, F.col("w.start").alias("bucket_start"), "rows", *[f"{x}_{n}" for x in fields for n in ("avg", "min", "max")])


def segment_targets(df: DataFrame, segments: DataFrame, residual: str = "raw_fs_mps", key: str = "serial", ts: str = "ts") -> DataFrame:
    """Each zero segment's (key, start, end) target: the median residual of its rows. Segments meet rows by day, then by time."""
    days = segments.withColumn("__day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    rows = df.select(key, ts, residual, F.to_date(ts).alias("__day"))
    hit = rows.join(days, [key, "__day"]).where((F.col(ts) >= F.col("start")) & (F.col(ts) <= F.col("end")))
    return hit.groupBy(key, "start", "end").agg(F.count(F.lit(1)).alias("n"), F.percentile(residual, F.lit(0.5)).alias("target"))
