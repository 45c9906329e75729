"""Telemetry attached to waveforms by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavejobs.functions.columns import micros, py_round, sq_label
from wavejobs.operators.order import CHUNK, carried, chunked, looking_back

FRESH_MS = 5 * 60 * 1000


def attach(frames: DataFrame, telemetry: DataFrame, key: str = "serial", ts: str = "ts", tie: str = "id", fresh_ms: float = FRESH_MS) -> DataFrame:
    """Frames with sq, sq_age_ms, sq_label and the telemetry's other fields, each as of its own last update.

    telemetry has key, ts, tie, sq and may have dt and meta. sq expires after
    fresh_ms; dt and meta don't, and meta is replaced whole. pub_dt_delta is the
    newest dt less the one before it. Telemetry at the frame's time counts.
    """
    for name, kind in (("sq", "double"), ("dt", "long"), ("meta", "string")):
        if name not in telemetry.columns:
            telemetry = telemetry.withColumn(name, F.lit(None).cast(kind))
    clocked = chunked(telemetry.where(F.col("dt").isNotNull()).select(key, ts, tie, "dt"), key, ts, tie)
    steps = looking_back(clocked, key, 2, CHUNK, __dt=lambda w: F.lag("dt").over(w)).select(key, ts, tie, (F.col("dt") - F.col("__dt")).alias("__step"))
    own = telemetry.select(F.col(key), F.col(ts), F.col(tie), F.lit(0).alias("__side"), "sq", "dt", "meta").join(steps, [key, ts, tie], "left")
    extra = [c for c in frames.columns if c not in (key, ts, tie)]
    both = frames.withColumn("__side", F.lit(1)).unionByName(own, allowMissingColumns=True)
    t = F.col(ts)
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), t.alias("at")))
    filled = carried(both, key, [ts, "__side", tie], ts, __sq=value("sq"), __dt=value("dt"), __meta=value("meta"), __delta=F.when(F.col("dt").isNotNull(), F.struct(F.col("__step").alias("v"))))
    ms = lambda at: (micros(ts) - micros(at)) / 1000.0
    age = ms("__sq.at")
    fresh = age <= fresh_ms
    out = filled.where("__side = 1").select(
        key, ts, tie, *extra,
        F.when(fresh, F.col("__sq.v")).alias("sq"),
        F.when(fresh, age).alias("sq_age_ms"),
        sq_label(F.when(fresh, F.col("__sq.v"))).alias("sq_label"),
        F.col("__dt.v").alias("pub_dt"),
        ms("__dt.at").alias("pub_dt_age_ms"),
        F.col("__delta.v").alias("pub_dt_delta"),
        F.col("__meta.v").alias("meta"),
    )
    return out


def telemetry_only(frames: DataFrame, telemetry: DataFrame, key: str = "serial", ts: str = "ts", tie: str = "id", grace_s: float = 15.0, wait_s: float = 4.0) -> DataFrame:
    """Telemetry rows that stand for a frame: no waveform of the meter within grace_s before, and, if there never was one, wait_s after the meter's first row."""
    both = telemetry.withColumn("__side", F.lit(1)).unionByName(frames.select(key, ts, tie).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    seen = carried(both, key, [ts, "__side", tie], ts, __wave=F.when(F.col("__side") == 0, F.col(ts)))
    first = telemetry.groupBy(key).agg(F.min(ts).alias("__first")).select(F.col(key).alias("__key"), "__first")
    rows = seen.where("__side = 1").join(first, F.col(key) == F.col("__key"))
    since = lambda c: (micros(ts) - micros(c)) / 1e6
    keep = F.when(F.col("__wave").isNotNull(), since("__wave") > grace_s).otherwise(since("__first") >= wait_s)
    return rows.where(keep).select(*telemetry.columns)


def telemetry_confidence(label: Column, has_dt: Column, has_flow: Column) -> Column:
    base = F.when(label == "good", 0.78).when(label == "fair", 0.62).when(label == "poor", 0.40).otherwise(0.54)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.86), base + F.when(has_dt, 0.06).otherwise(0.0) + F.when(has_flow, 0.04).otherwise(0.0)))


def telemetry_health(confidence: Column, label: Column, has_temperature: Column) -> Column:
    """The health of a frame without a waveform: a struct of score (its confidence in percent), label and drivers."""
    known = F.when(label.isNotNull() & (label != "unknown"), F.concat(F.lit("signal quality label: "), label))
    warm = F.when(has_temperature, F.lit("onboard temperature available"))
    first = [F.lit("meter/pub telemetry received"), F.lit("waveform not available for this device")]
    return F.struct(py_round(confidence * 100.0, 1).alias("score"), F.lit("Telemetry only").alias("label"), F.array_compact(F.array(*first, known, warm)).alias("drivers"))


def registered(df: DataFrame, registry: DataFrame, key: str = "serial", order: str = "position", limit: int = 10) -> DataFrame:
    """Rows of the first `limit` distinct meters of a registry, in its order. `limit` bounds the broadcast side."""
    first = registry.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__at")).orderBy("__at", key).limit(limit).select(key)
    return df.join(F.broadcast(first), key, "left_semi")
