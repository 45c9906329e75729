"""Daily health reports, condition minutes and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavejobs.functions.columns import DAILY_BANDS, band, clamp, micros, py_round, sigma_score

WEIGHTS = {"coupling": 0.30, "signal_strength": 0.20, "sq_quality": 0.20, "stability": 0.15, "incident_burden": 0.15}

#: A day's 5th percentile of the frames' health that is worth a message. Fixed value.
LOW_HEALTH = 60


def intervals(events: DataFrame, detect: str, clear: str, key: str = "serial", ts: str = "ts", tie: str = "id", event: str = "event") -> DataFrame:
    """key, start, end (null if still open) of each detect-to-clear interval; repeated detects and clears without a detect don't count."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    own = events.where(F.col(event).isin(detect, clear)).withColumn("__before", F.lag(event).over(w))
    switches = own.where((F.col(event) == detect) & (F.coalesce("__before", F.lit(clear)) == clear) | (F.col(event) == clear) & (F.col("__before") == detect))
    ended = switches.withColumn("end", F.lead(ts).over(w))
    return ended.where(F.col(event) == detect).select(key, F.col(ts).alias("start"), "end")


def condition_minutes(events: DataFrame, detect: str, clear: str, key: str = "serial", ts: str = "ts", tie: str = "id", event: str = "event", until: Column | None = None) -> DataFrame:
    """Minutes of each day and key inside the condition. An open interval runs to `until`, the end of its last day by default."""
    spans = intervals(events, detect, clear, key, ts, tie, event)
    end = F.coalesce("end", until if until is not None else (F.date_trunc("day", "start") + F.expr("INTERVAL 1 DAY")))
    days = spans.withColumn("end", end).withColumn("date", F.explode(F.sequence(F.to_date("start"), F.to_date(F.col("end") - F.expr("INTERVAL 1 MICROSECOND")))))
    low = F.greatest(F.col("start"), F.col("date").cast("timestamp"))
    high = F.least(F.col("end"), F.date_add("date", 1).cast("timestamp"))
    return days.withColumn("us", micros(high) - micros(low)).where("us > 0").groupBy(key, "date").agg((F.sum("us") / 60e6).alias("minutes"))


def cadence(df: DataFrame, key: str = "serial", ts: str = "ts", tie: str = "id", default: float = 60.0) -> DataFrame:
    """key, date, median_period_s: the median of the positive seconds between a day's frames."""
    w = Window.partitionBy(key, "date").orderBy(ts, tie)
    steps = df.withColumn("date", F.to_date(ts)).withColumn("__s", (micros(ts) - micros(F.lag(ts).over(w))) / 1e6)
    return steps.groupBy(key, "date").agg(F.coalesce(F.expr("percentile(CASE WHEN __s > 0 THEN __s END, 0.5)"), F.lit(default)).alias("median_period_s"))


def report(frames: DataFrame, stats: dict[str, tuple[float, float]], minutes: DataFrame | None = None, key: str = "serial", ts: str = "ts", tie: str = "id", digits: int = 1) -> DataFrame:
    """One row per key and day from frames with template_corr, snr_db, gate_rms_v, sq and label, and `health`, the frames' own, if they have it.

    stats: (center, robust sigma) of the three features. minutes: key, date,
    empty_minutes, air_minutes. Subscores are rounded before they are weighted.
    """
    by = frames.withColumn("date", F.to_date(ts)).groupBy(key, "date")
    daily = by.agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.avg(f).alias(f"mean_{f}") for f in ("template_corr", "snr_db", "gate_rms_v", "sq")],
        F.coalesce(F.stddev_samp("template_corr"), F.lit(0.0)).alias("std_template_corr"),
        F.count(F.when(F.col("label") == "anomaly", 1)).alias("anomaly_frames"),
        F.count(F.when(F.col("label") == "suspect", 1)).alias("suspect_frames"),
        (F.percentile("health", F.lit(0.05)) if "health" in frames.columns else F.lit(None).cast("double")).alias("p05_health"),
    ).join(cadence(frames, key, ts, tie), [key, "date"])
    if minutes is not None:
        daily = daily.join(minutes, [key, "date"], "left")
    else:
        daily = daily.withColumn("empty_minutes", F.lit(0.0)).withColumn("air_minutes", F.lit(0.0))
    daily = daily.fillna(0.0, ["empty_minutes", "air_minutes"])
    score = lambda f: sigma_score(F.col(f"mean_{f}"), F.lit(stats[f][0]), F.lit(stats[f][1]))
    observed = F.col("frames") * F.col("median_period_s") / 60.0
    troubled = F.least(F.col("empty_minutes") + F.col("air_minutes") + (F.col("anomaly_frames") + F.col("suspect_frames") * 0.5) * F.col("median_period_s") / 60.0, observed)
    ratio = F.col("std_template_corr") / max(stats["template_corr"][1], 1e-9)
    subs = {
        "coupling": score("template_corr"),
        "signal_strength": (score("snr_db") + score("gate_rms_v")) * 0.5,
        "sq_quality": clamp(F.coalesce("mean_sq", F.lit(50.0)), 0.0, 100.0),
        "stability": clamp(100.0 - (F.greatest(ratio, F.lit(1.0)) - 1.0) * 12.5, 0.0, 100.0),
        "incident_burden": F.greatest(F.lit(0.0), 100.0 - troubled / F.greatest(observed, F.lit(1.0)) * 100.0),
        "uptime": F.least(F.lit(100.0), F.col("frames") * F.col("median_period_s") / 864.0),
    }
    daily = daily.select("*", *[py_round(c, digits).alias(n) for n, c in subs.items()])
    health = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    return daily.withColumn("health", health).withColumn("health_score", py_round(health, 0).cast("int")).withColumn("band", band(F.col("health"), DAILY_BANDS)).withColumn("highlights", highlights())


def highlights() -> Column:
    """A day's messages, in order; the suspect one only without others before it. That the frames' health dipped goes with any other."""
    n = lambda c: F.format_string("%.0f", py_round(F.col(c).cast("double"), 0))
    first = F.array_compact(
        F.array(
            F.when(F.col("empty_minutes") > 0, F.concat(n("empty_minutes"), F.lit(" min of confirmed empty or lost coupling"))),
            F.when(F.col("air_minutes") > 0, F.concat(n("air_minutes"), F.lit(" min of an air bubble pattern"))),
            F.when(F.col("anomaly_frames") > 0, F.concat(n("anomaly_frames"), F.lit(" anomaly frames"))),
        )
    )
    mild = F.when((F.size(first) == 0) & (F.col("suspect_frames") > 0), F.array(F.concat(n("suspect_frames"), F.lit(" suspect frames")))).otherwise(first)
    every = F.when(F.col("uptime") < 80, F.concat(mild, F.array(F.concat(F.lit("uptime of only "), n("uptime"), F.lit("%"))))).otherwise(mild)
    told = F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("clean day")))
    dipped = F.concat(F.lit("realtime flow health dipped to p05="), n("p05_health"))
    return F.when(F.col("p05_health") < LOW_HEALTH, F.concat(told, F.array(dipped))).otherwise(told)


def trend(reports: DataFrame, columns: list[str], key: str = "serial", date: str = "date", n: int = 7) -> DataFrame:
    """Adds delta_<column>: the value less the median of the key's n reports before, to one decimal; null without any."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(-n, -1)
    return reports.select("*", *[py_round(F.col(c) - F.percentile(c, F.lit(0.5)).over(w), 1).alias(f"delta_{c}") for c in columns])
