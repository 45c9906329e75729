"""Realtime health of a frame, and the gate for frames that a profile may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavejobs.functions.columns import HEALTH_BANDS, age_penalty, anomaly_points, band, clamp, py_round, sigma_score
from wavejobs.operators.states import EMPTY, SATURATED, WEAK

WEIGHTS = {"signal_integrity": 0.30, "acoustic_pattern_match": 0.25, "coupling_condition": 0.20, "temporal_stability": 0.15, "telemetry_reliability": 0.10}


def blended(pattern: Column, evidence: Column | None, weight: float) -> Column:
    """The pattern match with its weight of a second one, where there is one."""
    w = min(1.0, max(0.0, weight))
    return pattern if evidence is None else F.coalesce(pattern * (1 - w) + evidence * w, pattern)


def health(df: DataFrame, stats: dict[str, dict[str, float]], suspect: float, anomaly: float, evidence: Column | None = None, weight: float = 0.5, air_threshold: float | None = None) -> DataFrame:
    """Adds the five subscores, health, health_label and drivers (the three lowest subscores).

    df has the features, score, label, pipe_state, sq, sq_age_ms, sq_label,
    pub_dt_age_ms, empty_pipe, air_bubble and corr_std. evidence is a second
    pattern match from 0 to 100, null where there is none; it gets `weight`.
    Subscores are rounded before they are weighted.
    """
    z = lambda f, points=25.0, up=True: sigma_score(F.col(f), F.lit(stats[f]["center"]), F.lit(stats[f]["robust_sigma"]), points, up)
    pattern = blended(anomaly_points(F.col("score"), F.lit(suspect), F.lit(anomaly)), evidence, weight)
    coupling = z("template_corr") * 0.45 + z("peak_abs_gate_v") * 0.25 + z("low_clip_ratio", 35.0, False) * 0.15 + z("high_clip_ratio", 50.0, False) * 0.15
    state = F.col("pipe_state")
    most = F.when((state == EMPTY) | F.col("empty_pipe"), 35.0).when(state == WEAK, 65.0).when(state == SATURATED, 55.0).otherwise(100.0)
    steady = F.lit(100.0)
    if air_threshold:
        steady = F.when(F.col("corr_std").isNotNull(), clamp(100.0 - F.greatest(F.col("corr_std") / air_threshold - 0.5, F.lit(0.0)) * 80.0, 0.0, 100.0)).otherwise(100.0)
    reliable = clamp(F.coalesce("sq", F.lit(50.0)), 0.0, 100.0) - age_penalty(F.col("sq_age_ms"), 300_000.0, 30.0) - age_penalty(F.col("pub_dt_age_ms"), 5_000.0, 20.0)
    subs = {
        "signal_integrity": z("snr_db") * 0.45 + z("gate_rms_v") * 0.35 + z("noise_rms_v", up=False) * 0.20,
        "acoustic_pattern_match": pattern,
        "coupling_condition": F.least(coupling, most),
        "temporal_stability": F.when(F.col("air_bubble"), F.least(steady, F.lit(55.0))).otherwise(steady),
        "telemetry_reliability": F.when(F.col("sq_label") == "unknown", F.least(reliable, F.lit(60.0))).otherwise(reliable),
    }
    out = df.select("*", *[py_round(clamp(c, 0.0, 100.0), 1).alias(n) for n, c in subs.items()])
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    total = F.when(F.col("label") == "anomaly", F.least(total, F.lit(55.0))).when(F.col("label") == "suspect", F.least(total, F.lit(74.0))).otherwise(total)
    total = F.when(F.col("empty_pipe"), F.least(total, F.lit(35.0))).otherwise(total)
    total = F.when(F.col("air_bubble"), F.least(total, F.lit(65.0))).otherwise(total)
    lowest = F.array_sort(F.array(*[F.struct(F.col(n).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(WEIGHTS)]))
    return out.withColumn("health", py_round(total, 1)).withColumn("health_label", band(total, HEALTH_BANDS)).withColumn("drivers", F.transform(F.slice(lowest, 1, 3), lambda x: x["n"]))


def training_gate(stats: dict[str, dict[str, float]], suspect: float, headroom: float = 0.95, stale_ms: float = 5000.0, percentile: str = "p05", allow: tuple[str, ...] = ("good",)) -> Column:
    """Why a frame may not train a profile: the first check that fails; null if it may. allow: labels of signal quality that may."""
    return (
        F.when(F.col("sq_label").isNotNull() & ~F.col("sq_label").isin(*allow), F.concat(F.lit("sq_label_"), "sq_label"))
        .when(F.col("pub_dt_age_ms") > stale_ms, "pub_dt_stale")
        .when(F.col("label") != "normal", F.concat(F.lit("label_"), "label"))
        .when(F.col("score") > suspect * headroom, "score_not_low_enough")
        .when(F.col("template_corr") < stats["template_corr"][percentile], f"template_corr_below_{percentile}")
        .when(F.col("snr_db") < stats["snr_db"][percentile], f"snr_below_{percentile}")
        .when(F.col("gate_rms_v") < stats["gate_rms_v"][percentile], f"gate_energy_below_{percentile}")
        .when(F.col("low_clip_ratio") > max(stats["low_clip_ratio"]["p95"] + 0.01, 0.07), "low_clipping_too_high")
        .when(F.col("high_clip_ratio") > 0.001, "high_clipping_present")
    )
