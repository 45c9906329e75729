"""The frame table: records to columns, lookups, metadata, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavejobs.functions import waveform
from wavejobs.functions.columns import FEATURES, first_finite
from wavejobs.operators import fit

#: Each number of the frame table and the record fields that it comes from, in order. Fixed values.
NUMBERS = {
    "raw_fs_mps": ("raw_fs_mps", "pub_fs_mps", "raw_flow_speed_mps", "zero_corr_fs_mps", "corr_fs_mps"),
    "raw_fr_m3h": ("raw_fr_m3h", "pub_fr_m3h", "raw_flow_rate_m3h", "zero_corr_fr_m3h", "corr_fr_m3h"),
    "temperature_c": ("temperature_c", "onboard_temperature_c", "ots"),
    "ots_temp_c": ("ots_temp_c", "ots", "onboard_temperature_c"),
    "zero_estimate_fs": ("zero_estimate_fs",),
    "corrected_fs_mps": ("corrected_fs_mps", "corr_fs_mps", "zero_corr_fs_mps"),
    "displayed_gpm": ("displayed_gpm",),
    "phantom_probability": ("phantom_probability",),
    "event_probability": ("event_probability",),
    "zero_probability": ("zero_probability",),
}
TEXTS = {"state_name": ("state_name", "pipe_state", "condition"), "quality_status": ("quality_status", "sq_label", "label")}


def frame_table(records: DataFrame, key: str = "serial", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Records as rows of the frame table: of each number the first finite source, of each text the first that isn't empty."""
    have = set(records.columns)

    def number(sources: tuple[str, ...]) -> Column:
        own = [s for s in sources if s in have]
        return first_finite(*own) if own else F.lit(None).cast("double")

    def text(sources: tuple[str, ...]) -> Column:
        own = [F.when(F.col(s) != "", F.col(s)) for s in sources if s in have]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    return records.select(key, ts, tie, *[number(s).alias(n) for n, s in NUMBERS.items()], *[text(s).alias(n) for n, s in TEXTS.items()])


def lookup(df: DataFrame, value: object, column: str = "waveform_id") -> DataFrame:
    """Rows by id; the filter reaches the scan."""
    return df.where(F.col(column) == F.lit(value))


def with_metadata(results: DataFrame, capture: DataFrame, fields: list[str], row: list[str]) -> DataFrame:
    """Results with the fields of the capture's rows that they come from."""
    return results.join(capture.select(*row, *fields), row, "left")


def outliers(results: DataFrame, by: str, n: int = 20, row: str = "row") -> DataFrame:
    return results.orderBy(F.desc_nulls_last(by), row).limit(n)


def score_summary(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per label: rows, mean and largest score; a null label stands for all rows."""
    return scored.rollup(label).agg(F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"))


def backfill(capture: DataFrame, profile: waveform.Profile, length: int, stats: dict[str, dict[str, float]], suspect: float, anomaly: float, samples: str = "samples") -> DataFrame:
    """A capture's rows as frames with features, score, label and the state that the label stands for; waveforms that can't be read are left out."""
    made = capture.withColumn("__f", waveform.extract(F.col(samples), profile, length)).where("__f.gate_rms_v IS NOT NULL")
    flat = made.select(*[c for c in capture.columns if c != samples], "__f.*")
    scored = fit.labelled(flat.withColumn("score", fit.score(list(FEATURES), stats)), suspect, anomaly)
    return scored.withColumn("pipe_state", F.when(F.col("label") == "anomaly", "waveform_anomaly").when(F.col("label") == "suspect", "signal_quality_suspect").otherwise("normal_acoustic_state"))
