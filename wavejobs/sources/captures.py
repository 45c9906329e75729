"""Captures, logs and payloads: reading, merging, writing, decoding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavejobs.functions.columns import finite, strict_pipe_area

_SAMPLE = "s_"


def sample_columns(columns: list[str]) -> list[str]:
    """s_0, s_1, ... in the order of their numbers."""
    found = sorted((int(c[2:]), c) for c in columns if c.startswith(_SAMPLE) and c[2:].isdigit())
    if not found:
        raise ValueError("the capture has no sample columns s_0, s_1, ...")
    return [c for _, c in found]


def read_capture(spark: SparkSession, path: str, bad: str = "drop") -> DataFrame:
    """A wide waveform CSV with its samples packed into one array, and where each row is from: source_file and source_row, 1-based in its file.

    bad: what becomes of rows with a sample that isn't a number: drop, keep (null samples) or raise.
    """
    df = spark.read.csv(path, header=True)
    names = sample_columns(df.columns)
    values = F.array(*[F.col(c).try_cast("double") for c in names])
    broken = F.exists(values, lambda v: v.isNull())
    if bad == "raise":
        values = F.when(broken, F.raise_error(F.lit("a sample isn't a number"))).otherwise(values)
    rest = [c for c in df.columns if c not in names]
    samples = F.when(~broken, values) if bad != "raise" else values
    out = with_row_numbers(df).select(*rest, samples.alias("samples"), "source_file", "source_row")
    return out.where("samples IS NOT NULL") if bad == "drop" else out


def with_row_numbers(df: DataFrame) -> DataFrame:
    """Rows read from files with source_file and source_row, 1-based in the file.

    A block of a file is read by one task, from front to back. A row's number is
    its place in its block and the rows of the file's earlier blocks, by the
    blocks' starts in the file's metadata: however files are cut into blocks,
    and blocks dealt to tasks, it is the same.
    """
    at, blocks = F.monotonically_increasing_id(), ["source_file", "__block"]
    own = df.select(*df.columns, F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__block"), at.alias("__at"))
    starts = own.groupBy(*blocks).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("source_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # over a row a block
    starts = starts.select(*blocks, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = own.join(starts, blocks).withColumn("source_row", F.col("__at") - F.col("__first") + F.col("__before") + 1)
    return numbered.select(*df.columns, "source_file", "source_row")


def merge(sources: dict[str, DataFrame], force_label: str | None = None, confirmed_good: bool = False) -> DataFrame:
    """The union of captures with source_dataset, source_file and source_row (as read_capture() has them) and confirmed_good; columns that a source lacks are null.

    Captures with samples, as columns or as read_capture()'s arrays, need equally many of them: a row with another number than the most raises.
    """
    wide = {n: df.columns for n, df in sources.items() if any(c.startswith(_SAMPLE) and c[2:].isdigit() for c in df.columns)}
    if wide:
        check_widths(wide)
    parts = []
    for name, df in sources.items():
        df = df.withColumn("source_dataset", F.lit(name))
        for column, type_ in (("source_file", "string"), ("source_row", "long")):
            df = df if column in df.columns else df.withColumn(column, F.lit(None).cast(type_))
        label = F.lit(force_label) if force_label else (F.col("label") if "label" in df.columns else F.lit(None).cast("string"))
        parts.append(df.withColumn("label", label).withColumn("confirmed_good", F.lit(confirmed_good) | (F.coalesce(F.col("label"), F.lit("")) == "good")))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "samples" not in merged.columns:
        return merged
    widths = merged.where(F.col("samples").isNotNull()).agg(F.max(F.size("samples")).alias("__most"))
    agreed = merged.join(F.broadcast(widths), how="left")  # one row
    fits = F.col("samples").isNull() | (F.size("samples") == F.col("__most"))
    return agreed.withColumn("samples", F.when(fits, F.col("samples")).otherwise(F.raise_error(F.lit("the captures differ in their number of samples")))).drop("__most")


def merge_summary(merged: DataFrame) -> DataFrame:
    return merged.groupBy(F.col("source_dataset").alias("source"), "label").agg(F.count(F.lit(1)).alias("rows"))


def check_widths(captures: dict[str, list[str]]) -> None:
    """Raise unless all captures' columns have the same samples."""
    kinds = {tuple(sample_columns(c)) for c in captures.values()}
    if len(kinds) > 1:
        raise ValueError("the captures' sample columns differ")


def read_log(spark: SparkSession, path: str, schema: str | T.StructType, serial: str | None = None) -> DataFrame:
    """A JSON-lines log: blank lines, lines that aren't JSON and JSON that isn't an object are skipped."""
    text = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{"))
    whole = text.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r")).select("r.*")
    return whole if serial is None else whole.where(F.col("serial") == serial)


def append_log(df: DataFrame, path: str, ts: str = "ts", fmt: str = "parquet") -> None:
    """Append records, partitioned by day."""
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").format(fmt).save(path)


def export_capture(df: DataFrame, path: str, width: int, metadata: list[str], samples: str = "samples") -> None:
    """A CSV of `width` sample columns: longer rows are cut, shorter ones and non-finite samples left blank."""
    wide = [finite(F.get(samples, F.lit(i))).alias(f"{_SAMPLE}{i}") for i in range(width)]
    df.select(*metadata, *wide).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def purge(df: DataFrame, serial: str, key: str = "serial") -> tuple[DataFrame, DataFrame]:
    """(rows that stay: all of other meters or without one, one row with kept and removed)."""
    gone = F.col(key).eqNullSafe(serial)
    return df.where(~gone), df.agg(F.count(F.when(~gone, 1)).alias("kept"), F.count(F.when(gone, 1)).alias("removed"))


def save_reports(reports: DataFrame, path: str) -> None:
    """One report per serial and day; only the days that are written are replaced."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("serial", "date").parquet(path)


def load_history(spark: SparkSession, path: str, serial: str, before: Column | str) -> DataFrame:
    """A meter's earlier reports in the order of date; the partitions of others aren't read. Reports without a health score are left out."""
    reports = spark.read.parquet(path).where((F.col("serial") == serial) & (F.col("date") < F.lit(before).cast("date")))
    return reports.where(F.col("health_score").isNotNull()).orderBy("date")


def save_model(parts: dict[str, DataFrame], path: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def decode_waveform(payload: Column) -> Column:
    """The samples of a payload: a JSON list; else numbers, samples or waveform of an object; else its s_<k> by k; else the bytes over ten."""
    text = payload.cast("string")
    fields = F.from_json(text, "numbers array<double>, samples array<double>, waveform array<double>")
    numbered = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: k.rlike(r"^s_[0-9]+$"))
    by_number = F.transform(F.array_sort(F.transform(F.map_entries(numbered), lambda e: F.struct(F.substring(e["key"], 3, 9).cast("int").alias("k"), e["value"].try_cast("double").alias("v")))), lambda e: e["v"])
    octets = F.hex(payload.cast("binary"))
    raw = F.transform(F.sequence(F.lit(1), F.length(octets) - 1, F.lit(2)), lambda i: F.conv(F.substr(octets, i, F.lit(2)), 16, 10).cast("double") / 10.0)
    is_json = text.rlike(r"^\s*[\[{]")
    return (
        F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<double>"))
        .when(is_json, F.coalesce(fields["numbers"], fields["samples"], fields["waveform"], F.when(F.size(by_number) > 0, by_number)))
        .when(F.length(octets) >= 2, raw)
    )


#: Fields of a waveform payload that go on with its frame, and the names of the onboard temperature, in order. Fixed values.
METADATA = ("timestamp", "serial", "seq", "sq", "temperature_c", "tdc", "direction", "format")
ONBOARD = ("ots", "OTS", "ots_temp_c", "onboard_temperature_c", "onboard_temp_c")


def waveform_metadata(payload: Column) -> Column:
    """A struct of METADATA, as text, and onboard_temperature_c, of a payload that is a JSON object; all null for others."""
    fields = F.from_json(payload.cast("string"), "map<string,string>")
    named = [fields[k] for k in METADATA]
    return F.struct(*[c.alias(k) for c, k in zip(named, METADATA)], finite(F.coalesce(*[fields[k] for k in ONBOARD])).alias("onboard_temperature_c"))


#: What a telemetry message has in each of its parts, and under which name it goes on. Fixed values.
TELEMETRY = {
    "flow": {"fs": "pub_fs_mps", "fr": "pub_fr_m3h", "tfs": "pub_tfs_mps", "tfr": "pub_tfr_m3h", "ft": "pub_flow_total_m3", "ots": "onboard_temperature_c"},
    "raw": {"flow_speed": "raw_flow_speed_mps", "flow_rate": "raw_flow_rate_m3h", "flow_total": "raw_flow_total_m3"},
    "corrected": {
        "zero_corr_fs": "zero_corr_fs_mps", "zero_corr_fr": "zero_corr_fr_m3h", "corr_fs": "corr_fs_mps", "corr_fr": "corr_fr_m3h",
        "flow_speed_zero_offset": "flow_speed_zero_offset_mps", "low_flow_cutoff": "low_flow_cutoff_mps", "pipe_area": "pipe_area_m2",
    },
    "measure_config": {"zero": "measure_zero", "lfc": "measure_lfc", "ledlfc": "measure_ledlfc", "kf": "measure_kf"},
    "diagnose": {"tt": "diagnose_tt_ns", "dt": "diagnose_dt_ns"},
}
#: Second names of some of these. Fixed values.
ALIASES = {"ots": "onboard_temperature_c", "diagnose_tt": "diagnose_tt_ns", "diagnose_dt": "diagnose_dt_ns"}
CLOCKS = ("dt_ns", "pub_dt_ns", "device_dt_ns")
#: Where the signal quality stands, in order. Fixed values.
SQ_PATHS = ("diagnose.sq", "diagnostic.sq", "diag.sq", "payload.diagnose.sq")


def telemetry_fields() -> list[str]:
    """The names of decode_telemetry()'s fields."""
    named = [n for part in TELEMETRY.values() for n in part.values()]
    return ["sq", "device_dt_ns", "pipe_outer_diameter_mm", "pipe_wall_thickness_mm", "pipe_inner_diameter_mm", "pipe_area_from_geometry_m2", *named, *ALIASES]


def decode_telemetry(payload: Column) -> Column:
    """A struct of all that a telemetry message says: telemetry_fields(). The text is parsed once, to a variant; fields are read by path.

    A `payload` that is an object is unwrapped, and then only it counts, but for
    the signal quality, which is looked for outside first. Numbers may be text;
    what isn't a finite number is null. The inner diameter and the area need
    both sizes of the pipe and a bore. The device's clock is the first of CLOCKS
    that is neither null, 0 nor empty; null if that is no positive integer.
    Messages that aren't JSON objects have nulls only.
    """
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")

    def fields(whole: Column) -> Column:
        inner = F.try_variant_get(whole, "$.payload", "variant")
        return _once(F.when(is_object(inner), inner).otherwise(whole), lambda root: _telemetry(whole, root))

    return _once(F.try_parse_json(payload.cast("string")), fields)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _telemetry(whole: Column, root: Column) -> Column:
    number = lambda v, path: finite(F.try_variant_get(v, f"$.{path}", "string"))
    found = {name: number(root, f"{part}.{field}") for part, fields in TELEMETRY.items() for field, name in fields.items()}
    outer, wall = number(root, "pipe.pd"), number(root, "pipe.pt")
    bore = outer - wall * 2.0

    def clock(name: str) -> Column:
        """The clock's ticks, -1 if it can't be read; null if there is none here."""
        text, kind = F.try_variant_get(root, f"$.{name}", "string"), F.schema_of_variant(F.try_variant_get(root, f"$.{name}", "variant"))
        said = F.when(kind == "STRING", F.trim(text).try_cast("long")).otherwise(F.floor(text.try_cast("double")))
        return F.when((text == "") | (kind == "BOOLEAN") | ((kind != "STRING") & (text.try_cast("double") == 0)), None).when(text.isNotNull(), F.coalesce(said, F.lit(-1)))

    ticks = F.coalesce(*[clock(c) for c in CLOCKS])
    return F.struct(
        F.coalesce(*[number(whole, path) for path in SQ_PATHS]).alias("sq"),
        F.when(ticks > 0, ticks).alias("device_dt_ns"),
        outer.alias("pipe_outer_diameter_mm"),
        wall.alias("pipe_wall_thickness_mm"),
        F.when(bore > 0, bore).alias("pipe_inner_diameter_mm"),
        strict_pipe_area(outer, wall).alias("pipe_area_from_geometry_m2"),
        *[c.alias(n) for n, c in found.items()],
        *[found[n].alias(alias) for alias, n in ALIASES.items()],
    )
