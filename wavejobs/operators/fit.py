"""Robust statistics of features, thresholds, templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavejobs.functions.columns import SIGMA_FLOOR, peak_mode, score_label

QUANTILES = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p995": 0.995, "p999": 0.999}
MODE_ROWS = 25


#: One over the part of all ranks by which a sketched quantile may be off.
ACCURACY = 10_000


def quantiles(values: DataFrame, qs: list[float], keys: list[str] = (), value: str = "value", exact: bool = True, accuracy: int = ACCURACY, few_keys: bool = True) -> DataFrame:
    """keys, n and q, an array: linear interpolation between the sorted values at each of qs. Nulls don't count.

    A sketch of each group (combinable, of bounded size) brackets each quantile
    between two values. If not exact, the sketch's values are the answer, at most
    one of `accuracy` parts of all ranks off. Else one more pass counts, before
    its shuffle, the rows of each gap between brackets and those of each value
    inside one, a few of ACCURACY's parts of all. Running counts over a bracket's
    values, sorted on disk where need be, give the value at a rank; no array or
    buffer grows with the data.

    few_keys says that there are few groups (features, modes, splits), so that
    their brackets can be broadcast; else they are joined.
    """
    held = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    at = lambda shift: F.array(*[F.lit(min(1.0, max(0.0, q + shift))) for q in qs])
    sketched = lambda shift: F.percentile_approx("v", at(shift), F.lit(accuracy))
    if not exact:
        return held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketched(0.0).alias("q"))
    few, side = 2.0 / accuracy, F.broadcast if few_keys else (lambda df: df)
    ids = [f"key{i}" for i in range(len(keys))]
    named = held.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], F.lit(0).alias("all"), "v")
    by = ["all", *ids]

    def beside(df: DataFrame, other: DataFrame, *more: str) -> DataFrame:
        """df with other's columns, by `by` and more; null keys are keys."""
        on = [*by, *more]
        renamed = other.select(*[F.col(c).alias(f"o_{c}") for c in on], *[c for c in other.columns if c not in on])
        return df.join(side(renamed), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in on])).drop(*[f"o_{c}" for c in on])

    n = F.count(F.lit(1))
    whole = lambda end: F.array_repeat(end("v"), len(qs))  # noqa: E731  a group of few values is its own bracket
    cut = lambda shift, end: F.when(n <= accuracy, whole(end)).otherwise(sketched(shift))
    bounds = named.groupBy(*by).agg(F.array_sort(F.arrays_zip(cut(-few, F.min).alias("low"), cut(few, F.max).alias("high"))).alias("brackets"))
    # Brackets that touch become one, so that gaps (even parts) and brackets (odd parts) are in the order of their values.
    last = lambda done: F.element_at(done, -1)
    widened = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["low"].alias("low"), F.greatest(last(done)["high"], x["high"]).alias("high"))))
    touching = lambda done, x: (F.size(done) > 0) & (x["low"] <= F.get(done, F.size(done) - 1)["high"])
    joined = F.aggregate("brackets", F.array().cast("array<struct<low: double, high: double>>"), lambda done, x: F.when(touching(done, x), widened(done, x)).otherwise(F.concat(done, F.array(x))))
    ends = [F.get("joined", F.lit(i))[end].alias(f"{end}{i}") for i in range(len(qs)) for end in ("low", "high")]
    met = beside(named, bounds.select(*by, joined.alias("joined")).select(*by, *ends))
    passed = sum((F.coalesce(F.col("v") > F.col(f"high{i}"), F.lit(False)).cast("int") for i in range(len(qs))), F.lit(0))
    inside = F.coalesce(reduce(lambda a, b: a | b, [F.col("v").between(F.col(f"low{i}"), F.col(f"high{i}")) for i in range(len(qs))]), F.lit(False))
    counts = met.groupBy(*by, (passed * 2 + inside.cast("int")).alias("part"), F.when(inside, F.col("v")).alias("v")).agg(n.alias("c"))

    group, upto = Window.partitionBy(*by), Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.groupBy(*by, "part").agg(F.sum("c").alias("in_part"))  # 2 * len(qs) + 1 rows a group at most
    totals = totals.select(*by, "part", F.sum("in_part").over(group).alias("n"), (F.sum("in_part").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_part")).alias("before"))
    running = beside(counts.where("v IS NOT NULL").withColumn("upto", F.sum("c").over(upto)), totals, "part").withColumn("upto", F.col("upto") + F.col("before"))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    at_rank = lambda rank: F.max(F.when((rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto")), F.col("v")))
    found = running.groupBy(*by, "n").agg(*[at_rank(end(place(q))).alias(f"{name}{i}") for i, q in enumerate(qs) for name, end in (("floor", F.floor), ("ceil", F.ceil))])

    def between(i: int, q: float) -> Column:
        low, high = F.floor(place(q)), F.ceil(place(q))
        return F.when(low == high, F.col(f"floor{i}")).otherwise((high - place(q)) * F.col(f"floor{i}") + (place(q) - low) * F.col(f"ceil{i}"))

    return found.select(*[F.col(i).alias(k) for k, i in zip(keys, ids)], "n", F.array(*[between(i, q) for i, q in enumerate(qs)]).alias("q"))


def long_form(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """One row per row and feature: keys, feature, value; missing and non-finite values are left out."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('inf')")


def robust_fit(df: DataFrame, features: list[str], keys: list[str] = (), floors: dict[str, float] | None = None, exact: bool = True) -> DataFrame:
    """Per keys and feature: n, center (median), mad, robust_sigma and the quantiles p01 to p999. There are few keys (modes, splits): tables of one row per key and feature are broadcast."""
    floors = SIGMA_FLOOR if floors is None else floors
    values = long_form(df, features, keys)
    by = [*keys, "feature"]
    centers = quantiles(values, list(QUANTILES.values()), by, exact=exact)
    centers = centers.select(*by, "n", F.col("q")[2].alias("center"), *[F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)])
    away = values.join(F.broadcast(centers.select(*by, "center")), by).select(*by, F.abs(F.col("value") - F.col("center")).alias("value"))
    spread = quantiles(away, [0.5], by, exact=exact).select(*by, F.col("q")[0].alias("mad"))
    floor = F.coalesce(F.create_map(*[x for f in features for x in (F.lit(f), F.lit(float(floors.get(f, 1e-6))))])[F.col("feature")], F.lit(1e-6))
    return centers.join(F.broadcast(spread), by).withColumn("robust_sigma", F.greatest(F.col("mad") * 1.4826, floor))


def stats_of(fit: DataFrame) -> dict[str, dict[str, float]]:
    """A global fit as a dict: one row per feature comes to the driver."""
    return {r["feature"]: r.asDict() for r in fit.collect()}


def z_of(f: str, stats: dict[str, dict[str, float]]) -> Column:
    return F.abs(F.col(f) - stats[f]["center"]) / stats[f]["robust_sigma"]


def score(features: list[str], stats: dict[str, dict[str, float]]) -> Column:
    """Root mean square of the features' z, each cut at 20."""
    total = sum((F.pow(F.least(z_of(f, stats), F.lit(20.0)), F.lit(2.0)) for f in features), F.lit(0.0))
    return F.sqrt(total / len(features))


def reasons(features: list[str], stats: dict[str, dict[str, float]], limit: int = 4) -> Column:
    """The features with the largest z, ties in the order of features: array of (feature, z)."""
    each = F.array(*[F.struct((-z_of(f, stats)).alias("k"), F.lit(i).alias("i"), F.lit(f).alias("feature")) for i, f in enumerate(features)])
    return F.transform(F.slice(F.array_sort(each), 1, limit), lambda x: F.struct(x["feature"].alias("feature"), (-x["k"]).alias("z")))


def score_by_mode(df: DataFrame, features: list[str], global_fit: DataFrame, mode_fit: DataFrame, row: list[str], mode: str = "mode") -> DataFrame:
    """Adds score, with the statistics of a row's mode, or the global ones where the mode has none. Fits have a row per (mode,) feature."""
    values = long_form(df, features, [*row, mode])
    g = global_fit.select("feature", F.col("center").alias("g_center"), F.col("robust_sigma").alias("g_sigma"))
    m = mode_fit.select(F.col("mode").alias(mode), "feature", F.col("center").alias("m_center"), F.col("robust_sigma").alias("m_sigma"))
    joined = values.join(F.broadcast(g), "feature").join(F.broadcast(m), [mode, "feature"], "left")  # four modes of len(features) rows
    z = F.least(F.abs(F.col("value") - F.coalesce("m_center", "g_center")) / F.coalesce("m_sigma", "g_sigma"), F.lit(20.0))
    return joined.groupBy(*row, mode).agg(F.sqrt(F.sum(z * z) / len(features)).alias("score"))


def mode_fits(df: DataFrame, features: list[str], mode: str = "mode", least: int = MODE_ROWS, exact: bool = True) -> DataFrame:
    """robust_fit for each mode that has at least `least` rows."""
    kept = df.groupBy(mode).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(mode)
    fit = robust_fit(df.join(F.broadcast(kept), mode), features, [mode], exact=exact)
    return fit.withColumnRenamed(mode, "mode")


def mode_summary(df: DataFrame, mode: str = "mode", least: int = MODE_ROWS) -> DataFrame:
    counted = df.groupBy(mode).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col(mode).alias("mode"), "rows", (F.col("rows") >= least).alias("enabled"), F.when(F.col("rows") < least, F.lit("too few rows")).alias("reason"))


def thresholds(scored: DataFrame, score_: str = "score", keys: list[str] = (), qs: tuple[float, float] = (0.995, 0.999), exact: bool = True) -> DataFrame:
    out = quantiles(scored, list(qs), list(keys), score_, exact)
    return out.select(*keys, F.col("q")[0].alias("suspect"), F.col("q")[1].alias("anomaly"))


def split_summary(scored: DataFrame, split: str = "split", score_: str = "score", label: str = "label") -> DataFrame:
    """Rows, label counts and score quantiles of each split and, with a null split, of all rows."""
    names = scored.select(F.col(split).alias("part"), F.col(label).alias("label"), F.col(score_).alias("score"))
    both = names.select(F.explode(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("whole")), F.struct(F.lit(None).cast(dict(names.dtypes)["part"]).alias("part"), F.lit(1).alias("whole")))).alias("g"), "label", "score").select("g.*", "label", "score")
    counted = both.groupBy("part", "whole").agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in ("normal", "suspect", "anomaly")])
    levels = quantiles(both, list(QUANTILES.values()), ["part", "whole"], "score").select(F.col("part").alias("p"), F.col("whole").alias("w"), "q")
    q = counted.join(levels, F.col("part").eqNullSafe(F.col("p")) & (F.col("whole") == F.col("w")), "left").withColumnRenamed("part", split)
    return q.select(split, "rows", "normal", "suspect", "anomaly", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)])


def is_train(row: Column, fraction: float) -> Column:
    """The interleaved split: a multiplicative hash of the 1-based row number, below a part of 10,000."""
    # the row goes modulo 2**31 first, so that the product stays a long
    hashed = (F.pmod(row.cast("long"), F.lit(1 << 31)) * 1_103_515_245 + 12_345) % (1 << 31)
    return hashed % 10_000 < int(max(0.01, min(fraction, 0.99)) * 10_000)


def is_train_temporal(row: Column, total: Column, fraction: float) -> Column:
    return row <= F.greatest(F.lit(1), F.least(total - 1, F.floor(total * fraction)))


def template(df: DataFrame, samples: str = "samples", baseline: int = 160, reach: int = 160) -> DataFrame:
    """One row: n, rows, mean_baseline, peak, gate_start, gate_end and template, from the mean waveform.

    Rows have as many samples as the most; the means are partial sums per
    position, so that only one row per position and task is shuffled.
    """
    means = df.select(F.posexplode(samples).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("rows"))
    one = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"), F.max("rows").alias("rows"))
    b = F.least(F.lit(baseline), F.size("mean"))
    head = F.array_sort(F.slice("mean", F.lit(1), b))
    one = one.withColumn("mean_baseline", (F.element_at(head, F.floor((b + 1) / 2).cast("int")) + F.element_at(head, (F.floor(b / 2) + 1).cast("int"))) / 2.0)
    one = one.withColumn("c", F.transform("mean", lambda v: v - F.col("mean_baseline")))
    first = F.least(F.lit(baseline), F.size("c") - 1)
    tail = F.transform(F.slice("c", first + 1, F.size("c")), lambda v: F.abs(v))
    one = one.withColumn("peak", (F.array_position(tail, F.array_max(tail)) - 1 + first).cast("int"))
    one = one.withColumn("gate_start", F.greatest(F.lit(baseline), F.col("peak") - reach)).withColumn("gate_end", F.least(F.size("c"), F.col("peak") + reach))
    return one.select(F.size("c").alias("n"), "rows", "mean_baseline", "peak", "gate_start", "gate_end", F.slice("c", F.col("gate_start") + 1, F.col("gate_end") - F.col("gate_start")).alias("template"))


def keep_labels(df: DataFrame, labels: set[str], column: str = "label") -> DataFrame:
    """Rows with one of the labels, whatever their case and outer spaces; all rows of a capture that has no labels."""
    return df.where(F.lower(F.trim(column)).isin(*sorted(labels))) if column in df.columns else df


EMPTY_PIPE_FEATURES = ("gate_rms_v", "peak_abs_gate_v", "snr_db", "template_corr", "noise_rms_v", "baseline_v", "low_clip_ratio")


def empty_pipe_quantiles(df: DataFrame) -> DataFrame:
    """feature, n and QUANTILES of each of EMPTY_PIPE_FEATURES."""
    q = quantiles(long_form(df, list(EMPTY_PIPE_FEATURES)), list(QUANTILES.values()), ["feature"])
    return q.select("feature", "n", *[F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)])


def empty_pipe_fit(df: DataFrame) -> dict[str, dict[str, float]]:
    """The limits that empty_pipe_score() compares with; seven rows come to the driver."""
    return stats_of(empty_pipe_quantiles(df))


def empty_pipe_score(limits: dict[str, dict[str, float]]) -> tuple[Column, Column]:
    """(score, label): the mean of how far four features are under p05 and p01, and of a missing arrival."""
    low = lambda f: F.when(F.col(f) < limits[f]["p01"], 1.0).when(F.col(f) < limits[f]["p05"], 0.5).otherwise(0.0)
    total = low("gate_rms_v") + low("peak_abs_gate_v") + low("snr_db") + low("template_corr") + F.when(F.col("first_arrival_idx") < 0, 1.0).otherwise(0.0)
    s = total / 5.0
    return s, F.when(s >= 0.6, "empty_pipe_or_lost_acoustic_path").when(s >= 0.3, "suspect").otherwise("normal")


def blocks(df: DataFrame, index: str, size: int = 64, keys: list[str] = ()) -> DataFrame:
    """Each full block of `size` rows by a 0-based index: fractions, spreads, label and severity. An unfinished block is left out."""
    arrived = F.when(F.col("first_arrival_idx") >= 0, F.col("first_arrival_idx"))
    by = df.groupBy(*keys, F.floor(F.col(index) / size).cast("long").alias("block")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") != "normal").cast("double")).alias("suspect_fraction"),
        F.avg((F.col("label") == "empty_pipe_or_lost_acoustic_path").cast("double")).alias("loss_fraction"),
        F.stddev_pop("template_corr").alias("corr_std"),
        (F.stddev_pop("gate_rms_v") / F.greatest(F.avg("gate_rms_v"), F.lit(1e-9))).alias("gate_rms_cv"),
        F.coalesce(F.stddev_pop(arrived), F.lit(0.0)).alias("arrival_std"),
    ).where(F.col("n") == size)
    lost = F.col("loss_fraction") >= 0.60
    air = (F.col("suspect_fraction") >= 0.15) & ((F.col("corr_std") >= 0.010) | (F.col("gate_rms_cv") >= 0.080) | (F.col("arrival_std") >= 4.0))
    shaky = (F.col("corr_std") >= 0.020) | (F.col("gate_rms_cv") >= 0.120) | ((F.col("arrival_std") >= 25.0) & (F.col("suspect_fraction") >= 0.05))
    label = F.when(lost, "sustained_acoustic_loss").when(air, "intermittent_air_or_bubbles").when(shaky, "unstable_acoustic_path").otherwise("normal")
    severity = (
        F.when(lost, F.greatest("loss_fraction", "suspect_fraction"))
        .when(air, F.col("suspect_fraction") + F.least(F.col("corr_std") * 10.0, F.lit(0.3)) + F.least(F.col("gate_rms_cv"), F.lit(0.3)))
        .when(shaky, F.least(F.col("corr_std") * 10.0 + F.col("gate_rms_cv") + F.col("arrival_std") / 50.0, F.lit(1.0)))
        .otherwise(F.col("suspect_fraction"))
    )
    return by.withColumn("event_label", label).withColumn("severity", severity)


def with_mode(df: DataFrame, offset: str = "peak_offset_samples") -> DataFrame:
    return df.withColumn("mode", peak_mode(F.col(offset)))


def labelled(df: DataFrame, suspect: float, anomaly: float, score_: str = "score") -> DataFrame:
    return df.withColumn("label", score_label(F.col(score_), F.lit(suspect), F.lit(anomaly)))


def worst(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def embedding_metric(df: DataFrame, column: str = "embedding", floor: float = 1e-6) -> DataFrame:
    """pos, center, scale of each dimension: its median and 1.4826 times the median deviation."""
    values = df.select(F.posexplode(column).alias("pos", "v")).select("pos", F.col("v").cast("double").alias("v"))
    centers = quantiles(values, [0.5], ["pos"], "v").select("pos", F.col("q")[0].alias("center"))
    away = values.join(F.broadcast(centers), "pos").select("pos", F.abs(F.col("v") - F.col("center")).alias("v"))
    mads = quantiles(away, [0.5], ["pos"], "v").select("pos", F.col("q")[0].alias("mad"))
    return centers.join(mads, "pos").select("pos", "center", F.greatest(F.col("mad") * 1.4826, F.lit(floor)).alias("scale"))


def amplitude_scale(df: DataFrame, samples: str = "samples", baseline: int = 160, q: float = 0.99, floor: float = 0.05) -> DataFrame:
    """One row: the q-quantile of the absolute centered samples of all rows."""
    b = F.array_sort(F.slice(samples, F.lit(1), F.least(F.lit(baseline), F.size(samples))))
    n = F.size("b")
    rows = df.select(F.col(samples).alias("s"), b.alias("b")).where(n > 0)
    middle = (F.element_at("b", F.floor((n + 1) / 2).cast("int")) + F.element_at("b", (F.floor(n / 2) + 1).cast("int"))) / 2.0
    values = rows.withColumn("m", middle).select(F.explode(F.transform("s", lambda v: F.abs(v - F.col("m")))).alias("v"))
    return quantiles(values, [q], value="v").select(F.greatest(F.col("q")[0], F.lit(floor)).alias("scale"))


