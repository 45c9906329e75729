"""The registered queries on the driver tables and their DuckDB SQL.

In `events` a user is a meter: user_id is the serial, value a measured value,
props.k the signal quality, and event types stand for raw states. Vectors of
`embeddings` are short waveforms.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavejobs.functions import columns as c
from wavejobs.functions import waveform
from wavejobs.operators import adapt, asof, audit, cluster, daily, drift, fit, health, history, neighbors, states, zero
from wavejobs.operators import frames as frame_ops
from wavejobs.operators.order import numbered
from wavejobs.sources import captures
from wavejobs.sources.tables import table
from wavejobs.streaming import frames as stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql.replace("FRAMES", FRAMES_SQL)
        return f

    return add


FRAMES_SQL = """(SELECT user_id AS serial, ts, event_id AS id, value, event_type, json_extract_string(props, '$.k')::DOUBLE AS sq,
CASE event_type WHEN 'click' THEN 'weak_signal_or_air_candidate' WHEN 'error' THEN 'empty_or_lost_acoustic_path_candidate' WHEN 'purchase' THEN 'waveform_anomaly' ELSE 'normal_acoustic_state' END AS raw_state FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    raw = F.when(kind == "click", states.WEAK).when(kind == "error", states.EMPTY).when(kind == "purchase", "waveform_anomaly").otherwise(states.NORMAL)
    return e.select(F.col("user_id").alias("serial"), "ts", F.col("event_id").alias("id"), "value", "event_type", F.get_json_object("props", "$.k").try_cast("double").alias("sq"), raw.alias("raw_state"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY serial ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY serial) AS t FROM FRAMES),
b AS (SELECT *, CASE WHEN t <= 20 THEN i ELSE ((i + 1) * 20 - 1) // t END AS bucket FROM n)
SELECT serial, bucket::BIGINT AS bucket, count(*) AS count, max(ts) AS ts, avg(value) AS value_avg, min(value) AS value_min, max(value) AS value_max, arg_max(value, id) AS value_latest, arg_max(event_type, id) AS event_type
FROM b GROUP BY ALL""")
def r2_bounded_series(spark, sf_dir):
    return history.series(frames(spark, sf_dir), ["value"], ["event_type"], 20)


@query("SELECT serial, arg_max(id, ts) AS id, max(ts) AS ts, arg_max(value, ts) AS value, arg_max(sq, ts) AS sq FROM FRAMES GROUP BY ALL")
def r1_latest(spark, sf_dir):
    return history.latest(frames(spark, sf_dir)).select("serial", "id", "ts", "value", "sq")


@query("""SELECT serial, id, ts, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY serial ORDER BY ts DESC, id DESC) AS rank FROM FRAMES
WHERE ts >= TIMESTAMP '2024-01-10' AND event_type IN ('error', 'click')) WHERE rank <= 5""")
def r3_recent_events(spark, sf_dir):
    recent = history.since(frames(spark, sf_dir), datetime(2024, 1, 10)).where(F.col("event_type").isin("error", "click"))
    return history.newest(recent, 5).select("serial", "id", "ts", "event_type", F.col("rank").cast("long").alias("rank"))


@query("SELECT serial, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY serial ORDER BY ts DESC, id DESC) AS rank FROM FRAMES) WHERE rank <= 10")
def r4_tail(spark, sf_dir):
    return history.newest(frames(spark, sf_dir), 10).select("serial", "id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT CASE WHEN sq IS NULL THEN 'unknown' WHEN sq < 50 THEN 'poor' WHEN sq < 80 THEN 'fair' ELSE 'good' END AS sq_label, count(*) AS n, avg(value) AS mean_value FROM FRAMES GROUP BY ALL""")
def p7_sq_label(spark, sf_dir):
    return frames(spark, sf_dir).groupBy(c.sq_label(F.col("sq")).alias("sq_label")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


@query("""SELECT event_id, ((event_id % 2147483648) * 1103515245 + 12345) % 2147483648 % 10000 < 7000 AS train FROM events""")
def p12_interleaved_split(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fit.is_train(F.col("event_id"), 0.7).alias("train"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity AS outer_mm, l_tax * 100 AS wall_mm, l_discount AS fs FROM lineitem),
b AS (SELECT *, greatest(greatest(outer_mm, 1) - 2 * greatest(wall_mm, 0), 0.1) / 1000.0 AS bore FROM g)
SELECT l_orderkey, l_linenumber, round(pi() * bore * bore / 4 * 1e9, 3) AS area, round(fs * pi() * bore * bore / 4 * 3600 * 4.4028675393 * 1e6, 3) AS flow FROM b""")
def p13_pipe_geometry(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    area = c.pipe_area(F.col("l_quantity"), F.col("l_tax") * 100)
    return li.select("l_orderkey", "l_linenumber", F.round(area * 1e9, 3).alias("area"), F.round(c.gpm(c.flow_rate(F.col("l_discount"), area)) * 1e6, 3).alias("flow"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
b AS (SELECT vec_id, e, list_sort(e)[len(e) // 2 + 1] AS baseline FROM s), a AS (SELECT *, list_transform(e, lambda x: abs(x - baseline)) AS d FROM b)
SELECT vec_id, len(e)::INT AS sample_count, baseline, list_position(d, list_max(d))::BIGINT - 1 AS peak_index, list_max(d) AS peak_abs FROM a""")
def p14_waveform_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", waveform.summary(F.col("embedding").cast("array<double>")).alias("s"))
    return e.select("vec_id", "s.sample_count", "s.baseline", "s.peak_index", "s.peak_abs")


def short_profile(waves: DataFrame) -> DataFrame:
    return fit.template(waves, "samples", 16, 16)


def waves_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))


TEMPLATE_SQL = """m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL),
base AS (SELECT median(m) AS b FROM m WHERE i < 16), cm AS (SELECT i, m - b AS v, b FROM m, base), pk AS (SELECT arg_max(i, (abs(v), -i)) AS peak FROM cm WHERE i >= 16),
gate AS (SELECT peak, greatest(16, peak - 16) AS g0, least(64, peak + 16) AS g1 FROM pk)"""


@query(f"""WITH {TEMPLATE_SQL} SELECT i AS pos, round(v, 9) AS value, peak::INT AS peak FROM cm, gate WHERE i >= g0 AND i < g1""")
def f1_template(spark, sf_dir):
    t = short_profile(waves_of(spark, sf_dir))
    return t.select(F.posexplode("template").alias("pos", "v"), "gate_start", "peak").select((F.col("pos") + F.col("gate_start")).cast("long").alias("pos"), F.round("v", 9).alias("value"), "peak")


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = waves_of(spark, sf_dir)
    row = short_profile(waves).first()  # one row
    p = waveform.Profile.from_row(row, baseline=16, low=-0.2, high=0.2)
    return waves.select("vec_id", "label", waveform.extract(F.col("samples"), p, 64).alias("f")).select("vec_id", "label", "f.*")


@query(f"""WITH {TEMPLATE_SQL}, tm AS (SELECT list(v ORDER BY i) AS t FROM cm, gate WHERE i >= g0 AND i < g1),
w AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), h AS (SELECT vec_id, e, list_median(e[1:16]) AS b FROM w),
k AS (SELECT vec_id, e, b, list_transform(e, lambda x: x - b) AS z, t, g0, g1, peak FROM h, tm, gate),
g AS (SELECT *, z[g0 + 1:g1] AS gt, sqrt(list_sum(list_transform(z[1:16], lambda x: x * x)) / 16) AS noise FROM k),
s AS (SELECT *, sqrt(list_sum(list_transform(gt, lambda x: x * x)) / len(gt)) AS energy, list_transform(gt, lambda x: abs(x)) AS a FROM g)
SELECT vec_id, round(b, 8) AS baseline_v, round(noise, 8) AS noise_rms_v, round(energy, 8) AS gate_rms_v, round(list_max(a), 8) AS peak_abs_gate_v, round(20 * log10(greatest(energy, 1e-9) / greatest(noise, 1e-9)), 6) AS snr_db,
round(list_dot_product(gt, t) / sqrt(list_dot_product(gt, gt) * list_dot_product(t, t)), 7) AS template_corr, (g0 + list_position(a, list_max(a)) - 1 - peak)::DOUBLE AS peak_offset_samples,
round(len(list_filter(e, lambda x: x <= -0.2)) / 64.0, 8)::DOUBLE AS low_clip_ratio, round(list_max(e) - list_min(e), 8) AS ptp_v FROM s""")
def f2_waveform_features(spark, sf_dir):
    d = featured(spark, sf_dir)
    places = {"baseline_v": 8, "noise_rms_v": 8, "gate_rms_v": 8, "peak_abs_gate_v": 8, "snr_db": 6, "template_corr": 7, "peak_offset_samples": 1, "low_clip_ratio": 8, "ptp_v": 8}
    return d.select("vec_id", *[F.round(f, n).alias(f) for f, n in places.items()])


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG_SQL = "unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value"
FIT_SQL = f"""v AS (SELECT l_returnflag, {LONG_SQL} FROM lineitem), cen AS (SELECT feature, count(*) AS n, median(value) AS center, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.999) AS p999 FROM v GROUP BY ALL),
mads AS (SELECT feature, median(abs(value - center)) AS mad FROM v JOIN cen USING (feature) GROUP BY ALL), fit AS (SELECT *, greatest(1.4826 * mad, 1e-6) AS sigma FROM cen JOIN mads USING (feature))"""


@query(f"WITH {FIT_SQL} SELECT feature, n, round(center, 6) AS center, round(mad, 6) AS mad, round(sigma, 6) AS robust_sigma, round(p01, 6) AS p01, round(p999, 6) AS p999 FROM fit")
def f4_robust_fit(spark, sf_dir):
    out = fit.robust_fit(table(spark, sf_dir, "lineitem"), LINE_FEATURES)
    return out.select("feature", "n", *[F.round(x, 6).alias(x) for x in ("center", "mad", "robust_sigma", "p01", "p999")])


SCORED_SQL = f"""{FIT_SQL}, keyed AS (SELECT rid, l_orderkey, l_linenumber, l_returnflag, {LONG_SQL} FROM (SELECT *, row_number() OVER () AS rid FROM lineitem)),
sc AS (SELECT rid, l_orderkey, l_linenumber, l_returnflag, sqrt(sum(least(abs(value - center) / sigma, 20) ** 2) / 4) AS score FROM keyed JOIN fit USING (feature) GROUP BY ALL)"""


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    stats = fit.stats_of(fit.robust_fit(li, LINE_FEATURES))
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", fit.score(LINE_FEATURES, stats).alias("score"), F.transform(fit.reasons(LINE_FEATURES, stats, 2), lambda x: x["feature"]).alias("reasons"))


@query(f"""WITH {SCORED_SQL} SELECT l_orderkey, l_linenumber, round(score, 6) AS score, CASE WHEN score >= 2 THEN 'anomaly' WHEN score >= 1.2 THEN 'suspect' ELSE 'normal' END AS label FROM sc""")
def f5_score_label(spark, sf_dir):
    d = fit.labelled(scored_lines(spark, sf_dir), 1.2, 2.0)
    return d.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "label")


@query(f"""WITH {FIT_SQL}, z AS (SELECT rid, l_orderkey, l_linenumber, unnest([1, 2, 3, 4]) AS o, {LONG_SQL} FROM (SELECT *, row_number() OVER () AS rid FROM lineitem)),
r AS (SELECT rid, l_orderkey, l_linenumber, feature, row_number() OVER (PARTITION BY rid ORDER BY abs(value - center) / sigma DESC, o) AS k FROM z JOIN fit USING (feature))
SELECT l_orderkey, l_linenumber, max(feature) FILTER (k = 1) AS first, max(feature) FILTER (k = 2) AS second FROM r GROUP BY rid, l_orderkey, l_linenumber""")
def f6_top_reasons(spark, sf_dir):
    return scored_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("reasons")[0].alias("first"), F.col("reasons")[1].alias("second"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity - 60 * l_discount * 10 AS off FROM lineitem)
SELECT CASE WHEN off <= -50 THEN 'peak_minus_100' WHEN off >= 25 THEN 'peak_plus_50' WHEN off BETWEEN -25 AND 25 THEN 'peak_center' ELSE 'peak_other' END AS mode, count(*) AS n FROM o GROUP BY ALL""")
def f7_peak_mode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(c.peak_mode(F.col("l_quantity") - F.lit(60) * F.col("l_discount") * 10).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


MODE_SQL = f"""{FIT_SQL}, mv AS (SELECT l_returnflag || l_linestatus AS mode, {LONG_SQL} FROM lineitem), mc AS (SELECT mode, feature, count(*) AS n, median(value) AS center FROM mv GROUP BY ALL HAVING count(*) >= 1000),
mm AS (SELECT mode, mv.feature, median(abs(value - center)) AS mad FROM mv JOIN mc USING (mode, feature) GROUP BY ALL),
mf AS (SELECT mode, feature, n, center, mad, greatest(1.4826 * mad, 1e-6) AS sigma FROM mc JOIN mm USING (mode, feature))"""


def moded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a mode; one mode has few lines, which may be too few for a model of its own."""
    return table(spark, sf_dir, "lineitem").withColumn("mode", F.concat("l_returnflag", "l_linestatus"))


@query(f"WITH {MODE_SQL} SELECT mode, feature, n, round(center, 6) AS center, round(sigma, 6) AS robust_sigma FROM mf")
def f8_mode_models(spark, sf_dir):
    out = fit.mode_fits(moded_lines(spark, sf_dir), LINE_FEATURES, least=1000)
    return out.select("mode", "feature", "n", F.round("center", 6).alias("center"), F.round("robust_sigma", 6).alias("robust_sigma"))


@query(f"""WITH {SCORED_SQL} SELECT l_returnflag, round(quantile_cont(score, 0.995), 6) AS suspect, round(quantile_cont(score, 0.999), 6) AS anomaly FROM sc GROUP BY ALL""")
def f9_thresholds(spark, sf_dir):
    t = fit.thresholds(scored_lines(spark, sf_dir), keys=["l_returnflag"])
    return t.select("l_returnflag", F.round("suspect", 6).alias("suspect"), F.round("anomaly", 6).alias("anomaly"))


@query(f"""WITH {MODE_SQL}, keyed AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS mode, {LONG_SQL} FROM lineitem)
SELECT l_orderkey, l_linenumber, keyed.mode, round(sqrt(sum(least(abs(value - coalesce(mf.center, fit.center)) / coalesce(mf.sigma, fit.sigma), 20) ** 2) / 4), 6) AS score
FROM keyed JOIN fit ON keyed.feature = fit.feature LEFT JOIN mf ON mf.mode = keyed.mode AND mf.feature = keyed.feature GROUP BY ALL""")
def f10_mode_fallback_score(spark, sf_dir):
    li = moded_lines(spark, sf_dir)
    modes = fit.mode_fits(li, LINE_FEATURES, least=1000)
    out = fit.score_by_mode(li, LINE_FEATURES, fit.robust_fit(li, LINE_FEATURES), modes, ["l_orderkey", "l_linenumber"])
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {SCORED_SQL}, lab AS (SELECT *, CASE WHEN score >= 2 THEN 'anomaly' WHEN score >= 1.2 THEN 'suspect' ELSE 'normal' END AS label FROM sc)
SELECT l_returnflag AS split, count(*) AS rows, count(*) FILTER (label = 'normal') AS normal, count(*) FILTER (label = 'suspect') AS suspect, count(*) FILTER (label = 'anomaly') AS anomaly, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.99), 6) AS p99
FROM lab GROUP BY ROLLUP (l_returnflag)""")
def f11_split_summary(spark, sf_dir):
    d = fit.labelled(scored_lines(spark, sf_dir), 1.2, 2.0).withColumnRenamed("l_returnflag", "split")
    return fit.split_summary(d).select("split", "rows", "normal", "suspect", "anomaly", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


BLOCK_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY serial ORDER BY ts, id) - 1 AS i FROM FRAMES),
f AS (SELECT serial, i // 16 AS block, value / 1000 AS corr, 1 + sq / 100 AS rms, CASE WHEN sq >= 20 THEN sq END AS arr, CASE event_type WHEN 'error' THEN 'empty_pipe_or_lost_acoustic_path' WHEN 'click' THEN 'suspect' ELSE 'normal' END AS label FROM n)"""


@query(f"""WITH {BLOCK_SQL}, b AS (SELECT serial, block, count(*) AS n, avg((label <> 'normal')::INT) AS sf, avg((label = 'empty_pipe_or_lost_acoustic_path')::INT) AS lf, stddev_pop(corr) AS cs, stddev_pop(rms) / greatest(avg(rms), 1e-9) AS cv, coalesce(stddev_pop(arr), 0) AS a FROM f GROUP BY ALL HAVING count(*) = 16)
SELECT serial, block, round(sf, 6) AS suspect_fraction, round(cs, 6) AS corr_std, round(a, 6) AS arrival_std,
CASE WHEN lf >= 0.6 THEN 'sustained_acoustic_loss' WHEN sf >= 0.15 AND (cs >= 0.01 OR cv >= 0.08 OR a >= 4) THEN 'intermittent_air_or_bubbles' WHEN cs >= 0.02 OR cv >= 0.12 OR (a >= 25 AND sf >= 0.05) THEN 'unstable_acoustic_path' ELSE 'normal' END AS event_label FROM b""")
def f15_block_events(spark, sf_dir):
    d = numbered(frames(spark, sf_dir), "serial", "ts", "id").select(
        "serial", "index", (F.col("value") / 1000).alias("template_corr"), (F.col("sq") / 100 + 1).alias("gate_rms_v"),
        F.when(F.col("sq") >= 20, F.col("sq")).otherwise(-1).alias("first_arrival_idx"),
        F.when(F.col("event_type") == "error", "empty_pipe_or_lost_acoustic_path").when(F.col("event_type") == "click", "suspect").otherwise("normal").alias("label"),
    )
    out = fit.blocks(d, "index", 16, ["serial"])
    return out.select("serial", "block", *[F.round(x, 6).alias(x) for x in ("suspect_fraction", "corr_std", "arrival_std")], "event_label")


@query("""WITH lim AS (SELECT quantile_cont(l_quantity, 0.01) q1, quantile_cont(l_quantity, 0.05) q5, quantile_cont(l_extendedprice, 0.01) e1, quantile_cont(l_extendedprice, 0.05) e5, quantile_cont(l_discount, 0.01) d1, quantile_cont(l_discount, 0.05) d5, quantile_cont(l_tax, 0.01) t1, quantile_cont(l_tax, 0.05) t5 FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, ((CASE WHEN l_quantity < q1 THEN 1 WHEN l_quantity < q5 THEN 0.5 ELSE 0 END) + (CASE WHEN l_extendedprice < e1 THEN 1 WHEN l_extendedprice < e5 THEN 0.5 ELSE 0 END) + (CASE WHEN l_discount < d1 THEN 1 WHEN l_discount < d5 THEN 0.5 ELSE 0 END)
 + (CASE WHEN l_tax < t1 THEN 1 WHEN l_tax < t5 THEN 0.5 ELSE 0 END) + (CASE WHEN l_linenumber < 2 THEN 1 ELSE 0 END))::DOUBLE / 5 AS score FROM lineitem, lim)
SELECT l_orderkey, l_linenumber, round(score, 6) AS score, CASE WHEN score >= 0.6 THEN 'empty_pipe_or_lost_acoustic_path' WHEN score >= 0.3 THEN 'suspect' ELSE 'normal' END AS label FROM s""")
def f14_empty_pipe_score(spark, sf_dir):
    names = {"l_quantity": "gate_rms_v", "l_extendedprice": "peak_abs_gate_v", "l_discount": "snr_db", "l_tax": "template_corr"}
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(a).alias(b) for a, b in names.items()], (F.col("l_linenumber") - 2).alias("first_arrival_idx"))
    score, label = fit.empty_pipe_score(fit.stats_of(fit.robust_fit(li, list(names.values()))))
    return li.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"), label.alias("label"))


@query("""SELECT pos, round(center, 9) AS center, round(greatest(1.4826 * mad, 1e-6), 9) AS scale FROM (SELECT pos, center, median(abs(v - center)) AS mad FROM
(SELECT unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings) JOIN (SELECT pos, median(v) AS center FROM (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL) USING (pos) GROUP BY ALL)""")
def e5_embedding_metric(spark, sf_dir):
    out = fit.embedding_metric(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("pos").cast("long").alias("pos"), F.round("center", 9).alias("center"), F.round("scale", 9).alias("scale"))


@query("""WITH b AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT e, list_median(e[1:16]) AS b FROM b)
SELECT round(greatest(quantile_cont(abs(x - b), 0.99), 0.05), 9) AS scale FROM (SELECT unnest(e) AS x, b FROM m)""")
def e2_amplitude_scale(spark, sf_dir):
    return fit.amplitude_scale(waves_of(spark, sf_dir), "samples", 16).select(F.round("scale", 9).alias("scale"))


ASOF_SQL = """t AS (SELECT serial, ts, id, sq FROM FRAMES WHERE event_type IN ('purchase', 'signup')), w AS (SELECT serial, ts, id, value FROM FRAMES WHERE event_type NOT IN ('purchase', 'signup')),
j AS (SELECT w.*, t.sq AS tsq, t.ts AS tts, t.id AS tid FROM w ASOF LEFT JOIN t ON w.serial = t.serial AND w.ts >= t.ts)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, sf_dir)
    telemetry = F.col("event_type").isin("purchase", "signup")
    return f.where(~telemetry).select("serial", "ts", "id", "value"), f.where(telemetry).select("serial", "ts", "id", "sq", F.col("id").alias("dt"))


@query(f"""WITH {ASOF_SQL}, s AS (SELECT *, epoch_us(ts) - epoch_us(tts) AS age FROM j)
SELECT serial, id, CASE WHEN age <= 21600000000 THEN tsq END AS sq, CASE WHEN age <= 21600000000 THEN CASE WHEN tsq < 50 THEN 'poor' WHEN tsq < 80 THEN 'fair' ELSE 'good' END ELSE 'unknown' END AS sq_label, tid AS pub_dt, round(age / 1000, 3) AS pub_dt_age_ms FROM s""")
def j1_asof_telemetry(spark, sf_dir):
    waves, telemetry = sides(spark, sf_dir)
    out = asof.attach(waves, telemetry, fresh_ms=6 * 3600 * 1000)
    return out.select("serial", "id", "sq", "sq_label", "pub_dt", F.round("pub_dt_age_ms", 3).alias("pub_dt_age_ms"))


@query("""WITH t AS (SELECT serial, ts, id, id - lag(id) OVER (PARTITION BY serial ORDER BY ts, id) AS delta FROM FRAMES WHERE event_type IN ('purchase', 'signup')), w AS (SELECT serial, ts, id FROM FRAMES WHERE event_type NOT IN ('purchase', 'signup'))
SELECT w.serial, w.id, t.delta AS pub_dt_delta FROM w ASOF LEFT JOIN t ON w.serial = t.serial AND w.ts >= t.ts""")
def j3_device_time_delta(spark, sf_dir):
    return asof.attach(*sides(spark, sf_dir)).select("serial", "id", "pub_dt_delta")


@query("""WITH t AS (SELECT serial, ts, id FROM FRAMES WHERE event_type IN ('purchase', 'signup')), w AS (SELECT serial, ts FROM FRAMES WHERE event_type NOT IN ('purchase', 'signup')),
f AS (SELECT serial, min(ts) AS first FROM t GROUP BY ALL), j AS (SELECT t.*, w.ts AS wts FROM t ASOF LEFT JOIN w ON t.serial = w.serial AND t.ts >= w.ts)
SELECT serial, id FROM j JOIN f USING (serial) WHERE CASE WHEN wts IS NOT NULL THEN epoch_us(ts) - epoch_us(wts) > 43200000000 ELSE epoch_us(ts) - epoch_us(first) >= 3600000000 END""")
def j4_telemetry_only(spark, sf_dir):
    waves, telemetry = sides(spark, sf_dir)
    return asof.telemetry_only(waves, telemetry, grace_s=12 * 3600, wait_s=3600).select("serial", "id")


@query("""WITH r AS (SELECT c_custkey AS serial FROM customer GROUP BY ALL ORDER BY min(c_acctbal), serial LIMIT 10) SELECT serial, id, value FROM FRAMES WHERE serial IN (SELECT serial FROM r)""")
def j6_registered_meters(spark, sf_dir):
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("serial"), F.col("c_acctbal").alias("position"))
    return asof.registered(frames(spark, sf_dir), registry).select("serial", "id", "value")


INTERVAL_SQL = """o AS (SELECT serial, ts, id, event_type AS e, lag(event_type) OVER (PARTITION BY serial ORDER BY ts, id) AS p FROM FRAMES WHERE event_type IN ('error', 'view')),
s AS (SELECT *, lead(ts) OVER (PARTITION BY serial ORDER BY ts, id) AS nx FROM o WHERE (e = 'error' AND coalesce(p, 'view') = 'view') OR (e = 'view' AND p = 'error')),
iv AS (SELECT serial, ts AS a, coalesce(nx, date_trunc('day', ts) + INTERVAL 1 DAY) AS b FROM s WHERE e = 'error'),
d AS (SELECT *, unnest(generate_series(date_trunc('day', a), date_trunc('day', b - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS day FROM iv),
cm AS (SELECT serial, day::DATE AS date, sum(epoch_us(least(b, day + INTERVAL 1 DAY)) - epoch_us(greatest(a, day))) / 60e6 AS minutes FROM d WHERE least(b, day + INTERVAL 1 DAY) > greatest(a, day) GROUP BY ALL)"""


@query(f"WITH {INTERVAL_SQL} SELECT serial, date, round(minutes, 6) AS minutes FROM cm")
def j7_condition_minutes(spark, sf_dir):
    out = daily.condition_minutes(frames(spark, sf_dir), "error", "view", event="event_type")
    return out.select("serial", "date", F.round("minutes", 6).alias("minutes"))


DEBOUNCE_SQL = """a AS (SELECT *, CASE WHEN raw_state = lag(raw_state) OVER w THEN 0 ELSE 1 END AS nw FROM FRAMES WINDOW w AS (PARTITION BY serial ORDER BY ts, id)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY serial ORDER BY ts, id) AS run FROM a), q AS (SELECT *, row_number() OVER (PARTITION BY serial, run ORDER BY ts, id) AS pos FROM r),
db AS (SELECT *, coalesce(last_value(CASE WHEN pos >= (CASE WHEN raw_state = 'normal_acoustic_state' THEN 3 ELSE 2 END) THEN raw_state END IGNORE NULLS) OVER (PARTITION BY serial ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 'normal_acoustic_state') AS state FROM q)"""


def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.debounce(frames(spark, sf_dir), "raw_state", enter=2, recover=3)


@query(f"WITH {DEBOUNCE_SQL} SELECT serial, id, state, pos::INT AS run FROM db")
def w2_debounced_state(spark, sf_dir):
    return debounced(spark, sf_dir).select("serial", "id", "state", "run")


@query(f"""WITH {DEBOUNCE_SQL}, t AS (SELECT *, lag(state) OVER (PARTITION BY serial ORDER BY ts, id) AS before FROM db) SELECT 'pipe_state_transition' AS event, serial, ts, before AS from_state, state AS to_state FROM t WHERE before <> state""")
def w5_state_transitions(spark, sf_dir):
    return states.transitions(debounced(spark, sf_dir))


EMPTY_SQL = """c AS (SELECT *, sum((raw_state IN ('weak_signal_or_air_candidate', 'empty_or_lost_acoustic_path_candidate'))::INT) OVER (PARTITION BY serial ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS bad FROM FRAMES),
ep AS (SELECT *, coalesce(last_value(CASE WHEN bad >= 3 THEN true WHEN bad <= 1 THEN false END IGNORE NULLS) OVER (PARTITION BY serial ORDER BY ts, id ROWS UNBOUNDED PRECEDING), false) AS empty FROM c)"""


@query(f"WITH {EMPTY_SQL} SELECT serial, id, bad::BIGINT AS bad_count, empty AS empty_pipe FROM ep")
def w6_empty_pipe(spark, sf_dir):
    return states.empty_pipe(frames(spark, sf_dir), "raw_state").select("serial", "id", "bad_count", "empty_pipe")


@query("""WITH s AS (SELECT *, CASE WHEN count(*) OVER l = 20 THEN stddev_samp(value) OVER l END AS d FROM FRAMES WINDOW l AS (PARTITION BY serial ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT serial, id, round(d, 6) AS corr_std, coalesce(last_value(CASE WHEN d >= 100 THEN true WHEN d < 80 THEN false END IGNORE NULLS) OVER (PARTITION BY serial ORDER BY ts, id ROWS UNBOUNDED PRECEDING), false) AS air_bubble FROM s""")
def w7_air_bubble(spark, sf_dir):
    return states.air_bubble(frames(spark, sf_dir), 20.0, "value", recovery=0.8).select("serial", "id", F.round("corr_std", 6).alias("corr_std"), "air_bubble")


@query(f"""WITH {EMPTY_SQL}, g AS (SELECT *, coalesce(lag(empty) OVER (PARTITION BY serial ORDER BY ts, id), false) AS was FROM ep),
h AS (SELECT *, last_value(CASE WHEN empty AND NOT was THEN ts END IGNORE NULLS) OVER (PARTITION BY serial ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS st FROM g)
SELECT CASE WHEN empty THEN 'empty_pipe_detected' ELSE 'pipe_refilled' END AS event, serial, ts, CASE WHEN NOT empty THEN st END AS since FROM h WHERE empty <> was""")
def w8_detection_events(spark, sf_dir):
    return states.detections(states.empty_pipe(frames(spark, sf_dir), "raw_state"), "empty_pipe", "empty_pipe_detected", "pipe_refilled")


@query("""SELECT serial, id, round(avg((sq >= 40)::INT) OVER l, 6) AS stable_ratio, count(*) OVER l = 16 AND sq >= 40 AND avg((sq >= 40)::INT) OVER l >= 0.6 AS train FROM FRAMES WINDOW l AS (PARTITION BY serial ORDER BY ts, id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def w11_stability(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("gate", F.col("sq") >= 40)
    return states.stability(f, "gate", n=16).select("serial", "id", F.round("stable_ratio", 6).alias("stable_ratio"), "train")


@query("""SELECT serial, id, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY serial ORDER BY ts, id))) / 1000.0, 0)::DOUBLE AS source_gap_ms, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY serial ORDER BY ts, id)) > 3600000000, false) AS data_gap FROM FRAMES""")
def w18_gaps(spark, sf_dir):
    return states.gaps(frames(spark, sf_dir), after_ms=3_600_000).select("serial", "id", "source_gap_ms", "data_gap")


@query("""SELECT serial, id, round(CASE WHEN x <= 1 THEN greatest(0.8, 1 - 0.2 * x) WHEN x <= 2 THEN greatest(0.3, 0.8 - 0.5 * (x - 1)) ELSE greatest(0, 0.3 * exp(2 - x)) END, 9) AS confidence FROM (SELECT *, value / 100 AS x FROM FRAMES)""")
def w9_confidence(spark, sf_dir):
    return frames(spark, sf_dir).select("serial", "id", F.round(c.confidence(F.col("value") / 100, F.lit(1.0), F.lit(2.0)), 9).alias("confidence"))


@query("""SELECT dimension, value, count(*) AS n FROM (SELECT 'event_type' AS dimension, event_type AS value FROM FRAMES UNION ALL SELECT 'raw_state', raw_state FROM FRAMES UNION ALL SELECT 'serial', serial::VARCHAR FROM FRAMES) GROUP BY ALL""")
def r6_distributions(spark, sf_dir):
    return audit.distributions(frames(spark, sf_dir), ["event_type", "raw_state", "serial"])


@query("""SELECT serial, sum((e IS NOT NULL AND e <> event_type)::INT)::BIGINT AS event_type_changes, sum((r IS NOT NULL AND r <> raw_state)::INT)::BIGINT AS raw_state_changes FROM
(SELECT *, lag(event_type) OVER w AS e, lag(raw_state) OVER w AS r FROM FRAMES WINDOW w AS (PARTITION BY serial ORDER BY ts, id)) GROUP BY ALL""")
def r7_change_counts(spark, sf_dir):
    return audit.switches(frames(spark, sf_dir), ["event_type", "raw_state"])


@query("""SELECT event_type, metric, count(x) AS n, min(x) AS min, round(quantile_cont(x, 0.05), 6) AS p05, round(median(x), 6) AS p50, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.95), 6) AS p95, max(x) AS max FROM
(SELECT event_type, unnest(['value', 'sq']) AS metric, unnest([value, sq]) AS x FROM FRAMES) GROUP BY ALL""")
def r8_stats_table(spark, sf_dir):
    out = audit.stats(frames(spark, sf_dir), ["value", "sq"], ["event_type"])
    return out.select("event_type", "metric", "n", "min", *[F.round(x, 6).alias(x) for x in ("p05", "p50", "mean", "p95")], "max")


@query("""SELECT serial, min(ts) AS start, max(ts) AS "end", (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s, round(median(s), 7) AS median_interval_s, max(s) AS max_interval_s FROM
(SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY serial ORDER BY ts, id))) / 1e6 AS s FROM FRAMES) GROUP BY ALL""")
def r9_time_summary(spark, sf_dir):
    return audit.times(frames(spark, sf_dir)).select("serial", "start", "end", "duration_s", F.round("median_interval_s", 7).alias("median_interval_s"), "max_interval_s")


@query("""(SELECT id, value, sq, 'score' AS list FROM FRAMES ORDER BY value DESC, id LIMIT 12) UNION ALL (SELECT id, value, sq, 'health' FROM FRAMES ORDER BY sq, id LIMIT 12)""")
def r10_worst_rows(spark, sf_dir):
    return audit.worst(frames(spark, sf_dir).select("id", "value", "sq"), 12, "value", "sq")


DAILY_SQL = f"""{INTERVAL_SQL}, fr AS (SELECT *, ts::DATE AS date, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY serial, ts::DATE ORDER BY ts, id))) / 1e6 AS st, CASE event_type WHEN 'error' THEN 'anomaly' WHEN 'click' THEN 'suspect' ELSE 'normal' END AS label FROM FRAMES),
ag AS (SELECT serial, date, count(*) AS frames, avg(value) AS mv, avg(sq) AS ms, coalesce(stddev_samp(value), 0) AS sd, count(*) FILTER (label = 'anomaly') AS an, count(*) FILTER (label = 'suspect') AS su, coalesce(median(st) FILTER (st > 0), 60) AS md FROM fr GROUP BY ALL),
jn AS (SELECT ag.*, coalesce(minutes, 0) AS em FROM ag LEFT JOIN cm USING (serial, date)),
su AS (SELECT *, frames * md / 60 AS ob, CASE WHEN mv >= 50 THEN 100 ELSE greatest(0, 100 + (mv - 50) / 20 * 25) END AS cp FROM jn)"""


def daily_reports(spark: SparkSession, sf_dir: str, digits: int = 1) -> DataFrame:
    f = frames(spark, sf_dir)
    label = F.when(F.col("event_type") == "error", "anomaly").when(F.col("event_type") == "click", "suspect").otherwise("normal")
    f = f.select("serial", "ts", "id", F.col("value").alias("template_corr"), F.col("value").alias("snr_db"), F.col("value").alias("gate_rms_v"), "sq", label.alias("label"), "event_type", (F.col("value") * 1.00123).alias("health"))
    minutes = daily.condition_minutes(f, "error", "view", event="event_type").select("serial", "date", F.col("minutes").alias("empty_minutes"), F.lit(0.0).alias("air_minutes"))
    return daily.report(f, {x: (50.0, 20.0) for x in ("template_corr", "snr_db", "gate_rms_v")}, minutes, digits=digits)


@query(f"""WITH {DAILY_SQL} SELECT serial, date, frames, an AS anomaly_frames, su AS suspect_frames, round(md, 7) AS median_period_s, round(cp, 7) AS coupling, round(greatest(0, 100 - least(em + (an + su * 0.5) * md / 60, ob) / greatest(ob, 1) * 100), 7) AS incident_burden,
round(greatest(0, least(100, 100 - (greatest(sd / 20, 1) - 1) * 12.5)), 7) AS stability, round(em, 6) AS empty_minutes FROM su""")
def r11_daily_aggregates(spark, sf_dir):
    out = daily_reports(spark, sf_dir, 7)
    return out.select("serial", "date", "frames", "anomaly_frames", "suspect_frames", F.round("median_period_s", 7).alias("median_period_s"), "coupling", "incident_burden", "stability", F.round("empty_minutes", 6).alias("empty_minutes"))


REPORT_SQL = f"""{DAILY_SQL}, sb AS (SELECT *, cp AS coupling, cp AS signal_strength, least(100, greatest(0, coalesce(ms, 50))) AS sq_quality, greatest(0, least(100, 100 - (greatest(sd / 20, 1) - 1) * 12.5)) AS stability,
greatest(0, 100 - least(em + (an + su * 0.5) * md / 60, ob) / greatest(ob, 1) * 100) AS incident_burden, least(100, frames * md / 864) AS uptime FROM su),
rs AS (SELECT * REPLACE (round_even(coupling, 7) AS coupling, round_even(signal_strength, 7) AS signal_strength, round_even(sq_quality, 7) AS sq_quality, round_even(stability, 7) AS stability, round_even(incident_burden, 7) AS incident_burden, round_even(uptime, 7) AS uptime) FROM sb),
hs AS (SELECT *, coupling * 0.3 + signal_strength * 0.2 + sq_quality * 0.2 + stability * 0.15 + incident_burden * 0.15 AS health FROM rs)"""


@query(f"""WITH {REPORT_SQL} SELECT serial, date, round(signal_strength + 1e-9, 5) AS signal_strength, round(sq_quality + 1e-9, 5) AS sq_quality, round(uptime + 1e-9, 5) AS uptime, round(health + 1e-9, 5) AS health,
CASE WHEN health >= 90 THEN 'Optimal' WHEN health >= 75 THEN 'Good' WHEN health >= 60 THEN 'Fair' ELSE 'Pay attention' END AS band FROM hs""")
def r11_daily_health(spark, sf_dir):
    """The subscores, the weighted health and its band; subscores aren't rounded to a decimal here, as ties of rounding differ between engines."""
    out = daily_reports(spark, sf_dir, 7)
    return out.select("serial", "date", *[F.round(F.col(x) + 1e-9, 5).alias(x) for x in ("signal_strength", "sq_quality", "uptime", "health")], "band")


@query(f"""WITH {REPORT_SQL}, hp AS (SELECT serial, ts::DATE AS date, quantile_cont(value * 1.00123::DOUBLE, 0.05) AS p05 FROM FRAMES GROUP BY ALL),
hm AS (SELECT serial, date, list_filter([CASE WHEN em > 0 THEN printf('%.0f', em) || ' min of confirmed empty or lost coupling' END, CASE WHEN an > 0 THEN an || ' anomaly frames' END], lambda x: x IS NOT NULL) AS first, su, uptime, p05 FROM hs JOIN hp USING (serial, date)),
hn AS (SELECT *, CASE WHEN len(first) = 0 AND su > 0 THEN [su || ' suspect frames'] ELSE first END AS mild FROM hm),
ho AS (SELECT *, CASE WHEN uptime < 80 THEN list_append(mild, 'uptime of only ' || printf('%.0f', uptime) || '%') ELSE mild END AS every FROM hn),
hq AS (SELECT *, CASE WHEN len(every) > 0 THEN every ELSE ['clean day'] END AS told FROM ho)
SELECT serial, date, array_to_string(CASE WHEN p05 < 60 THEN list_append(told, 'realtime flow health dipped to p05=' || printf('%.0f', p05)) ELSE told END, '; ') AS highlights FROM hq""")
def r13_highlights(spark, sf_dir):
    """A day's messages, with the frames' value as their health."""
    return daily_reports(spark, sf_dir, 7).select("serial", "date", F.array_join("highlights", "; ").alias("highlights"))


@query()
def r11_daily_report(spark, sf_dir):
    return daily.trend(daily_reports(spark, sf_dir), ["health_score", "coupling", "stability", "incident_burden"])


@query("""WITH d AS (SELECT serial, ts::DATE AS date, count(*) AS frames FROM FRAMES GROUP BY ALL)
SELECT serial, date, frames, round(frames - quantile_cont(frames, 0.5) OVER (PARTITION BY serial ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 1) AS delta_frames FROM d""")
def r14_trend(spark, sf_dir):
    d = frames(spark, sf_dir).groupBy("serial", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("frames"))
    return daily.trend(d, ["frames"])


@query("""SELECT l_returnflag AS source, l_linestatus AS label, count(*) AS rows FROM lineitem GROUP BY ALL""")
def io3_merge_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    parts = {flag: li.where(F.col("l_returnflag") == flag).select(F.col("l_linestatus").alias("label"), "l_quantity") for flag in ("A", "N", "R")}
    return captures.merge_summary(captures.merge(parts))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
d AS (SELECT q.vec_id, b.vec_id AS neighbor, list_distance(q.e, b.e) AS distance FROM p q JOIN p b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0)
SELECT vec_id, neighbor, round(distance, 7) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS rank FROM d) WHERE rank <= 5""")
def e6_nearest_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = neighbors.nearest(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "embedding")
    return out.select("vec_id", "neighbor", F.round("distance", 7).alias("distance"), "rank")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 8) AS distance FROM embeddings""")
def e7_distance_to_center(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("point"))
    return e.select("vec_id", F.round(neighbors.distance_to_center(), 8).alias("distance"))


@query("""SELECT id, CASE WHEN value >= 300 OR d >= 95 THEN 'anomaly' WHEN value >= 150 OR d >= 80 THEN 'suspect' ELSE 'normal' END AS label FROM (SELECT *, CASE WHEN sq >= 10 THEN sq END AS d FROM FRAMES)""")
def e8_two_signal_label(spark, sf_dir):
    d = F.when(F.col("sq") >= 10, F.col("sq"))
    return frames(spark, sf_dir).select("id", neighbors.label(F.col("value"), d, (150, 300), (80, 95)).alias("label"))


@query("""SELECT round(quantile_cont(value, 0.995), 7) AS mse_suspect, round(quantile_cont(value, 0.999), 7) AS mse_anomaly, round(quantile_cont(sq, 0.95), 7) AS distance_suspect, round(quantile_cont(sq, 0.99), 7) AS distance_anomaly,
round(quantile_cont(1 / (1 + sq), 0.05), 7) AS similarity_suspect, round(quantile_cont(1 / (1 + sq), 0.01), 7) AS similarity_anomaly FROM FRAMES WHERE event_type <> 'error'""")
def e9_thresholds(spark, sf_dir):
    out = neighbors.limits(frames(spark, sf_dir), "value", "sq", F.col("event_type") != "error")
    return out.select(*[F.round(x, 7).alias(x) for x in out.columns])


#: Eight smooth directions, orthonormal.
BASIS = np.linalg.qr(np.cos(np.outer(np.arange(64) + 0.5, np.arange(8)) * np.pi / 64))[0].T
BASIS_SQL = " + ".join(f"list_dot_product(e, {[float(x) for x in b]}::DOUBLE[]) ** 2" for b in BASIS)


@query(f"""SELECT vec_id, round((list_dot_product(e, e) - ({BASIS_SQL})) / 64, 7) AS reconstruction_mse, 'completed' AS status FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def e4_linear_encoding(spark, sf_dir):
    """The energy that eight smooth directions leave of each vector."""
    return neighbors.encode(waves_of(spark, sf_dir), neighbors.linear_encoder(BASIS), row="vec_id").select("vec_id", F.round("reconstruction_mse", 7).alias("reconstruction_mse"), "status")


@query("""WITH r AS (SELECT serial, ts, max(id) AS id FROM FRAMES GROUP BY ALL) SELECT f.serial, f.id, CASE WHEN f.event_type = 'error' AND r.id IS NOT NULL THEN f.value * 2 END AS score FROM FRAMES f LEFT JOIN r USING (serial, ts, id)""")
def e11_late_enrichment(spark, sf_dir):
    f = frames(spark, sf_dir)
    late = f.where("event_type = 'error'").select("serial", "ts", (F.col("value") * 2).alias("score"), F.col("id").alias("at"))
    return history.enrich(f, late, ["score"]).select("serial", "id", "score")


@query()
def f19_kmeans(spark, sf_dir):
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    li = table(spark, sf_dir, "lineitem")
    stats = fit.stats_of(fit.robust_fit(li, features))
    row = F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice").alias("row")
    assigned, centers, _ = cluster.kmeans(li.select(row, cluster.vectorize(features, stats).alias("point")), 4)
    return cluster.report(assigned, centers, features, stats)


@query()
def f12_probe_detection(spark, sf_dir):
    """For each synthetic fault, what part of all vectors scores as anomalies."""
    good = featured(spark, sf_dir)
    stats = fit.stats_of(fit.robust_fit(good, list(c.FEATURES)))
    limit = fit.thresholds(good.select(fit.score(list(c.FEATURES), stats).alias("score"))).first()
    waves = waves_of(spark, sf_dir)
    profile = waveform.Profile.from_row(short_profile(waves).first(), baseline=16, low=-0.2, high=0.2)
    parts = [waves.select(F.lit(n).alias("probe"), waveform.probed(F.col("samples"), n, 64, 16).alias("samples")) for n in waveform.PROBES]
    tried = reduce(DataFrame.union, parts).select("probe", waveform.extract(F.col("samples"), profile, 64).alias("f")).select("probe", "f.*")
    scored = tried.select("probe", fit.score(list(c.FEATURES), stats).alias("score"))
    return scored.groupBy("probe").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("score") >= limit["anomaly"]).cast("double")).alias("detected"))


@query()
def w12_adaptive_profile(spark, sf_dir):
    """Each label's vectors in the order of vec_id as one meter's frames."""
    good = featured(spark, sf_dir)
    stats = fit.stats_of(fit.robust_fit(good, list(c.FEATURES)))
    waves = waves_of(spark, sf_dir)
    profile = waveform.Profile.from_row(short_profile(waves).first(), baseline=16, low=-0.2, high=0.2)
    model = adapt.Adaptive(profile, stats, suspect=2.0, window=8)
    return adapt.adapt(waves.select(F.col("label").alias("serial"), F.col("vec_id").alias("ts"), F.col("vec_id").alias("id"), "samples"), model)


@query()
def w13_realtime_health(spark, sf_dir):
    names = {"value": "gate_rms_v", "sq": "snr_db"}
    f = frames(spark, sf_dir)
    f = f.select("serial", "ts", "id", "sq", "raw_state", *[F.col(a).alias(b) for a, b in names.items()], *[(F.col("value") / (i + 2)).alias(n) for i, n in enumerate(x for x in c.FEATURES if x not in names.values())])
    stats = fit.stats_of(fit.robust_fit(f, list(c.FEATURES)))
    scored = fit.labelled(f.withColumn("score", fit.score(list(c.FEATURES), stats)), 2.0, 3.0)
    marked = states.air_bubble(states.empty_pipe(scored, "raw_state"), stats["template_corr"]["robust_sigma"])
    marked = marked.withColumns({"pipe_state": F.col("raw_state"), "sq_age_ms": F.lit(0.0), "pub_dt_age_ms": F.lit(None).cast("double"), "sq_label": c.sq_label(F.col("sq"))})
    out = health.health(marked, stats, 2.0, 3.0, air_threshold=5 * stats["template_corr"]["robust_sigma"])
    return out.select("serial", "id", *health.WEIGHTS, "health", "health_label", "drivers", states.condition(("empty_pipe", "empty_pipe"), ("air_bubble", "air_bubble")).alias("condition"), health.training_gate(stats, 2.0).alias("freeze_reason"))


@query()
def w15_zero_tracker(spark, sf_dir):
    f = frames(spark, sf_dir)
    return zero.track(f.select("serial", "ts", "id", (F.col("value") / 10_000).alias("raw_fs_mps"), (F.col("sq") / 10 + 15).alias("temperature_c")))


@query()
def t2_tracked_frames(spark, sf_dir):
    """The streaming job's rows, run over the whole table."""
    f = frames(spark, sf_dir).select("serial", "ts", "id", "raw_state", (F.col("value") / 10_000).alias("raw_fs_mps"), (F.col("sq") / 10 + 15).alias("temperature_c"))
    return stream.track(stream.inputs(f))


@query("""SELECT user_id AS serial, ts, event_id AS id, CASE WHEN value > 20 THEN value WHEN k > 50 THEN k END AS raw_fs_mps, coalesce(k, value) AS temperature_c, event_type AS state_name FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)""")
def p8_frame_table(spark, sf_dir):
    f = frames(spark, sf_dir)
    f = f.select("serial", "ts", "id", F.when(F.col("value") > 20, F.col("value")).otherwise(float("nan")).alias("raw_fs_mps"), F.when(F.col("sq") > 50, F.col("sq")).alias("pub_fs_mps"), F.col("sq").alias("onboard_temperature_c"), F.col("value").alias("ots"), F.lit("").alias("state_name"), F.col("event_type").alias("pipe_state"))
    return frame_ops.frame_table(f).select("serial", "ts", "id", "raw_fs_mps", "temperature_c", "state_name")


@query("SELECT serial, ts, id, value FROM FRAMES WHERE ts >= TIMESTAMP '2024-01-20' AND serial = 7")
def p10_time_filter(spark, sf_dir):
    return history.since(frames(spark, sf_dir), datetime(2024, 1, 20), serial=7).select("serial", "ts", "id", "value")


@query("SELECT l_returnflag AS label, count(*) AS rows, round(avg(l_discount), 7) AS mean_score, max(l_discount) AS max_score FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def f16_score_summary(spark, sf_dir):
    out = frame_ops.score_summary(table(spark, sf_dir, "lineitem"), "l_discount", "l_returnflag")
    return out.select(F.col("l_returnflag").alias("label"), "rows", F.round("mean_score", 7).alias("mean_score"), "max_score")


@query("SELECT id, value, serial FROM FRAMES ORDER BY value DESC, id LIMIT 20")
def e10_outliers(spark, sf_dir):
    f = frames(spark, sf_dir)
    top = frame_ops.outliers(f.select("id", "value"), "value", 20, "id")
    return frame_ops.with_metadata(top, f, ["serial"], ["id"])


@query("""WITH x AS (SELECT user_id AS serial, value AS y, k - 50 AS a, event_id % 21 - 10.5 AS b FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)),
s AS (SELECT serial, CASE WHEN b < 0 THEN 'cooling' ELSE 'heating' END AS branch, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM x GROUP BY ALL)
SELECT serial, branch, n, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 6) AS delta_coeff, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 6) AS rate_coeff FROM s""")
def d1_thermal_fit(spark, sf_dir):
    f = frames(spark, sf_dir).select("serial", F.col("value").alias("raw_fs_mps"), (F.col("sq") - 50).alias("thermal_delta_c"), (F.col("id") % 21 - 10.5).alias("temp_rate_c_per_min"))
    return drift.thermal_fit(f).select("serial", "branch", "n", F.round("delta_coeff", 6).alias("delta_coeff"), F.round("rate_coeff", 6).alias("rate_coeff"))


@query("""SELECT serial, round(median(abs(value)), 7) AS raw_error, round(median(abs(value - sq)), 7) AS corrected_error FROM FRAMES GROUP BY ALL""")
def d2_zero_error(spark, sf_dir):
    out = drift.zero_error(frames(spark, sf_dir).withColumn("c", F.col("value") - F.col("sq")), "value", "c")
    return out.select("serial", F.round("raw_error", 7).alias("raw_error"), F.round("corrected_error", 7).alias("corrected_error"))


@query("""SELECT serial, time_bucket(INTERVAL 1 DAY, ts) AS bucket_start, count(*) AS rows, round(avg(value), 6) AS value_avg, min(value) AS value_min, max(value) AS value_max FROM FRAMES GROUP BY ALL""")
def d3_bucket_rollup(spark, sf_dir):
    out = drift.rollup(frames(spark, sf_dir), ["value"], "1 day")
    return out.withColumn("value_avg", F.round("value_avg", 6))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
