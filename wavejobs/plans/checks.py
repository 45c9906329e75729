"""More registered queries: states, gates, payloads, routing and stream helpers on the driver tables, each with its SQL."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import functions as F

from wavejobs.functions import columns as c
from wavejobs.functions import waveform
from wavejobs.operators import asof, drift, fit, health, states
from wavejobs.operators import frames as frame_ops
from wavejobs.plans.registry import frames, query, sides, waves_of
from wavejobs.sources import captures
from wavejobs.sources.tables import table
from wavejobs.streaming import frames as stream

LIMITS = {f: {"p01": 10.0, "p05": 15.0, "p95": 0.05, "p99": 0.06, "center": 50.0, "robust_sigma": 20.0} for f in c.FEATURES}


def featured_frames(spark, sf_dir):
    """Frames with made-up features: energy is the value, peak and match the signal quality, noise ratio the sum."""
    f = frames(spark, sf_dir)
    label = F.when(F.col("event_type") == "error", "anomaly").when(F.col("event_type") == "click", "suspect").otherwise("normal")
    return f.withColumns(
        {
            "gate_rms_v": F.col("value"), "peak_abs_gate_v": F.col("sq"), "snr_db": F.col("value") * 2, "template_corr": F.col("sq") / 2,
            "low_clip_ratio": F.col("id") % 100 / 1000, "high_clip_ratio": F.col("id") % 7 / 1000, "label": label, "score": F.col("value") / 100,
        }
    )


FEATURED_SQL = """(SELECT *, value AS gate_rms_v, sq AS peak_abs_gate_v, value * 2 AS snr_db, sq / 2 AS template_corr, id % 100 / 1000.0::DOUBLE AS low_clip_ratio, id % 7 / 1000.0::DOUBLE AS high_clip_ratio, value / 100 AS score,
CASE event_type WHEN 'error' THEN 'anomaly' WHEN 'click' THEN 'suspect' ELSE 'normal' END AS label FROM FRAMES)"""


@query(f"""WITH w AS (SELECT *, (gate_rms_v < 10)::INT + (peak_abs_gate_v < 10)::INT + (snr_db < 10)::INT + (template_corr < 10)::INT AS weak, low_clip_ratio > 0.08 AS lo, high_clip_ratio > 0.065 AS hi FROM {FEATURED_SQL})
SELECT id, CASE WHEN lo OR hi THEN 'adc_saturation_or_bias_issue' WHEN weak >= 3 THEN 'empty_or_lost_acoustic_path_candidate' WHEN weak >= 2 THEN 'weak_signal_or_air_candidate'
WHEN label = 'anomaly' THEN 'waveform_anomaly' WHEN label = 'suspect' THEN 'signal_quality_suspect' ELSE 'normal_acoustic_state' END AS state, CASE WHEN lo OR hi THEN lo::INT + hi::INT WHEN weak >= 2 THEN weak WHEN label = 'normal' THEN 0 ELSE 1 END::INT AS reasons FROM w""")
def w1_raw_state(spark, sf_dir):
    d = featured_frames(spark, sf_dir)
    state, why = states.raw_state(LIMITS, F.col("label"), F.array(F.lit("score")))
    return d.select("id", state.alias("state"), F.size(why).alias("reasons"))


@query("""WITH a AS (SELECT *, CASE WHEN raw_state = lag(raw_state) OVER w THEN 0 ELSE 1 END AS nw FROM FRAMES WINDOW w AS (PARTITION BY serial ORDER BY ts, id)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY serial ORDER BY ts, id) AS rn FROM a), d AS (SELECT *, row_number() OVER (PARTITION BY serial, rn ORDER BY ts, id) AS k FROM b),
e AS (SELECT *, coalesce(last_value(CASE WHEN k >= CASE raw_state WHEN 'normal_acoustic_state' THEN 5 ELSE 3 END THEN raw_state END IGNORE NULLS) OVER (PARTITION BY serial ORDER BY ts, id), 'normal_acoustic_state') AS state FROM d),
f AS (SELECT *, lag(state) OVER (PARTITION BY serial ORDER BY ts, id) AS was FROM e), g AS (SELECT *, sum((state <> coalesce(was, state))::INT) OVER (PARTITION BY serial ORDER BY ts, id) AS stay FROM f)
SELECT serial, id, CASE WHEN was IS NULL THEN CASE WHEN raw_state = state THEN 'initialized' ELSE 'startup_waiting_for_confirmation' END WHEN state <> was THEN 'confirmed' WHEN raw_state = state THEN 'stable' ELSE 'pending' END AS status,
first_value(ts) OVER (PARTITION BY serial, stay ORDER BY ts, id) AS entered_at, row_number() OVER (PARTITION BY serial, stay ORDER BY ts, id)::INT AS frames_in_state FROM g""")
def w3_confirmation(spark, sf_dir):
    held = states.debounce(frames(spark, sf_dir), "raw_state")
    return held.select("serial", "id", "status", "entered_at", F.col("frames_in_state").cast("int").alias("frames_in_state"))


@query(f"""SELECT id, CASE WHEN sq < 80 THEN 'sq_label_' || CASE WHEN sq < 50 THEN 'poor' ELSE 'fair' END WHEN id % 9000 > 5000 THEN 'pub_dt_stale' WHEN label <> 'normal' THEN 'label_' || label WHEN score > 2 * 0.95::DOUBLE THEN 'score_not_low_enough'
WHEN template_corr < 15 THEN 'template_corr_below_p05' WHEN snr_db < 15 THEN 'snr_below_p05' WHEN gate_rms_v < 15 THEN 'gate_energy_below_p05' WHEN low_clip_ratio > 0.07 THEN 'low_clipping_too_high' WHEN high_clip_ratio > 0.001 THEN 'high_clipping_present' END AS reason FROM {FEATURED_SQL}""")
def w10_training_gate(spark, sf_dir):
    d = featured_frames(spark, sf_dir).withColumn("sq_label", c.sq_label(F.col("sq"))).withColumn("pub_dt_age_ms", (F.col("id") % 9000).cast("double"))
    return d.select("id", health.training_gate(LIMITS, 2.0).alias("reason"))


@query("""WITH RECURSIVE n AS (SELECT serial, id, row_number() OVER (PARTITION BY serial ORDER BY ts, id) AS i,
sum((raw_state IN ('empty_or_lost_acoustic_path_candidate', 'weak_signal_or_air_candidate'))::INT) OVER (PARTITION BY serial ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS k FROM FRAMES),
r AS (SELECT serial, id, i, k, k >= 2 AS empty_pipe FROM n WHERE i = 1 UNION ALL SELECT n.serial, n.id, n.i, n.k, CASE WHEN r.empty_pipe THEN n.k > 3 ELSE n.k >= 2 END FROM r JOIN n ON n.serial = r.serial AND n.i = r.i + 1)
SELECT serial, id, k::BIGINT AS bad_count, empty_pipe FROM r""")
def w6_turning_latch(spark, sf_dir):
    """The empty-pipe latch where counts of 2 and 3 turn it over at every frame; the SQL goes frame by frame."""
    return states.empty_pipe(frames(spark, sf_dir), "raw_state", on=2, off=3).select("serial", "id", "bad_count", "empty_pipe")


def _z_sql(f: str, points: int = 25, up: bool = True) -> str:
    away = f"({f} - 50) / 20" if up else f"(50 - {f}) / 20"
    return f"(CASE WHEN {away} >= 0 THEN 100::DOUBLE ELSE greatest(0::DOUBLE, least(100::DOUBLE, {away} * {points}::DOUBLE + 100)) END)"


def _penalty_sql(age: str, stale: int, most: int) -> str:
    return f"(CASE WHEN {age} IS NULL THEN {most} * 0.5::DOUBLE ELSE greatest(0, least({most}, ({age} - {stale}) / ({stale} * 2::DOUBLE) * {most})) END)"


#: The subscores with their weights, as the weighted sum adds them up.
_TOTAL_SQL = " + ".join(f"{n} * {w}::DOUBLE" for n, w in health.WEIGHTS.items())


@query(f"""WITH x AS (SELECT * REPLACE (value * 1.0123457::DOUBLE AS gate_rms_v, sq * 0.50123::DOUBLE AS template_corr, sq * 1.0004321::DOUBLE AS peak_abs_gate_v), value * 3 AS noise_rms_v, event_type = 'error' AS empty_pipe, id % 4 = 0 AS air_bubble, CASE WHEN id % 5 > 0 THEN id % 10 / 9.7::DOUBLE END AS corr_std, id % 1000 * 1000.37::DOUBLE AS sq_age, CASE WHEN id % 3 > 0 THEN id % 20000 * 1.000313::DOUBLE END AS dt_age FROM {FEATURED_SQL}),
p AS (SELECT *, {_z_sql("snr_db")} * 0.45::DOUBLE + {_z_sql("gate_rms_v")} * 0.35::DOUBLE + {_z_sql("noise_rms_v", up=False)} * 0.2::DOUBLE AS a, CASE WHEN score <= 0.41::DOUBLE THEN 100 - score * 20 / 0.41::DOUBLE WHEN score <= 0.83::DOUBLE THEN 80 - (score - 0.41::DOUBLE) * 40 / (0.83::DOUBLE - 0.41::DOUBLE) ELSE exp(0.83::DOUBLE - score) * 40 END AS b,
{_z_sql("template_corr")} * 0.45::DOUBLE + {_z_sql("peak_abs_gate_v")} * 0.25::DOUBLE + {_z_sql("low_clip_ratio", 35, False)} * 0.15::DOUBLE + {_z_sql("high_clip_ratio", 50, False)} * 0.15::DOUBLE AS c,
CASE WHEN raw_state = 'empty_or_lost_acoustic_path_candidate' OR empty_pipe THEN 35 WHEN raw_state = 'weak_signal_or_air_candidate' THEN 65 ELSE 100 END AS most, CASE WHEN corr_std IS NULL THEN 100 ELSE greatest(0, least(100, 100 - greatest(corr_std / 0.5::DOUBLE - 0.5::DOUBLE, 0) * 80)) END AS steady,
greatest(0, least(100, sq)) - {_penalty_sql("sq_age", 300_000, 30)} - {_penalty_sql("dt_age", 5_000, 20)} AS e FROM x),
s AS (SELECT *, round_even(greatest(0, least(100, a)), 1) AS signal_integrity, round_even(greatest(0, least(100, b)), 1) AS acoustic_pattern_match, round_even(greatest(0, least(100, least(c, most))), 1) AS coupling_condition,
round_even(greatest(0, least(100, CASE WHEN air_bubble THEN least(steady, 55) ELSE steady END)), 1) AS temporal_stability, round_even(greatest(0, least(100, e)), 1) AS telemetry_reliability FROM p),
t AS (SELECT *, {_TOTAL_SQL} AS total FROM s), u AS (SELECT *, least(total, CASE label WHEN 'anomaly' THEN 55 WHEN 'suspect' THEN 74 ELSE 100 END, CASE WHEN empty_pipe THEN 35 ELSE 100 END, CASE WHEN air_bubble THEN 65 ELSE 100 END) AS capped FROM t)
SELECT id, {", ".join(health.WEIGHTS)}, CASE WHEN capped >= 90 THEN 'Excellent' WHEN capped >= 75 THEN 'Healthy' WHEN capped >= 60 THEN 'Watch' WHEN capped >= 40 THEN 'Degraded' ELSE 'Unreliable' END AS health_label FROM u""")
def w13_subscores(spark, sf_dir):
    """The five subscores and the label of the weighted and capped health, with fixed statistics and factors that keep values off the ties of rounding."""
    d = featured_frames(spark, sf_dir).withColumns(
        {
            "gate_rms_v": F.col("value") * 1.0123457, "template_corr": F.col("sq") * 0.50123, "peak_abs_gate_v": F.col("sq") * 1.0004321, "noise_rms_v": F.col("value") * 3, "empty_pipe": F.col("event_type") == "error", "air_bubble": F.col("id") % 4 == 0, "corr_std": F.when(F.col("id") % 5 > 0, F.col("id") % 10 / 9.7), "pipe_state": F.col("raw_state"),
            "sq_age_ms": F.col("id") % 1000 * 1000.37, "pub_dt_age_ms": F.when(F.col("id") % 3 > 0, F.col("id") % 20000 * 1.000313), "sq_label": c.sq_label(F.col("sq")),
        }
    )
    return health.health(d, LIMITS, 0.41, 0.83, air_threshold=0.5).select("id", *health.WEIGHTS, "health_label")


@query("""WITH x AS (SELECT serial, id, value, sq, greatest(value / 100, 0) AS s, CASE WHEN sq >= 20 THEN sq END AS ev FROM FRAMES),
p AS (SELECT *, CASE WHEN s <= 1 THEN 100 - s * 20 WHEN s <= 2 THEN 80 - (s - 1) * 40 ELSE exp(2 - s) * 40 END AS base FROM x)
SELECT id, round(CASE WHEN ev IS NULL THEN base ELSE base * 0.7 + ev * 0.3 END, 6) AS pattern FROM p""")
def w14_evidence_blend(spark, sf_dir):
    d = frames(spark, sf_dir)
    pattern = c.anomaly_points(F.col("value") / 100, F.lit(1.0), F.lit(2.0))
    seen = F.when(F.col("sq") >= 20, F.col("sq"))
    return d.select("id", F.round(health.blended(pattern, seen, 0.3), 6).alias("pattern"))


@query("""SELECT id, round(least(86, p) / 100, 6)::DOUBLE AS confidence, least(86, p)::DOUBLE AS score, 3 + (id % 3 = 0)::INT AS drivers
FROM (SELECT *, CASE WHEN sq < 50 THEN 40 WHEN sq < 80 THEN 62 ELSE 78 END + CASE WHEN id % 2 = 0 THEN 6 ELSE 0 END + CASE WHEN value > 50 THEN 4 ELSE 0 END AS p FROM FRAMES)""")
def j5_telemetry_only_health(spark, sf_dir):
    label = c.sq_label(F.col("sq"))
    sure = asof.telemetry_confidence(label, F.col("id") % 2 == 0, F.col("value") > 50)
    d = frames(spark, sf_dir).select("id", F.round(sure, 6).alias("confidence"), asof.telemetry_health(sure, label, F.col("id") % 3 == 0).alias("h"))
    return d.select("id", "confidence", F.round("h.score", 1).alias("score"), F.size("h.drivers").alias("drivers"))


@query("""WITH w AS (SELECT serial, ts, id FROM FRAMES WHERE event_type NOT IN ('purchase', 'signup')), t AS (SELECT serial, ts, id, sq FROM FRAMES WHERE event_type IN ('purchase', 'signup') AND sq IS NOT NULL AND sq > 30),
d AS (SELECT serial, ts, id FROM FRAMES WHERE event_type IN ('purchase', 'signup') AND id % 3 = 0)
SELECT w.serial, w.id, t.sq AS sq, d.id AS pub_dt FROM w ASOF LEFT JOIN t ON w.serial = t.serial AND w.ts >= t.ts ASOF LEFT JOIN d ON w.serial = d.serial AND w.ts >= d.ts""")
def j2_independent_asof(spark, sf_dir):
    waves, telemetry = sides(spark, sf_dir)
    told = telemetry.withColumn("sq", F.when(F.col("sq") > 30, F.col("sq"))).withColumn("dt", F.when(F.col("id") % 3 == 0, F.col("id")))
    return asof.attach(waves, told, fresh_ms=math.inf).select("serial", "id", "sq", "pub_dt")


@query("""SELECT event_id AS id, event_type AS format, json_extract_string(props, '$.k') AS sq, value AS onboard_temperature_c FROM events""")
def p2_payload_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    payload = F.to_json(F.struct(F.col("event_type").alias("format"), F.col("k").alias("sq"), F.col("value").alias("onboard_temp_c"), F.array(F.lit(1.0)).alias("numbers")))
    return e.select(F.col("event_id").alias("id"), captures.waveform_metadata(payload).alias("m")).select("id", "m.format", "m.sq", "m.onboard_temperature_c")


@query("""SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings""")
def p1_decoded_waveform(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    text = F.when(F.col("vec_id") % 2 == 0, F.to_json(F.col("embedding").cast("array<double>"))).otherwise(F.to_json(F.struct(F.col("embedding").cast("array<double>").alias("samples"))))
    d = e.select("vec_id", captures.decode_waveform(text).alias("s"))
    return d.select("vec_id", F.size("s").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN k END AS sq, value AS pub_fs_mps, event_id * 1000 + 1 AS device_dt_ns FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)""")
def p3_decoded_telemetry(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    flow = F.struct(F.col("value").cast("string").alias("fs"))
    told = F.struct(F.when(F.col("event_id") % 2 == 0, F.struct(F.col("k").alias("sq"))).alias("diagnose"), flow.alias("flow"), (F.col("event_id") * 1000 + 1).cast("string").alias("dt_ns"))
    text = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(told.alias("payload")))).otherwise(F.to_json(told))
    return e.select(F.col("event_id").alias("id"), captures.decode_telemetry(text).alias("t")).select("id", "t.sq", "t.pub_fs_mps", "t.device_dt_ns")


#: The message fields of p4_flow_metadata, by part, and what they are called afterwards.
P4 = [(part, field, name) for part, fields in captures.TELEMETRY.items() for field, name in fields.items()]
P4_SQL = [f"CASE WHEN (event_id + {k}) % 5 = 0 OR (event_id + {k}) % 7 = 0 THEN NULL ELSE value + {k} END AS {name}" for k, (_, _, name) in enumerate(P4)]


@query(f"""WITH t AS (SELECT event_id AS id, event_id % 100 AS sq, (20 + event_id % 10)::DOUBLE AS pipe_outer_diameter_mm, (1 + event_id % 12)::DOUBLE AS pipe_wall_thickness_mm, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS device_dt_ns, {", ".join(P4_SQL)} FROM events),
b AS (SELECT *, CASE WHEN pipe_outer_diameter_mm > 2 * pipe_wall_thickness_mm THEN pipe_outer_diameter_mm - 2 * pipe_wall_thickness_mm END AS pipe_inner_diameter_mm FROM t)
SELECT * REPLACE (sq::DOUBLE AS sq), onboard_temperature_c AS ots, diagnose_tt_ns AS diagnose_tt, diagnose_dt_ns AS diagnose_dt, round(pi() * (pipe_inner_diameter_mm / 1000) ** 2 / 4, 12) AS pipe_area_from_geometry_m2 FROM b""")
def p4_flow_metadata(spark, sf_dir):
    """All fields of messages in which a fifth of the fields are null, a seventh no numbers, and a third text; a third of the messages are wrapped."""
    e = table(spark, sf_dir, "events")
    parts = {}
    for k, (part, field, _) in enumerate(P4):
        at, value = F.col("event_id") + k, (F.col("value") + k).cast("string")
        said = F.when(at % 5 == 0, "null").when(at % 7 == 0, '"x"').when(at % 3 == 0, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
        parts.setdefault(part, []).append(F.concat(F.lit(f'"{field}":'), said))
    parts["diagnose"].append(F.concat(F.lit('"sq":'), (F.col("event_id") % 100).cast("string")))
    parts["pipe"] = [F.concat(F.lit('"pd":'), (F.col("event_id") % 10 + 20).cast("string")), F.concat(F.lit('"pt":"'), (F.col("event_id") % 12 + 1).cast("string"), F.lit('"'))]
    clock = F.concat(F.lit('"dt_ns":0,"pub_dt_ns":'), F.when(F.col("event_id") % 4 == 0, '"none"').otherwise(F.col("event_id").cast("string")))
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{part}":{{'), F.concat_ws(",", *fields), F.lit("}")) for part, fields in parts.items()], clock)
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"payload":{'), body, F.lit("}}"))).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    told = e.select(F.col("event_id").alias("id"), captures.decode_telemetry(text).alias("t")).select("id", "t.*")
    return told.withColumn("pipe_area_from_geometry_m2", F.round("pipe_area_from_geometry_m2", 12))


@query("""SELECT event_id AS id, upper('ab-' || user_id) AS serial, date_trunc('second', ts) AS ts FROM events""")
def p9_serial_and_time(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    topic = F.concat(F.when(F.col("event_id") % 2 == 0, "meter/sig/").otherwise("other/x/"), F.lit("ab-"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), c.topic_serial(topic).alias("serial"), c.timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast(dict(e.dtypes)["ts"]).alias("ts"))


@query("""SELECT upper('m' || user_id) AS serial, count(*) FILTER (event_type = 'view') AS waveforms, count(*) FILTER (event_type = 'click') AS telemetry FROM events GROUP BY ALL HAVING count(*) FILTER (event_type IN ('view', 'click')) > 0""")
def t1_routing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "meter/sig/m").when(F.col("event_type") == "click", "meter/pub/m").otherwise("else/m")
    waves, told = stream.route(e.select(F.concat(kind, F.col("user_id").cast("string")).alias("topic"), "ts", F.lit("[1, 2]").alias("payload")))
    both = waves.select("serial", F.lit(1).alias("w")).union(told.select("serial", F.lit(0)))
    return both.groupBy("serial").agg(F.sum("w").alias("waveforms"), F.sum(1 - F.col("w")).alias("telemetry"))


@query("""SELECT l_linestatus AS label, count(*) AS rows FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""")
def p11_label_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("label", F.concat(F.lit(" "), F.lower("l_linestatus")))
    return fit.keep_labels(li, {"o"}).groupBy(F.upper(F.trim("label")).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 THEN -1 ELSE l_quantity END AS i FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN i >= 0 THEN i / 100 ELSE -1 END, 6)::DOUBLE AS arrival_us FROM l""")
def f3_arrival(spark, sf_dir):
    i = F.when(F.col("l_quantity") < 25, -1.0).otherwise(F.col("l_quantity").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(waveform.arrival_us(i), 6).alias("arrival_us"))


@query(f"""SELECT feature, round(quantile_cont(v, 0.01), 7) AS p01, round(quantile_cont(v, 0.05), 7) AS p05 FROM
(SELECT unnest(['gate_rms_v', 'peak_abs_gate_v', 'snr_db', 'template_corr', 'low_clip_ratio']) AS feature, unnest([gate_rms_v, peak_abs_gate_v, snr_db, template_corr, low_clip_ratio]) AS v FROM {FEATURED_SQL}) GROUP BY ALL""")
def f13_empty_pipe_fit(spark, sf_dir):
    d = featured_frames(spark, sf_dir).withColumn("noise_rms_v", F.lit(1.0)).withColumn("baseline_v", F.lit(1.0))
    out = fit.empty_pipe_quantiles(d).where(~F.col("feature").isin("noise_rms_v", "baseline_v"))
    return out.select("feature", F.round("p01", 7).alias("p01"), F.round("p05", 7).alias("p05"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT vec_id, e, list_median(e[1:16]) AS b FROM e)
SELECT vec_id, 32 AS n, round(list_sum(list_transform(e[9:40], lambda x: greatest(-1.5, least(1.5, (x - b) / 0.1)))), 5) AS total FROM m""")
def e3_normalized_crop(spark, sf_dir):
    d = waves_of(spark, sf_dir).select("vec_id", waveform.centered(F.col("samples"), 16, 0.1, 1.5, 8, 40).alias("s"))
    return d.select("vec_id", F.size("s").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""SELECT id, value, event_type FROM FRAMES WHERE id = 77""")
def r5_lookup(spark, sf_dir):
    return frame_ops.lookup(frames(spark, sf_dir).select("id", "value", "event_type"), 77, "id")


@query("""WITH g AS (SELECT DISTINCT serial, date_trunc('day', ts) AS s FROM FRAMES WHERE event_type = 'error'), h AS (SELECT serial, s + INTERVAL 6 HOUR AS "start", s + INTERVAL 30 HOUR AS "end" FROM g)
SELECT serial, "start", count(*) AS n, round(median(value), 6) AS target FROM FRAMES JOIN h USING (serial) WHERE ts >= "start" AND ts <= "end" GROUP BY ALL""")
def d4_segment_targets(spark, sf_dir):
    f = frames(spark, sf_dir)
    day = F.date_trunc("day", "ts")
    spans = f.where("event_type = 'error'").select("serial", (day + F.expr("INTERVAL 6 HOURS")).alias("start"), (day + F.expr("INTERVAL 30 HOURS")).alias("end")).distinct()
    out = drift.segment_targets(f, spans, "value")
    return out.select("serial", F.col("start").cast(dict(f.dtypes)["ts"]).alias("start"), "n", F.round("target", 6).alias("target"))


@query("""SELECT id FROM FRAMES WHERE serial <> 7""")
def io7_purge(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("serial", F.col("serial").cast("string"))
    return captures.purge(f, "7")[0].select("id")
