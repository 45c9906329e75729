"""The zero tracker, self-training and the stream."""

import datetime as dt
import json
import math
import os
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavejobs.functions import waveform
from wavejobs.functions.columns import FEATURES
from wavejobs.operators import adapt, fit, neighbors, states, zero
from wavejobs.sources import captures
from wavejobs.streaming import frames as stream

T0 = dt.datetime(2024, 3, 1)


def night(meters=3, n=120):
    rng = random.Random(8)
    rows = []
    for m in range(meters):
        now = T0
        for i in range(n):
            now += dt.timedelta(seconds=25 if i == 40 else 2)
            flow = 0.4 if 70 <= i < 80 else rng.gauss(0.0, 0.0005)
            rows.append((f"M{m}", now, m * 1000 + i, flow, 25.0 - i * 0.0005 if i else 0.0, rng.choice(("normal_acoustic_state", "waveform_anomaly")) if i < 90 else "waveform_anomaly"))
    return rows


SCHEMA = "serial string, ts timestamp, id long, raw_fs_mps double, temperature_c double, raw_state string"


def test_tracker_states(spark):
    got = {r.id: r for r in zero.track(spark.createDataFrame(night(1), SCHEMA)).collect()}
    assert got[40].data_gap and got[40].state_name == "data_gap" and got[40].zero_probability == 0
    assert got[75].state_name == "event_flow" and got[75].displayed_gpm > 1
    assert got[0].temperature_c == 25.0  # 0.0 degrees count as missing
    assert got[30].displayed_gpm == 0 and got[30].zero_stability > 0 and not got[0].data_gap
    for r in got.values():
        assert all(0 <= p <= 1 for p in (r.zero_probability, r.phantom_probability, r.event_probability, r.measurement_confidence))
        assert math.isclose(r.corrected_fs_mps, r.raw_fs_mps - r.zero_estimate_fs)


def prepared(frame, ts="ts"):
    cols = [c.alias(n) for n, c in zero.frame_columns(frame).items()]
    return frame.select("serial", F.unix_micros(ts).alias("us"), "id", *cols)


def test_tracker_in_chunks_is_the_same(spark):
    rows = [("A", T0 + dt.timedelta(seconds=2 * i), i, 0.001 * math.sin(i), 20 + i / 50, 0.26, "pub_only" if i % 9 == 0 else "wave", i % 7 != 0) for i in range(90)]
    frame = spark.createDataFrame(rows, "serial string, ts timestamp, id long, raw_fs_mps double, ots double, noise_rms_v double, source_type string, waveform_supported boolean")
    pdf = prepared(frame).orderBy("us").toPandas()
    whole = zero.walk(pdf, zero.State())
    state, parts = zero.State(), []
    for k in range(0, 90, 17):
        parts.append(zero.walk(pdf.iloc[k : k + 17], state))
        state = zero.State(**json.loads(json.dumps(state.as_dict())))
    pd.testing.assert_frame_equal(whole, pd.concat(parts))
    corr = {r.id: r.worn for r in prepared(frame).collect()}  # a missing correlation wears a waveform frame, not telemetry
    assert corr[1] > corr[9] == corr[7] == corr[0]


def test_tracker_row_by_row(spark):
    """Each frame's numbers follow from the frame before by the rules, taken one at a time."""
    cfg, rng, now, rows = zero.Config(), random.Random(5), T0, []
    for i in range(400):
        now += dt.timedelta(seconds=rng.choice((1, 2, 5, 30)))
        rows.append(("A", now, i, 0.3 if 200 <= i < 230 else rng.gauss(0.002, 0.001), 20 + 3 * math.sin(i / 40) + rng.gauss(0, 0.05), 0.996 + rng.gauss(0, 0.001), 0.25 + rng.random() / 50))
    frame = spark.createDataFrame(rows, "serial string, ts timestamp, id long, raw_fs_mps double, ots double, template_corr double, noise_rms_v double")
    got = sorted(zero.track(frame).collect(), key=lambda r: r.id)
    close = lambda a, b: math.isclose(a, b, abs_tol=1e-9)
    heats, learned = [r[4] for r in rows], 0
    for i, (r, b) in enumerate(zip(got, [None, *got])):
        heat, minutes = heats[i], max((rows[i][1] - rows[i - 1][1]).total_seconds() / 60, 0.001) if i else 0.001
        gain = 1.0 if b is None else min(0.35, max(0.015, 1 - math.exp(-minutes / cfg.tau_min)))
        level = heat if b is None else b.thermal_temp_c + gain * (heat - b.thermal_temp_c)
        assert close(r.thermal_temp_c, level)
        slope = 0.0 if b is None else max(-0.35, min(0.35, (level - b.thermal_temp_c) / minutes))
        assert close(r.temp_rate_c_per_min, slope)
        warm = sorted(heats[: min(i + 1, 12)])
        middle = (warm[(len(warm) - 1) // 2] + warm[len(warm) // 2]) / 2
        assert close(r.temp_model_fs, 0.002 * (level - middle) + 0.002 * (1.45 if slope < 0 else 1) * 1.8 * slope)
        learns = r.no_flow_run > 0
        learned += learns
        assert r.no_flow_run == (1 + (b.no_flow_run if b else 0) if learns else 0)
        bias = b.adaptive_zero_fs if b else 0.0
        aim = r.temp_model_fs + (bias + 0.045 * (r.raw_fs_mps - r.temp_model_fs - bias) if learns else bias * 0.995)
        most = max(0.00005, 0.006 * minutes)
        estimate = aim if b is None else max(b.zero_estimate_fs - most, min(b.zero_estimate_fs + most, aim))
        assert close(r.zero_estimate_fs, estimate) and close(r.adaptive_zero_fs, estimate - r.temp_model_fs)
        steady = (b.zero_stability if b else 0.0) + (0.08 if learns else -0.04)
        assert close(r.zero_stability, max(0.0, min(1.0, steady)))
        assert r.data_gap == (b is not None and minutes > 1 / 3) and not (r.data_gap and learns)
        assert close(r.corrected_fs_mps, r.raw_fs_mps - estimate)
        if r.displayed_gpm == 0 and r.display_suppression_reason == "":
            assert r.published_gpm <= 0
    assert 20 < learned < 380 and {"event_flow", "data_gap"} <= {r.state_name for r in got}


TELEMETRY = "serial string, ts timestamp, id long, sq double, dt long"


def files(spark, path, parts, schema):
    """A folder that a stream reads part by part."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k}")
        for f in os.listdir(f"{path}/{k}"):
            if f.endswith(".parquet"):
                os.utime(f"{path}/{k}/{f}", (1_700_000_000 + k * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def wide(spark, rows=None):
    """Frames and telemetry of a night in one table: side 1 and 0."""
    frame = spark.createDataFrame(rows or night(), SCHEMA).withColumn("template_corr", 0.996 + F.pmod(F.xxhash64("id"), F.lit(100)) / 5000)
    told = spark.createDataFrame([(f"M{m}", T0 + dt.timedelta(seconds=30 * k), k, float(k), 10 * k) for m in range(3) for k in range(6)], TELEMETRY)
    return stream.inputs(frame, told)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    inputs = wide(spark)
    batch = {(r.serial, r.id): r for r in stream.track(inputs).collect()}
    cut = sorted(inputs.collect(), key=lambda r: (r.us, r.side))
    parts = [cut[k * 95 : (k + 1) * 95] for k in range(4)]
    for p in parts:
        rng.shuffle(p)
    late = [next(r for r in cut if r.id == 0 and r.side == 1)]
    source = files(spark, f"{tmp_path}/in", [*parts, late], inputs.schema)
    done = stream.sink(stream.track(source, ttl="7 days", watermark="1 hour"), f"{tmp_path}/frames", f"{tmp_path}/events", f"{tmp_path}/check")
    done.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/frames")
    got = {(r.serial, r.id): r for r in out.collect()}
    assert set(got) == set(batch) and out.count() == len(batch)
    for i, r in batch.items():
        assert math.isclose(got[i].zero_estimate_fs, r.zero_estimate_fs, abs_tol=1e-12)
        for c in ("state", "transitioned", "bad_count", "empty_pipe", "air_bubble", "sq", "sq_label", "pub_dt", "pub_dt_delta", "corr_std"):
            assert getattr(got[i], c) == getattr(r, c), (i, c)
    assert spark.read.parquet(f"{tmp_path}/events").count() == sum(r.transitioned for r in batch.values())
    assert {r.sq for r in batch.values()} >= {0.0, 5.0} and any(r.pub_dt_delta == 10 for r in batch.values())
    stream._put(spark.createDataFrame([(1,)], "v long"), 0, f"{tmp_path}/again")
    stream._put(spark.createDataFrame([(1,)], "v long"), 0, f"{tmp_path}/again")
    assert spark.read.parquet(f"{tmp_path}/again").count() == 1  # a batch that runs again replaces its rows


def test_live_state_agrees_with_the_windows(spark):
    frame = spark.createDataFrame(night(), SCHEMA).withColumn("template_corr", 0.996 + F.pmod(F.xxhash64("id"), F.lit(100)) / 5000).withColumn("raw_state", F.when(F.col("id") % 50 > 30, states.EMPTY).otherwise(F.col("raw_state")))
    live = {r.id: r for r in stream.track(stream.inputs(frame), stream.Rules(sigma=0.001)).collect()}
    held = states.air_bubble(states.empty_pipe(states.debounce(frame, "raw_state")), 0.001)
    for r in held.collect():
        assert (live[r.id].state, live[r.id].empty_pipe, live[r.id].air_bubble, live[r.id].bad_count) == (r.state, r.empty_pipe, r.air_bubble, r.bad_count)


def test_warm_start_and_late_rows(spark):
    rows = wide(spark)
    cut = T0 + dt.timedelta(seconds=100)
    whole = {(r.serial, r.id): r for r in stream.track(rows).collect()}
    before = stream.snapshot(rows.where(F.col("at") < F.lit(cut)))
    assert before.count() == 3
    for r in stream.track(rows.where(F.col("at") >= F.lit(cut)), start=before).collect():
        w = whole[(r.serial, r.id)]
        assert r.zero_estimate_fs == w.zero_estimate_fs and r.state == w.state and r.sq == w.sq and r.no_flow_run == w.no_flow_run


def test_scores_come_later(spark, tmp_path):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(20)] + [(100, None), (101, [1.0])]
    frames = spark.createDataFrame(rows, "row long, samples array<double>")
    source = files(spark, f"{tmp_path}/in", [rows[:12], rows[12:]], frames.schema)
    stream.scored(source, neighbors.linear_encoder(np.eye(3)[:2]), f"{tmp_path}/scores", f"{tmp_path}/check").awaitTermination(120)
    more = frames.union(spark.createDataFrame([(500, [1.0, 2.0, 3.0])], frames.schema))
    got = {r.row: (r.status, r.reconstruction_mse) for r in stream.scores_so_far(more, spark.read.parquet(f"{tmp_path}/scores")).collect()}
    assert got[3] == ("completed", 4 / 3) and got[100][0] == got[101][0] == "error" and got[500] == ("pending", None) and len(got) == 23


def echo(n=256, peak=120, seed=0, gain=1.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n) - peak
    wave = 1.4 + 0.02 * rng.standard_normal(n)
    return wave + gain * np.where(t >= -8, np.exp(-np.abs(t) / 20.0) * np.cos(t / 3.0), 0.0)


def test_features_and_probes(spark):
    waves = [echo(seed=i).tolist() for i in range(60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(waves)] + [(100, [1.0, 2.0]), (101, None)], "id long, samples array<double>")
    good = df.where("id < 60")
    row = fit.template(good, "samples", 60, 60).first()
    assert abs(row.peak - 120) <= 1 and row.gate_start == 60 and row.rows == 60
    p = waveform.Profile.from_row(row, baseline=60)
    got = {r.id: r.f for r in df.select("id", waveform.extract(df.samples, p, 256).alias("f")).collect()}
    assert got[100].gate_rms_v is None and got[101].gate_rms_v is None
    w = np.array(waves[0])
    base = np.median(w[:60])
    gate = (w - base)[row.gate_start : row.gate_end]
    assert math.isclose(got[0].gate_rms_v, math.sqrt(np.mean(gate**2))) and math.isclose(got[0].ptp_v, w.max() - w.min())
    assert got[0].template_corr > 0.98 and abs(got[0].peak_offset_samples) <= 1
    flat = waveform.features(np.full((1, 256), 1.4), p)
    assert flat["template_corr"][0] == 0 and flat["first_arrival_offset_samples"][0] == waveform.NO_ARRIVAL
    features = good.select(waveform.extract(good.samples, p, 256).alias("f")).select("f.*")
    stats = fit.stats_of(fit.robust_fit(features, list(FEATURES)))
    limit = fit.thresholds(features.select(fit.score(list(FEATURES), stats).alias("score"))).first().anomaly
    for name in ("attenuated", "noise_only", "delayed", "bias", "gain"):
        probed = good.select(waveform.probed(good.samples, name, 256, 60).alias("samples"))
        scored = probed.select(waveform.extract(probed.samples, p, 256).alias("f")).select("f.*").select(fit.score(list(FEATURES), stats).alias("s"))
        assert scored.where(scored.s >= limit).count() >= 55, name
    model = adapt.Adaptive(p, stats, suspect=3.0, window=8)
    frames = good.selectExpr("'A' AS serial", "id AS ts", "id", "samples")
    moved = adapt.adapt(frames, model).orderBy("id").collect()
    assert not any(r.trained for r in moved[:7]) and moved[-1].updates == sum(r.trained for r in moved) > 10


def test_captures(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,serial,label,s_0,s_10,s_2\n2024-01-01T00:00:00Z,x1,good,1,3,2\n2024-01-01T00:00:01Z,x1,poor,1,oops,2\n")
    got = captures.read_capture(spark, f"{tmp_path}/a.csv").collect()
    assert len(got) == 1 and got[0].samples == [1.0, 2.0, 3.0]
    (tmp_path / "log.jsonl").write_text('{"serial":"A","v":1}\n\nnot json\n[1]\n{"serial":"B","v":2}\n{"serial":"A","v":\n')
    log = captures.read_log(spark, f"{tmp_path}/log.jsonl", "serial string, v double")
    assert sorted((r.serial, r.v) for r in log.collect()) == [("A", 1.0), ("B", 2.0)]
    kept, counts = captures.purge(log.union(spark.createDataFrame([(None, 3.0)], "serial string, v double")), "A")
    assert kept.count() == 2 and tuple(counts.first()) == (2, 1)
    captures.export_capture(spark.createDataFrame([("A", [1.0, float("nan"), 3.0, 4.0]), ("B", [1.0])], "serial string, samples array<double>").coalesce(1), f"{tmp_path}/out", 3, ["serial"])
    lines = sorted(x for f in (tmp_path / "out").glob("*.csv") for x in f.read_text().splitlines())
    assert lines == ["A,1.0,,3.0", "B,1.0,,", "serial,s_0,s_1,s_2"]


def test_payloads(spark):
    cases = [(b"[1, 2.5]", [1.0, 2.5]), (b'{"numbers":[1]}', [1.0]), (b'{"samples":[2]}', [2.0]), (b'{"waveform":[3]}', [3.0]), (b'{"s_10":3,"s_2":2,"s_0":1}', [1.0, 2.0, 3.0]), (bytes([10, 33]), [1.0, 3.3]), (b'{"x":1}', None)]
    df = spark.createDataFrame([(i, bytearray(p)) for i, (p, _) in enumerate(cases)], "i int, p binary")
    got = {r.i: r.s for r in df.select("i", captures.decode_waveform(df.p).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    text = '{"payload":{"flow":{"fs":"0.001","fr":"x"},"diagnose":{"sq":"77"},"pipe":{"pd":"26.67","pt":"2.87"},"dt_ns":"0"},"pub_dt_ns":"5"}'
    t = spark.createDataFrame([(text,)], "p string")
    r = t.select(captures.decode_telemetry(t.p).alias("t")).first().t
    assert (r.sq, r.pub_fs_mps, r.pub_fr_m3h, r.device_dt_ns) == (77.0, 0.001, None, None) and abs(r.pipe_area_from_geometry_m2 - math.pi * 0.02093**2 / 4) < 1e-9
    waves, meters = stream.route(spark.createDataFrame([("meter/sig/ab-1", T0, "[1]"), ("meter/pub/ab-1", T0, text), ("other", T0, "")], "topic string, ts timestamp, payload string"))
    assert [(w.serial, w.samples) for w in waves.collect()] == [("AB-1", [1.0])] and meters.first().serial == "AB-1"


def test_telemetry_fields(spark):
    texts = [
        '{"diag":{"sq":null},"diagnostic":{"sq":"nan"},"payload":{"diagnose":{"sq":" 61 ","tt":5,"dt":"-2e3"},"corrected":{"pipe_area":"0.0003","corr_fs":0.5},"dt_ns":0,"pub_dt_ns":"","device_dt_ns":12.7}}',
        '{"diagnose":{"sq":3},"payload":"text","flow":{"fs":1,"ots":41.5},"raw":{"flow_total":true},"measure_config":{"kf":"1.01"},"pipe":{"pd":10,"pt":6},"dt_ns":"12.7","pub_dt_ns":9}',
        "[1, 2]", "nothing", None, '{"payload":{},"flow":{"fs":1}}',
    ]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, p string")
    got = {r.i: r.t.asDict() for r in t.select("i", captures.decode_telemetry(t.p).alias("t")).collect()}
    assert len(got[0]) == 31 and set(got[0]) == set(captures.telemetry_fields())
    known = lambda i: {k: v for k, v in got[i].items() if v is not None}
    assert known(0) == {"sq": 61.0, "diagnose_tt_ns": 5.0, "diagnose_tt": 5.0, "diagnose_dt_ns": -2000.0, "diagnose_dt": -2000.0, "pipe_area_m2": 0.0003, "corr_fs_mps": 0.5, "device_dt_ns": 12}
    assert known(1) == {"sq": 3.0, "pub_fs_mps": 1.0, "onboard_temperature_c": 41.5, "ots": 41.5, "measure_kf": 1.01, "pipe_outer_diameter_mm": 10.0, "pipe_wall_thickness_mm": 6.0}
    assert [known(i) for i in range(2, 6)] == [{}] * 4


def test_from_telemetry_to_the_tracker(spark):
    """A message's fields reach the tracker under the names that it looks for."""
    said = [
        '{"flow":{"fs":"0.001","ots":"30"},"pipe":{"pd":26.67,"pt":2.87}}', '{"raw":{"flow_speed":0.002},"corrected":{"pipe_area":0.0004}}', '{"corrected":{"zero_corr_fs":0.003,"corr_fs":9}}',
        '{"corrected":{"corr_fs":0.004,"zero_corr_fr":1}}', '{"raw":{"flow_rate":0.5}}', '{"corrected":{"corr_fr":0.25},"pipe":{"pd":40,"pt":5}}',
    ]
    t = spark.createDataFrame([("A", T0 + dt.timedelta(seconds=i), i, x) for i, x in enumerate(said)], "serial string, ts timestamp, id long, p string")
    frames = t.select("serial", "ts", "id", captures.decode_telemetry(t.p).alias("t")).select("serial", "ts", "id", "t.*").withColumn("source_type", F.lit("pub_only"))
    got = {r.id: r for r in prepared(frames).join(frames.select("id"), "id").collect()}
    own, usual = [math.pi * x**2 / 4 for x in (0.02093, 0.03)], zero.Config().area_m2
    assert [round(got[i].speed, 9) for i in range(4)] == [0.001, 0.002, 0.003, 0.004]
    assert math.isclose(got[4].speed, 0.5 / (usual * 3600)) and math.isclose(got[5].speed, 0.25 / (own[1] * 3600))
    assert math.isclose(got[0].per_speed, own[0] * 3600) and got[1].per_speed == 0.0004 * 3600 and got[0].heat == 30
    assert zero.track(frames).count() == 6


def test_meters_in_batches(spark):
    frame = spark.createDataFrame(night(4, 90), SCHEMA)
    narrow = prepared(frame).orderBy("us").toPandas()
    whole = pd.concat([zero.walk(p, zero.State()) for _, p in narrow.groupby("serial")]).set_index("id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        tracked = zero.track(frame)
        got = tracked.toPandas().set_index("id")
        for each in (tracked, stream.track(stream.inputs(frame))):
            assert "FlatMapGroups" not in each._jdf.queryExecution().toString()
        live = stream.track(stream.inputs(frame)).toPandas().set_index("id")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(live) == len(whole) == 360
    assert (got["zero_estimate_fs"].loc[whole.index] == whole["estimate"]).all() and (live["no_flow_run"].loc[whole.index] == whole["quiet_run"]).all()
