"""The live state of meters: one stateful processor, equal to the fold over a table."""

import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavejobs.functions import waveform
from wavejobs.functions.columns import FEATURES
from wavejobs.operators import adapt, states
from wavejobs.streaming import frames as stream
from wavejobs.streaming import live

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "serial string, ts timestamp, id long, raw_fs_mps double, temperature_c double, raw_state string, template_corr double"
TELEMETRY = "serial string, ts timestamp, id long, sq double, dt long"


def night(meters=2, n=60, seed=8):
    rng, rows = random.Random(seed), []
    for m in range(meters):
        now = T0
        for i in range(n):
            now += dt.timedelta(seconds=25 if i == 20 else 2)
            rows.append((f"M{m}", now, m * 1000 + i, 0.4 if 35 <= i < 40 else rng.gauss(0, 0.0005), 25 - i / 2000, states.EMPTY if i % 25 > 17 else states.NORMAL, None if i % 11 == 3 else 0.996 + rng.random() / 50))
    return rows


def inputs(spark, rows=None):
    told = spark.createDataFrame([(f"M{m}", T0 + dt.timedelta(seconds=20 * k), k, float(k), 10 * k) for m in range(2) for k in range(5)], TELEMETRY)
    return stream.inputs(spark.createDataFrame(rows or night(), SCHEMA), told)


def files(spark, path, parts, schema):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k}")
        for f in os.listdir(f"{path}/{k}"):
            if f.endswith(".parquet"):
                os.utime(f"{path}/{k}/{f}", (1_700_000_000 + k * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def ran(spark, tracked, tmp_path):
    stream.sink(tracked, f"{tmp_path}/frames", f"{tmp_path}/events", f"{tmp_path}/check").awaitTermination(170)
    return spark.read.parquet(f"{tmp_path}/frames").collect()


SAME = ("state", "transitioned", "bad_count", "empty_pipe", "air_bubble", "sq", "pub_dt", "pub_dt_delta", "corr_std", "no_flow_run", "trained", "updates")


def agree(got, batch):
    assert len(got) == len(batch)
    for r in got:
        b = batch[(r.serial, r.id)]
        assert math.isclose(r.zero_estimate_fs, b.zero_estimate_fs, abs_tol=1e-12)
        assert [getattr(r, c) for c in SAME] == [getattr(b, c) for c in SAME], (r, b)


def end(schema, serial="END", seconds=100_000):
    """A row of another meter that moves the watermark past all others."""
    row = dict.fromkeys(schema.fieldNames()) | {"serial": serial, "at": T0 + dt.timedelta(seconds=seconds), "id": 1, "side": 1, "raw_state": "x"}
    row["us"] = int(row["at"].replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    numbers = {f.name: 0.0 for f in schema if f.dataType.typeName() == "double" and f.name not in ("corr", "sq")}
    return tuple((row | numbers | {"still": False, "sensed": False})[n] for n in schema.fieldNames())


def test_rows_out_of_order_within_the_watermark(spark, tmp_path):
    rows = inputs(spark)
    batch = {(r.serial, r.id): r for r in stream.track(rows).collect()}
    cut = sorted((tuple(r) for r in rows.collect()), key=lambda r: r[rows.columns.index("us")] + random.Random(str(r)).randrange(40_000_000))
    parts = [cut[k::1][: len(cut) // 3 + 1] for k in (0, len(cut) // 3 + 1, 2 * (len(cut) // 3 + 1))]
    assert sum(map(len, parts)) == len(cut)
    source = files(spark, f"{tmp_path}/in", [*parts, [end(rows.schema)], [end(rows.schema, seconds=100_001)]], rows.schema)
    got = ran(spark, stream.track(source, watermark="2 minutes", reorder=True), tmp_path)
    agree([r for r in got if r.serial != "END"], batch)
    assert all(r.late_rows == 0 for r in got)


def test_rows_without_a_time(spark, tmp_path):
    """They come last in a table and with their batch in a stream, are never late, and stop nothing."""
    frame = spark.createDataFrame([*night(1, 20), ("M0", None, 500, 0.1, 20.0, states.NORMAL, 0.99), ("M0", None, 501, None, None, None, None)], SCHEMA)
    rows = stream.inputs(frame)
    got = {r.id: r for r in stream.track(rows).collect()}
    assert len(got) == 22 and got[500].us is None and got[501].late_rows == 0 and got[500].source_gap_ms == 0
    both = [tuple(r) for r in rows.collect()]
    first = [r for r in both if r[rows.columns.index("id")] in (0, 1, 500, 501)]
    source = files(spark, f"{tmp_path}/in", [first, [r for r in both if r not in first]], rows.schema)
    out = ran(spark, stream.track(source), tmp_path)
    assert {r.id for r in out} == set(got) and all(r.late_rows == 0 for r in out)


@pytest.mark.parametrize("watermark", ["10 seconds"])
def test_silent_meters_are_forgotten(spark, tmp_path, watermark):
    rows = inputs(spark, night(2, 30))
    cut = sorted((tuple(r) for r in rows.collect()), key=lambda r: r[rows.columns.index("us")])
    at = lambda r, s: tuple((v if n not in ("us", "at", "id") else (v + s * 1_000_000 if n == "us" else v + dt.timedelta(seconds=s) if n == "at" else v + 5000)) for n, v in zip(rows.columns, r))
    m0 = [r for r in cut if r[0] == "M0"]
    again = [at(r, 200_000) for r in m0]
    source = files(spark, f"{tmp_path}/in", [m0, [end(rows.schema)], [end(rows.schema, seconds=100_001)], again], rows.schema)
    got = {r.id: r for r in ran(spark, stream.track(source, ttl="1 hour", watermark=watermark), tmp_path) if r.serial == "M0"}
    fresh = {r.id: r for r in stream.track(rows.where("serial = 'M0'")).collect()}
    assert len(got) == 60
    for i, r in fresh.items():
        assert got[i].zero_estimate_fs == r.zero_estimate_fs == got[i + 5000].zero_estimate_fs and got[i + 5000].no_flow_run == r.no_flow_run and got[i + 5000].state == r.state


def echo(n=120, peak=60, seed=0, gain=1.0):
    rng, t = np.random.default_rng(seed), np.arange(n) - peak
    return 1.4 + 0.02 * rng.standard_normal(n) + gain * np.where(t >= -8, np.exp(-np.abs(t) / 20.0) * np.cos(t / 3.0), 0.0)


def trained_rows(spark, n=40):
    waves = np.stack([echo(seed=i) for i in range(n)])
    gate = (waves - np.median(waves[:, :30], 1)[:, None]).mean(0)[40:90]
    profile = waveform.Profile(gate, 60, 40, 90, baseline=30)
    x = waveform.features(waves, profile)
    stats = {f: {"center": float(np.median(x[f])), "robust_sigma": max(float(np.std(x[f])), 1e-3), **{q: float(np.quantile(x[f], p)) for q, p in (("p01", 0.0), ("p05", 0.0), ("p95", 1.0), ("p99", 1.0))}} for f in FEATURES}
    model = adapt.Adaptive(profile, stats, 3.0, window=5, ratio=0.4, anomaly=6.0)
    rows = [("M0", T0 + dt.timedelta(seconds=2 * i), i, 0.0, 20.0, echo(seed=500 + i, gain=0.02 if 20 <= i < 26 else 1.0).tolist() if i != 30 else None, i % 7 != 3) for i in range(n)]
    frame = spark.createDataFrame(rows, "serial string, ts timestamp, id long, raw_fs_mps double, temperature_c double, samples array<double>, good boolean").withColumn("raw_state", F.lit(None).cast("string"))
    return frame, model


def test_own_profile_in_the_same_state(spark, tmp_path):
    frame, model = trained_rows(spark)
    rules = stream.Rules(model=model, corr_rows=4, sigma=0.001)
    rows = stream.inputs(frame)
    batch = {(r.serial, r.id): r for r in stream.track(rows, rules).collect()}
    alone = {r.id: r for r in adapt.adapt(frame.where("samples IS NOT NULL"), model, good="good").collect()}
    for (_, i), r in batch.items():
        assert (r.score, r.trained, r.updates) == ((alone[i].score, alone[i].trained, alone[i].updates) if i != 30 else (None, None, None))
    assert batch[("M0", 39)].updates > 5 and batch[("M0", 23)].state == states.EMPTY and batch[("M0", 39)].state == states.NORMAL
    assert {r.raw_state for r in batch.values()} >= {states.EMPTY, states.NORMAL, None} and 0 < batch[("M0", 39)].stable_ratio <= 1
    cut = [tuple(r) for r in rows.orderBy("us").collect()]
    source = files(spark, f"{tmp_path}/in", [cut[:13], cut[13:29], cut[29:]], rows.schema)
    agree(ran(spark, stream.track(source, rules), tmp_path), batch)


def test_the_stream_starts_where_a_table_ends(spark, tmp_path):
    frame, model = trained_rows(spark)
    rules = stream.Rules(model=model, corr_rows=4, sigma=0.001)
    rows = stream.inputs(frame)
    batch = {(r.serial, r.id): r for r in stream.track(rows, rules).collect()}
    start = stream.snapshot(rows.where("id < 25"), rules)
    later = [tuple(r) for r in rows.where("id >= 25").orderBy("us").collect()]
    source = files(spark, f"{tmp_path}/in", [later[:6], later[6:]], rows.schema)
    agree(ran(spark, stream.track(source, rules, start=start), tmp_path), {k: r for k, r in batch.items() if k[1] >= 25})


def test_typed_states_are_the_state():
    rules = stream.Rules()
    fresh = rules.fresh()
    assert live.from_typed(*live.to_typed(fresh)) == fresh
