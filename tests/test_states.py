"""Ordered windows against sequential loops."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from wavejobs.operators import asof, daily, history, states

T0 = dt.datetime(2024, 3, 1)
N, E, W = states.NORMAL, states.EMPTY, states.WEAK


def walk(seed, n=400, meters=3):
    rng = random.Random(seed)
    rows, now = [], T0
    for i in range(n):
        now += dt.timedelta(seconds=rng.choice((1, 2, 30, 3000)))
        state = rows[-1][3] if rows and rng.random() < 0.6 else rng.choice((N, E, W, "waveform_anomaly"))
        rows.append((f"M{rng.randrange(meters)}", now, i, state, rng.gauss(0.99, 0.003 if i % 100 < 60 else 0.05)))
    return rows


def per_meter(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


SCHEMA = "serial string, ts timestamp, id long, raw string, template_corr double"


@pytest.mark.parametrize("seed", range(3))
def test_debounce(spark, seed):
    rows = walk(seed)
    got = {r.id: r for r in states.debounce(spark.createDataFrame(rows, SCHEMA).repartition(5), "raw").collect()}
    for own in per_meter(rows).values():
        shown, pending, count, stay = N, None, 0, 0
        for k, r in enumerate(own):
            before = shown
            if r[3] == shown and k:
                pending, count = None, 0
            else:
                count = count + 1 if pending == r[3] else 1
                pending = r[3]
                if r[3] != shown and count >= (5 if r[3] == N else 3):
                    shown, pending, count = r[3], None, 0
            stay = 1 if k == 0 or shown != before else stay + 1
            assert got[r[2]].state == shown, (k, r)
            assert got[r[2]].frames_in_state == stay
            assert got[r[2]].transitioned == (k > 0 and shown != before)


@pytest.mark.parametrize("seed", range(2))
def test_empty_pipe_and_air(spark, seed):
    rows = walk(seed)
    df = states.air_bubble(states.empty_pipe(spark.createDataFrame(rows, SCHEMA), "raw"), 0.004)
    got = {r.id: r for r in df.collect()}
    for own in per_meter(rows).values():
        last, on, corr, air = deque(maxlen=5), False, deque(maxlen=20), False
        for r in own:
            last.append(r[3] in (E, W))
            on = sum(last) >= 3 if not on else sum(last) > 1
            corr.append(r[4])
            if len(corr) == 20:
                m = sum(corr) / 20
                s = (sum((c - m) ** 2 for c in corr) / 19) ** 0.5
                assert abs(got[r[2]].corr_std - s) < 1e-9
                air = s >= 0.02 if not air else s >= 0.01
            assert (got[r[2]].empty_pipe, got[r[2]].air_bubble) == (on, air)
    with pytest.raises(ValueError):
        states.air_bubble(df, 0.004, recovery=1.5)


@pytest.mark.parametrize("most", [1, 7, 50, 1000])
def test_series_buckets(spark, most):
    rows = [("A", T0 + dt.timedelta(minutes=97 * i), i, float(i) if i % 7 else None) for i in range(103)] + [("B", T0, 500, float("nan"))]
    got = history.series(spark.createDataFrame(rows, "serial string, ts timestamp, id long, v double"), ["v"], max_points=most).collect()
    a = sorted((r for r in got if r.serial == "A"), key=lambda r: r.bucket)
    if most >= 103:
        want = [[r] for r in rows[:103]]
    else:
        want = [rows[:103][b * 103 // most : max(b * 103 // most + 1, (b + 1) * 103 // most)] for b in range(most)]
    assert [r["count"] for r in a] == [len(w) for w in want]
    for r, w in zip(a, want):
        values = [x[3] for x in w if x[3] is not None]
        assert r.v_min == min(values, default=None) and r.v_latest == w[-1][3] and r.ts == w[-1][1]
    assert [(r["count"], r.v_avg) for r in got if r.serial == "B"] == [(1, None)]


def test_asof_expiry_and_ties(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    frames = spark.createDataFrame([("A", at(0), 1), ("A", at(10), 2), ("A", at(310), 3), ("A", at(310.001), 4), ("A", at(86400 * 2), 5), ("B", at(10), 6)], "serial string, ts timestamp, id long")
    tele = spark.createDataFrame([("A", at(10), 11, 70.0, 100, "m1"), ("A", at(200), 12, None, 160, None), ("A", at(86400), 13, 90.0, None, "m2")], "serial string, ts timestamp, id long, sq double, dt long, meta string")
    got = {r.id: r for r in asof.attach(frames, tele).collect()}
    assert [got[i].sq for i in range(1, 7)] == [None, 70.0, 70.0, None, None, None]
    assert [got[i].sq_label for i in (1, 2, 4)] == ["unknown", "fair", "unknown"]
    assert [got[i].pub_dt for i in (1, 2, 3, 5)] == [None, 100, 160, 160] and got[3].pub_dt_delta == 60 and got[2].pub_dt_delta is None
    assert [got[i].meta for i in (2, 3, 5)] == ["m1", "m1", "m2"] and got[5].pub_dt_age_ms == (86400 * 2 - 200) * 1000


def test_condition_minutes(spark):
    at = lambda d, h: T0 + dt.timedelta(days=d, hours=h)
    rows = [("A", at(0, 1), 1, "off"), ("A", at(0, 23), 2, "on"), ("A", at(0, 23.5), 3, "on"), ("A", at(2, 1), 4, "off"), ("A", at(2, 2), 5, "off"), ("A", at(2, 20), 6, "on"), ("B", at(0, 0), 7, "off")]
    got = {(r.serial, r.date.day): r.minutes for r in daily.condition_minutes(spark.createDataFrame(rows, "serial string, ts timestamp, id long, event string"), "on", "off").collect()}
    assert got == {("A", 1): 60.0, ("A", 2): 1440.0, ("A", 3): 300.0}


def test_trend(spark):
    rows = [("A", dt.date(2024, 1, d), float(v)) for d, v in zip((1, 2, 3, 5, 6, 9, 10, 11, 12), (50, 60, 70, 80, 90, 10, 20, 30, 40))]
    got = [r.delta_v for r in daily.trend(spark.createDataFrame(rows, "serial string, date date, v double"), ["v"]).orderBy("date").collect()]
    assert got == [None, 10.0, 15.0, 20.0, 25.0, -60.0, -45.0, -30.0, -20.0]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (states.debounce(none, "raw"), states.empty_pipe(none, "raw"), states.air_bubble(none, 1.0), states.gaps(none), history.latest(none), history.series(none, ["template_corr"]), history.newest(none, 3)):
        assert df.collect() == []
    assert states.debounce(none.union(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)), "raw").count() == 1


def test_telemetry_only(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    frames = spark.createDataFrame([("A", at(100), 1)], "serial string, ts timestamp, id long")
    tele = spark.createDataFrame([("A", at(0), 10), ("A", at(3.9), 11), ("A", at(4), 12), ("A", at(110), 13), ("A", at(115), 14), ("A", at(115.5), 15)], "serial string, ts timestamp, id long")
    assert sorted(r.id for r in asof.telemetry_only(frames, tele).collect()) == [12, 15]
    assert asof.telemetry_only(frames, tele).columns == tele.columns
    label = asof.telemetry_confidence(F.lit("good"), F.lit(True), F.lit(True))
    assert spark.range(1).select(label.alias("c")).first().c == 0.86
