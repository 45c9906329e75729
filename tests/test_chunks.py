"""States over chunks of a meter's frames against loops over all of them: a chunk's summary stands for its frames."""

import datetime as dt
import random
from collections import deque
from statistics import stdev

import pytest
from pyspark.sql import functions as F

from wavejobs.operators import order, states
from wavejobs.streaming import frames as stream

T0 = dt.datetime(2024, 3, 1)
N, E, W = states.NORMAL, states.EMPTY, states.WEAK
SCHEMA = "serial string, ts timestamp, id long, raw string, template_corr double"


def walk(seed, n=160, meters=2, stay=0.7):
    rng, rows, now = random.Random(seed), [], T0
    for i in range(n):
        now += dt.timedelta(seconds=rng.choice((0, 1, 30, 9000)))
        raw = rows[-1][3] if rows and rng.random() < stay else rng.choice((N, N, E, W, "waveform_anomaly", None))
        rows.append((f"M{rng.randrange(meters)}", now, i, raw, None if rng.random() < 0.2 else rng.gauss(0.99, 0.003 if i % 50 < 30 else 0.05)))
    return rows + [(None, T0, 1000, E, 0.5), (None, T0, 1001, E, 0.5)]


def own(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out.values()


@pytest.mark.parametrize("chunk", [1, 4, 33])
@pytest.mark.parametrize("seed", range(2))
def test_debounce(spark, seed, chunk):
    rows = walk(seed)
    df = states.debounce(spark.createDataFrame(rows, SCHEMA).repartition(3), "raw", chunk=chunk)
    got = {r.id: r for r in df.collect()}
    assert len(got) == len(rows)
    for meter in own(rows):
        shown, run, before, entered, stay, last = N, 0, None, None, 0, None
        for k, r in enumerate(meter):
            run = run + 1 if k and r[3] == last and r[3] is not None else 1
            last, before = r[3], shown if k else None
            if r[3] is not None and run >= (5 if r[3] == N else 3):
                shown = r[3]
            moved = k > 0 and shown != before
            entered, stay = (r[1], 1) if moved or not k else (entered, stay + 1)
            g = got[r[2]]
            assert (g.run, g.state, g.transitioned, g.previous_state, g.entered_at, g.frames_in_state) == (run, shown, moved, before, entered, stay), (k, r, g)


@pytest.mark.parametrize("chunk", [3, 50])
def test_empty_pipe_for_all_counts(spark, chunk):
    rows = walk(5, 60, stay=0.4)
    frame = spark.createDataFrame(rows, SCHEMA)
    for on, off in [(on, off) for on in range(0, 6) for off in range(-1, 6)][:: 2 if chunk == 3 else 11]:
        got = {r.id: (r.bad_count, r.empty_pipe) for r in states.empty_pipe(frame, "raw", on=on, off=off, chunk=chunk).collect()}
        for meter in own(rows):
            last, empty = deque(maxlen=5), False
            for r in meter:
                last.append(r[3] in (E, W))
                empty = sum(last) > off if empty else sum(last) >= on
                assert got[r[2]] == (sum(last), empty), (on, off, r)


@pytest.mark.parametrize("chunk", [2, 9, 1000])
def test_air_bubble_with_unknown_correlations(spark, chunk):
    rows = walk(6)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in states.air_bubble(frame, 0.004, n=6, chunk=chunk).collect()}
    for meter in own(rows):
        known, air = deque(maxlen=6), False
        for r in meter:
            if r[4] is not None:
                known.append(r[4])
            spread = stdev(known) if len(known) == 6 else None
            if spread is not None:
                air = spread >= (0.01 if air else 0.02)
            assert got[r[2]].air_bubble == air and (got[r[2]].corr_std is None) == (spread is None)
            assert spread is None or abs(got[r[2]].corr_std - spread) < 1e-9
    live = stream.track(stream.inputs(frame.where("serial IS NOT NULL").withColumn("raw_fs_mps", F.lit(0.0)), raw="raw"), stream.Rules(sigma=0.004, corr_rows=6))
    for r in live.collect():
        assert r.air_bubble == got[r.id].air_bubble


@pytest.mark.parametrize("chunk", [2, 7])
def test_events_gates_and_gaps(spark, chunk):
    rows = walk(7)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("flag", F.coalesce(F.col("raw") == E, F.lit(False)))
    events = {(r.serial, r.ts, r.event, r.since) for r in states.detections(frame, "flag", "on", "off", chunk=chunk).collect()}
    rated = {r.id: r for r in states.stability(frame, "flag", n=5, least=0.4, chunk=chunk).collect()}
    gaps = {r.id: r for r in states.gaps(frame, chunk=chunk).collect()}
    want = set()
    for meter in own(rows):
        was, since, last, before = False, None, deque(maxlen=5), None
        for r in meter:
            flag = r[3] == E
            if flag != was:
                since = r[1] if flag else since
                want.add((r[0], r[1], "on" if flag else "off", None if flag else since))
            was = flag
            last.append(flag)
            assert rated[r[2]].stable_ratio == sum(last) / len(last) and rated[r[2]].train == (flag and len(last) == 5 and sum(last) >= 2)
            ms = (r[1] - before).total_seconds() * 1000 if before else 0
            assert (gaps[r[2]].source_gap_ms, gaps[r[2]].data_gap) == (ms, ms > 20_000)
            before = r[1]
    assert events == want


def test_no_window_over_a_whole_history(spark):
    """Windows over rows are by chunk; those by meter alone stand on aggregates of one row per chunk or day."""
    frame = spark.createDataFrame(walk(1), SCHEMA).withColumn("flag", F.col("raw") == E)
    for df in (states.debounce(frame, "raw"), states.empty_pipe(frame, "raw"), states.air_bubble(frame, 1.0), states.stability(frame, "flag"), states.gaps(frame), states.detections(frame, "flag", "a", "b")):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if " Window [" in line and "__chunk" not in line.split("], [")[1] and "__day" not in line.split("], [")[1]:
                assert any("Aggregate" in x for x in lines[i : i + 9]), line


def test_chunked_numbers(spark):
    rows = walk(3)
    got = {r.id: (r["__index"], r["__chunk"]) for r in order.chunked(spark.createDataFrame(rows, SCHEMA), "serial", "ts", "id", 10).collect()}
    for meter in own(rows):
        assert [got[r[2]] for r in meter] == [(i, i // 10) for i in range(len(meter))]
