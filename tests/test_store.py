"""Stored frames, late results written back to them, logs by day, and rows numbered by file."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from wavejobs.operators import history
from wavejobs.sources import captures
from wavejobs.streaming import frames as stream
from wavejobs.streaming import store

T0 = dt.datetime(2024, 3, 1)
FRAMES = "serial string, ts timestamp, id long, value double"
RESULTS = "serial string, ts timestamp, at long, mse double"


def at(day, second=0):
    return T0 + dt.timedelta(days=day, seconds=second)


def batch(spark, root, number, rows):
    stream._put(spark.createDataFrame(rows, FRAMES).withColumn("date", F.to_date("ts")), number, f"{root}/frames", "date")


def values(spark, root):
    got = store.current(spark, root)
    got = got if "mse" in got.columns else got.withColumn("mse", F.lit(None))
    rows = got.collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.mse for r in rows}


def test_results_are_written_back_once(spark, tmp_path):
    root = f"{tmp_path}/store"
    batch(spark, root, 0, [("A", at(0), 1, 0.1), ("A", at(0), 2, 0.1), ("B", at(0), 3, 0.1), ("A", at(1), 4, 0.1)])
    assert values(spark, root) == {1: None, 2: None, 3: None, 4: None}
    first = spark.createDataFrame([("A", at(0), 1, 5.0), ("A", at(0), 2, 6.0), ("C", at(0), 1, 9.0)], RESULTS)
    assert store.write_back(spark, root, first, 0, ["mse"])
    assert values(spark, root) == {1: None, 2: 6.0, 3: None, 4: None}  # the newest frame of meter and time, the last result
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs)
    assert not store.write_back(spark, root, first, 0, ["mse"])  # run again: nothing is done
    assert files == sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs)
    batch(spark, root, 1, [("B", at(0, 9), 5, 0.2), ("B", at(2), 6, 0.2)])  # frames that come later, of a day that is written already
    assert values(spark, root) == {1: None, 2: 6.0, 3: None, 4: None, 5: None, 6: None}
    assert store.write_back(spark, root, spark.createDataFrame([("B", at(0, 9), 3, 7.0), ("A", at(1), 3, 8.0)], RESULTS), 1, ["mse"])
    assert values(spark, root) == {1: None, 2: 6.0, 3: None, 4: 8.0, 5: 7.0, 6: None}
    assert {(r.version, r.date.day) for r in store.versions_to_keep(spark, root).collect()} == {(1, 1), (1, 2)}
    assert store.write_back(spark, root, first.limit(0), 2, ["mse"]) and not store.write_back(spark, root, first, 2, ["mse"])
    assert {r.id for r in store.current(spark, root, [at(1).date()]).collect()} == {4}


def test_a_run_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/store"
    batch(spark, root, 0, [("A", at(0), 1, 0.1), ("A", at(0, 1), 2, 0.1)])
    results = spark.createDataFrame([("A", at(0), 1, 5.0)], RESULTS)
    written = store._day_by_day

    def breaks(df, path):
        written(df, path)
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_day_by_day", breaks)
    with pytest.raises(RuntimeError):
        store.write_back(spark, root, results, 0, ["mse"])
    assert values(spark, root) == {1: None, 2: None}
    monkeypatch.setattr(store, "_day_by_day", written)
    assert store.write_back(spark, root, results, 0, ["mse"]) and values(spark, root) == {1: 5.0, 2: None}


def test_as_a_query(spark, tmp_path):
    root = f"{tmp_path}/store"
    batch(spark, root, 0, [("A", at(0, i), i, 0.1) for i in range(6)])
    for k in range(3):
        spark.createDataFrame([("A", at(0, i), k, float(k)) for i in range(2 * k, 2 * k + 2)], RESULTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/results")
    source = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/results")
    store.written_back(source, root, ["mse"], f"{tmp_path}/check").awaitTermination(120)
    assert values(spark, root) == {i: float(i // 2) for i in range(6)}


def test_partitions_before_the_cutoff_are_not_read(spark, tmp_path):
    rows = [("A", at(d, 3600 * h), d * 24 + h, 0.0) for d in range(4) for h in (0, 12)]
    captures.append_log(spark.createDataFrame(rows, FRAMES), f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    recent = history.since(log, at(2, 7200), serial="A")
    assert {r.id for r in recent.collect()} == {60, 72, 84}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def capture(path, n, start=0):
    path.write_text("serial,s_0,s_1\n" + "".join(f"M{start + i},{i},{'x' if i % 50 == 7 else i + 0.5}\n" for i in range(n)))


def test_rows_are_numbered_by_file(spark, tmp_path):
    capture(tmp_path / "a.csv", 3000)
    capture(tmp_path / "b.csv", 40, 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = captures.read_capture(spark, f"{tmp_path}/*.csv")
            merged = captures.merge({"one": df, "two": spark.createDataFrame([("X", [1.0, 2.0])], "serial string, samples array<double>")})
            rows = merged.select("serial", F.substring_index("source_file", "/", -1).alias("f"), "source_row").collect()
            found.append((df.rdd.getNumPartitions(), sorted(map(tuple, rows), key=str)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0][1] == found[1][1] and found[1][0] > found[0][0]
    want = [(f"M{i}", "a.csv", i + 1) for i in range(3000) if i % 50 != 7] + [(f"M{5000 + i}", "b.csv", i + 1) for i in range(40) if i % 50 != 7] + [("X", None, None)]
    assert found[0][1] == sorted(want, key=str)  # rows that are dropped have numbers too


def test_logs_reports_and_models(spark, tmp_path):
    lines = spark.createDataFrame([(1, "A", at(0)), (2, "B", at(0, 5)), (3, "A", at(1))], "n int, serial string, ts timestamp")
    captures.append_log(lines.where("n < 3"), f"{tmp_path}/events", fmt="json")
    captures.append_log(lines.where("n = 3"), f"{tmp_path}/events", fmt="json")
    assert sorted(os.listdir(tmp_path / "events"))[-2:] == ["date=2024-03-01", "date=2024-03-02"]
    assert {(r.n, str(r.date)) for r in spark.read.schema("n int, serial string, date date").json(f"{tmp_path}/events").collect()} == {(1, "2024-03-01"), (2, "2024-03-01"), (3, "2024-03-02")}
    report = lambda rows: spark.createDataFrame([(s, d.date(), h) for s, d, h in rows], "serial string, date date, health_score int")
    captures.save_reports(report([("A", at(0), 90), ("A", at(1), 80), ("A", at(2), None), ("B", at(0), 10)]), f"{tmp_path}/reports")
    captures.save_reports(report([("A", at(1), 85), ("A", at(3), 70)]), f"{tmp_path}/reports")
    assert [(r.date.day, r.health_score) for r in captures.load_history(spark, f"{tmp_path}/reports", "A", "2024-03-04").collect()] == [(1, 90), (2, 85)]
    parts = {"stats": spark.range(3), "thresholds": lines}
    for _ in range(2):
        captures.save_model(parts, f"{tmp_path}/model")
    loaded = captures.load_model(spark, f"{tmp_path}/model", list(parts))
    assert loaded["stats"].count() == 3 and loaded["thresholds"].schema == lines.schema and sorted(map(tuple, loaded["thresholds"].collect())) == sorted(map(tuple, lines.collect()))
