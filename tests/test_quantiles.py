"""Exact quantiles by brackets and running counts against NumPy."""

import random

import numpy as np
import pytest

from wavejobs.operators import audit, fit

QS = [0.01, 0.05, 0.5, 0.95, 0.99, 0.995, 0.999]


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
@pytest.mark.parametrize("few_keys", [True, False])
def test_groups(spark, accuracy, few_keys):
    rng = random.Random(accuracy)
    kinds = {"even": lambda: rng.random(), "ties": lambda: float(rng.randrange(3)), "one": lambda: 4.5, "long tail": lambda: rng.paretovariate(0.7), None: lambda: rng.gauss(0, 1)}
    rows = [(k, f()) for k, f in kinds.items() for _ in range(700)] + [("single", -1.0), ("two", 1.0), ("two", 2.0), ("nothing", None)] + [("mostly", 0.0)] * 900 + [("mostly", float(i)) for i in range(5)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, value double").repartition(5)
    got = {r.k: (r.n, r.q) for r in fit.quantiles(frame, QS, ["k"], accuracy=accuracy, few_keys=few_keys).collect()}
    assert set(got) == {*kinds, "single", "two", "mostly"}
    for k, (n, q) in got.items():
        values = [v for x, v in rows if x == k]
        assert n == len(values) and np.allclose(q, np.quantile(values, QS), rtol=1e-12, atol=0)


def test_without_keys(spark):
    values = [float(i % 97) ** 2 for i in range(5000)]
    frame = spark.createDataFrame([(v,) for v in values], "value double")
    (row,) = fit.quantiles(frame, QS, accuracy=50).collect()
    assert row.n == 5000 and np.allclose(row.q, np.quantile(values, QS))
    assert fit.quantiles(frame.limit(0), QS).collect() == []


def test_nothing_grows_with_the_data(spark):
    """The values inside a bracket are rows, never an array; tables of few rows are broadcast."""
    frame = spark.range(100).selectExpr("id % 3 AS mode", "cast(id AS double) AS x", "cast(id AS double) AS y")
    plan = fit.robust_fit(frame, ["x", "y"], ["mode"], {})._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_switches_and_times(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", t0 + dt.timedelta(seconds=i * i), i, "ab"[(i // 3) % 2], None if i % 4 else "x") for i in range(20)] + [("B", t0, 50, "a", "x"), (None, t0, 51, "a", None)]
    frame = spark.createDataFrame(rows, "serial string, ts timestamp, id long, state string, mode string")
    for chunk in (2, 100):
        got = {r.serial: tuple(r)[1:] for r in audit.switches(frame, ["state", "mode"], chunk=chunk).collect()}
        changes = lambda c: sum(rows[i][c] != rows[i - 1][c] for i in range(1, 20))
        assert got == {"A": (changes(3), changes(4)), "B": (0, 0), None: (0, 0)}
        span = {r.serial: r for r in audit.times(frame, chunk=chunk).collect()}
        assert (span["A"].duration_s, span["A"].min_interval_s, span["A"].median_interval_s, span["A"].max_interval_s) == (361.0, 1.0, 19.0, 37.0)
        assert span["B"].median_interval_s is None and span["B"].duration_s == 0 and None in span
