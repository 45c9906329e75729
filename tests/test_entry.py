"""The driver contract, and a few queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wavejobs.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver tables aren't here")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@needs_data
@pytest.mark.parametrize("name", ["r1_latest", "r2_bounded_series", "j1_asof_telemetry", "j4_telemetry_only", "w2_debounced_state", "w6_empty_pipe", "f4_robust_fit", "f15_block_events", "j7_condition_minutes", "r8_stats_table"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(v) for v in row) for row in found.fetchall()), key=repr)
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == want


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
