"""Running values per meter that don't need all of a meter's rows in one task.

A meter's history is cut into chunks (days, as a rule). What a chunk hands on to
the next is summed up in one row per chunk, so that one busy meter's days run in
parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


#: Rows of a chunk of a key's rows. A chunk is worked on by one task.
CHUNK = 50_000


def numbered(df: DataFrame, key: str, ts: str, tie: str, index: str = "index", total: str = "total", counted: Column | None = None) -> DataFrame:
    """A 0-based row number per key in the order of ts, tie, and the key's number of rows. With `counted` only rows where it holds count; others have the number of the one before (-1 at the start)."""
    day = df.withColumn("__day", F.to_date(ts))
    one = F.lit(1) if counted is None else F.coalesce(counted, F.lit(False)).cast("int")
    counts = day.groupBy(key, "__day").agg(F.sum(one).alias("__n"))
    w = Window.partitionBy(key)
    counts = counts.select(
        F.col(key).alias("__key"),
        F.col("__day").alias("__d"),
        F.coalesce(F.sum("__n").over(w.orderBy(F.col("__day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(w).alias(total),
    )
    local = Window.partitionBy(key, "__day").orderBy(F.col(ts), F.col(tie))
    local = (F.row_number().over(local) if counted is None else F.sum(one).over(local.rowsBetween(Window.unboundedPreceding, 0))) - 1
    joined = day.withColumn("__local", local).join(counts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__day").eqNullSafe(F.col("__d")))
    return joined.withColumn(index, F.col("__local") + F.col("__before")).drop("__day", "__local", "__key", "__d", "__before")


def carried(df: DataFrame, key: str, order: list[str], ts: str, **values: Column) -> DataFrame:
    """For each name=column the latest non-null value up to and with this row, in the order given; ties go by `order`."""
    day = df.withColumn("__day", F.to_date(ts))
    for name, c in values.items():
        day = day.withColumn(f"__v_{name}", c)
    w = Window.partitionBy(key, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    last = day.groupBy(key, "__day").agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__l_{n}") for n in values])
    earlier = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(F.col(key).alias("__key"), F.col("__day").alias("__d"), *[F.last(f"__l_{n}", True).over(earlier).alias(f"__p_{n}") for n in values])
    for n in values:
        day = day.withColumn(f"__w_{n}", F.last(f"__v_{n}", True).over(w))
    joined = day.join(last, F.col(key).eqNullSafe(F.col("__key")) & F.col("__day").eqNullSafe(F.col("__d")))
    return joined.select(*df.columns, *[F.coalesce(f"__w_{n}", f"__p_{n}").alias(n) for n in values])


def chunked(df: DataFrame, key: str, ts: str, tie: str, rows: int = CHUNK, counted: Column | None = None) -> DataFrame:
    """Adds __index (see numbered()) and __chunk: a key's rows in order, cut into chunks of equally many."""
    out = numbered(df, key, ts, tie, "__index", "__total", counted).drop("__total")
    return out.withColumn("__chunk", F.floor(F.col("__index") / rows))


def within(key: str, *by: str) -> WindowSpec:
    """The window of a chunk."""
    return Window.partitionBy(key, "__chunk").orderBy("__index", *by)


def looking_back(df: DataFrame, key: str, n: int, rows: int, by: tuple[str, ...] = (), **values: Callable[[WindowSpec], Column]) -> DataFrame:
    """Adds name=value(window) for values that need a row and the n - 1 before it. A chunk is given the rows of the chunks before that its first ones look back to."""
    seen_by = F.explode(F.sequence(F.col("__chunk"), F.floor((F.col("__index") + (n - 1)) / rows)))
    own = df.withColumn("__own", F.col("__chunk")).withColumn("__chunk", seen_by)
    for name, value in values.items():
        own = own.withColumn(name, value(within(key, *by)))
    return own.where(F.col("__own") == F.col("__chunk")).drop("__own")


def handed_on(df: DataFrame, key: str, aggregates: list[Column], carry: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """df with what each chunk is handed by those before it. aggregates sum up a chunk in one row; carry adds columns to these rows by windows over a key's chunks, in order."""
    chunks = df.groupBy(key, "__chunk").agg(*aggregates)
    names = set(chunks.columns)
    done = carry(chunks, Window.partitionBy(key).orderBy("__chunk"))
    given = [c for c in done.columns if c not in names]
    done = done.select(F.col(key).alias("__key"), F.col("__chunk").alias("__c"), *given)
    return df.join(done, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__c"))).drop("__key", "__c")


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def folded(rows: DataFrame, key: str, by: list[Column], fresh: Callable[[], object], advance: Callable[[pd.DataFrame, object], pd.DataFrame], schema: str) -> DataFrame:
    """What advance says of each key's rows, in order, from a state that moves on. A key's rows come in Arrow batches; no more of them stand in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            codes = pd.factorize(batch[key], use_na_sentinel=False)[0]
            cuts = [0, *(i for i in range(1, len(batch)) if codes[i] != codes[i - 1]), len(batch)] if len(batch) else []
            for a, b in zip(cuts, cuts[1:]):
                part = batch.iloc[a:b]
                own = None if pd.isna(part[key].iloc[0]) else part[key].iloc[0]
                if state is None or own != now:
                    now, state = own, fresh()
                yield advance(part, state)

    return rows.repartition(key).sortWithinPartitions(key, *by).mapInPandas(run, schema)
