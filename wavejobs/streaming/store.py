"""Stored frames that late results are written back to, a day at a time.

A store's folder has `frames`, where the tracking query's sink appends (by batch
and date), `written` (by version and date), where a day is written anew with the
results in it, and `commits`, one row per version and day, with the last batch of
frames that it holds. A day's frames are those of its newest committed version
and those of later batches. Versions without a commit are never read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavejobs.operators.history import enrich

_COMMITS = "version long, date date, upto long"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet table, or null if it isn't there yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def commits(spark: SparkSession, root: str) -> DataFrame:
    """version, date, upto of what is committed."""
    found = _read(spark, f"{root}/commits", _COMMITS)
    return spark.createDataFrame([], _COMMITS) if found is None else found


def current(spark: SparkSession, root: str, dates: list | None = None) -> DataFrame:
    """The frames as they stand, with the columns of the newest version; of some days only, if given, which is a filter on partitions."""
    newest = commits(spark, root).groupBy("date").agg(F.max_by(F.struct("version", "upto"), "version").alias("c")).select(F.col("date").alias("c_date"), F.col("c.version").alias("c_version"), F.col("c.upto").alias("upto"))
    of = lambda df: df if dates is None else df.where(F.col("date").isin(dates))
    new = of(spark.read.parquet(f"{root}/frames")).join(F.broadcast(newest), F.col("date") == F.col("c_date"), "left")  # a row a day
    new = new.where(F.col("upto").isNull() | (F.col("batch") > F.col("upto"))).drop("c_date", "c_version", "upto")
    old = _read(spark, f"{root}/written")
    if old is None:
        return new
    old = of(old).join(F.broadcast(newest), (F.col("date") == F.col("c_date")) & (F.col("version") == F.col("c_version"))).drop("c_date", "c_version", "upto", "version")
    return old.unionByName(new, allowMissingColumns=True)


def write_back(spark: SparkSession, root: str, results: DataFrame, version: int, fields: list[str], key: str = "serial", ts: str = "ts", tie: str = "id") -> bool:
    """Write results (key, ts, at and fields) into the newest stored frame of their meter and time; false if this version is committed already.

    Only days that have results are written anew. A run that broke off before its
    commit leaves files that nothing reads, and running it again replaces them;
    once committed it does nothing. So each result is there once. Versions come
    one after another, from one writer. A result without a stored frame is left out.
    """
    if not commits(spark, root).where(F.col("version") == version).isEmpty():
        return False
    results = results.persist()
    try:
        dates = [r.date for r in results.select(F.to_date(ts).alias("date")).distinct().collect() if r.date is not None]  # a row a day
        if dates:
            now = current(spark, root, dates)
            upto = now.agg(F.max("batch").alias("upto")).first().upto
            _day_by_day(enrich(now, results, fields, key, ts, tie).withColumn("version", F.lit(version)), f"{root}/written")
        rows = [(d, upto if dates else None) for d in dates] or [(None, None)]
        spark.createDataFrame([(version, *r) for r in rows], _COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    finally:
        results.unpersist()
    return True


def _day_by_day(df: DataFrame, path: str) -> None:
    df.repartition("date", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "date").parquet(path)


def written_back(results: DataFrame, root: str, fields: list[str], checkpoint: str, available_now: bool = True, **names: str):
    """Start a query that writes a stream of results back; a batch is a version, so that one that runs again changes nothing."""
    write = lambda batch, number: write_back(batch.sparkSession, root, batch, number, fields, **names)
    writer = results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def versions_to_keep(spark: SparkSession, root: str) -> DataFrame:
    """version, date of what current() reads; other versions' folders can go once no reader has them open."""
    newest = Window.partitionBy("date").orderBy(F.desc("version"))
    return commits(spark, root).where("date IS NOT NULL").withColumn("n", F.row_number().over(newest)).where("n = 1").select("version", "date")
