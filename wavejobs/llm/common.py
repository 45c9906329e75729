"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the space and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_wavejobs_dir", None)
    if own is None:
        own = spark.sparkContext._wavejobs_dir = tempfile.mkdtemp(prefix="spark-wavejobs-")
    return own


def settle(df: DataFrame, name: str = "step", dictionary: bool = True, codec: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back. Without dictionaries tables of hashes are written faster; codec is the session's unless given.

    This cuts the lineage; the table outlives executors. The driver then drops
    its references to finished shuffles, so that their files can go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write if codec is None else df.write.option("compression", codec)).option("parquet.enable.dictionary", dictionary).parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def let_go(spark: SparkSession, wait_s: float = 0.5) -> None:
    """Have the files of finished shuffles deleted now. Listeners may hold a query for a moment after its end, which settle() alone doesn't wait for."""
    time.sleep(wait_s)
    spark.sparkContext._jvm.System.gc()


def discard(*settled: DataFrame) -> None:
    """Delete tables of settle() that nothing reads any more; what was made of them must be written."""
    for df in settled:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def digest60(c: Column) -> Column:
    """The first 60 bits of the MD5 as a long from 0 up; null stays null."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at just the characters that WORD leaves out."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
