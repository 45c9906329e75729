"""A corpus from raw documents to shards, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavejobs.llm import benchmarks, mixing, sharding, simhash, toxicity
from wavejobs.llm.common import settle
from wavejobs.sources.tables import table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on the labelled ones of docs.

    Null and empty texts have no evidence and stay, as do null doc_ids; repeated
    rows are judged alike. Without labels, or without documents, nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.judged(model)["score"] < 0.5)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest doc_id stays. Rows without a doc_id aren't in a group and stay.

    Copies are near as op2's contract says (fingerprints within its radius), so
    edited copies farther off stay. Null and empty texts are copies of each
    other. Rows with one doc_id and texts of different groups are documents of
    their own; within a group, rows that share its smallest doc_id are cut to
    the one with the smallest hash. An empty table stays empty.
    """
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    own = docs.where("doc_id IS NOT NULL")
    grouped = simhash.group(own.select("doc_id", "text", text.alias("t")), keep=("t",)).where("doc_id = component_id")
    first = grouped.groupBy("root").agg(F.min("t").alias("t"), F.min("component_id").alias("id"))
    rows = own.select("doc_id", text.alias("t"), F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("h"))
    stay = rows.join(first, (rows.doc_id == first.id) & (rows.t == first.t), "left_semi").groupBy("doc_id", "t").agg(F.min_by("row", "h").alias("row"))
    return stay.select("row.*").union(docs.where("doc_id IS NULL"))


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay; rows are judged by their text, whatever their doc_id. Without items nothing goes."""
    found = benchmarks.find(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id"), "t").distinct()
    return docs.join(found, docs.doc_id.eqNullSafe(found.id) & (F.xxhash64(docs.text) == found.t), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. Null sources are one, null ids are ids like any other, and documents without words are taken at their source's rate. An empty table stays empty."""
    return mixing.take(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row. Null texts and ids are rows like any other; equal texts stay together. An empty table has no shards."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", near_copies_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The fitted toxicity model and the components have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
