"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavejobs.llm import alignment, bands, benchmarks, embeddings, licenses, lines, mixing, passages, sharding, simhash, spelling, toxicity, walks, warc
from wavejobs.sources.tables import table


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.group(table(spark, sf_dir, "embeddings"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.classes(walks.edit_test(table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_simhash, op3_substring_dedup, op4_line_dedup, op5_warc, op6_decontamination, op7_embedding_neighbours, op8_source_mixing, op9_toxicity, op10_sharding, op11_spelling_variants, op12_edit_fingerprints, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": benchmarks.ORACLE, "op8_source_mixing": mixing.ORACLE, "op10_sharding": sharding.ORACLE}
