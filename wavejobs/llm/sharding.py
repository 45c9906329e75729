"""Sharding by sampled splitters: ranges of a key with near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavejobs.llm.common import digest60, settle

SHARDS = 40
#: Ranges that the splitters make, and sampled keys for each; both bound what the driver gets.
RANGES = 1024
KEYS_A_RANGE = 8
#: Bytes that a record has besides its text.
OVERHEAD = 16
#: A group of equal texts stays whole up to this part of a shard.
WHOLE = 8


def splitters(rows: DataFrame, total: int, ranges: int = RANGES) -> list[tuple[int, int]]:
    """Quantile boundaries of a sample of (h, d) keys in which a key's chance goes with its size.

    The sample has about RANGES * KEYS_A_RANGE keys at any input size. It only
    sets how even the ranges are; the shards' borders come from exact sums.
    """
    most = ranges * KEYS_A_RANGE
    chance = F.pmod(F.xxhash64("h", "d", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keys = sorted((r.h, r.d) for r in rows.where(chance * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(most))).select("h", "d").toLocalIterator())
    step = max(1, len(keys) // ranges)
    return sorted(set(keys[step::step]))


def ranged(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows with range: the number of cuts that are at or below (h, d), by binary search in one array, which a subquery of one row gives."""
    if not cuts:
        return rows.withColumn("range", F.lit(0))
    n = 1 << len(cuts).bit_length()
    one = rows.sparkSession.createDataFrame([(cuts,)], "cuts array<struct<h:long,d:long>>")
    steps = F.array(*[F.lit(n >> i) for i in range(1, n.bit_length())])
    key = F.struct("h", "d")
    # cuts is used once, so that Spark puts the subquery's value into the lambda and no row holds a copy of it
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("cuts", low + step - 1) <= key, low + step).otherwise(low))
    return rows.withColumn("cuts", one.scalar()).select(*rows.columns, found.alias("range"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal docs into shards 0 to shards-1 under the law `bytes`: sizes near equal.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    Records stand in the order of their key: a digest of the text, then a digest
    of doc_id, then doc_id. Size-weighted sampled splitters cut that order into
    ranges; the ranges' exact bytes and rows, added up, say where each range
    begins, so running sums within a range give every record's exact place in
    the whole. A record goes to the shard in which its middle byte lies. Equal
    texts stand together and go by the middle of their group; a group over an
    eighth of a shard is subdivided over as many shards as it spans.

    Null text has no bytes, a null text_crc32, and forms one group; texts of any
    length count whole; a null doc_id sorts first within its group. Rows that repeat whole tie and may
    swap slots. An empty table gives no rows. Columns other than doc_id and text
    are not looked at.
    """
    rows = settle(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.coalesce(digest60(F.col("text").cast("binary")), F.lit(-1)).alias("h"),
            F.coalesce(digest60(F.col("doc_id").cast("string").cast("binary")), F.lit(-1)).alias("d"),
        ),
        "sized",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(rows, total)
    cut = ranged(rows, cuts)
    before = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    starts = starts.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    order = Window.partitionBy("range").orderBy("h", "d", "doc_id")
    placed = (
        cut.withColumn("rank", F.row_number().over(order))
        .withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(starts), "range")  # one row per range: RANGES at most
        .select("doc_id", "size", "text_crc32", "h", (F.col("rank") - 1 + F.col("rows_before")).alias("rank"), (F.col("start") + F.col("bytes_before")).alias("start"))
    )
    placed = settle(placed, "placed")
    groups = placed.groupBy("h").agg(F.sum("size").alias("group_bytes"), F.min("start").alias("group_start"))
    whole = F.col("group_bytes") * F.lit(WHOLE * shards) <= F.lit(total)
    twice = F.when(whole, F.col("group_start") * 2 + F.col("group_bytes")).otherwise(F.col("start") * 2 + F.col("size"))
    dealt = placed.join(groups, "h").withColumn("shard", F.least(F.lit(shards - 1), F.floor(twice * shards / F.lit(2.0 * max(total, 1)))).cast("int"))
    dealt = settle(dealt.select("doc_id", "size", "text_crc32", "rank", "shard"), "dealt")
    firsts = dealt.groupBy("shard").agg(F.min("rank").alias("first"))
    return dealt.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: The table of the CRC is made by its rule: eight steps of the reversed polynomial for each byte.
ORACLE = """
WITH RECURSIVE c(n, v, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM c WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS v FROM c WHERE k = 8),
x AS (SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda a, b: xor(crc.v[(xor(a, b) & 255) + 1], a >> 8))) AS text_crc32 FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), crc),
r AS (SELECT doc_id, text, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS h,
    coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, -1) AS d FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY h, d, doc_id NULLS FIRST) - 1 AS rank, (sum(size) OVER (ORDER BY h, d, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start,
    (sum(size) OVER (PARTITION BY h))::BIGINT AS gb, (sum(size) OVER ())::BIGINT AS total FROM r),
g AS (SELECT *, min(start) OVER (PARTITION BY h) AS gs FROM p),
s AS (SELECT *, least(39, floor((CASE WHEN gb * 320 <= total THEN gs * 2 + gb ELSE start * 2 + size END) * 40 / (2.0::DOUBLE * total)))::INT AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s LEFT JOIN x USING (text)
"""
