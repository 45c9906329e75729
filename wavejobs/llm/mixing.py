"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavejobs.llm.common import WORD, settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Rows of one source and size class are dealt over so many blocks.
SALTS = 64


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: skey, source_size, target, rate and offset.

    Sources in code point order, null last, weigh `weights`, repeating. They
    share `share` times all words. A target stops at `most` times the source's
    size and what is above goes to the others by weight. With the sources in
    the order of cap over weight, the level of those that stay below their cap
    is the largest of the levels found with all sources before one at their cap.
    The windows run over one row per source.
    """
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1))
    ranked = per.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.select(
        "skey",
        "source_size",
        "rank",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(most)).alias("cap"),
    )
    before = everything.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "*",
        (
            (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight"))
    return levels.select("skey", "source_size", target.alias("target")).select(
        "skey",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("rate"),
        (F.conv(F.substring(F.md5(F.concat("skey", F.lit(":offset"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("offset"),
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each document is taken: doc_id, size, source_size, target, taken, source, copies.

    Within a source the expected copies of a document are target over source
    size. Their prefix sum runs in the order of size class, salt, size and
    doc_id, which keeps the words taken near the target, and a document is
    emitted once for each integer that the sum plus the source's offset
    crosses. The sum is not made by one task: rows are numbered within (source,
    size class, salt), and the blocks' counts give where each block begins.

    Null text has size 0. Null and missing sources form one source, the last.
    Null doc_ids and repeated rows are rows like any other. An empty table gives
    no rows. A source without words has target 0 and nothing is taken from it.
    Columns other than doc_id, text and source are not looked at; those named
    in keep are passed on.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    power = F.length(F.bin("size")) - 1
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))  # the text too, so that a null or repeated id is dealt over salts
    h = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    sizes = settle(
        docs.select(*keep, "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), size.alias("size"), h.alias("h")).select(
            "*",
            F.when(F.col("size") == 0, 0).when(F.col("size") < 8, F.col("size")).otherwise(power * 8 + F.expr("shiftright(size, length(bin(size)) - 4)")).cast("int").alias("class"),
            F.pmod(F.col("h"), F.lit(SALTS)).cast("int").alias("salt"),
        ),
        "sizes",
    )
    block = ["skey", "class", "salt"]
    counts = sizes.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(*block, F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = sizes.withColumn("row", F.row_number().over(Window.partitionBy(*block).orderBy("size", "h", "doc_id")))
    at = numbered.join(starts.join(targets(sizes, weights, share, most), "skey"), block).withColumn("place", F.col("before") + F.col("row"))
    copies = F.floor(F.col("rate") * F.col("place") + F.col("offset")) - F.floor(F.col("rate") * (F.col("place") - 1) + F.col("offset"))
    return at.withColumn("copies", copies.cast("int")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", *keep
    )


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken.

    Rows that agree in doc_id, source and text share what they take: evenly, and
    what is left over goes to one of them.
    """
    names = ("key1", "key2")
    keys = [F.xxhash64("doc_id", "source", "text", F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *keys)  # the columns of docs may have any names
    taken = mix(docs.select("doc_id", "source", "text", *keys), keep=names).groupBy(*names).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    joined = keyed.join(taken, list(names))
    each, left = F.floor(F.col("copies") / F.col("rows")), F.col("copies") % F.col("rows")
    even = joined.where(each > 0).select("row", F.explode(F.sequence(F.lit(1), each)).alias("copy"))
    rest = joined.where(left > 0).groupBy(*names).agg(F.first("row").alias("row"), F.first(left).alias("left")).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))).alias("copy"))
    return even.select("row.*").union(rest.select("row.*"))


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 8))::BIGINT AS h FROM documents),
k AS (SELECT *, CASE WHEN size < 8 THEN size ELSE (length(bin(size)) - 1) * 8 + (size >> (length(bin(size)) - 4)) END AS class, h % 64 AS salt FROM d),
per AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap
    FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per)),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT skey, source_size, least(cap, max(level) OVER () * weight) AS target,
    ('0x' || substr(md5(skey || ':offset'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS o FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0 END::DOUBLE AS rate FROM t),
p AS (SELECT k.*, row_number() OVER (PARTITION BY skey ORDER BY class, salt, size, h, doc_id) AS place FROM k),
c AS (SELECT p.*, source_size, target, (floor(rate * place + o) - floor(rate * (place - 1) + o))::INT AS copies FROM p JOIN r USING (skey))
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM c
"""
