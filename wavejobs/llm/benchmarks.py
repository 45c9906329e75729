"""Benchmark decontamination by canonical templates, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavejobs.llm.common import settle

#: Tokens of a window, and the part of an item's windows that one occurrence in a contaminated document has.
WINDOW = 5
COVERAGE = 0.8
#: Tokens that may be put in or left out within one occurrence: it is the windows on this many neighbouring diagonals, and up to twice as many.
DRIFT = 16
#: Bytes of the items' anchors up to which they are broadcast; beyond it Spark picks the join.
BROADCAST_BYTES = 64 << 20
_ANCHOR_BYTES = 64  # of a row of two longs in a hash table, and some to spare
#: Words that count as units. Fixed values.
UNITS = (
    "km cm mm metre metres meter meters mile miles foot feet inch inches kg mg gram grams lb lbs pound pounds ounce ounces ml litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degrees"
).split()
#: A number, or a word that may have digits after its first letter.
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}\p{M}\p{Nd}]*"


def kind(token: Column) -> Column:
    """The placeholder of a token: <num>, <unit>, or <name> for words with a capital, wherever they stand; null for other words."""
    first = F.substring(token, 1, 1)
    return F.when(first < ":", "<num>").when(F.lower(token).isin(*UNITS), "<unit>").when(first != F.lower(first), "<name>")


def tokenized(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, and by position r (the tokens in lower case, as hashes) and k (the placeholders' hashes, null for literal words). Texts without tokens have no row."""
    raw = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), 0)
    parts = rows.select(*keys, raw.alias("raw")).where(F.size("raw") > 0)
    return parts.select(*keys, F.transform("raw", lambda t: F.xxhash64(F.lower(t))).alias("r"), F.transform("raw", lambda t: F.when(kind(t).isNotNull(), F.xxhash64(kind(t)))).alias("k"))


def _windows(mode: int, width: int, at) -> Column:
    """The hashes of the windows over r, of the tokens that at(position) says; a shorter text is one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("r") - width, F.lit(0)))
    return F.transform(starts, lambda q: F.xxhash64(F.lit(mode), *[F.coalesce(at(q + i), F.lit(0)) for i in range(width)]))


def literal(width: int) -> Column:
    return _windows(0, width, lambda i: F.get("r", i))


def template(width: int) -> Column:
    return _windows(1, width, lambda i: F.coalesce(F.get("k", i), F.get("r", i)))


def item_windows(tokens: DataFrame, width: int) -> DataFrame:
    """item_id, mode (0: literal, 1: template), p, w of the items' windows. Items without placeholders have no templates; template windows without a literal word would be met everywhere and are left out."""
    kept = lambda p: F.exists(F.slice("k", p + 1, width), lambda k: k.isNull())
    both = F.array(F.struct(F.lit(0).alias("mode"), literal(width).alias("ws")), F.struct(F.lit(1).alias("mode"), template(width).alias("ws")))
    each = tokens.select("item_id", "k", F.explode(both).alias("m")).where((F.col("m.mode") == 0) | F.exists("k", lambda k: k.isNotNull()))
    each = each.select("item_id", "k", "m.mode", F.posexplode("m.ws").alias("p", "w"))
    return each.where((F.col("mode") == 0) | kept(F.col("p"))).select("item_id", "mode", "p", "w")


def runs(ws: str) -> Column:
    """Runs of equal windows of an array column: an array of first, last and w."""
    begins = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda q: (q == 0) | (F.get(ws, q) != F.get(ws, q - 1)))
    last = F.concat(F.transform(F.slice(begins, F.lit(2), F.size(ws)), lambda q: q - 1), F.array(F.size(ws) - 1))
    return F.transform(F.arrays_zip(begins.alias("a"), last.alias("b")), lambda x: F.struct(x["a"].alias("first"), x["b"].alias("last"), F.get(ws, x["a"]).alias("w")))


def anchors(bench: DataFrame, coverage: float) -> DataFrame:
    """w, item_id: of each item and mode the windows that fewest items have, as many as an occurrence can't miss all of."""
    spread = bench.groupBy("w").agg(F.countDistinct("item_id").alias("items"))
    own = Window.partitionBy("item_id", "mode")
    ranked = bench.join(spread, "w").withColumn("rank", F.row_number().over(own.orderBy("items", "w", "p"))).withColumn("of", F.count(F.lit(1)).over(own))
    return ranked.where(F.col("rank") <= F.col("of") - F.ceil(F.col("of") * F.lit(coverage) - 1e-9) + 1).select("w", "item_id").distinct()


def find(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, width: int = WINDOW, drift: int = DRIFT) -> DataFrame:
    """doc_id, t (a hash of the text), item_id, covered: the items that occur in a text with at least `coverage` of their windows.

    Windows of tokens join by hash: literal ones, whatever the case, and template
    ones, in which numbers, names and units are placeholders. An occurrence is
    the windows on neighbouring diagonals (the text's position less the item's);
    windows elsewhere in the text don't add to it. Its
    template windows count only if all their slots are filled consistently,
    equal fillings of the item by equal ones of the text and different ones by
    different ones, wherever in the occurrence they stand. A window that meets the
    text on several diagonals of an occurrence is read on that which has most.

    Texts first meet the items' anchors alone. Only these pairs are looked at by
    position, in runs: where windows of the text repeat one after another, and
    those of the item, each diagonal is one row.
    """
    marks = settle(tokenized(items.where("item_id IS NOT NULL").select("item_id", "text"), "item_id"), "items")
    bench = settle(item_windows(marks, width), "windows")
    of = bench.groupBy("item_id", "mode").agg(F.count(F.lit(1)).alias("of"))
    least = settle(anchors(bench, coverage), "anchors")
    side = F.broadcast(least) if least.count() * _ANCHOR_BYTES <= BROADCAST_BYTES else least

    texts = docs.select(F.xxhash64("text").alias("t"), "text")
    met = tokenized(texts, "t").select("t", F.explode(F.concat(literal(width), template(width))).alias("w")).join(side, "w")
    pairs = settle(met.select("t", "item_id").distinct(), "pairs")

    own = texts.join(pairs.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    own = settle(tokenized(own, "t"), "texts")
    hits = settle(meetings(pairs, bench, own, width), "hits")
    band = F.floor(F.col("d") / drift).cast("int")
    banded = hits.withColumn("band", F.explode(F.array(band, band - 1)))

    plain = banded.where("mode = 0").groupBy("t", "item_id", "mode", "band").agg(_united(F.collect_list(F.struct("low", "high"))).alias("n"))
    chosen = settle(read_once(banded.where("mode = 1")), "chosen")
    changed = chosen.join(clashes(chosen, marks, own, width), ["t", "item_id", "band"], "left_anti")
    changed = changed.groupBy("t", "item_id", "band").agg(F.count(F.lit(1)).alias("n")).select("t", "item_id", F.lit(1).alias("mode"), "band", "n")
    counted = plain.union(changed).join(of, ["item_id", "mode"])
    best = counted.groupBy("t", "item_id").agg(F.max(F.col("n") / F.col("of")).alias("covered")).where(F.col("covered") >= coverage)
    ids = docs.select("doc_id", F.xxhash64("text").alias("t"))
    return ids.join(settle(best, "found"), "t").distinct().select("doc_id", "t", "item_id", "covered")


def meetings(pairs: DataFrame, bench: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """t, item_id, mode, d, low, high: on diagonal d (the text's position less the item's) the item's windows low to high are those of the text."""
    placed = lambda windows: own.select("t", windows.alias("ws")).select("t", F.explode(runs("ws")).alias("x")).select("t", "x.w", F.col("x.first").alias("q0"), F.col("x.last").alias("q1"))
    of_text = placed(literal(width)).union(placed(template(width)))
    in_item = Window.partitionBy("item_id", "mode").orderBy("p")
    new = F.coalesce((F.lag("w").over(in_item) != F.col("w")) | (F.lag("p").over(in_item) != F.col("p") - 1), F.lit(True))
    of_item = bench.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(in_item.rowsBetween(Window.unboundedPreceding, 0)))
    of_item = of_item.groupBy("item_id", "mode", "run").agg(F.first("w").alias("w"), F.min("p").alias("p0"), F.max("p").alias("p1"))
    both = pairs.join(of_item, "item_id").join(of_text, ["t", "w"])
    each = both.withColumn("d", F.explode(F.sequence(F.col("q0") - F.col("p1"), F.col("q1") - F.col("p0"))))
    return each.select("t", "item_id", "mode", "d", F.greatest("p0", F.col("q0") - F.col("d")).alias("low"), F.least("p1", F.col("q1") - F.col("d")).alias("high"))


def _united(spans: Column) -> Column:
    """How many positions an array of spans (low, high) covers. There are at most an item's windows for each of an occurrence's diagonals."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    add = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(x["low"] - 1, a["end"]))).alias("n"), F.greatest(a["end"], x["high"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, add, lambda a: a["n"].cast("long"))


def read_once(banded: DataFrame) -> DataFrame:
    """t, item_id, band, p, d: each of an occurrence's template windows on that of its diagonals which has most of them (ties: the smallest)."""
    support = banded.groupBy("t", "item_id", "band", "d").agg(F.sum(F.col("high") - F.col("low") + 1).alias("support"))
    each = banded.join(support, ["t", "item_id", "band", "d"]).withColumn("p", F.explode(F.sequence("low", "high")))
    return each.groupBy("t", "item_id", "band", "p").agg(F.max_by("d", F.struct("support", -F.col("d"))).alias("d"))


def clashes(chosen: DataFrame, marks: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """t, item_id, band of occurrences in which a filling of the item stands for two of the text, or two for one."""
    slots = marks.select("item_id", F.posexplode(F.arrays_zip("r", "k")).alias("i", "x")).where("x.k IS NOT NULL").select("item_id", "i", F.col("x.r").alias("filling"), F.col("x.k").alias("kind"))
    tokens = own.select("t", F.posexplode("r").alias("j", "own"))
    covered = chosen.select("t", "item_id", "band", "d", F.explode(F.sequence(F.col("p"), F.col("p") + (width - 1))).alias("i")).distinct()
    filled = covered.join(slots, ["item_id", "i"]).withColumn("j", F.col("i") + F.col("d")).join(tokens, ["t", "j"]).select("t", "item_id", "band", "kind", "filling", "own").distinct()
    found = filled.groupBy("t", "item_id", "band").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("kind", "filling").alias("a"), F.countDistinct("kind", "own").alias("b"))
    return found.where((F.col("n") != F.col("a")) | (F.col("n") != F.col("b"))).select("t", "item_id", "band")


def decontaminate(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, contaminated, items (ids in order), covered (the largest share of an item's windows).

    Null and empty texts are clean, and null, empty or null-id items find
    nothing. Very long texts are cut into windows whole. Null doc_ids and
    repeated rows are judged by their text. An empty table of documents gives no
    rows. Other columns aren't looked at.
    """
    found = find(docs, items, coverage, width)
    per = found.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("covered").alias("covered"))
    per = per.select(F.col("doc_id").alias("d"), "t", "items", "covered")
    ids = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = ids.join(per, ids.doc_id.eqNullSafe(per.d) & (ids.text_hash == per.t), "left")
    none = F.array().cast("array<bigint>")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


ORACLE = r"""
WITH texts AS (SELECT DISTINCT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
raw AS (SELECT side, id, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}\p{M}\p{Nd}]*') AS r FROM texts),
tok AS (SELECT side, id, list_transform(r, lambda t: lower(t)) AS r, list_transform(r, lambda t: CASE WHEN t[1] < ':' THEN '<num>' WHEN list_contains(string_split('UNITS', ' '), lower(t)) THEN '<unit>' WHEN t[1] <> lower(t[1]) THEN '<name>' END) AS k
    FROM raw WHERE len(r) > 0),
can AS (SELECT *, list_transform(range(1, len(r) + 1), lambda i: coalesce(k[i], r[i])) AS c FROM tok),
win AS (SELECT side, id, mode, p, CASE mode WHEN 0 THEN 'l ' || array_to_string(r[p + 1:p + 5], ' ') ELSE 't ' || array_to_string(c[p + 1:p + 5], ' ') END AS w,
        mode = 0 OR len(list_filter(range(p + 1, least(p + 5, len(r)) + 1), lambda i: k[i] IS NULL)) > 0 AS kept
    FROM (SELECT *, unnest(range(0, greatest(len(r) - 5, 0) + 1))::INT AS p FROM can), (VALUES (0), (1)) m(mode)),
b AS (SELECT id AS item_id, mode, p, w FROM win WHERE side = 'b' AND kept AND (mode = 0 OR id IN (SELECT id FROM tok WHERE side = 'b' AND len(list_filter(k, lambda x: x IS NOT NULL)) > 0))),
o AS (SELECT item_id, mode, count(*) AS total FROM b GROUP BY ALL),
h AS (SELECT win.id AS doc_id, item_id, b.mode, b.p, win.p - b.p AS d FROM win JOIN b USING (w) WHERE side = 'd'),
hb AS (SELECT *, unnest([floor(d / 16.0), floor(d / 16.0) - 1]) AS band FROM h),
su AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, band, d) AS support FROM hb WHERE mode = 1),
ch AS (SELECT doc_id, item_id, band, p, d FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, band, p ORDER BY support DESC, d) AS place FROM su) WHERE place = 1),
s AS (SELECT DISTINCT doc_id, item_id, band, d, unnest(range(p, p + 5)) AS i FROM ch),
f AS (SELECT DISTINCT s.doc_id, s.item_id, s.band, bt.k[i + 1] AS kind, bt.r[i + 1] AS filling, dt.r[i + d + 1] AS own
    FROM s JOIN tok bt ON bt.side = 'b' AND bt.id = s.item_id JOIN tok dt ON dt.side = 'd' AND dt.id = s.doc_id WHERE bt.k[i + 1] IS NOT NULL AND i + d < len(dt.r)),
x AS (SELECT doc_id, item_id, band FROM f GROUP BY ALL HAVING count(*) <> count(DISTINCT (kind, filling)) OR count(*) <> count(DISTINCT (kind, own))),
n AS (SELECT doc_id, item_id, mode, band, count(DISTINCT p) AS n FROM hb WHERE mode = 0 GROUP BY ALL
    UNION ALL SELECT doc_id, item_id, 1, band, count(*) FROM ch LEFT JOIN (SELECT *, true AS bad FROM x) USING (doc_id, item_id, band) WHERE bad IS NULL GROUP BY ALL),
c AS (SELECT doc_id, item_id, max(n / total::DOUBLE) AS covered FROM n JOIN o USING (item_id, mode) GROUP BY ALL),
y AS (SELECT doc_id, list_sort(list(item_id)) AS items, max(covered) AS covered FROM c WHERE covered >= 0.8 GROUP BY ALL)
SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(items, []::BIGINT[]) AS items, coalesce(covered, 0)::DOUBLE AS covered FROM documents LEFT JOIN y USING (doc_id)
""".replace("UNITS", " ".join(UNITS))
