"""Line dedup by an exact set-similarity join, in DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavejobs.llm.common import discard, settle

SIMILARITY = 0.8
#: Cells of the table that says how frequent words are, a power of two whatever the input. It only orders a line's words.
CELLS = 1 << 20
#: Longs of the bit table that says which lines are asked for; it only saves shuffling others.
ASKED = 1 << 17
#: The level of a cell whose words occur once in all: 4 * log2(1 + 1).
_ONCE = 4
#: A prefix word of more lines than this is hot: its lines are compared with their earliest one first.
HOT = 128
#: Lines of so many distinct words have to meet on two prefix words; their prefixes have one word more. Others meet on one.
LONG = 40
#: Stands for a null doc_id in the order of documents: after all others.
_LAST = (1 << 63) - 1
_LOW = (1 << 56) - 1
#: The codes 0000, 0001, 0011, 0111, 1111, 1110, 1100, 1000 of counts modulo 8, from the lowest bits up: n codes on differ in n bits at most.
_CODES = 0x8CEF7310


def split_words(line: Column) -> Column:
    """The words of a line. Lines whose only white space is single spaces, nearly all, are cut at a plain space."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.split(F.when(odd, F.btrim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "), F.lit(" "))).otherwise(line), " ")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, t (tells texts under one id apart), n_lines, l, line and a 128-bit key k1, k2 of every line; a null text has one row, of no lines."""
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.xxhash64(text).alias("t"), F.col("text").isNull().alias("none"), F.split(text, "\n").alias("parts"))
    # sizes are taken before, or every line would hold all parts; without "outer" Spark splits each text twice, to leave out empty arrays, which there are none of
    sized = whole.select("doc_id", "t", F.when(F.col("none"), 0).otherwise(F.size("parts")).alias("n_lines"), "parts")
    each = sized.select("doc_id", "t", "n_lines", F.posexplode_outer("parts").alias("l", "line"))
    return each.select("*", F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit("again")).alias("k2"))


def one_row(counted: DataFrame, cells: int) -> DataFrame:
    """One row, one array of `cells` values, from rows of cell and value; other cells are 0. Its size doesn't depend on the input."""
    every = counted.unionByName(counted.sparkSession.range(cells).select(F.col("id").alias("cell"), F.lit(0).cast(dict(counted.dtypes)["value"]).alias("value")))
    in_order = lambda at, v: F.transform(F.sort_array(F.collect_list(F.struct(at, v))), lambda x: x[v]).alias("value")
    chunks = every.groupBy("cell").agg(F.max_by("value", F.col("value") != 0).alias("value")).groupBy(F.shiftright("cell", 10).alias("chunk")).agg(in_order("cell", "value"))
    return settle(chunks.agg(F.flatten(in_order("chunk", "value")).alias("values")), "cells")


def rarity(docs: DataFrame, cells: int) -> DataFrame:
    """For each cell of word hashes, a level that rises with how often its words occur in all documents."""
    text = F.col("text")
    odd = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    plain = F.when(odd, F.regexp_replace(text, r"[\x20\x09-\x0D]", " ")).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    words = docs.where("text IS NOT NULL").select(F.explode_outer(F.split(plain, " ")).alias("w"))  # an empty word where spaces meet, which no line has, does no harm
    counted = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(cells - 1)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return one_row(counted.select("cell", F.least(F.lit(120), F.floor(F.log2(F.col("n") + 1) * 4)).cast("tinyint").alias("value")), cells)


def twice(n: Column, similarity: float) -> Column:
    """Whether a line of n distinct words has to meet others on two; any similar one shares two at least with it."""
    return n >= max(LONG, math.ceil(2 / similarity))


def sketched(hashes: DataFrame) -> DataFrame:
    """The rows with sig, 64 bits that differ between two sets of hashes (h, distinct, 56 bits each) in as many places at most as the sets differ by hashes.

    The hashes fall into 16 equal ranges; sig has a code of 4 bits for each
    range's count. Bounds sorted in among the hashes tell the counts without a
    function called for every word.
    """
    bounds = [j << 52 for j in range(1, 16)]
    kept = [c for c in hashes.columns if c != "h"]
    placed = hashes.select(*kept, "h", F.sort_array(F.concat("h", F.array(*[F.lit(b) for b in bounds]))).alias("placed"))
    placed = placed.select(*kept, "h", F.size("placed").cast("long").alias("p16"), *[F.array_position("placed", F.lit(b)).alias(f"p{j}") for j, b in enumerate(bounds, 1)])
    count = lambda j: (F.col("p1") - 1) if j == 0 else (F.col("p16") - F.col("p15")) if j == 15 else (F.col(f"p{j + 1}") - F.col(f"p{j}") - 1)
    code = lambda j: F.call_function("shiftright", F.lit(_CODES), (count(j).bitwiseAND(F.lit(7)) * 4).cast("int")).bitwiseAND(F.lit(15))
    return placed.select(*kept, "h", reduce(Column.bitwiseOR, [F.shiftleft(code(j), 4 * j) for j in range(16)]).alias("sig"))


def features(docs: DataFrame, similarity: float, cells: int) -> DataFrame:
    """Every line: doc_id, t, n_lines, l, k1, k2, n (distinct words), sig (see sketched) and prefix.

    prefix has the line's n - ceil(similarity * n) + 1 rarest words, and one
    more in a long line, as numbers that sort by rarity, then hash.
    """
    level = lambda h: F.coalesce(F.get("levels", h.bitwiseAND(F.lit(cells - 1)).cast("int")), F.lit(0).cast("tinyint"))
    rank = lambda h: F.shiftleft(level(h).cast("long"), 56).bitwiseOR(h)
    keys = ["doc_id", "t", "n_lines", "l", "k1", "k2"]
    hashes = F.array_distinct(F.transform(split_words(F.col("line")), lambda w: F.xxhash64(w).bitwiseAND(F.lit(_LOW))))
    sketches = sketched(lines_of(docs).select(*keys, hashes.alias("h")))
    blank = F.xxhash64(F.lit("")).bitwiseAND(F.lit(_LOW))  # the one word of a line without words is empty
    n = F.when(F.get("h", F.lit(0)) == blank, 0).otherwise(F.size("h"))
    # levels is used once, so that Spark puts the subquery's value into the lambda and no row holds a copy of it
    ranked = sketches.withColumn("levels", rarity(docs, cells).scalar()).select(*keys, n.alias("n"), "sig", F.sort_array(F.transform("h", rank)).alias("s"))
    return ranked.select(*keys, "n", "sig", F.slice("s", F.lit(1), F.size("s") - F.ceil(F.size("s") * F.lit(similarity) - 1e-9).cast("int") + 1 + twice(F.size("s"), similarity).cast("int")).alias("prefix"))


def may_match(similarity: float, before: Column | None = None) -> Column:
    """The length, positional and bit filters between the columns of one side and those of the other, named b_. Of common words that come before the one met on, so many are allowed for, or any number."""
    n, m = F.col("n"), F.col("b_n")
    need = F.ceil((n + m) * F.lit(similarity / (1 + similarity)) - 1e-9)
    most = F.least("i", "b_i", *([] if before is None else [before])) + F.least(n - F.col("i"), m - F.col("b_i"))
    return (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9) & (most >= (n + m) * F.lit(similarity / (1 + similarity)) - 1e-9) & (F.bit_count(F.col("sig").bitwiseXOR(F.col("b_sig"))) <= n + m - need * 2)


def band(n: Column, similarity: float) -> Column:
    """Which of the bands of lengths n is in; those of similar lines are in one band or in two neighbouring ones. Wider bands hold more lines, narrower ones hold more of them twice."""
    return F.floor(F.log(n) / max(-1.5 * math.log(similarity), 0.4))


def longest(n: Column, i: Column, similarity: float) -> Column:
    """How long a line can be that is similar to one of n distinct words and shares as its first word (its second one, if they have to share two) that at place i."""
    return F.floor((n - i + twice(n, similarity).cast("int")) * (1 + 1 / similarity) - n + 1e-6)


def in_band(key: Column, which: Column) -> Column:
    """The key together with a band. Should two of them ever be the same number, one pair more is looked at."""
    return key.bitwiseXOR(F.shiftleft(which, 48))


def other(rows: DataFrame, *kept: str) -> DataFrame:
    """The rows as the other side of a join on key."""
    return rows.select("key", *[F.col(c).alias(f"b_{c}") for c in kept])


def later(a: str = "", b: str = "b_") -> Column:
    """The place of one side comes after the other's."""
    return (F.col(f"{a}d") > F.col(f"{b}d")) | ((F.col(f"{a}d") == F.col(f"{b}d")) & (F.col(f"{a}l") > F.col(f"{b}l")))


def texts_by_id(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, d, l, k1, k2, m (distinct words), h (their hashes) and s0 to s3 of the classes with these ids.

    s0 to s3 are a sketch of 256 bits, of which each word flips one: two lines
    differ by as many words at least as their sketches by bits. A bit table of
    the keys spares most other lines the way.
    """
    asked = settle(classes.select("id", "d", "l", "k1", "k2").join(ids.distinct().hint("shuffle_hash"), "id"), "asked")
    cell = lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(ASKED - 1))
    bit = F.expr("shiftleft(1L, CAST(k1 & 63 AS INT))")
    bits = one_row(asked.groupBy(cell("k1").alias("cell")).agg(F.bit_or(bit).alias("value")), ASKED)
    lines = lines_of(docs).select("k1", "k2", "line").withColumn("bits", bits.scalar())
    lines = lines.where(F.get("bits", cell("k1").cast("int")).bitwiseAND(bit) != 0).select("k1", "k2", "line")
    texts = lines.groupBy("k1", "k2").agg(F.any_value("line").alias("line"))
    hashes = F.array_distinct(F.transform(split_words(F.col("line")), lambda w: F.xxhash64(w)))
    named = asked.join(texts, ["k1", "k2"]).select("id", "d", "l", "k1", "k2", hashes.alias("h"))
    bit_of = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    flipped = lambda k: F.aggregate("h", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(F.when(F.shiftright(h, 6).bitwiseAND(F.lit(3)) == k, bit_of(h)).otherwise(0)))
    out = settle(named.select("id", "d", "l", "k1", "k2", F.size("h").cast("long").alias("m"), *[flipped(k).alias(f"s{k}") for k in range(4)], "h"), "texts", dictionary=False)
    discard(asked, bits)
    return out


def near(similarity: float) -> Column:
    """Whether the sketches of texts_by_id allow for the similarity; those of the other side are named b_."""
    most = F.col("m") + F.col("b_m") - F.ceil((F.col("m") + F.col("b_m")) * F.lit(similarity / (1 + similarity)) - 1e-9) * 2
    return sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(4)), F.lit(0)) <= most


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """id: of pairs (id, b_id) the later lines whose words, by their 64-bit hashes, have the similarity with the earlier one's. Their sketches rule most of the others out."""
    texts = texts.drop("k1", "k2")
    both = pairs.join(texts, "id").join(texts.select(*[F.col(c).alias(f"b_{c}") for c in texts.columns]), "b_id").where(near(similarity) & (later() | later("b_", "")))
    met = both.select(F.when(later(), F.col("id")).otherwise(F.col("b_id")).alias("last"), (F.col("m") + F.col("b_m")).alias("all"), F.size(F.array_intersect("h", "b_h")).alias("both"))
    return settle(met.where(F.col("both") >= F.ceil(F.col("all") * F.lit(similarity / (1 + similarity)) - 1e-9)).select(F.col("last").alias("id")).distinct(), "matched")


def repeated(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The distinct lines that are repeated or again: k1, k2, the first place d, l, and again (an earlier line is similar). The settled lines are used up.

    Equal lines are one class. Of two similar lines the longer one's prefix
    holds one of the n - ceil(2 s / (1 + s) * n) + 1 rarest words of the
    shorter, for any order that all lines share, and lines meet on that word.
    With one word more in each prefix they meet on two words, or all but one
    of them would be beyond the prefixes; this is asked of long lines, which
    the bit filter spares least, unless a hot word, looked at apart, is there.
    Length, positional and bit filters stand in the join; what passes is
    verified on all words. The lines of a word meet in bands of lengths, as most
    of them are too short or too long for each other.

    In the group of a hot word a line is compared only with the earliest one at
    first, which settles groups of near copies of any size. Then the hot words'
    lines meet where the later one has found no match yet and their larger
    sketches allow for it. Words that occur
    once in all documents meet nothing.
    """
    firsts = lines.where("n > 0").select("k1", "k2", F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "l").alias("place"), "n", "sig", "prefix")
    grouped = firsts.groupBy("k1", "k2").agg(F.min("place").alias("first"), *[F.any_value(c).alias(c) for c in ("n", "sig", "prefix")], F.count(F.lit(1)).alias("copies"))
    classes = settle(grouped.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "first.d", "first.l", "n", "sig", "prefix", "copies"), "classes", dictionary=False)
    discard(lines)

    again_somewhere = F.shiftright("key", 56) > _ONCE
    rows = classes.select("id", "d", "l", "n", "sig", F.posexplode("prefix").alias("i", "key")).where(again_somewhere)
    held = lambda df: df.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * F.lit(2 * similarity / (1 + similarity)) - 1e-9) + twice(F.col("n"), similarity).cast("int"))
    shorter = (F.col("b_n") < F.col("n")) | ((F.col("b_n") == F.col("n")) & (F.col("b_id") < F.col("id")))
    common = F.shiftright("key", 56) >= int(4 * math.log2(HOT + 1))  # others occur HOT times at most
    hot = settle(held(rows).where(common).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("key"), "hot")
    # most lines of a word are too short or too long for each other: a line looks in its own band, where those are that it could be similar to and not shorter than
    bands = F.array_distinct(F.array(band(F.col("n"), similarity), band(F.floor(F.col("n") / similarity + 1e-6), similarity)))
    cold = classes.select("id", "n", "sig", "prefix", band(F.col("n"), similarity).alias("lowest"), F.explode(bands).alias("band"))
    cold = held(cold.select("id", "n", "sig", "lowest", "band", F.posexplode("prefix").alias("i", "key")).where(again_somewhere))
    # the later a word's place, the less can be shared from there on, so that only shorter lines are of use
    cold = cold.where((F.col("band") == F.col("lowest")) | (F.col("band") <= band(longest(F.col("n"), F.col("i"), similarity), similarity)))
    cold = cold.join(hot, "key", "left_anti").withColumn("key", in_band(F.col("key"), F.col("band")))
    sought = rows.select(in_band(F.col("key"), band(F.col("n"), similarity)).alias("key"), "id", "n", "sig", "i")
    # a cold word has HOT lines at most, so the rows needn't be sorted to meet
    pairs = sought.join(other(cold, "id", "n", "sig", "i").hint("shuffle_hash"), "key").where(shorter & may_match(similarity, twice(F.col("b_n"), similarity).cast("int"))).select("id", "b_id", "b_n")
    own = settle(rows.join(hot, "key"), "own")
    apart = own.select(F.col("id").alias("b_id")).distinct()
    met = settle(pairs.groupBy("id", "b_id").agg(((F.count(F.lit(1)) > 1) | ~twice(F.any_value("b_n"), similarity)).alias("enough")), "met")
    pairs = met.where("enough").select("id", "b_id").union(met.where("NOT enough").join(apart, "b_id", "left_semi").select("id", "b_id"))
    lead = own.groupBy("key").agg(F.min(F.struct("d", "l", "id", "n", "sig", "i")).alias("m")).select("key", "m.*")
    pairs = pairs.union(own.join(other(lead, "id", "n", "sig", "i"), "key").where((F.col("id") != F.col("b_id")) & may_match(similarity)).select("id", "b_id"))
    pairs = settle(pairs.distinct(), "pairs")
    texts = texts_by_id(pairs.select("id").union(pairs.select("b_id")).union(own.select("id")), classes, docs)
    matched = verified(pairs, texts, similarity)
    discard(met, pairs, hot)

    again = matched.withColumn("again", F.lit(True))
    marked = own.join(again, "id", "left").withColumn("open", F.col("again").isNull()).drop("again")
    marked = settle(marked.join(texts.drop("d", "l", "k1", "k2", "h"), "id"), "marked")
    discard(own)
    sides = ("id", "d", "l", "n", "sig", "i", "m", "s0", "s1", "s2", "s3")
    meet = lambda a, b, wanted: a.join(other(b, *sides, "open"), "key").where(shorter & wanted & may_match(similarity) & near(similarity)).select("id", "b_id")
    rest = meet(marked.where("open"), held(marked), later() | F.col("b_open")).union(meet(marked.where("NOT open"), held(marked.where("open")), later("b_", "")))
    rest = settle(rest.distinct(), "rest")
    more = verified(rest, texts, similarity)
    again = texts.select("id", "k1", "k2", "d", "l").join(matched.union(more).distinct(), "id").select("k1", "k2", "d", "l", F.lit(True).alias("again"))
    copied = classes.where("copies > 1").select("k1", "k2", "d", "l", F.lit(False).alias("again"))
    state = settle(copied.union(again).groupBy("k1", "k2", "d", "l").agg(F.max("again").alias("again")), "state")
    discard(classes, marked, rest, texts, matched, more)
    return state


def dedup(docs: DataFrame, similarity: float = SIMILARITY, cells: int = CELLS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 0, in order).

    A line is removed if an earlier one (a smaller doc_id, or the same document
    and an earlier line) has the same text or a Jaccard similarity of words of
    at least `similarity`; lines are judged on the input, not on what is left.
    Lines without words are never removed.

    A null text has no lines, an empty one a single empty line; texts of any
    length are cut into lines whole. A null doc_id comes after all others. Rows
    that share a doc_id are one document to the order, so that copies of a whole
    row don't remove each other. An empty table gives no rows. Columns other
    than doc_id and text aren't looked at.
    """
    lines = settle(features(docs, similarity, cells), "lines", dictionary=False)
    places = settle(lines.select("doc_id", "t", "n_lines", "l", "k1", "k2"), "places")
    state = repeated(docs, lines, similarity).select("k1", "k2", F.col("d").alias("first_d"), F.col("l").alias("first_l"), "again")
    placed = places.join(state.hint("shuffle_hash"), ["k1", "k2"])
    gone = placed.where(F.col("again") | (F.coalesce("doc_id", F.lit(_LAST)) != F.col("first_d")) | (F.col("l") != F.col("first_l")))
    per = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t"), F.col("n_lines").alias("gone_n")).agg(F.sort_array(F.collect_set("l")).alias("removed"))
    rows = places.where("l = 0").select("doc_id", "t", "n_lines")  # every document has a line 0
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("t") == F.col("gone_t")) & (F.col("n_lines") == F.col("gone_n")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
