"""Spelling variants: words one edit apart, found by walking a relational trie level by level."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavejobs.llm.common import discard, settle

SHORTEST = 5
LEAST = 3
#: A run of a document is misspelt if this divides the checksum of the document and the run.
MISSPELT = 97
#: Words of up to so many code points are in the trie; longer ones are compared by their heads and tails.
DEEP = 48
#: A level's edges are broadcast up to so many rows of some 60 bytes; larger levels are joined by shuffles.
BROADCAST_ROWS = 100_000
#: Distinct words that a task holds before it hands them on, and letters that it cuts into words at once.
HELD = 300_000
SLICE = 1 << 22

#: In Latin-1: A to Z to lower case, other letters as they are, the rest (also "?", which stands for all other code points) a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str | None, size: int = SLICE) -> Iterator[Counter]:
    """The lower-cased letter runs of a text in Latin-1 with their counts, a slice of the text at a time."""
    data = text.encode("latin-1", "replace").translate(_LETTERS) if text else b""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield Counter(data[at:end].split())
        at = end


def misspelt(run: bytes, base: int) -> bytes:
    """The run, less one letter where MISSPELT divides its checksum; base is the checksum of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
    if h % MISSPELT:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word and n, its occurrences in all documents, for words of at least `shortest` code points and `least` occurrences.

    A null text has no words; a null doc_id is written as nothing. Repeated rows count as often as they stand there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        give = lambda: pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
        for part in batches:
            for doc, text in zip(part["doc"], part["text"]):
                base = zlib.crc32(f"{doc}:".encode())
                for found in runs_of(text):
                    for w, n in found.items():
                        if len(w) >= shortest and len(w := misspelt(w, base)) >= shortest:
                            held[w] += n
                    if len(held) > HELD:
                        yield give()
                        held.clear()
        if held:
            yield give()

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(doc.alias("doc"), "text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def head(c: str | Column, n: int | Column = 1) -> Column:
    return F.substring(c, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def tail(c: str | Column) -> Column:
    """All but the first code point."""
    return F.substring(c, F.lit(2), F.length(c))


def trie(words: DataFrame, deep: int) -> tuple[DataFrame, DataFrame]:
    """paths: a row for each word (id) and branching node on its way: d, node, ch, after (what follows ch); edges: node, ch, child, d, and what is below.

    A node is the hash of its prefix. Only nodes that several words share are
    there: an edge that leads to a single word (only = 1) has the whole rest of
    it, `rest` and `owner`. Otherwise `lens` has a bit for each number of code
    points that can follow, `firsts` one for each letter that can come next
    (modulo 64), and `ends` is the word that ends at the child.
    """
    at = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    steps = words.where(F.length("word") <= deep).select("id", "word", at.alias("d"))
    steps = steps.select("id", "d", F.xxhash64(head("word", F.col("d"))).alias("node"), F.substring("word", F.col("d") + 1, F.lit(1)).alias("ch"), F.substring("word", F.col("d") + 2, F.lit(deep)).alias("after"), F.xxhash64(head("word", F.col("d") + 1)).alias("child"))
    below, comes = F.expr("shiftleft(1L, length(after))"), F.expr("CASE WHEN after = '' THEN 0L ELSE shiftleft(1L, ascii(after) % 64) END")
    grouped = steps.groupBy("node", "ch").agg(
        F.count(F.lit(1)).alias("only"), F.min("d").alias("d"), F.min("child").alias("child"), F.min("after").alias("rest"), F.min("id").alias("owner"), F.bit_or(below).alias("lens"), F.bit_or(comes).alias("firsts"), F.min(F.when(F.col("after") == "", F.col("id"))).alias("ends")
    )
    every = settle(grouped, "edges")
    root = words.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("node"))
    forks = settle(every.where("only > 1").select(F.col("child").alias("node")).union(root), "forks")
    edges = settle(every.join(forks, "node", "left_semi"), "edges")
    # A word's ways end where it is alone: its rows stand at forks only. They are dealt by word, as a node's lie together.
    paths = settle(steps.drop("child").join(forks, "node", "left_semi").repartition("id"), "paths", dictionary=False)
    discard(every, forks)
    return paths, edges


def near_in_trie(words: DataFrame, deep: int = DEEP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """a, b: ids of words one edit apart, each pair once.

    A state is (word, node, what is left of the word, one edit made). At each
    level, words at a fork skip a letter (unless the next one is the same) or
    take an edge of a later letter; states with an edit made take the edge of
    their next letter. A state ends where an edge leads to a single word, or
    nothing is left and a word ends. Of a pair of unequal lengths the longer
    word finds the other, of equal lengths the one with the smaller letter.
    """
    paths, edges = trie(words, deep)
    sizes = {r.d: r.n for r in edges.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each level, `deep` at most
    found, ones, steps = [], None, []
    for d in range(max(sizes, default=-1) + 1):
        level = edges.where(F.col("d") == d).drop("d")
        level = F.broadcast(level) if sizes.get(d, 0) <= broadcast_rows else level
        here = paths.where(F.col("d") == d).select("id", "node", F.col("ch").alias("own"), "after")
        skipped = here.where((F.col("after") != "") & (head("after") != F.col("own"))).select("id", "node", F.col("after").alias("left"))
        moving = skipped if ones is None else skipped.union(ones)
        moved = moving.withColumn("ch", head("left")).join(level, ["node", "ch"]).withColumn("left", tail("left"))
        swapped = here.join(level, "node").where(F.col("ch") > F.col("own")).withColumnRenamed("after", "left")
        both = moved.select("id", "left", "child", "only", "rest", "owner", "lens", "firsts", "ends").union(swapped.select("id", "left", "child", "only", "rest", "owner", "lens", "firsts", "ends"))
        hit = F.when(F.col("only") == 1, F.when(F.col("rest") == F.col("left"), F.col("owner"))).when(F.col("left") == "", F.col("ends"))
        goes = (F.col("only") > 1) & (F.col("left") != "") & F.expr("shiftright(lens, length(left)) & 1 = 1 AND shiftright(firsts, ascii(left) % 64) & 1 = 1")
        step = settle(both.select("id", F.col("child").alias("node"), "left", hit.alias("hit"), goes.alias("goes")).where("hit IS NOT NULL OR goes").drop("goes"), f"level{d}", dictionary=False)
        steps.append(step)
        found.append(step.where("hit IS NOT NULL").select(F.col("id").alias("a"), F.col("hit").alias("b")))
        ones = step.where("hit IS NULL").select("id", "node", "left")
    # The last letter skipped: what is left is a word itself.
    short = words.where(F.length("word") <= deep).select(F.col("id").alias("a"), F.xxhash64(head("word", F.length("word") - 1)).alias("b"))
    pairs = short.join(words.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    for more in found:
        pairs = pairs.union(more)
    out = settle(pairs.distinct(), "pairs")
    discard(paths, edges, *steps)
    return out


def near_if_long(words: DataFrame, deep: int = DEEP) -> DataFrame:
    """a, b: ids of words that may be one edit apart, of at least `deep` code points: one edit leaves the first or the last half of `deep` as it is."""
    half = deep // 2
    n = F.length("word")
    keys = F.array(F.struct(F.lit(0).alias("side"), head("word", half).alias("part")), F.struct(F.lit(1).alias("side"), F.substring("word", -half, half).alias("part")))
    long_ = words.where(n >= deep).select("id", n.alias("n"), F.explode(keys).alias("key"))
    other = long_.select(F.col("id").alias("b"), F.explode(F.array(F.col("n"), F.col("n") + 1)).alias("n"), "key")
    return long_.join(other, ["n", "key"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def near(words: DataFrame, deep: int = DEEP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """word, near for all pairs of distinct words one inserted, deleted or replaced code point apart, both ways round. Nodes and ids are hashes; the words decide."""
    ided = settle(words.select("word", F.xxhash64("word").alias("id")), "words")
    pairs = near_in_trie(ided, deep, broadcast_rows).union(near_if_long(ided, deep)).distinct()
    sides = pairs.join(ided.select(F.col("id").alias("a"), "word"), "a").join(ided.select(F.col("id").alias("b"), F.col("word").alias("near")), "b")
    sure = settle(sides.where(F.levenshtein("word", "near", 1) == 1).select("word", "near"), "near")
    return sure.union(sure.select("near", "word")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms ends, by doubling. n at least doubles at each step, so a chain has fewer than 63 and six rounds reach its end."""
    now = settle(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        onward = now.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = settle(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            return now


def variants(words: DataFrame, deep: int = DEEP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per word of a table of distinct words and their counts n: word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or
    replaced code point. A word's form is its near word of largest n (ties: the
    smallest in code-point order), if that n is at least twice its own; root is
    where the forms lead. Words without near words have n_near 0 and
    themselves as root. An empty table gives no rows.
    """
    words = settle(words.select("word", "n"), "vocabulary")
    named = near(words, deep, broadcast_rows).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = named.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("k"), "near")).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.k") >= 2 * F.col("n"), F.col("best")).alias("best"))
    formed = settle(joined.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.k")).alias("form_n")), "forms")
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")


def group(docs: DataFrame) -> DataFrame:
    """variants() of the words of all documents (vocabulary()). Null, empty and very long texts, and other columns, do no harm; texts are read whole."""
    return variants(vocabulary(docs))
