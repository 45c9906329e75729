"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavejobs.llm.common import settle


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root for every node of links (a, b: longs); root is the smallest node that is reachable.

    Large-star and small-star rounds: in turn, every larger, then every smaller
    neighbour of a node is hung on the node's smallest neighbour, until nothing
    changes. Every round is two combinable aggregates and two equi-joins, in
    which Spark can split a hub's rows; only the number of links and a
    checksum come to the driver. Links with a null end and links from a node to
    itself are left out.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = settle(pairs.distinct(), "links")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    was = state(now)
    if was[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        if (then := state(now)) == was:
            break
        was = then
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Components within one task: labels of nodes 0 to n-1, joined by arrays of links."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        while len(i):
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while (nxt := label[label] != label).any():
                label[nxt] = label[label[nxt]]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
