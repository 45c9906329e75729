"""Operating modes by k-means from farthest-first centers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavejobs.functions.columns import clamp
from wavejobs.operators.fit import quantiles


def vectorize(features: list[str], stats: dict[str, dict[str, float]], most: float = 8.0) -> Column:
    """Signed robust z of each feature, cut at +-most."""
    return F.array(*[clamp((F.col(f) - stats[f]["center"]) / stats[f]["robust_sigma"], -most, most) for f in features])


def _squared(point: str, center: list[float]) -> Column:
    return sum(((F.get(point, F.lit(i)) - x) * (F.get(point, F.lit(i)) - x) for i, x in enumerate(center)), F.lit(0.0))


def _nearest(point: str, centers: list[list[float]]) -> Column:
    """(squared distance, number) of the nearest center, the first of equals."""
    return F.array_min(F.array(*[F.struct(_squared(point, c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centers)]))


def _farthest(points: DataFrame, centers: list[list[float]], point: str, row: str) -> list[float] | None:
    found = points.select(point, row, _nearest(point, centers)["d"].alias("d")).orderBy(F.desc("d"), row).first()
    return None if found is None else list(found[point])


def first_centers(points: DataFrame, k: int, point: str = "point", row: str = "row") -> list[list[float]]:
    """The point nearest to the origin, then k-1 times the one farthest from all centers, ties by row. k small rows come to the driver."""
    any_point = points.select(point).first()
    if any_point is None:
        return []
    dims = len(any_point[0])
    start = points.select(point, row, _squared(point, [0.0] * dims).alias("d")).orderBy("d", row).first()
    centers = [list(start[point])]
    while len(centers) < k:
        centers.append(_farthest(points, centers, point, row))
    return centers


def kmeans(points: DataFrame, k: int, most_rounds: int = 80, point: str = "point", row: str = "row") -> tuple[DataFrame, list[list[float]], float]:
    """(points with cluster and distance, centers, inertia). Only k sums a round come to the driver; an empty cluster gets the farthest point."""
    points = points.persist()
    centers = first_centers(points, k, point, row)
    if not centers:
        return points.withColumn("cluster", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("double")), [], 0.0
    dims = len(centers[0])
    for _ in range(most_rounds):
        assigned = points.select(point, _nearest(point, centers)["cluster"].alias("cluster"))
        sums = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(*[F.avg(F.get(point, F.lit(i))).alias(f"m{i}") for i in range(dims)]).collect()}
        moved = [[sums[c][f"m{i}"] for i in range(dims)] if c in sums else _farthest(points, centers, point, row) for c in range(k)]
        if max(abs(a - b) for x, y in zip(moved, centers) for a, b in zip(x, y)) < 1e-12:
            break
        centers = moved
    near = _nearest(point, centers)
    out = points.withColumn("cluster", near["cluster"]).withColumn("distance", F.sqrt(near["d"]))
    inertia = out.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0] or 0.0
    points.unpersist()
    return out, centers, inertia


def report(assigned: DataFrame, centers: list[list[float]], features: list[str], stats: dict[str, dict[str, float]]) -> DataFrame:
    """Per cluster: n, distance quantiles and the center in the features' units; thresholds over all rows stand in each row."""
    limits = quantiles(assigned, [0.995, 0.999], value="distance").first()
    limits = limits["q"] if limits else (None, None)
    units = [[v * stats[f]["robust_sigma"] + stats[f]["center"] for f, v in zip(features, c)] for c in centers]
    if not units:
        return assigned.select("cluster", F.lit(0).cast("long").alias("n")).where("cluster IS NOT NULL")
    named = F.array(*[F.struct(*[F.lit(float(v)).alias(f) for f, v in zip(features, u)]) for u in units])
    out = quantiles(assigned, [0.05, 0.5, 0.95, 0.99], ["cluster"], "distance")
    return out.select("cluster", "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95", "p99"))], F.get(named, F.col("cluster")).alias("center"), F.lit(limits[0]).cast("double").alias("suspect"), F.lit(limits[1]).cast("double").alias("anomaly"))


def outliers(assigned: DataFrame, n: int = 20, row: str = "row") -> DataFrame:
    return assigned.orderBy(F.desc("distance"), row).limit(n)
