"""Rounds of k-means."""

import inspect

from wavejobs.operators import cluster
from wavejobs.plans import registry


def test_kmeans_runs_to_the_end(spark, monkeypatch):
    seen = []
    real = cluster.kmeans

    def spy(*args, **more):
        seen.append(inspect.signature(real).bind(*args, **more).arguments.get("most_rounds", 80))
        return real(*args, **more | {"most_rounds": 1} if len(args) < 3 else more)

    monkeypatch.setattr(registry.cluster, "kmeans", spy)
    registry.queries()["f19_kmeans"](spark, "/root/testdata/sf0.001")
    assert seen == [80]
