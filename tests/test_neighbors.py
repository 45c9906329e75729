"""Nearest neighbours against brute force, with ties."""

import numpy as np

from wavejobs.operators import neighbors


def test_ties_and_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BANK_BLOCK", 150)
    monkeypatch.setattr(neighbors, "QUERY_PART", 40)
    rng = np.random.default_rng(2)
    points = rng.standard_normal((400, 6))
    points[rng.permutation(400)[:120]] = points[0]  # far more ties than k
    points[300:330] = 1e6 + rng.standard_normal((30, 6)) * 1e-4  # near-equal rows far from the origin
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    bank = spark.createDataFrame(rows, "row long, point array<double>")
    got = {}
    for r in neighbors.nearest(bank, bank, 5).collect():
        got.setdefault(r.row, {})[r.rank] = r.neighbor
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(1))
        want = [int(j) for j in np.lexsort((np.arange(400), d)) if j != i][:5]
        assert [got[i][k] for k in range(1, 6)] == want, i
