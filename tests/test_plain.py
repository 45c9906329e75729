"""Operators without SQL of their own against plain loops over rows."""

import datetime as dt
import math
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from wavejobs.functions import waveform
from wavejobs.functions.columns import FEATURES
from wavejobs.operators import adapt, cluster, daily, frames, neighbors

T0 = dt.datetime(2024, 3, 1)


def echo(n=120, peak=60, seed=0, gain=1.0):
    rng, t = np.random.default_rng(seed), np.arange(n) - peak
    return 1.4 + 0.02 * rng.standard_normal(n) + gain * np.where(t >= -8, np.exp(-np.abs(t) / 20.0) * np.cos(t / 3.0), 0.0)


def features_of(w, template, start, end, base, peak):
    """A waveform's features, sample by sample."""
    ordered = sorted(w[:base])
    middle = (ordered[(base - 1) // 2] + ordered[base // 2]) / 2
    x = [v - middle for v in w]
    noise = math.sqrt(sum(v * v for v in x[:base]) / base)
    gate = x[start:end]
    energy = math.sqrt(sum(v * v for v in gate) / len(gate))
    dot, norm = sum(a * b for a, b in zip(gate, template)), math.sqrt(sum(v * v for v in gate) * sum(v * v for v in template))
    return {
        "baseline_v": middle, "noise_rms_v": noise, "gate_rms_v": energy, "peak_abs_gate_v": max(map(abs, gate)), "snr_db": 20 * math.log10(max(energy, 1e-9) / max(noise, 1e-9)), "template_corr": dot / norm if norm > 1e-9 else 0.0,
        "low_clip_ratio": sum(v <= 0.05 for v in w) / len(w), "high_clip_ratio": sum(v >= 3.25 for v in w) / len(w), "ptp_v": max(w) - min(w),
    }


def model_of(waves):
    gate = (waves - np.median(waves[:, :30], 1)[:, None]).mean(0)[40:90]
    profile = waveform.Profile(gate, 60, 40, 90, baseline=30)
    x = waveform.features(waves, profile)
    at = lambda f, q: float(np.quantile(x[f], q))
    stats = {f: {"center": at(f, 0.5), "robust_sigma": max(float(np.std(x[f])), 1e-3), "p01": at(f, 0.01), "p05": at(f, 0.05), "p95": at(f, 0.95), "p99": at(f, 0.99)} for f in FEATURES}
    return profile, stats


def test_adaptive_profile(spark):
    profile, stats = model_of(np.stack([echo(seed=i) for i in range(40)]))
    rows = [(m, i, i, echo(seed=900 + 50 * ord(m) + i, gain=0.1 if i % 11 == 5 else 1 + i / 400).tolist()) for m in "AB" for i in range(45)]
    model = adapt.Adaptive(profile, stats, suspect=2.5, window=6, ratio=0.5)
    got = {(r.serial, r.id): r for r in adapt.adapt(spark.createDataFrame(rows, "serial string, ts int, id int, samples array<double>").repartition(4), model).collect()}
    trained = 0
    for m in "AB":
        template, centers, recent, updates = profile.template.tolist(), {f: stats[f]["center"] for f in FEATURES}, [], 0
        for _, _, i, w in [r for r in rows if r[0] == m]:
            x = features_of(w, template, 40, 90, 30, 60)
            score = math.sqrt(sum(min(abs(x[f] - centers[f]) / stats[f]["robust_sigma"], 20) ** 2 for f in FEATURES) / len(FEATURES))
            safe = score <= 2.5 * 0.95 and all(x[f] >= stats[f]["p05"] for f in ("template_corr", "snr_db", "gate_rms_v")) and x["low_clip_ratio"] <= max(stats["low_clip_ratio"]["p95"] + 0.01, 0.07) and x["high_clip_ratio"] <= 0.001
            recent = [*recent, safe][-6:]
            moves = safe and len(recent) == 6 and sum(recent) >= 3
            if moves:
                base = statistics.median(w[:30])
                template = [a + 0.02 * (v - base - a) for a, v in zip(template, w[40:90])]
                centers = {f: c + 0.02 * (x[f] - c) for f, c in centers.items()}
                updates += 1
            trained += moves
            r = got[(m, i)]
            assert math.isclose(r.score, score, rel_tol=1e-9) and (r.trained, r.updates) == (moves, updates)
    assert 5 < trained < 85


def test_kmeans_and_its_report(spark):
    rng = random.Random(2)
    points = [[rng.gauss(c[0], 0.4), rng.gauss(c[1], 0.4)] for c in ((0, 0), (5, 1), (-4, 3)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(points)), "row long, point array<double>").repartition(3)
    far = lambda p, cs: min(sum((a - b) ** 2 for a, b in zip(p, c)) for c in cs)
    centers = [min(points, key=lambda p: sum(v * v for v in p))]
    while len(centers) < 4:
        centers.append(max(points, key=lambda p: far(p, centers)))
    for _ in range(80):
        own = [min(range(4), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, centers[c])), c)) for p in points]
        moved = [[sum(x) / len(x) for x in zip(*[p for p, o in zip(points, own) if o == c])] for c in range(4)]
        if np.allclose(moved, centers, atol=1e-13, rtol=0):
            break
        centers = moved
    assigned, found, inertia = cluster.kmeans(frame, 4)
    assert np.allclose(found, centers) and {r.row: r.cluster for r in assigned.collect()} == dict(enumerate(own))
    distances = [math.sqrt(far(p, centers)) for p in points]
    assert math.isclose(inertia, sum(d * d for d in distances))
    stats = {"x": {"center": 10.0, "robust_sigma": 2.0}, "y": {"center": -1.0, "robust_sigma": 0.5}}
    for r in cluster.report(assigned, found, ["x", "y"], stats).collect():
        inside = [d for d, o in zip(distances, own) if o == r.cluster]
        assert r.n == len(inside) and np.allclose((r.p05, r.p50, r.p95, r.p99), np.quantile(inside, (0.05, 0.5, 0.95, 0.99)))
        assert np.allclose((r.center.x, r.center.y), (centers[r.cluster][0] * 2 + 10, centers[r.cluster][1] * 0.5 - 1)) and np.allclose((r.suspect, r.anomaly), np.quantile(distances, (0.995, 0.999)))


def test_encoder(spark):
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(12, 3)))[0].T
    rng = np.random.default_rng(2)
    waves = [rng.normal(size=12).tolist() for _ in range(30)]
    rows = [*enumerate(waves), (100, None), (101, [1.0] * 5), (102, [float("nan")] * 12)]
    got = {r.row: r for r in neighbors.encode(spark.createDataFrame(rows, "row long, samples array<double>").coalesce(1), neighbors.linear_encoder(basis)).collect()}
    for i, w in enumerate(waves):
        z = [sum(a * b for a, b in zip(row, w)) for row in basis]
        back = [sum(z[k] * basis[k][j] for k in range(3)) for j in range(12)]
        assert np.allclose(got[i].embedding, z) and math.isclose(got[i].reconstruction_mse, sum((a - b) ** 2 for a, b in zip(w, back)) / 12)
    assert {got[i].status for i in (100, 101, 102)} == {"error"} and got[101].embedding is None


def test_probes(spark):
    """The features of faulty waveforms, sample by sample."""
    waves = np.stack([echo(n=120, seed=i) for i in range(40)])
    profile, _ = model_of(waves)
    frame = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(waves)], "id long, samples array<double>")
    for name in waveform.PROBES:
        tried = frame.select("id", waveform.probed(F.col("samples"), name, 120, 30).alias("samples"))
        for r in tried.select("id", "samples", waveform.extract(F.col("samples"), profile, 120).alias("f")).collect():
            x = features_of(list(r.samples), profile.template.tolist(), 40, 90, 30, 60)
            for f in FEATURES:
                assert math.isclose(r.f[f], x[f], rel_tol=1e-9, abs_tol=1e-9), (name, f)


def test_backfill(spark):
    profile, stats = model_of(np.stack([echo(seed=i) for i in range(40)]))
    rows = [("A", i, echo(seed=100 + i, gain=0.02 if i % 5 == 0 else 1.0).tolist()) for i in range(20)] + [("A", 50, None), ("A", 51, [1.0])]
    made = frames.backfill(spark.createDataFrame(rows, "serial string, id int, samples array<double>"), profile, 120, stats, 3.0, 6.0)
    got = {r.id: r for r in made.collect()}
    assert set(got) == set(range(20)) and "samples" not in made.columns
    names = {"anomaly": "waveform_anomaly", "suspect": "signal_quality_suspect", "normal": "normal_acoustic_state"}
    for _, i, w in rows[:20]:
        x = features_of(w, profile.template.tolist(), 40, 90, 30, 60)
        score = math.sqrt(sum(min(abs(x[f] - stats[f]["center"]) / stats[f]["robust_sigma"], 20) ** 2 for f in FEATURES) / len(FEATURES))
        label = "anomaly" if score >= 6 else "suspect" if score >= 3 else "normal"
        assert math.isclose(got[i].score, score, rel_tol=1e-9) and (got[i].label, got[i].pipe_state) == (label, names[label])
    assert got[5].label == "anomaly"


def test_daily_report(spark):
    rng, rows = random.Random(4), []
    for m in "AB":
        for day in range(3):
            now = T0 + dt.timedelta(days=day)
            for i in range(rng.choice((1, 40, 90))):
                now += dt.timedelta(seconds=rng.choice((0, 60, 60, 61, 300)))
                rows.append((m, now, len(rows), rng.gauss(0.99, 0.01), rng.gauss(12, 2), rng.gauss(0.5, 0.1), rng.choice((None, 40.0, 90.0)), rng.choice(("normal",) * 9 + ("anomaly", "suspect")), rng.uniform(30, 100)))
    frame = spark.createDataFrame(rows, "serial string, ts timestamp, id long, template_corr double, snr_db double, gate_rms_v double, sq double, label string, health double")
    stats = {"template_corr": (0.99, 0.004), "snr_db": (13.0, 1.5), "gate_rms_v": (0.5, 0.08)}
    minutes = spark.createDataFrame([("A", T0.date(), 12.4, 3.0), ("B", T0.date(), 0.0, 500.0)], "serial string, date date, empty_minutes double, air_minutes double")
    got = {(r.serial, r.date): r for r in daily.report(frame, stats, minutes, digits=7).collect()}
    days = {}
    for r in rows:
        days.setdefault((r[0], r[1].date()), []).append(r)
    assert set(got) == set(days)
    for key, own in days.items():
        g, n = got[key], len(own)
        steps = [s for a, b in zip(own, own[1:]) if (s := (b[1] - a[1]).total_seconds()) > 0]
        period = statistics.median(steps) if steps else 60.0
        points = lambda c, name: 100.0 if (z := (statistics.mean(r[c] for r in own) - stats[name][0]) / stats[name][1]) >= 0 else max(0.0, min(100.0, 100 + 25 * z))  # noqa: B023, E731
        empty, air = {"A": (12.4, 3.0), "B": (0.0, 500.0)}[key[0]] if key[1] == T0.date() else (0.0, 0.0)
        bad, odd = sum(r[7] == "anomaly" for r in own), sum(r[7] == "suspect" for r in own)
        seen = n * period / 60
        trouble = min(empty + air + bad * period / 60 + odd * period / 120, seen)
        known = [r[6] for r in own if r[6] is not None]
        spread = statistics.stdev(r[3] for r in own) if n > 1 else 0.0
        subs = {
            "coupling": points(3, "template_corr"), "signal_strength": (points(4, "snr_db") + points(5, "gate_rms_v")) / 2, "sq_quality": statistics.mean(known) if known else 50.0,
            "stability": max(0.0, min(100.0, 100 - 12.5 * (max(spread / 0.004, 1) - 1))), "incident_burden": max(0.0, 100 - 100 * trouble / max(seen, 1)), "uptime": min(100.0, n * period / 864),
        }
        for name, want in subs.items():
            assert math.isclose(g[name], want, abs_tol=1e-6), (key, name)
        health = 0.3 * subs["coupling"] + 0.2 * subs["signal_strength"] + 0.2 * subs["sq_quality"] + 0.15 * subs["stability"] + 0.15 * subs["incident_burden"]
        assert math.isclose(g.health, health, abs_tol=1e-5) and g.band == ("Optimal" if health >= 90 else "Good" if health >= 75 else "Fair" if health >= 60 else "Pay attention")
        p05 = float(np.quantile([r[8] for r in own], 0.05))
        assert math.isclose(g.p05_health, p05) and any("p05=" in h for h in g.highlights) == (p05 < 60)
        assert any("empty or lost" in h for h in g.highlights) == (empty > 0) and any(h.startswith(f"{bad} anomaly") for h in g.highlights) == (bad > 0)
        assert any("suspect" in h for h in g.highlights) == (odd > 0 and not (empty or air or bad)) and any("uptime" in h for h in g.highlights) == (subs["uptime"] < 80)
        if p05 < 60:
            assert "p05=" in g.highlights[-1]
