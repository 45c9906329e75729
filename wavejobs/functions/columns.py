"""Column helpers: numbers that may be missing, units, labels, times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M3H_TO_GPM = 4.4028675393
SQ_POOR, SQ_FAIR = 50.0, 80.0
FEATURES = ("baseline_v", "noise_rms_v", "gate_rms_v", "peak_abs_gate_v", "snr_db", "template_corr", "low_clip_ratio", "high_clip_ratio", "ptp_v")
#: Least robust sigma of each feature. Fixed values.
SIGMA_FLOOR = {"baseline_v": 0.05, "noise_rms_v": 0.005, "gate_rms_v": 0.02, "peak_abs_gate_v": 0.05, "snr_db": 0.20, "template_corr": 0.002, "low_clip_ratio": 0.005, "high_clip_ratio": 0.001, "ptp_v": 0.05}


def finite(c: Column | str) -> Column:
    """The value as a double; null if it isn't a number, or is NaN or infinite."""
    x = F.col(c) if isinstance(c, str) else c
    x = x.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def first_finite(*cs: Column | str) -> Column:
    return F.coalesce(*[finite(c) for c in cs])


def truthy(c: Column, default: float) -> Column:
    """A default for null and for 0, as `x or default` has it."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def clamp(c: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.greatest(low, F.least(high, c))


def py_round(c: Column, digits: int) -> Column:
    """Half to even. On ties of the decimal text this can differ from rounding of the binary value."""
    return F.bround(c, digits)


def sq_label(sq: Column, poor: float = SQ_POOR, fair: float = SQ_FAIR) -> Column:
    return F.when(sq.isNull(), "unknown").when(sq < poor, "poor").when(sq < fair, "fair").otherwise("good")


def normal_serial(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_-]", ""))


def topic_serial(topic: Column, prefixes: tuple[str, ...] = ("meter/sig/", "meter/pub/", "meter/")) -> Column:
    """The meter of a topic: what follows a known prefix, else the last segment."""
    plain = F.substring_index(topic, "/", -1)
    for p in reversed(prefixes):
        plain = F.when(topic.startswith(p), F.substring(topic, len(p) + 1, 1000)).otherwise(plain)
    return normal_serial(plain)


def pipe_area(outer_mm: Column, wall_mm: Column) -> Column:
    """Square metres, with outer of at least 1 mm, wall of at least 0 and a bore of at least 0.1 mm."""
    bore = F.greatest(F.greatest(outer_mm, F.lit(1.0)) - F.greatest(wall_mm, F.lit(0.0)) * 2.0, F.lit(0.1)) / 1000.0
    return F.lit(math.pi) * bore * bore / 4.0


def strict_pipe_area(outer_mm: Column, wall_mm: Column) -> Column:
    """As pipe_area, but null where there is no bore."""
    bore = (outer_mm - wall_mm * 2.0) / 1000.0
    return F.when(bore > 0, F.lit(math.pi) * bore * bore / 4.0)


def flow_rate(speed: Column, area: Column) -> Column:
    return speed * area * 3600.0


def flow_speed(rate: Column, area: Column) -> Column:
    return rate / F.greatest(area * 3600.0, F.lit(1e-9))


def gpm(rate: Column) -> Column:
    return rate * M3H_TO_GPM


def peak_mode(offset: Column) -> Column:
    return F.when(offset <= -50, "peak_minus_100").when(offset >= 25, "peak_plus_50").when(offset.between(-25, 25), "peak_center").otherwise("peak_other")


def score_label(score: Column, suspect: Column, anomaly: Column) -> Column:
    return F.when(score >= anomaly, "anomaly").when(score >= suspect, "suspect").otherwise("normal")


def confidence(score: Column, suspect: Column, anomaly: Column) -> Column:
    """From 1 down to 0.8 at the suspect threshold, to 0.3 at the anomaly threshold, then exponentially to 0."""
    s = F.greatest(suspect, F.lit(1e-9))
    a = F.greatest(anomaly, s + 1e-9)
    return (
        F.when(score <= s, F.greatest(F.lit(0.8), 1.0 - score * 0.2 / s))
        .when(score <= a, F.greatest(F.lit(0.3), 0.8 - (score - s) * 0.5 / (a - s)))
        .otherwise(F.greatest(F.lit(0.0), F.exp(a - score) * 0.3))
    )


def sigma_score(value: Column, center: Column, sigma: Column, points: float = 25.0, higher_is_better: bool = True) -> Column:
    """100 at the healthy side of the center; points off for each sigma on the other."""
    z = (value - center) / F.greatest(sigma, F.lit(1e-9))
    z = z if higher_is_better else -z
    return F.when(z >= 0, F.lit(100.0)).otherwise(clamp(z * points + 100.0, 0.0, 100.0))


def anomaly_points(score: Column, suspect: Column, anomaly: Column) -> Column:
    """100 to 80 up to the suspect threshold, to 40 up to the anomaly threshold, then exponentially to 0."""
    s = F.greatest(suspect, F.lit(1e-9))
    a = F.greatest(anomaly, s + 1e-9)
    x = F.greatest(score, F.lit(0.0))
    return F.when(x <= s, 100.0 - x * 20.0 / s).when(x <= a, 80.0 - (x - s) * 40.0 / (a - s)).otherwise(F.exp(a - x) * 40.0)


def age_penalty(age_ms: Column, stale_ms: float, most: float) -> Column:
    """None up to stale_ms, rising to `most` at three times that; half of it if the age isn't known."""
    return F.when(age_ms.isNull(), most * 0.5).otherwise(clamp((F.greatest(age_ms, F.lit(0.0)) - stale_ms) / (stale_ms * 2.0) * most, 0.0, most))


def band(score: Column, bands: tuple[tuple[float, str], ...]) -> Column:
    out = F.lit(bands[-1][1])
    for cut, name in reversed(bands[:-1]):
        out = F.when(score >= cut, name).otherwise(out)
    return out


HEALTH_BANDS = ((90, "Excellent"), (75, "Healthy"), (60, "Watch"), (40, "Degraded"), (0, "Unreliable"))
DAILY_BANDS = ((90, "Optimal"), (75, "Good"), (60, "Fair"), (0, "Pay attention"))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970, of timestamps with or without a zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def timestamp(text: Column) -> Column:
    """ISO 8601 with Z, an offset, or none, which is UTC; null if it can't be read. The session's zone has to be UTC."""
    return F.try_to_timestamp(text)


def range_seconds(text: str | None, default: int = 24 * 3600) -> int:
    """Seconds of a range such as 15m, 24h or 7d; at least a minute, the default if it can't be read."""
    unit = {"m": 60, "h": 3600, "d": 86400}.get((text or "").strip().lower()[-1:])
    try:
        return max(60, int(float(text.strip()[:-1]) * unit)) if unit else default
    except ValueError:
        return default
