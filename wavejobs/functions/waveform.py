"""Waveform math on stacked arrays, and its pandas UDFs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("baseline_v", "noise_rms_v", "gate_rms_v", "peak_abs_gate_v", "snr_db", "template_corr", "first_arrival_idx", "first_arrival_offset_samples", "peak_offset_samples", "low_clip_ratio", "high_clip_ratio", "ptp_v")
NO_ARRIVAL = 9999.0
SAMPLE_RATE_HZ = 100_000_000.0


@dataclass
class Profile:
    """Where the echo is and what it looks like."""

    template: np.ndarray
    peak: int
    gate_start: int
    gate_end: int
    baseline: int = 160
    low: float = 0.05
    high: float = 3.25
    arrival: float = 0.15
    eps: float = 1e-9

    @classmethod
    def from_row(cls, row, **more) -> "Profile":
        return cls(np.array(row["template"]), row["peak"], row["gate_start"], row["gate_end"], **more)


def features(waves: np.ndarray, p: Profile) -> dict[str, np.ndarray]:
    """The features of each row of a matrix of equally long waveforms."""
    base = np.median(waves[:, : p.baseline], 1)
    centered = waves - base[:, None]
    gate = centered[:, p.gate_start : p.gate_end]
    size = np.abs(gate)
    rms = lambda m: np.sqrt(np.mean(m * m, 1))
    noise, energy = rms(centered[:, : p.baseline]), rms(gate)
    norm = np.sqrt(np.sum(gate * gate, 1) * np.sum(p.template**2))
    over = size > np.maximum(6.0 * noise, p.arrival)[:, None]
    arrival = np.where(over.any(1), p.gate_start + over.argmax(1), -1)
    return {
        "baseline_v": base,
        "noise_rms_v": noise,
        "gate_rms_v": energy,
        "peak_abs_gate_v": size.max(1),
        "snr_db": 20.0 * np.log10(np.maximum(energy, 1e-9) / np.maximum(noise, 1e-9)),
        "template_corr": np.where(norm > p.eps, gate @ p.template / np.where(norm > p.eps, norm, 1.0), 0.0),
        "first_arrival_idx": arrival.astype(float),
        "first_arrival_offset_samples": np.where(arrival >= 0, arrival - p.peak, NO_ARRIVAL).astype(float),
        "peak_offset_samples": (p.gate_start + size.argmax(1) - p.peak).astype(float),
        "low_clip_ratio": np.mean(waves <= p.low, 1),
        "high_clip_ratio": np.mean(waves >= p.high, 1),
        "ptp_v": waves.max(1) - waves.min(1),
    }


def arrival_us(first_arrival_idx: Column, rate_hz: float = SAMPLE_RATE_HZ) -> Column:
    """Microseconds up to the first arrival; -1 without one."""
    return F.when(first_arrival_idx >= 0, first_arrival_idx / rate_hz * 1e6).otherwise(-1.0)


def _stacked(waves: pd.Series, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have `length` finite samples, those rows as a matrix)."""
    ok = np.array([w is not None and len(w) == length and bool(np.isfinite(np.asarray(w, float)).all()) for w in waves], bool)
    return ok, np.array([np.asarray(w, float) for w, k in zip(waves, ok) if k]).reshape(-1, length)


def extract(samples: Column, profile: Profile, length: int) -> Column:
    """A struct of FIELDS; null for rows of another length or with missing samples."""

    @F.pandas_udf(", ".join(f"{f} double" for f in FIELDS))
    def run(waves: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=range(len(waves)), columns=list(FIELDS))
        ok, matrix = _stacked(waves, length)
        if ok.any():
            for name, values in features(matrix, profile).items():
                out.loc[ok, name] = values
        return out.astype(object).where(out.notna(), None).astype("Float64")

    return run(samples)


def probe(name: str, waves: np.ndarray, baseline: int = 160) -> np.ndarray:
    """A synthetic fault: attenuated, noise_only, delayed, bias or gain."""
    base = np.median(waves[:, :baseline], 1, keepdims=True)
    if name == "attenuated":
        return base + 0.2 * (waves - base)
    if name == "noise_only":
        noise = (waves - base)[:, :baseline]
        return base + 0.8 * noise[:, np.arange(waves.shape[1]) % noise.shape[1]]
    if name == "delayed":
        moved = np.zeros_like(waves)
        moved[:, 35:] = (waves - base)[:, :-35]
        return base + moved
    if name == "bias":
        return np.clip(waves - 0.3, 0.0, 3.3)
    if name == "gain":
        return np.clip(base + 1.6 * (waves - base), 0.0, 3.3)
    raise ValueError(name)


PROBES = ("attenuated", "noise_only", "delayed", "bias", "gain")


def probed(samples: Column, name: str, length: int, baseline: int = 160) -> Column:
    @F.pandas_udf("array<double>")
    def run(waves: pd.Series) -> pd.Series:
        ok, matrix = _stacked(waves, length)
        made = iter(probe(name, matrix, baseline)) if ok.any() else iter(())
        return pd.Series([next(made) if k else None for k in ok])

    return run(samples)


def centered(samples: Column, baseline: int = 160, scale: float = 1.0, clip: float = 6.0, start: int = 0, end: int | None = None) -> Column:
    """Samples less the median of the first ones, cropped, divided by scale and clipped."""

    @F.pandas_udf("array<double>")
    def run(waves: pd.Series) -> pd.Series:
        out = []
        for w in waves:
            if w is None or not len(w):
                out.append(None)
                continue
            v = np.asarray(w, float)
            out.append(np.clip((v - np.median(v[:baseline]))[start:end] / scale, -clip, clip))
        return pd.Series(out)

    return run(samples)


def summary(samples: Column, n: int = 80) -> Column:
    """sample_count, baseline (upper median of the first n), peak_index (first), peak_abs and the gate."""
    count = F.size(samples)
    head = F.array_sort(F.slice(samples, F.lit(1), F.least(F.lit(n), count)))
    base = F.get(head, F.floor(F.size(head) / 2).cast("int"))
    away = F.transform(samples, lambda v: F.abs(v - base))
    gated = count > 120
    return F.struct(
        count.alias("sample_count"),
        base.alias("baseline"),
        F.when(count > 0, F.array_position(away, F.array_max(away)) - 1).alias("peak_index"),
        F.array_max(away).alias("peak_abs"),
        F.when(gated, 120).alias("gate_start"),
        F.when(gated, F.least(F.lit(520), count)).alias("gate_end"),
    )
