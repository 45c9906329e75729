"""Self-training: a meter's template and centers follow its safe frames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavejobs.functions.columns import FEATURES
from wavejobs.functions.waveform import Profile, features
from wavejobs.operators.order import folded
from wavejobs.operators.states import EMPTY, NORMAL, SATURATED, WEAK


@dataclass
class Adaptive:
    """A meter's own profile. Scores use the centers as moved so far; the limits of the gate stay."""

    profile: Profile
    stats: dict[str, dict[str, float]]
    suspect: float
    window: int = 64
    ratio: float = 0.6
    template_alpha: float = 0.02
    center_alpha: float = 0.02
    headroom: float = 0.95
    anomaly: float = float("inf")

    def start(self) -> dict:
        return {"template": self.profile.template.copy(), "centers": {f: self.stats[f]["center"] for f in FEATURES}, "recent": [], "updates": 0}

    def step(self, state: dict, wave: np.ndarray, good: bool = True) -> tuple[float, bool, int]:
        """(score, trained, updates) of a frame; state moves on."""
        return self.judged(state, wave, good)[1:]

    def raw_state(self, x: dict[str, float], score: float) -> str:
        """What states.raw_state() says of a frame's features and score."""
        s = self.stats
        if x["low_clip_ratio"] > max(s["low_clip_ratio"]["p99"] + 0.02, 0.08) or x["high_clip_ratio"] > max(s["high_clip_ratio"]["p99"] + 0.005, 0.005):
            return SATURATED
        weak = sum(x[f] < s[f]["p01"] for f in ("gate_rms_v", "peak_abs_gate_v", "snr_db", "template_corr"))
        if weak >= 2:
            return EMPTY if weak >= 3 else WEAK
        return "waveform_anomaly" if score >= self.anomaly else "signal_quality_suspect" if score >= self.suspect else NORMAL

    def judged(self, state: dict, wave: np.ndarray, good: bool = True) -> tuple[dict[str, float], float, bool, int]:
        """(features, score, trained, updates) of a frame; state moves on."""
        p = self.profile
        own = Profile(state["template"], p.peak, p.gate_start, p.gate_end, p.baseline, p.low, p.high, p.arrival, p.eps)
        x = {n: float(v[0]) for n, v in features(wave[None, :], own).items()}
        z = [min(abs(x[f] - state["centers"][f]) / self.stats[f]["robust_sigma"], 20.0) for f in FEATURES]
        score = float(np.sqrt(np.mean(np.square(z))))
        s = self.stats
        safe = (
            good
            and score <= self.suspect * self.headroom
            and all(x[f] >= s[f]["p05"] for f in ("template_corr", "snr_db", "gate_rms_v"))
            and x["low_clip_ratio"] <= max(s["low_clip_ratio"]["p95"] + 0.01, 0.07)
            and x["high_clip_ratio"] <= 0.001
        )
        state["recent"] = [*state["recent"], safe][-self.window :]
        trained = safe and len(state["recent"]) == self.window and sum(state["recent"]) >= self.ratio * self.window
        if trained:
            gate = wave[p.gate_start : p.gate_end] - np.median(wave[: p.baseline])
            state["template"] = state["template"] + self.template_alpha * (gate - state["template"])
            state["centers"] = {f: c + self.center_alpha * (x[f] - c) for f, c in state["centers"].items()}
            state["updates"] += 1
        return x, score, trained, state["updates"]


def adapt(frames: DataFrame, model: Adaptive, key: str = "serial", ts: str = "ts", tie: str = "id", samples: str = "samples", good: str | None = None) -> DataFrame:
    """key, tie, score, trained, updates of each frame, in order of time per key. good names a boolean column that the gate asks for."""

    def run(part: pd.DataFrame, state: dict) -> pd.DataFrame:
        out = []
        for r in part.to_dict("records"):
            out.append((r[key], r[tie], *model.step(state, np.asarray(r[samples], float), True if good is None else bool(r[good]))))
        return pd.DataFrame(out, columns=[key, tie, "score", "trained", "updates"])

    kinds = dict(frames.dtypes)
    narrow = frames.select(key, ts, tie, samples, *([good] if good else []))
    return folded(narrow, key, [F.asc_nulls_last(ts), F.asc_nulls_last(tie)], model.start, run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, score double, trained boolean, updates long")
