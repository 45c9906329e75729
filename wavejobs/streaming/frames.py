"""Live frames: routing, stateful tracking, sinks, scoring and late enrichment on Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from statistics import stdev

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavejobs.functions.columns import finite, sq_label, topic_serial
from wavejobs.operators import adapt, history, neighbors, zero
from wavejobs.operators.order import folded
from wavejobs.operators.states import EMPTY, NORMAL, WEAK
from wavejobs.sources.captures import decode_telemetry, decode_waveform
from wavejobs.streaming import live

_LIVE = "us long, raw_state string, state string, transitioned boolean, bad_count int, empty_pipe boolean, corr_std double, air_bubble boolean, sq double, sq_age_ms double, pub_dt long, pub_dt_delta long, score double, stable_ratio double, trained boolean, updates long, late_rows long"
_LIVE_NAMES = [c.split()[0] for c in _LIVE.split(", ")]
_STATEFUL = f"serial string, id long, {zero.WALKED}, {_LIVE}"


def route(messages: DataFrame, signal: str = "meter/sig/", telemetry: str = "meter/pub/") -> tuple[DataFrame, DataFrame]:
    """(waveforms, telemetry) of one stream or table of (topic, ts, payload)."""
    named = messages.withColumn("serial", topic_serial(F.col("topic")))
    waves = named.where(F.col("topic").startswith(signal)).select("serial", "ts", decode_waveform(F.col("payload")).alias("samples"))
    meters = named.where(F.col("topic").startswith(telemetry)).select("serial", "ts", decode_telemetry(F.col("payload")).alias("t")).select("serial", "ts", "t.*")
    return waves, meters


class Rules:
    """What a meter's live state follows. sigma is the profile's spread of template_corr.

    With a model, frames that have samples are scored by the meter's own profile,
    which follows its safe frames; their raw state and correlation come from it.
    """

    def __init__(self, enter: int = 3, recover: int = 5, normal: str = NORMAL, bad: tuple[str, ...] = (EMPTY, WEAK), of: int = 5, on: int = 3, off: int = 1, corr_rows: int = 20, sigma: float = 0.002, times: float = 5.0, recovery: float = 0.5, fresh_ms: float = 300_000.0, cfg: zero.Config = zero.Config(), model: adapt.Adaptive | None = None) -> None:
        self.enter, self.recover, self.normal, self.bad, self.of, self.on, self.off = enter, recover, normal, bad, of, on, off
        self.corr_rows, self.high, self.low, self.fresh_ms, self.cfg, self.model = corr_rows, times * sigma, times * sigma * recovery, fresh_ms, cfg, model

    def fresh(self) -> dict:
        return {"zero": zero.State().as_dict(), "run": 0, "raw": None, "shown": self.normal, "started": False, "bad": [], "empty": False, "corr": [], "air": False, "sq": None, "sq_us": None, "dt": None, "step": None, "last": None, "late": 0, "own": None if self.model is None else self.model.start() | {"template": self.model.profile.template.tolist()}}

    def told(self, s: dict, us: int, sq: float | None, dt: int | None) -> None:
        """Telemetry: each value counts from its own last update."""
        if sq is not None:
            s["sq"], s["sq_us"] = sq, us
        if dt is not None:
            s["step"], s["dt"] = (None if s["dt"] is None else dt - s["dt"]), dt

    def trained(self, s: dict, samples, good: bool) -> tuple:
        """(raw state, correlation, score, stable ratio, trained, updates) of a waveform by the meter's own profile."""
        own = s["own"] | {"template": np.asarray(s["own"]["template"], float)}
        x, score, moved, updates = self.model.judged(own, np.asarray(samples, float), good)
        s["own"] = own | {"template": own["template"].tolist()}
        return self.model.raw_state(x, score), x["template_corr"], score, sum(own["recent"]) / len(own["recent"]), moved, updates

    def seen(self, s: dict, us: int | None, raw: str | None, corr: float | None, *more) -> tuple:
        """A frame: the values of _LIVE but for late_rows. more: score and what follows it."""
        s["run"] = s["run"] + 1 if raw == s["raw"] and raw is not None else 1
        s["raw"], shown = raw, s["shown"]
        if raw is not None and s["run"] >= (self.recover if raw == self.normal else self.enter):
            s["shown"] = raw
        moved, s["started"] = s["started"] and s["shown"] != shown, True
        s["bad"] = [*s["bad"], s["shown"] in self.bad][-self.of :]
        count = sum(s["bad"])
        s["empty"] = count > self.off if s["empty"] else count >= self.on
        if corr is not None:
            s["corr"] = [*s["corr"], corr][-self.corr_rows :]
        spread = stdev(s["corr"]) if len(s["corr"]) == self.corr_rows > 1 else None
        if spread is not None:
            s["air"] = spread >= (self.low if s["air"] else self.high)
        age = None if s["sq_us"] is None or us is None else (us - s["sq_us"]) / 1000.0
        good = age is not None and age <= self.fresh_ms
        return us, raw, s["shown"], moved, count, s["empty"], spread, s["air"], s["sq"] if good else None, age if good else None, s["dt"], s["step"], *more

    def advance(self, part: pd.DataFrame, s: dict) -> pd.DataFrame:
        """A meter's rows of one batch, in order; rows before the newest one seen are counted and left out. Rows without a time come last, and are never late."""
        part = part.sort_values(["us", "side", "id"])
        if s["last"] is not None:
            late = part["us"] < s["last"]
            s["late"] += int(late.sum())
            part = part[~late]
        if part["us"].notna().any():
            s["last"] = int(part["us"].max())
        made = []
        none = lambda x: None if pd.isna(x) else x
        samples = part["samples"].tolist() if "samples" in part else [None] * len(part)
        good = [bool(none(x)) for x in part["good"]] if "good" in part else [True] * len(part)
        for us, side, raw, corr, sq, dt, wave, safe in zip(*(part[c].tolist() for c in ("us", "side", "raw_state", "corr", "sq", "dt")), samples, good):
            us = none(us) if none(us) is None else int(us)
            if side == 0:
                self.told(s, us, none(sq), none(dt) if none(dt) is None else int(dt))
                continue
            own = (none(raw), none(corr), None, None, None, None)
            if self.model is not None and wave is not None and len(wave) >= self.model.profile.gate_end:
                own = self.trained(s, wave, safe)
            made.append((*self.seen(s, us, *own), s["late"]))
        frames = part[part["side"] == 1]
        tracker = zero.State(**s["zero"])
        walked = zero.walk(frames, tracker, self.cfg)
        s["zero"] = tracker.as_dict()
        kinds = {c: "Float64" for c in ("corr_std", "sq", "sq_age_ms", "score", "stable_ratio")} | {c: "Int64" for c in ("us", "pub_dt", "pub_dt_delta", "updates")} | {"trained": "boolean"}  # missing values stay null
        return pd.concat([walked.reset_index(drop=True), pd.DataFrame(made, columns=_LIVE_NAMES).astype(kinds)], axis=1)


def inputs(frames: DataFrame, telemetry: DataFrame | None = None, key: str = "serial", ts: str = "ts", tie: str = "id", raw: str = "raw_state") -> DataFrame:
    """The narrow rows that track() keeps in order: frames (side 1) and, before frames of the same time, telemetry with sq and dt (side 0). Of frames, `samples` and `good` (safe to learn from) go along if they have them."""
    have = set(frames.columns)
    corr = finite("template_corr") if "template_corr" in have else F.lit(None).cast("double")
    at = F.col(ts).cast("timestamp")
    same = lambda side: (F.col(key).cast("string").alias("serial"), at.alias("at"), F.unix_micros(at).alias("us"), F.col(tie).cast("long").alias("id"), F.lit(side).alias("side"))
    rows = frames.select(*same(1), *[c.alias(n) for n, c in zero.frame_columns(frames).items()], F.col(raw).alias("raw_state"), corr.alias("corr"), F.lit(None).cast("double").alias("sq"), F.lit(None).cast("long").alias("dt"), *[F.col(c) for c in ("samples", "good") if c in have])
    if telemetry is None:
        return rows
    told = telemetry.select(*same(0), finite("sq").alias("sq"), (F.col("dt").cast("long") if "dt" in telemetry.columns else F.lit(None).cast("long")).alias("dt"))
    return rows.unionByName(told, allowMissingColumns=True)


def stateful(rows: DataFrame, order: list, fresh: Callable[[], dict], advance: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str, ttl: str | None = None, watermark: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """What advance says of each meter's rows, a stream or a table. A meter's state is one JSON text.

    start (serial, state) is where meters without a state begin, as of
    snapshot(); it meets the rows by an equi-join. With a watermark Spark drops
    rows of `at` that are later than that. ttl ends the state of silent meters:
    of event time with a watermark, else of processing time.
    """
    if start is not None:
        rows = rows.join(start.select("serial", F.col("state").alias("saved")), "serial", "left")
    else:
        rows = rows.withColumn("saved", F.lit(None).cast("string"))
    begin = lambda part: json.loads(part["saved"].iloc[0]) if part["saved"].notna().iloc[0] else fresh()
    if not rows.isStreaming:

        def more(part: pd.DataFrame, state: dict) -> pd.DataFrame:
            if not state:
                state |= begin(part)
            return advance(part, state)

        return folded(rows.drop("at"), "serial", order, dict, more, schema)

    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    empty = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        got = list(parts)
        if not got:
            return
        part = pd.concat(got)
        state = json.loads(group.get[0]) if group.exists else begin(part)
        out = advance(part, state)
        yield out if len(out) else pd.DataFrame(columns=empty)
        group.update((json.dumps(state),))
        if ttl_ms and watermark:
            group.setTimeoutTimestamp(max(int(part["us"].max()) // 1000, group.getCurrentWatermarkMs()) + ttl_ms)
        elif ttl_ms:
            group.setTimeoutDuration(ttl_ms)

    if watermark:
        rows = rows.withWatermark("at", watermark)
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("serial").applyInPandasWithState(run, schema, "state string", "append", timeout)


_ORDER = [F.asc_nulls_last, "us"], [F.asc, "side"], [F.asc_nulls_last, "id"]


def track(rows: DataFrame, rules: Rules | None = None, ttl: str | None = None, watermark: str | None = None, start: DataFrame | None = None, reorder: bool = False) -> DataFrame:
    """For each frame of inputs(): the zero tracker's output, the debounced state, empty pipe, air bubble, latest telemetry, the score by the meter's own profile and how many late rows the meter has had.

    A stream is followed by live.Meter, which with reorder puts rows in order up
    to the watermark; a table by a fold of the same rules.
    """
    rules = rules or Rules()
    if rows.isStreaming:
        rows = rows.withColumn("serial", F.col("serial").cast("string"))
        followed = live.followed(rows, rules, _STATEFUL, ttl, watermark, start, reorder)
    else:
        followed = stateful(rows, [f(c) for f, c in _ORDER], rules.fresh, rules.advance, _STATEFUL, start=start)
    return zero.finished(followed, ["serial", "id", *_LIVE_NAMES], rules.cfg).withColumn("sq_label", sq_label(F.col("sq")))


def snapshot(rows: DataFrame, rules: Rules | None = None) -> DataFrame:
    """serial, state: where each meter of a table of inputs() stands after its last row, to start a stream from."""
    rules = rules or Rules()

    def more(part: pd.DataFrame, state: dict) -> pd.DataFrame:
        if not state:
            state |= rules.fresh()
        rules.advance(part, state)
        return pd.DataFrame({"serial": part["serial"].iloc[:1], "us": part["us"].iloc[-1:].to_numpy(), "rows": [state["zero"]["rows"]], "state": [json.dumps(state)]})

    steps = folded(rows.drop("at"), "serial", [f(c) for f, c in _ORDER], dict, more, "serial string, us long, rows long, state string")
    return steps.groupBy("serial").agg(F.max_by("state", F.struct("us", "rows")).alias("state"))


def self_trained(frames: DataFrame, model: adapt.Adaptive, ttl: str | None = None, watermark: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """serial, us, id, score, trained, updates of frames (serial, at, us, id, samples, good), with each meter's own template and centers as state."""

    def advance(part: pd.DataFrame, state: dict) -> pd.DataFrame:
        state["template"] = np.asarray(state["template"])
        part = part.sort_values(["us", "id"])
        out = [(s, us, i, *model.step(state, np.asarray(w, float), bool(g))) for s, us, i, w, g in zip(*(part[c].tolist() for c in ("serial", "us", "id", "samples", "good")))]
        state["template"] = state["template"].tolist()
        return pd.DataFrame(out, columns=["serial", "us", "id", "score", "trained", "updates"])

    fresh = lambda: model.start() | {"template": model.profile.template.tolist()}
    return stateful(frames, [F.asc_nulls_last("us"), F.asc_nulls_last("id")], fresh, advance, "serial string, us long, id long, score double, trained boolean, updates long", ttl, watermark, start)


def events_of(tracked: DataFrame) -> DataFrame:
    return tracked.where("transitioned").select(F.lit("pipe_state_transition").alias("event"), "serial", F.timestamp_micros("us").alias("ts"), F.col("state").alias("to_state"))


def sink(tracked: DataFrame, frames_path: str, events_path: str, checkpoint: str, available_now: bool = True):
    """Start a query that writes frames, by day, and their events. A batch's rows stand under its number, so that a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        _put(batch.withColumn("date", F.to_date(F.timestamp_micros("us"))), number, frames_path, "date")
        _put(events_of(batch), number, events_path)
        batch.unpersist()

    return _started(tracked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def _put(batch: DataFrame, number: int, path: str, *by: str) -> None:
    batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)


def _started(writer, available_now: bool):
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def scored(frames: DataFrame, encoder, path: str, checkpoint: str, available_now: bool = True):
    """Start a query of its own that scores frames (row, samples) and writes row, embedding, reconstruction_mse and status: completed, or error for a frame that can't be scored.

    The tracking query doesn't wait for it; enriched() joins what is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        _put(neighbors.encode(batch, encoder), number, path)

    return _started(frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def scores_so_far(frames: DataFrame, results: DataFrame, row: str = "row") -> DataFrame:
    """Frames with reconstruction_mse and status of scored(); pending where it hasn't come by."""
    done = results.select(F.col(row).alias("__row"), "reconstruction_mse", "status")
    return frames.join(done, frames[row] == done["__row"], "left").drop("__row").withColumn("status", F.coalesce("status", F.lit("pending")))


def enriched(frames: DataFrame, results: DataFrame, fields: list[str]) -> DataFrame:
    """Scores that come later, joined to the newest frame of their meter and time."""
    return history.enrich(frames, results, fields)
