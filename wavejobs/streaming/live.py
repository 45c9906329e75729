"""A meter's live state as one stateful processor: typed values and lists, timers, expiry and initial state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Typed states: a value of these fields each, by the name under which a meter's state has them.
VALUES = {
    "zero": "rows long, warmth double, last_us long, estimate double, bias double, steadiness double, quiet_run int",
    "shown": "raw string, run long, shown string, started boolean, empty boolean, air boolean, last long, late long",
    "telemetry": "sq double, sq_us long, dt long, step long",
    "profile": "template array<double>, centers map<string, double>, updates long",
}
#: Typed lists of one field each.
LISTS = {"warm": "double", "bad": "boolean", "corr": "double", "recent": "boolean"}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace("map<string, double>", "map").split(", ")]


def to_typed(state: dict) -> tuple[dict[str, tuple], dict[str, list]]:
    """A meter's state as VALUES and LISTS."""
    own = state.get("own") or {}
    flat = {"zero": state["zero"], "shown": state, "telemetry": state, "profile": own}
    values = {n: tuple(flat[n].get(c) for c in _names(schema)) for n, schema in VALUES.items() if n != "profile" or own}
    lists = {"warm": state["zero"]["warm"], "bad": state["bad"], "corr": state["corr"], "recent": own.get("recent", [])}
    return values, lists


def from_typed(values: dict[str, tuple], lists: dict[str, list]) -> dict:
    got = {n: dict(zip(_names(VALUES[n]), v)) for n, v in values.items()}
    state = {**got["shown"], **got["telemetry"], "zero": got["zero"] | {"warm": lists["warm"]}, "bad": lists["bad"], "corr": lists["corr"], "own": None}
    if "profile" in got:
        own = got["profile"]
        state["own"] = {"template": list(own["template"]), "centers": dict(own["centers"]), "updates": own["updates"], "recent": lists["recent"]}
    return state


class Meter(StatefulProcessor):
    """Follows `rules` for one meter's rows (see frames.inputs()).

    The rows of a batch are followed as they come, in order among themselves, and
    rows before the newest one followed are late. With `reorder` (and a
    watermark) rows wait in a list of their own until the watermark has passed
    them, and are then followed in order of time: rows that come out of order
    within the watermark give what ordered rows give. A timer of event time is
    set for the first that waits. Rows without a time don't wait.

    A meter that is silent for ttl is forgotten: by a timer of event time with a
    watermark, else by the states' own time to live.
    """

    def __init__(self, rules, columns: str, output: list[str], watermark: bool, reorder: bool, ttl_ms: int | None) -> None:
        self.rules, self.columns, self.output, self.watermark, self.reorder, self.ttl_ms = rules, columns, output, watermark, reorder, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        live = None if self.watermark else self.ttl_ms
        self.handle = handle
        self.values = {n: handle.getValueState(n, schema, live) for n, schema in VALUES.items()}
        self.lists = {n: handle.getListState(n, f"x {kind}", live) for n, kind in LISTS.items()}
        self.waiting = handle.getListState("waiting", self.columns, live)

    def _load(self) -> dict:
        if not self.values["shown"].exists():
            return self.rules.fresh()
        values = {n: v.get() for n, v in self.values.items() if v.exists()}
        return from_typed(values, {n: [x[0] for x in s.get()] for n, s in self.lists.items()})

    def _store(self, state: dict) -> None:
        values, lists = to_typed(state)
        for n, v in values.items():
            self.values[n].update(v)
        for n, items in lists.items():
            if items:
                self.lists[n].put([(x,) for x in items])
            else:
                self.lists[n].clear()

    def _follow(self, part: pd.DataFrame) -> pd.DataFrame:
        state = self._load()
        out = self.rules.advance(part, state)
        self._store(state)
        return out[self.output]

    def _release(self, rows: pd.DataFrame, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Follow the rows that the watermark has passed; the others wait, and a timer is set for the first of them."""
        ready = rows["us"].isna() | (rows["us"] <= watermark_ms * 1000)
        later, now = rows[~ready], rows[ready]
        if len(now):
            yield self._follow(now)
        if len(later):
            whole = [c.split()[1] in ("int", "bigint") for c in self.columns.split(", ")]
            plain = later.astype(object).where(later.notna(), None)
            self.waiting.put([tuple(int(x) if i and x is not None else x for x, i in zip(r, whole)) for r in plain.itertuples(index=False)])
            self.handle.registerTimer(int(later["us"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        self._expires(rows, watermark_ms)

    def _expires(self, rows: pd.DataFrame, watermark_ms: int) -> None:
        if self.watermark and self.ttl_ms and rows["us"].notna().any():
            self.handle.registerTimer(max(int(rows["us"].max()) // 1000, watermark_ms) + self.ttl_ms)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=_names(self.columns))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[_names(self.columns)]
        watermark = timerValues.getCurrentWatermarkInMs() if self.watermark else 0
        if not self.reorder:
            yield self._follow(new)
            self._expires(new, watermark)
            return
        held = self._held()
        yield from self._release(pd.concat([held, new], ignore_index=True) if len(held) else new, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        if len(held):
            yield from self._release(held, watermark)
        elif self.ttl_ms and self.values["shown"].exists():
            last = self._load()["last"]
            if last is not None and last // 1000 + self.ttl_ms <= watermark:
                for state in (*self.values.values(), *self.lists.values(), self.waiting):
                    state.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        state = json.loads(initialState["state"].iloc[0])
        self._store(state)
        if self.watermark and self.ttl_ms and state["last"] is not None:
            self.handle.registerTimer(max(state["last"] // 1000, timerValues.getCurrentWatermarkInMs()) + self.ttl_ms)

    def close(self) -> None:
        pass


def followed(rows: DataFrame, rules, schema: str, ttl: str | None = None, watermark: str | None = None, start: DataFrame | None = None, reorder: bool = False) -> DataFrame:
    """What rules say of each meter's rows of a stream. Rows without a meter aren't followed. start (serial, state) is where meters begin, as of frames.snapshot().

    Such states need the RocksDB store, which is chosen for the session here.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "at")
    output = [c.split()[0] for c in schema.split(", ")]
    if reorder and not watermark:
        raise ValueError("rows are put in order up to a watermark")
    processor = Meter(rules, columns, output, bool(watermark), reorder, int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None)
    rows = rows.where(F.col("serial").isNotNull())
    if watermark:
        rows = rows.withWatermark("at", watermark)
    initial = None if start is None else start.select("serial", "state").groupBy("serial")
    return rows.groupBy("serial").transformWithStateInPandas(processor, schema, "append", "EventTime" if watermark else "ProcessingTime" if ttl else "None", initial)
