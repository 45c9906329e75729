"""Debounced states, detections and gates over a meter's ordered frames.

A meter's frames are cut into chunks of equally many, which are worked on in
parallel: windows stay within a chunk, and what a chunk is handed by those before
it comes from one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wavejobs.functions.columns import micros
from wavejobs.operators.order import CHUNK, before, chunked, handed_on, looking_back, so_far, within

NORMAL = "normal_acoustic_state"
EMPTY = "empty_or_lost_acoustic_path_candidate"
WEAK = "weak_signal_or_air_candidate"
SATURATED = "adc_saturation_or_bias_issue"


def raw_state(limits: dict[str, dict[str, float]], label: Column, reasons: Column) -> tuple[Column, Column]:
    """(state, reasons) of a frame: clipping first, then how many of four features are under their p01, then the label."""
    low = F.col("low_clip_ratio") > max(limits["low_clip_ratio"]["p99"] + 0.02, 0.08)
    high = F.col("high_clip_ratio") > max(limits["high_clip_ratio"]["p99"] + 0.005, 0.005)
    clipped = F.array_compact(F.array(F.when(low, F.lit("low_side_clipping_high")), F.when(high, F.lit("high_side_clipping_high"))))
    checks = (("gate_rms_v", "gate_energy_low"), ("peak_abs_gate_v", "peak_low"), ("snr_db", "snr_low"), ("template_corr", "template_match_low"))
    weak = F.array_compact(F.array(*[F.when(F.col(f) < limits[f]["p01"], F.lit(name)) for f, name in checks]))
    state = (
        F.when(F.size(clipped) > 0, SATURATED)
        .when(F.size(weak) >= 3, EMPTY)
        .when(F.size(weak) >= 2, WEAK)
        .when(label == "anomaly", "waveform_anomaly")
        .when(label == "suspect", "signal_quality_suspect")
        .otherwise(NORMAL)
    )
    why = F.when(F.size(clipped) > 0, clipped).when(F.size(weak) >= 2, weak).when(label.isin("anomaly", "suspect"), F.slice(reasons, 1, 3)).otherwise(F.array().cast("array<string>"))
    return state, why


def debounce(df: DataFrame, raw: str, key: str = "serial", ts: str = "ts", tie: str = "id", enter: int = 3, recover: int = 5, normal: str = NORMAL, chunk: int = CHUNK) -> DataFrame:
    """Adds state: a new raw state counts after `enter` equal frames in a row, normal after `recover`; a meter starts as normal.

    Also adds run (its number of equal raw frames so far), status, entered_at
    and frames_in_state. A null raw state is a run of its own and changes nothing.

    The rule is an automaton, and chunks of a meter's frames compose: a chunk's
    summary says what it makes of any state it is entered in, namely where its
    last run began, which states its own runs signal, and when the run that it
    was entered in the middle of signals.
    """
    need = lambda c: F.when(c == normal, recover).otherwise(enter)
    place = lambda when: F.when(when, F.struct(F.col("__index").alias("i"), F.col(ts).alias("at")))
    w = within(key)
    rows = looking_back(chunked(df, key, ts, tie, chunk), key, 2, chunk, __new=lambda w: F.coalesce(F.col(raw) != F.lag(raw).over(w), F.lit(True)))
    rows = rows.withColumn("__start", F.last(F.when(F.col("__new"), F.col("__index")), True).over(so_far(w)))
    own = rows.withColumn("__signal", F.when(F.col("__index") - F.col("__start") + 1 >= need(F.col(raw)), F.col(raw)))
    own = own.withColumn("__own", F.last("__signal", True).over(so_far(w)))
    own = own.withColumn("__turn", F.col("__own") != F.lag("__own").over(w))

    signals = F.when(F.col("__signal").isNotNull(), F.col("__index"))
    early = F.when(F.col("__index") % chunk < max(enter, recover), F.struct(F.col("__index").alias("i"), F.col(ts).alias("at")))
    summary = [
        F.max("__start").alias("last_start"), F.min("__index").alias("first"), (F.coalesce(F.min("__start"), F.max("__index") + 1) - F.min("__index")).alias("lead"), F.min_by(raw, "__index").alias("lead_raw"),
        F.max_by("__signal", signals).alias("signal"), F.min_by("__signal", signals).alias("first_signal"), F.min_by(place(F.lit(True)), signals).alias("first_at"),
        F.max_by(place(F.lit(True)), F.when(F.col("__turn"), F.col("__index"))).alias("turn"), F.collect_list(early).alias("early"), F.min_by(place(F.lit(True)), "__index").alias("begin"),
    ]

    def carry(chunks: DataFrame, w: WindowSpec) -> DataFrame:
        known = chunks.withColumn("__start_before", F.last("last_start", True).over(before(w)))
        fires = F.col("__start_before") + need(F.col("lead_raw")) - 1
        fires = F.when((F.col("lead") > 0) & (fires < F.col("first") + F.col("lead")), F.greatest(fires, F.col("first")))
        known = known.withColumn("fires", fires).withColumn("lead_signal", F.when(F.col("fires").isNotNull(), F.col("lead_raw")))
        known = known.withColumn("__state_before", F.coalesce(F.last(F.coalesce("signal", "lead_signal"), True).over(before(w)), F.lit(normal)))
        after_lead = F.coalesce("lead_signal", "__state_before")
        lead_at = F.get(F.filter("early", lambda x: x["i"] == F.col("fires")), F.lit(0))
        turn = F.coalesce("turn", F.when(F.col("first_signal") != after_lead, F.col("first_at")), F.when(F.col("lead_signal") != F.col("__state_before"), lead_at))
        begin = F.when(F.col("__chunk") == 0, F.col("begin"))
        return known.withColumn("turned", F.coalesce(turn, begin)).withColumn("__turn_before", F.last("turned", True).over(before(w))).drop("fires", "lead_signal", "turned")

    held = handed_on(own, key, summary, carry).withColumn("run", (F.col("__index") - F.coalesce("__start", "__start_before") + 1).cast("int"))
    held = held.withColumn("state", F.coalesce(F.last(F.when(F.col("run") >= need(F.col(raw)), F.col(raw)), True).over(so_far(w)), F.col("__state_before")))
    held = held.withColumn("__before", F.when(F.col("__index") > 0, F.coalesce(F.lag("state").over(w), F.col("__state_before"))))
    moved = F.col("state") != F.coalesce("__before", F.col("state"))
    status = (
        F.when(F.col("__before").isNull(), F.when(F.col(raw) == F.col("state"), "initialized").otherwise("startup_waiting_for_confirmation"))
        .when(moved, "confirmed")
        .when(F.col(raw) == F.col("state"), "stable")
        .otherwise("pending")
    )
    held = held.withColumn("status", status).withColumn("transitioned", moved & F.col("__before").isNotNull())
    held = held.withColumn("__stay", F.coalesce(F.last(place(F.col("transitioned") | (F.col("__index") == 0)), True).over(so_far(w)), F.col("__turn_before")))
    return held.select(*df.columns, "run", "state", "status", "transitioned", F.col("__before").alias("previous_state"), F.col("__stay.at").alias("entered_at"), (F.col("__index") - F.col("__stay.i") + 1).cast("int").alias("frames_in_state"))


def transitions(df: DataFrame, key: str = "serial", ts: str = "ts") -> DataFrame:
    """The event feed of debounce(): one row per confirmed change."""
    return df.where("transitioned").select(F.lit("pipe_state_transition").alias("event"), key, ts, F.col("previous_state").alias("from_state"), F.col("state").alias("to_state"))


def _switch(w: WindowSpec, constant: str, swaps: Column, start: Column) -> Column:
    """A two-state switch in a window: the last constant, turned over once for each swap since; start is what it stands at before."""
    since = F.last(F.when(F.col(constant).isNotNull(), F.struct(F.col(constant).alias("v"), swaps.alias("n"))), True).over(w)
    return F.coalesce(since["v"], start) != ((swaps - F.coalesce(since["n"], F.lit(0))) % 2 == 1)


def latch(df: DataFrame, name: str, on: Column, off: Column, key: str = "serial", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a switch to chunked rows: on turns it on where it is off, off turns it off where it is on; it starts off.

    A row is one of four maps of the switch: to on, to off, turned over (where
    both hold), or as it was. Maps compose, so a chunk is one of them too.
    """
    on, off = F.coalesce(on, F.lit(False)), F.coalesce(off, F.lit(False))
    w = within(key, *by)
    rows = df.withColumn("__constant", F.when(on & ~off, True).when(off & ~on, False)).withColumn("__swap", (on & off).cast("int"))
    rows = rows.withColumn("__swaps", F.sum("__swap").over(so_far(w))).withColumn("__order", F.row_number().over(w))
    end = F.max_by(F.struct(F.col("__constant").alias("v"), F.col("__swaps").alias("n")), F.when(F.col("__constant").isNotNull(), F.col("__order"))).alias("end")
    summary = [end, F.sum("__swap").alias("swapped")]

    def carry(chunks: DataFrame, w: WindowSpec) -> DataFrame:
        maps = chunks.withColumn("constant", F.col("end.v") != ((F.col("swapped") - F.col("end.n")) % 2 == 1)).withColumn("odd", F.when(F.col("constant").isNull(), F.col("swapped") % 2).otherwise(0))
        maps = maps.withColumn("odds", F.sum("odd").over(so_far(w)))
        maps = maps.withColumn("after", _switch(so_far(w), "constant", F.col("odds"), F.lit(False)))
        return maps.withColumn("__on_before", F.coalesce(F.lag("after").over(w), F.lit(False))).drop("constant", "odd", "odds", "after")

    held = handed_on(rows, key, summary, carry)
    return held.withColumn(name, _switch(so_far(w), "__constant", F.col("__swaps"), F.col("__on_before"))).drop("__constant", "__swap", "__swaps", "__order", "__on_before")


def empty_pipe(df: DataFrame, state: str = "state", key: str = "serial", ts: str = "ts", tie: str = "id", of: int = 5, on: int = 3, off: int = 1, bad: tuple[str, ...] = (EMPTY, WEAK), chunk: int = CHUNK) -> DataFrame:
    """Adds bad_count and empty_pipe: on with `on` bad states of the last `of`, off with `off` or fewer. If off isn't below on, a count that is both turns it over at every frame."""
    hit = F.coalesce(F.col(state).isin(*bad), F.lit(False)).cast("int")
    counted = looking_back(chunked(df, key, ts, tie, chunk), key, of, chunk, bad_count=lambda w: F.sum(hit).over(w.rowsBetween(1 - of, 0)))
    return latch(counted, "empty_pipe", F.col("bad_count") >= on, F.col("bad_count") <= off, key).select(*df.columns, "bad_count", "empty_pipe")


def air_bubble(df: DataFrame, sigma: float, corr: str = "template_corr", key: str = "serial", ts: str = "ts", tie: str = "id", n: int = 20, times: float = 5.0, recovery: float = 0.5, chunk: int = CHUNK) -> DataFrame:
    """Adds corr_std (sample deviation of the last n known correlations, when there are n) and air_bubble: on from times * sigma, off below recovery of that.

    A frame without a correlation has the deviation of those before it, as it has in the live state.
    """
    if recovery > 1:
        raise ValueError("the recovery factor can't exceed 1")
    last = lambda w: Window.partitionBy(key, "__chunk").orderBy("__index").rangeBetween(1 - n, 0)
    known = F.col(corr).isNotNull()
    full = looking_back(chunked(df, key, ts, tie, chunk, counted=known), key, n, chunk, corr_std=lambda w: F.when(F.count(corr).over(last(w)) == n, F.stddev_samp(corr).over(last(w))))
    return latch(full, "air_bubble", F.col("corr_std") >= times * sigma, F.col("corr_std") < times * sigma * recovery, key, (ts, tie)).select(*df.columns, "corr_std", "air_bubble")


def condition(*flags: tuple[str, str]) -> Column:
    """Active conditions in order, joined by +, or normal. flags: (column, name)."""
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in flags])))
    return F.when(F.size(names) > 0, F.array_join(names, "+")).otherwise("normal")


def detections(df: DataFrame, flag: str, detected: str, cleared: str, key: str = "serial", ts: str = "ts", tie: str = "id", chunk: int = CHUNK) -> DataFrame:
    """One event for each switch of a flag; a clearing one says since when."""
    marked = looking_back(chunked(df, key, ts, tie, chunk), key, 2, chunk, __was=lambda w: F.coalesce(F.lag(flag).over(w), F.lit(False)))
    marked = marked.where(F.col(flag) != F.col("__was"))  # from here on a row per switch
    risen = F.when(F.col(flag), F.col(ts))
    carry = lambda chunks, w: chunks.withColumn("__risen", F.last("risen", True).over(before(w)))
    switched = handed_on(marked, key, [F.max_by(risen, F.when(F.col(flag), F.col("__index"))).alias("risen")], carry)
    since = F.coalesce(F.last(risen, True).over(so_far(within(key))), F.col("__risen"))
    return switched.select(F.when(F.col(flag), detected).otherwise(cleared).alias("event"), key, ts, F.when(~F.col(flag), since).alias("since"))


def stability(df: DataFrame, gate: str, key: str = "serial", ts: str = "ts", tie: str = "id", n: int = 64, least: float = 0.6, chunk: int = CHUNK) -> DataFrame:
    """Adds stable_ratio (share of gate in the last n) and train: gate holds, the window is full and the ratio is at least `least`."""
    last = lambda w: w.rowsBetween(1 - n, 0)
    rated = looking_back(chunked(df, key, ts, tie, chunk), key, n, chunk, stable_ratio=lambda w: F.avg(F.col(gate).cast("double")).over(last(w)), __full=lambda w: F.count(F.lit(1)).over(last(w)) == n)
    return rated.select(*df.columns, "stable_ratio", (F.col("__full") & F.col(gate) & (F.col("stable_ratio") >= least)).alias("train"))


def gaps(df: DataFrame, key: str = "serial", ts: str = "ts", tie: str = "id", after_ms: float = 20_000, chunk: int = CHUNK) -> DataFrame:
    """Adds source_gap_ms since the meter's frame before, and data_gap."""
    lagged = looking_back(chunked(df, key, ts, tie, chunk), key, 2, chunk, __earlier=lambda w: F.lag(ts).over(w))
    ms = F.coalesce(F.greatest((micros(ts) - micros("__earlier")) / 1000.0, F.lit(0.0)), F.lit(0.0))
    return lagged.select(*df.columns, ms.alias("source_gap_ms"), (ms > after_ms).alias("data_gap"))
