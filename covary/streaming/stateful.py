"""Path-dependent operators on streams: a pair's state lives in typed state variables and goes on from batch to batch and over restarts.

The steps are those of the batch folds. Rows of a batch are taken in order; rows that a pair has had already, or that come behind
its latest row, are left out, so a replayed file changes nothing. With `idle`, a pair whose clock has not moved for that long is
closed: an event-time timer writes a last flat row and its state goes.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from covary.operators.folds import Rules, gate_step, kalman_step, missing, signal_step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MAD_ROWS = 50


class Ordered(StatefulProcessor):
    """A fold over a pair's rows in order of t. Subclasses open, load, step and save their state; names: the columns a step gives."""

    names: tuple[str, ...] = ()
    flat: tuple = ()

    def __init__(self, time: str | None = None, idle_ms: int | None = None):
        self.time, self.idle_ms = time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "t long, ts long")
        self.open(handle)

    def _frame(self, key, t, outs) -> pd.DataFrame:
        out = pd.DataFrame({"pair": [key[0]] * len(t), "t": t})
        for i, name in enumerate(self.names):
            out[name] = [o[i] for o in outs]
        return out

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values("t", kind="stable")
        last, ts = self.clock.get() if self.clock.exists() else (-1, 0)
        frame = frame[frame["t"] > last].drop_duplicates("t")
        if not len(frame):
            return
        state, outs = self.load(), []
        for row in frame.to_dict("records"):
            state, out = self.step(state, row)
            outs.append(out)
        self.save(state)
        if self.idle_ms:
            self.handle.deleteTimer(ts + self.idle_ms)
            ts = int(pd.Timestamp(frame[self.time].iloc[-1]).timestamp() * 1000)
            self.handle.registerTimer(ts + self.idle_ms)
        self.clock.update((int(frame["t"].iloc[-1]), ts))
        yield self._frame(key, frame["t"].to_numpy(), outs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, _ = self.clock.get()
        self.drop()
        self.clock.clear()
        yield self._frame(key, [last + 1], [self.flat])

    def close(self) -> None:
        pass


class System(Ordered):
    """The adaptive hedge, the z-score of its innovations and the signal machine of a pair, from (y, x, regime)."""

    names = ("innovation", "hedge", "z", "signal")
    form = "pair string, t long, innovation double, hedge double, z double, signal int"
    flat = (None, None, None, 0)

    def __init__(self, rules: Rules | None = None, z_rows: int = 20, damp: bool = True, **idle):
        super().__init__(**idle)
        self.z_rows, self.kalman, self.machine = z_rows, kalman_step(damp), signal_step(rules or Rules())

    def open(self, handle) -> None:
        self.filter = handle.getValueState("filter", "weight double, variance double")
        self.past = handle.getListState("past", "e double")
        self.spreads = handle.getListState("spreads", "s double")
        self.held = handle.getValueState("held", "position int, since int, row int")

    def load(self):
        if not self.filter.exists():
            return (None, 0.0, deque(maxlen=MAD_ROWS)), deque(maxlen=self.z_rows), (0, 0, 0)
        w, var = self.filter.get()
        past, spreads = (deque((v for (v,) in s.get()), n) for s, n in ((self.past, MAD_ROWS), (self.spreads, self.z_rows)))
        return (w, var, past), spreads, tuple(self.held.get())

    def step(self, state, row):
        filtered, spreads, held = state
        filtered, (e, _, w) = self.kalman(filtered, row["y"], row["x"], row["regime"])
        spreads.append(e)
        z = None
        if len(spreads) == self.z_rows:
            s = np.array(spreads)
            z = float(np.round((e - s.mean()) / (s.std(ddof=1) + 1e-8), 6))
        held, (signal,) = self.machine(held, z, row["regime"])
        return (filtered, spreads, held), (float(e), float(w), z, signal)

    def save(self, state) -> None:
        (w, var, past), spreads, held = state
        self.filter.update((float(w), float(var)))
        for variable, values in ((self.past, past), (self.spreads, spreads)):
            if values:
                variable.put([(float(v),) for v in values])
        self.held.update(tuple(map(int, held)))

    def drop(self) -> None:
        for variable in (self.filter, self.past, self.spreads, self.held):
            variable.clear()


class Gate(Ordered):
    """The health gate of a pair, from (signal, healthy)."""

    names = ("gated", "sick")
    form = "pair string, t long, gated int, sick int"
    flat = (0, 0)

    def __init__(self, grace: int = 5, **idle):
        super().__init__(**idle)
        self.gate = gate_step(grace)

    def open(self, handle) -> None:
        self.held = handle.getValueState("held", "sick int, position int")

    def load(self):
        return tuple(self.held.get()) if self.held.exists() else (0, 0)

    def step(self, state, row):
        healthy = row["healthy"]
        state, (gated,) = self.gate(state, int(row["signal"]), None if missing(healthy) else bool(healthy))
        return state, (int(gated), int(state[0]))

    def save(self, state) -> None:
        self.held.update(tuple(map(int, state)))

    def drop(self) -> None:
        self.held.clear()


def stateful(stream: DataFrame, processor: Ordered, late: str = "1 hour") -> DataFrame:
    """(pair, t, ..) of the processor's names, appended as rows come in; needs the state store PROVIDER names."""
    if processor.idle_ms:
        return stream.withWatermark(processor.time, late).groupBy("pair").transformWithStateInPandas(processor, processor.form, "append", "EventTime")
    return stream.groupBy("pair").transformWithStateInPandas(processor, processor.form, "append", "None")
