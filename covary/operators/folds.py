"""Ordered folds: state carried from row to row of a group, one implementation for all path-dependent operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold(df: DataFrame, keys: list[str], order: str, start: Callable[[], object], step: Callable, inputs: list[str], outputs: list[tuple[str, T.DataType]]) -> DataFrame:
    """df with columns that step(state, *inputs) -> (state, outputs) gives row by row, in order, per group.

    Groups are exchanged by key once (an exchange that is there already is used); a group is one series and fits a task.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in outputs]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        state, made = start(), []
        for values in zip(*[frame[c].tolist() for c in inputs], strict=True):
            state, out = step(state, *values)
            made.append(out)
        for i, (name, _) in enumerate(outputs):
            frame[name] = [m[i] for m in made]
        return frame

    return df.groupBy(*keys).applyInPandas(run, schema)


def missing(v) -> bool:
    return v is None or v != v


@dataclass(frozen=True)
class Rules:
    """Entry and exit levels by regime, holding times in rows, and the stop as a multiple of the entry level."""

    entry: float = 1.5
    exit: float = 0.5
    entry_volatile: float = 2.0
    exit_volatile: float = 0.3
    min_hold: int = 3
    max_hold: int = 30
    stop: float = 2.0


def signal_step(rules: Rules):
    """State (position, row of entry, row); gives the position -1, 0 or 1."""

    def step(state, z, regime):
        pos, since, row = state
        if not missing(z) and not missing(regime):
            calm = regime != 0
            entry, leave = (rules.entry_volatile, rules.exit_volatile) if regime == 1 else (rules.entry, rules.exit)
            held = row - since
            if pos:
                broken = -pos * z > entry * rules.stop or held > rules.max_hold
                done = calm and held >= rules.min_hold and abs(z) < leave
                pos = 0 if broken or done else pos
            elif calm and abs(z) > entry:
                pos, since = (-1 if z > 0 else 1), row
        return (pos, since, row + 1), (pos,)

    return step


def gate_step(grace: int):
    """Health gate: state (unhealthy rows, position). An unhealthy pair keeps its position for the grace period, then is flat."""

    def step(state, signal, healthy):
        sick, pos = state
        if healthy is None or healthy:
            sick, pos = 0, signal
        else:
            sick += 1
            pos = 0 if pos == 0 or sick > grace else pos
        return (sick, pos), (pos,)

    return step


def kalman_step(damp: bool = True, drift: float = 1e-4, noise: float = 1e-3, walk: float = 1e-4):
    """Adaptive hedge ratio: state (weight, variance, last 50 innovations); gives innovation, its deviation and the weight after."""
    scale = {0: 5.0, 1: 2.0, 2: 1.0}

    def step(state, y, x, regime):
        w, var, seen = state
        if w is None:
            w = y / x if x else 0.0
            return (w, drift, seen), (0.0, noise**0.5, w)
        before = var + walk * scale[int(regime)]
        e = y - w * x
        r = before * x * x + noise
        seen.append(e)
        gain = before * x / r
        if damp and len(seen) >= 10:
            past = np.array(seen)
            middle = np.median(past)
            spread = np.median(np.abs(past - middle))
            if spread > 1e-6 and abs(e - middle) > 3 * spread:
                gain *= 0.05
        w += gain * e
        return (w, before - gain * x * before, seen), (e, float(r**0.5), w)

    return step


def kalman(df: DataFrame, damp: bool = True, keys: list[str] | None = None) -> DataFrame:
    """df with innovation (the spread), innovation_sd and hedge."""
    out = [("innovation", T.DoubleType()), ("innovation_sd", T.DoubleType()), ("hedge", T.DoubleType())]
    return fold(df, keys or ["pair"], "t", lambda: (None, 0.0, deque(maxlen=50)), kalman_step(damp), ["y", "x", "regime"], out)


def signals(df: DataFrame, rules: Rules | None = None, keys: list[str] | None = None, z: str = "z", regime: str = "regime", name: str = "signal") -> DataFrame:
    return fold(df, keys or ["pair"], "t", lambda: (0, 0, 0), signal_step(rules or Rules()), [z, regime], [(name, T.IntegerType())])


def health_gate(df: DataFrame, grace: int = 5, keys: list[str] | None = None, signal: str = "signal", healthy: str = "healthy") -> DataFrame:
    return fold(df, keys or ["pair"], "t", lambda: (0, 0), gate_step(grace), [signal, healthy], [("gated", T.IntegerType())])


def sweep_signals(df: DataFrame, grid: list[tuple[int, Rules]], keys: list[str] | None = None) -> DataFrame:
    """(config_id, keys.., t, signal) for every setting: a pair's rows are exchanged once, the settings run within its group."""
    keys = keys or ["pair"]
    kept = [*keys, "t"]
    schema = T.StructType([T.StructField("config_id", T.IntegerType()), *[df.schema[c] for c in kept], T.StructField("signal", T.IntegerType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t", kind="stable")
        z, regime, out = frame["z"].tolist(), frame["regime"].tolist(), []
        for number, rules in grid:
            step, state, made = signal_step(rules), (0, 0, 0), []
            for a, b in zip(z, regime, strict=True):
                state, (pos,) = step(state, a, b)
                made.append(pos)
            out.append(frame[kept].assign(config_id=number, signal=made))
        return pd.concat(out)[schema.names]

    return df.select(*kept, "z", "regime").groupBy(*keys).applyInPandas(run, schema)
