"""Order intents of pairs: what to buy and sell of both legs, given signal, hedge, confidence, prices and what is held.

Positions are built up in steps and closed at once, so what is held at a row is what the intents before it made: an ordered
fold over the pair's rows carries both legs' quantities and with them the room that is left below the pair's share of the account.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covary.operators import folds


@dataclass(frozen=True)
class Account:
    """value: of the account; share: of it that a pair may hold at most; full: part of that share from which nothing is added; step: part of it added at once; floor: least value of an order."""

    value: float = 10_000_000.0
    share: float = 0.2
    full: float = 0.95
    step: float = 0.5
    floor: float = 100.0


def intent_step(account: Account):
    """State (quantity of y, of x); gives action, order of y and of x, and both quantities after it."""

    def step(state, signal, y, x, hedge, confidence):
        qy, qx = state
        if folds.missing(signal) or folds.missing(y) or folds.missing(x):
            return state, ("none", 0, 0, qy, qx)
        if signal == 0:
            return (0, 0), ("exit" if qy or qx else "flat", -qy, -qx, 0, 0)
        held = (abs(qy * y) + abs(qx * x)) / account.value
        if held >= account.share * account.full:
            return state, ("full", 0, 0, qy, qx)
        strength = max(min(0.0 if folds.missing(confidence) else confidence, 1.0), 0.5)
        value = account.value * min(account.share * account.step * strength, account.share - held)
        if value < account.floor:
            return state, ("small", 0, 0, qy, qx)
        side = 1 if signal > 0 else -1
        units = int(value / y)
        oy, ox = side * units, -side * int(units * (0.0 if folds.missing(hedge) else hedge))
        return (qy + oy, qx + ox), ("add long" if side > 0 else "add short", oy, ox, qy + oy, qx + ox)

    return step


NAMES = [("action", T.StringType()), ("order_y", T.LongType()), ("order_x", T.LongType()), ("qty_y", T.LongType()), ("qty_x", T.LongType())]


def intents(df: DataFrame, account: Account | None = None) -> DataFrame:
    """df (pair, t, signal, y, x, hedge, confidence) with action, order_y, order_x, qty_y and qty_x."""
    return folds.fold(df, ["pair"], "t", lambda: (0, 0), intent_step(account or Account()), ["signal", "y", "x", "hedge", "confidence"], NAMES)


def confidence(z: Column, entry: float = 1.5) -> Column:
    return F.abs(z) / entry


def held_value(qty_y: str = "qty_y", y: str = "y", qty_x: str = "qty_x", x: str = "x") -> Column:
    return F.abs(F.col(qty_y) * F.col(y)) + F.abs(F.col(qty_x) * F.col(x))


def intents_sql(name: str, source: str, a: Account) -> str:
    """A recursive walk over source (pair, t, signal, y, x, hedge, confidence)."""
    held = f"(abs(g.qy * s.y) + abs(g.qx * s.x)) / {a.value}"
    value = f"{a.value} * least({a.share * a.step} * greatest(least(coalesce(s.confidence, 0.0), 1.0), 0.5), {a.share} - {held})"
    action = f"CASE WHEN s.signal = 0 THEN CASE WHEN g.qy <> 0 OR g.qx <> 0 THEN 'exit' ELSE 'flat' END WHEN {held} >= {a.share * a.full} THEN 'full' WHEN {value} < {a.floor} THEN 'small' WHEN s.signal > 0 THEN 'add long' ELSE 'add short' END"
    return f"""{name}(pair, t, action, oy, ox, qy, qx) AS (SELECT DISTINCT pair, -1, '', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM {source}
  UNION ALL SELECT pair, t, action, oy, ox, qy + oy, qx + ox FROM (SELECT *, CASE WHEN action = 'exit' THEN -qx WHEN starts_with(action, 'add') THEN -signal * trunc(abs(oy) * coalesce(hedge, 0.0))::BIGINT ELSE 0 END AS ox FROM (
    SELECT s.pair, s.t, s.signal, s.hedge, g.qy, g.qx, {action} AS action, CASE WHEN {action} = 'exit' THEN -g.qy WHEN starts_with({action}, 'add') THEN s.signal * trunc({value} / s.y)::BIGINT ELSE 0 END AS oy
    FROM {name} g JOIN {source} s ON s.pair = g.pair AND s.t = g.t + 1)))"""
