"""The signal machine and the health gate as ordered folds inside the JVM: no Python worker runs.

A group's rows become one sorted array, over which a higher-order fold carries the state; the array then turns back into rows. Like
the grouped folds in Python it needs a group to fit a task, and it costs one exchange by key, or none where the rows are there already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.operators.folds import Rules


def fold(df: DataFrame, keys: list[str], order: str, start: dict[str, Column], step: Callable, name: str, result: str) -> DataFrame:
    """df with a column: step(state, row) gives the next state as a dict of columns by name, and `result` of each row's state is the column's value."""
    rest = [c for c in df.columns if c not in (order, *keys)]
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("_rows"))
    kind = "array<int>"
    first = F.struct(*[c.cast("int").alias(k) for k, c in start.items()], F.array().cast(kind).alias("_out"))

    def merge(acc, row):
        then = {k: v.cast("int") for k, v in step(acc, row).items()}
        return F.struct(*[then[k].alias(k) for k in start], F.concat(acc["_out"], F.array(then[result])).alias("_out"))

    made = rows.select(*keys, "_rows", F.aggregate("_rows", first, merge, lambda acc: acc["_out"]).alias("_out"))
    each = made.select(*keys, F.explode(F.arrays_zip("_rows", "_out")).alias("_v"))
    by_name = {c: F.col(f"_v._rows.{c}").alias(c) for c in (order, *rest)} | {k: F.col(k) for k in keys}
    return each.select(*[by_name[c] for c in df.columns], F.col("_v._out").alias(name))


def signals(df: DataFrame, rules: Rules | None = None, keys: list[str] | None = None, z: str = "z", regime: str = "regime", name: str = "signal") -> DataFrame:
    """As folds.signals."""
    r = rules or Rules()

    def step(acc, row):
        pos, since, at, v, g = acc["pos"], acc["since"], acc["row"], row[z], row[regime]
        there, calm, shaky = v.isNotNull() & ~F.isnan(v) & g.isNotNull(), g != 0, g == 1
        entry = F.when(shaky, r.entry_volatile).otherwise(r.entry)
        leave = F.when(shaky, r.exit_volatile).otherwise(r.exit)
        held = at - since
        left = (-pos * v > entry * r.stop) | (held > r.max_hold) | (calm & (held >= r.min_hold) & (F.abs(v) < leave))
        enters = there & (pos == 0) & calm & (F.abs(v) > entry)
        then = F.when(enters, F.when(v > 0, -1).otherwise(1)).when(there & (pos != 0) & left, 0).otherwise(pos)
        return {"pos": then, "since": F.when(enters, at).otherwise(since), "row": at + 1}

    zero = F.lit(0)
    return fold(df, keys or ["pair"], "t", {"pos": zero, "since": zero, "row": zero}, step, name, "pos")


def health_gate(df: DataFrame, grace: int = 5, keys: list[str] | None = None, signal: str = "signal", healthy: str = "healthy") -> DataFrame:
    """As folds.health_gate."""

    def step(acc, row):
        well = F.coalesce(row[healthy], F.lit(True))
        sick = F.when(well, 0).otherwise(acc["sick"] + 1)
        kept = F.when((acc["pos"] == 0) | (acc["sick"] + 1 > grace), 0).otherwise(acc["pos"])
        return {"sick": sick, "pos": F.when(well, row[signal]).otherwise(kept)}

    zero = F.lit(0)
    return fold(df, keys or ["pair"], "t", {"sick": zero, "pos": zero}, step, "gated", "pos")
