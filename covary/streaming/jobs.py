"""Structured Streaming over the event and bar streams: bars, keyed folds, monitors, sessions and a deduplicating sink."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from covary.operators import monitor as mo
from covary.operators.folds import Rules, kalman_step, signal_step

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(ticker, start, close, mean, n): a tumbling bar per ticker; ticks behind the watermark are dropped."""
    w = F.window("ts", width)
    return ticks.withWatermark("ts", late).groupBy(F.col("event_type").alias("ticker"), w.alias("w")).agg(F.max_by("value", "ts").alias("close"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select("ticker", F.col("w.start").alias("start"), "close", "mean", "n")


def sliding_monitor(log: DataFrame, width: str = "1 day", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, measures.., alerts) of every sliding window of a log (ts, date, signal, z, regime); rows behind the watermark count in no window and in the query's progress."""
    got = log.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w")).agg(*mo.measures())
    got = got.select(F.col("w.start").cast("date").alias("start"), "*").drop("w").withColumn("per_day", mo.per_day())
    return got.withColumn("alerts", mo.alerts())


def late_groups(progress: list) -> int:
    """What came too late, of a query's progress reports: rows of one task and window, which are summed before they are dropped, count as one."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(ticker, start, end, n): runs of activity without a gap longer than `gap`."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(F.col("event_type").alias("ticker"), w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("ticker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(log: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The log without rows that repeat the keys within the watermark; for an append sink."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def stateful_fold(stream: DataFrame, key: str, order: str, start, step, inputs: list[str], outputs: str, names: list[str]) -> DataFrame:
    """The batch fold's step over a stream: the state of each key is kept as bytes between batches."""
    import pickle

    kind = dict(stream.dtypes)

    def run(of, frames, held: GroupState):
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        state = pickle.loads(held.get[0]) if held.exists else start()
        made = []
        for values in zip(*[frame[c].tolist() for c in inputs], strict=True):
            state, out = step(state, *values)
            made.append(out)
        held.update((pickle.dumps(state),))
        out = pd.DataFrame({key: of[0], order: frame[order].to_numpy()})
        for i, name in enumerate(names):
            out[name] = [m[i] for m in made]
        yield out

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {order} {kind[order]}, {outputs}", "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_kalman(panel: DataFrame) -> DataFrame:
    """(pair, t, innovation, innovation_sd, hedge): the batch operator's values, row for row."""
    return stateful_fold(panel, "pair", "t", lambda: (None, 0.0, deque(maxlen=50)), kalman_step(), ["y", "x", "regime"], "innovation double, innovation_sd double, hedge double", ["innovation", "innovation_sd", "hedge"])


def stream_signals(scored: DataFrame, rules: Rules | None = None) -> DataFrame:
    return stateful_fold(scored, "pair", "t", lambda: (0, 0, 0), signal_step(rules or Rules()), ["z", "regime"], "signal int", ["signal"])
