"""Streaming queries, run to completion over the tables (E)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from covary.operators import folds, monitor
from covary.operators.systems import System
from covary.plans.base import query, spine
from covary.plans.systems import _HEALTHY, QUANTILES, healthy_signals, quantile_spine, systems_sql
from covary.plans.trading import BT, signal_sql
from covary.sources.sinks import append_table, results_dir, written
from covary.streaming import jobs, stateful


def drain(spark, made, name: str):
    """Runs a streaming frame over all that is there and returns what it wrote."""
    out = results_dir(spark, name)
    run = made.writeStream.format("parquet").option("path", out + "/rows").option("checkpointLocation", out + "/state").outputMode("append").trigger(availableNow=True).queryName(f"{name}-{uuid.uuid4().hex}").start()
    run.awaitTermination()
    return spark.read.schema(made.schema).parquet(out + "/rows")


def _table_stream(spark, df, name: str):
    path = results_dir(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _events(spark, sf_dir):
    return _table_stream(spark, spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "events")


PARTS, BEFORE = 6, 3
PART_ROWS = 5_000_000  # of a file of a replayed table


class Replay:
    """A table as a stream that arrives in parts by t, a file or a few a trigger; the query stops after BEFORE parts and goes on from its checkpoint."""

    def __init__(self, df, parts: int = PARTS, before: int = BEFORE):
        self.spark, self.df, self.parts, self.before, self.progress = df.sparkSession, df, parts, before, []
        size = df.agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count(F.lit(1)).alias("n")).first()
        self.first, self.rows = size["a"] or 0, (size["z"] or 0) - (size["a"] or 0) + 1
        self.files = max(1, size["n"] // (parts * PART_ROWS))
        self.path, self.out = results_dir(self.spark, "arriving"), results_dir(self.spark, "replayed")

    def arrive(self, k: int) -> None:
        """Part k; a pair's rows of a part are in one file, so that no order of files within a part matters."""
        low, high = (self.first + self.rows * i // self.parts for i in (k, k + 1))
        append_table(self.df.filter((F.col("t") >= low) & (F.col("t") < high)).repartition(self.files, "pair"), self.path)

    def stream(self):
        return self.spark.readStream.schema(self.df.schema).option("maxFilesPerTrigger", self.files).parquet(self.path)

    def run(self, made) -> None:
        """One run of the query made(stream) over what has arrived since the last."""
        key = "spark.sql.streaming.stateStore.providerClass"
        was = self.spark.conf.get(key, None)
        self.spark.conf.set(key, stateful.PROVIDER)
        try:
            sink = made(self.stream()).writeStream.format("parquet").option("path", self.out + "/rows").option("checkpointLocation", self.out + "/state").outputMode("append")
            query = sink.trigger(availableNow=True).queryName(f"replay-{uuid.uuid4().hex}").start()
            query.awaitTermination()
            self.progress += query.recentProgress
        finally:
            self.spark.conf.set(key, was) if was else self.spark.conf.unset(key)

    def all(self, made):
        """The rows that both runs wrote."""
        for k in range(self.before):
            self.arrive(k)
        self.run(made)
        for k in range(self.before, self.parts):
            self.arrive(k)
        self.run(made)
        return self.spark.read.schema(made(self.stream()).schema).parquet(self.out + "/rows")


@query("e2_stream_system", systems_sql([System("full")]) + "SELECT pair, t::BIGINT AS t, z.z, round(z.hedge, 6) AS hedge, m.pos AS signal FROM m_0 m JOIN z_0 z USING (pair, t)")
def e2_system(spark, sf_dir):
    """The whole system on a stream of bars: adaptive hedge, z-score and machine as typed state, carried over six triggers and a restart."""
    rows = quantile_spine(spark, sf_dir).select("pair", F.col("t").cast("bigint").alias("t"), "y", "x", "regime")
    got = Replay(written(rows, "bars")).all(lambda s: stateful.stateful(s, stateful.System()))
    return got.select("pair", "t", "z", F.round("hedge", 6).alias("hedge"), "signal")


@query("e3_stream_gate", _HEALTHY + "SELECT h.pair, h.t::BIGINT AS t, g.pos AS gated, g.sick FROM hh h JOIN hgate g ON g.pair = h.pair AND g.t = h.t")
def e3(spark, sf_dir):
    """The health gate on a stream of signals and rolling health: how long a pair has been sick is state that outlives batches and a restart."""
    rows = healthy_signals(spark, sf_dir).select("pair", F.col("t").cast("bigint").alias("t"), "signal", "healthy")
    return Replay(written(rows, "signals")).all(lambda s: stateful.stateful(s, stateful.Gate()))


WIDTH, SLIDE = 182, 28  # days
_LOG = QUANTILES + f", {signal_sql(source='qspine')}, log AS (SELECT s.pair, s.sector, s.t, s.date, s.z, s.regime, g.pos AS signal FROM qspine s JOIN sig g ON g.pair = s.pair AND g.t = s.t WHERE s.z IS NOT NULL)"
_MEASURED = "n, days, round(n / greatest(days, 1), 4) AS per_day, mean_z, max_z, long_pct, short_pct, flat_pct, active_pct, crisis_pct"


def signal_log(spark, sf_dir):
    """The machine's rows with a z-score, as a log."""
    return folds.signals(quantile_spine(spark, sf_dir)).filter("z is not null").select("pair", "sector", "t", "date", "z", "regime", "signal")


@query("e4_sliding_monitor", _LOG + f""", wide AS (SELECT log.*, DATE '1970-01-01' + (unnest(range((date - DATE '1970-01-01' - {WIDTH}) // {SLIDE} + 1, (date - DATE '1970-01-01') // {SLIDE} + 1)) * {SLIDE})::INT AS start FROM log),
  per AS (SELECT start, {monitor.MEASURES_SQL} FROM wide GROUP BY 1 HAVING start + {WIDTH} <= (SELECT max(date) FROM log) - 7)
  SELECT *, {monitor.alerts_sql()} AS alerts FROM (SELECT start, {_MEASURED} FROM per)""")
def e4(spark, sf_dir):
    """The log's sliding half-years: activity, shares of sides and regimes, and the alerts of eight rules, for every window that the watermark has closed."""
    rows = signal_log(spark, sf_dir).withColumn("t", F.datediff("date", F.lit("1970-01-01").cast("date")))
    return Replay(written(rows, "log")).all(lambda s: jobs.sliding_monitor(s.withColumn("ts", F.col("date").cast("timestamp")), f"{WIDTH} days", f"{SLIDE} days", "7 days"))


@query("e1_bars", "SELECT event_type AS ticker, date_trunc('hour', ts) AS start, arg_max(value, ts) AS close, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE", ctes="")
def e1(spark, sf_dir):
    """Hourly bars that the watermark has closed."""
    return drain(spark, jobs.bars(_events(spark, sf_dir)), "bars").select("ticker", F.col("start").cast("timestamp_ntz").alias("start"), "close", "n")


@query("e2_stream_signals", BT + "SELECT pair, t, signal FROM bt")
def e2(spark, sf_dir):
    """The signal machine as keyed state over the panel as a stream: equal to the batch fold."""
    rows = spine(spark, sf_dir).select("pair", "t", "z", "regime")
    return drain(spark, jobs.stream_signals(_table_stream(spark, rows, "scored")), "signals")


@query("e5_sessions", "SELECT event_type AS ticker, count(*)::BIGINT AS n, min(ts) AS start FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce((ts > lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 30 MINUTE)::INT, 1) AS new FROM events)) GROUP BY event_type, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE", ctes="")
def e5(spark, sf_dir):
    return drain(spark, jobs.sessions(_events(spark, sf_dir)), "sessions").select("ticker", "n", F.col("start").cast("timestamp_ntz").alias("start"))


@query("e6_dedupe_sink", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1", ctes="")
def e6(spark, sf_dir):
    """Every row twice in the stream, once in the sink."""
    once = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    twice = _table_stream(spark, once.unionByName(once), "twice")
    return drain(spark, jobs.deduplicated(twice, ["event_id"]), "once").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
