"""What a log of signals says about the system that wrote it: activity measures, and alerts by a table of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# alert, measure, comparison, level: fixed values
RULES = [
    ("low z-scores", "mean_z", "<", 1.5),
    ("very high z-scores", "mean_z", ">", 3.5),
    ("mostly flat", "flat_pct", ">", 90.0),
    ("hardly active", "active_pct", "<", 10.0),
    ("crisis regime", "crisis_pct", ">", 50.0),
    ("few signals a day", "per_day", "<", 0.5),
    ("long bias", "long_pct", ">", 70.0),
    ("short bias", "short_pct", ">", 70.0),
]


def measures(signal: str = "signal", z: str = "z", regime: str = "regime", day: str = "date") -> list[Column]:
    """Aggregates of a group of log rows; `days` is as long as the group has dates."""
    pct = lambda c: F.round(100 * F.avg(c.cast("int")), 4)
    s = F.col(signal)
    return [
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set(day)).cast("bigint").alias("days"), F.round(F.avg(F.abs(z)), 6).alias("mean_z"), F.round(F.max(F.abs(z)), 6).alias("max_z"),
        pct(s == 1).alias("long_pct"), pct(s == -1).alias("short_pct"), pct(s == 0).alias("flat_pct"), pct(s != 0).alias("active_pct"), pct(F.col(regime) == 0).alias("crisis_pct"),
    ]


def per_day() -> Column:
    return F.round(F.col("n") / F.greatest("days", F.lit(1)), 4)


def alerts(rules=RULES) -> Column:
    """The names of the rules that the measures break, in the order of the rules."""
    broken = {"<": lambda m, v: F.col(m) < v, ">": lambda m, v: F.col(m) > v}
    return F.filter(F.array(*[F.when(broken[op](m, v), name) for name, m, op, v in rules]), lambda a: a.isNotNull())


MEASURES_SQL = """count(*)::BIGINT AS n, count(DISTINCT date)::BIGINT AS days, round(avg(abs(z)), 6) AS mean_z, round(max(abs(z)), 6) AS max_z, round(100 * avg((signal = 1)::INT), 4) AS long_pct, round(100 * avg((signal = -1)::INT), 4) AS short_pct,
  round(100 * avg((signal = 0)::INT), 4) AS flat_pct, round(100 * avg((signal <> 0)::INT), 4) AS active_pct, round(100 * avg((regime = 0)::INT), 4) AS crisis_pct"""


def alerts_sql(rules=RULES) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {m} {op} {v} THEN '{name}' END" for name, m, op, v in rules) + "], lambda a: a IS NOT NULL)"
