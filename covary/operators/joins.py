"""Joins that Spark has no word for: as-of, folds of an expanding walk, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """left with the values of right's last row at or before `on`, per `by`; null where there is none.

    One union and one window: rows of both sides meet in one exchange by key, and nothing is multiplied.
    """
    cols = left.columns
    a = left.select(*cols, *[F.lit(None).cast(right.schema[v].dataType).alias("_" + v) for v in values], F.lit(1).alias("_side"), F.lit(False).alias("_hit"))
    b = right.select(*[F.col(c) if c in [*by, on] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], *[F.col(v).alias("_" + v) for v in values], F.lit(0).alias("_side"), F.lit(True).alias("_hit"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    # the whole right row is carried, so that its nulls stay nulls
    last = F.last(F.when(F.col("_hit"), F.struct(*["_" + v for v in values])), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("_last", last).filter("_side = 1")
    return out.select(*cols, *[F.col(f"_last._{v}").alias(v) for v in values])


def walk_forward_folds(spark, n_rows: int, least: int = 504, step: int = 63, test: int = 126) -> DataFrame:
    """(fold, train_end_t, test_start_t, test_end_t) of an expanding walk over n_rows rows."""
    rows = []
    end = least
    while end + test <= n_rows:
        rows.append((len(rows), end - 1, end, end + test - 1))
        end += step
    return spark.createDataFrame(rows, "fold int, train_end_t int, test_start_t int, test_end_t int")


def in_own_folds(df: DataFrame, least: int = 504, step: int = 63, test: int = 126, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Every row once for each fold (column fold) whose test window it lies in; the walk goes over all of its group's rows t = 0, 1, ..., however many."""
    last = F.max("t").over(Window.partitionBy(*keys))
    first, most = F.floor((F.col("t") - least - test) / step) + 1, F.floor(F.least(F.col("t") - least, F.col("_last") + 1 - least - test) / step)
    number = F.when(most >= F.greatest(first, F.lit(0)), F.sequence(F.greatest(first, F.lit(0)).cast("int"), most.cast("int")))
    return df.withColumn("_last", last).withColumn("fold", F.explode(number)).drop("_last")


def in_periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    """df once for every named period (name, start, end) that its date lies in; the periods are few and are broadcast."""
    return df.join(F.broadcast(periods), F.col("date").between(F.col("start"), F.col("end")))


PERIODS = [("1996H1", "1996-01-01", "1996-06-30"), ("1998Q3", "1998-07-01", "1998-09-30"), ("1998H2", "1998-07-01", "1998-12-31"), ("2000", "2000-01-01", "2000-12-31")]


def periods(spark) -> DataFrame:
    return spark.createDataFrame(PERIODS, "name string, start string, end string").select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
