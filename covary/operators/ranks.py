"""Signed ranks of paired differences, with the exact distribution of the statistic for small samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covary.functions import exprs as x

EXACT = 50


def subset_sums(n: Column) -> Column:
    """How many subsets of 1 .. n have each sum, from 0 to n (n + 1) / 2: each number adds the counts so far, moved by it."""
    def more(counts, k):
        zeros = F.array_repeat(F.lit(0).cast("bigint"), k.cast("int"))
        return F.zip_with(F.concat(counts, zeros), F.concat(zeros, counts), lambda a, b: a + b)

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.array(F.lit(1).cast("bigint")), more)


def signed_ranks(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """(by.., n, stat, p, median): the sum of the ranks of positive differences and its one-sided p (greater).

    Zeros take no part. Up to EXACT differences without ties p counts subsets of ranks; beyond that it is the normal
    approximation with the ties' correction. Ranks are made per group, of one row per compared unit.
    """
    rows = df.filter(F.col(d).isNotNull() & (F.col(d) != 0)).withColumn("_a", F.abs(d))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, "_a"))
    rows = rows.withColumn("_ties", ties).withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy("_a")) + (F.col("_ties") - 1) / 2.0)
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("stat"), F.sum((F.col("_ties") * F.col("_ties") - 1).cast("double")).alias("_tied"), F.median(d).alias("median"))
    n = F.col("n")
    counts = F.when(n <= EXACT, subset_sums(n))
    above = F.aggregate(F.slice(counts, F.ceil("stat").cast("int") + 1, F.greatest(F.lit(0), F.size(counts) - F.ceil("stat").cast("int"))), F.lit(0).cast("bigint"), lambda a, v: a + v)
    exact = above / F.pow(F.lit(2.0), n)
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tied") / 48.0)
    normal = 1 - x.norm_cdf((F.col("stat") - n * (n + 1) / 4.0) / spread)
    return g.select(*by, "n", "stat", F.when((n <= EXACT) & (F.col("_tied") == 0), exact).otherwise(normal).alias("p"), "median")
