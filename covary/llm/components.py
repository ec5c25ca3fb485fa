"""Connected components of an edge table by alternating large and small stars (joins and aggregates, written out each round)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covary.llm.store import discard, materialize


SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (a, b) with m, the least b of their a. A node's neighbours lie in SALTS places: no task meets a hub's whole star."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy(F.col("a").alias("u")).agg(F.min("m").alias("m"))
    known = parts.select("a", "salt").hint("merge").join(least, F.col("a") == F.col("u")).select("a", "salt", "m")
    return dealt.hint("merge").join(known, ["a", "salt"]).select("a", "b", "m")


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge: the smallest node reachable. edges: (a, b); loops and repeats do no harm.

    A node's neighbours are never gathered: each round only takes minima by node and joins them back, by node and salt, so that
    the star of a node with very many neighbours is met in SALTS parts. No edges give no rows.
    """
    spark = edges.sparkSession
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while before["n"]:
        both = now.union(now.select("b", "a"))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = materialize(large, "large")
        small = _with_least(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        made = materialize(small, "edges")
        after = _state(made)
        discard(spark, now._covary_path, large._covary_path)
        now = made
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
