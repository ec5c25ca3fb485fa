"""Price panels from the star-schema tables, and the panel of pairs that the other operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = "1999-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents():
    """Prices as whole cents: their sums are exact, whatever the order of addition."""
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def week_prices(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, ticker, sector, close): weekly mean price by nation. Dates bound the scan where they are given."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    if start:
        items = items.filter(F.col("l_shipdate") >= F.lit(start).cast("timestamp"))
    if end:
        items = items.filter(F.col("l_shipdate") < F.date_add(F.lit(end), 1).cast("timestamp"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region")
    # sums by supplier and week first: the joins then see a row per supplier and week, not per item
    weekly = items.groupBy("l_suppkey", F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(F.sum(cents()).alias("s"), F.count("l_extendedprice").alias("n"))
    named = weekly.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("date", F.col("n_name").alias("ticker"), F.col("r_name").alias("sector")).agg((F.sum("s") / F.sum("n") / 100.0).alias("close"))


def day_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by region and day; one sector."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(F.sum(cents()).alias("s"), F.count("l_extendedprice").alias("n"))
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("date", F.col("r_name").alias("ticker"), F.lit("ALL").alias("sector")).agg((F.sum("s") / F.sum("n") / 100.0).alias("close"))


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean price by brand; the sector is the brand's number modulo 5."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sector = (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 5).cast("string")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("date", F.col("p_brand").alias("ticker"), sector.alias("sector")).agg((F.sum(cents()) / F.count("l_extendedprice") / 100.0).alias("close"))


def market(prices: DataFrame) -> DataFrame:
    """(date, m): the mean close of the date, from whole millionths, so that no order of addition changes it."""
    whole = F.round(F.col("close") * 1e6).cast("bigint")
    return prices.groupBy("date").agg(F.round(F.sum(whole) / F.count("close") / 1e6, 4).alias("m"))


def sector_pairs(prices: DataFrame) -> DataFrame:
    """(pair, ticker_y, ticker_x, sector): unordered pairs within a sector."""
    tickers = prices.select("ticker", "sector").distinct()
    a, b = tickers.alias("a"), tickers.alias("b")
    same = (F.col("a.sector") == F.col("b.sector")) & (F.col("a.ticker") < F.col("b.ticker"))
    return a.join(b, same).select(F.concat_ws("/", "a.ticker", "b.ticker").alias("pair"), F.col("a.ticker").alias("ticker_y"), F.col("b.ticker").alias("ticker_x"), F.col("a.sector").alias("sector"))


def align(pairs: DataFrame, prices: DataFrame, with_market: bool = True) -> DataFrame:
    """(pair, sector, date, t, y, x, m): the dates on which both have a price, numbered from 0 within the pair.

    Rows meet on (ticker, date); the last exchange is by pair and serves the windows that follow.
    """
    y = prices.select(F.col("ticker").alias("ticker_y"), "date", F.col("close").alias("y"))
    x = prices.select(F.col("ticker").alias("ticker_x"), "date", F.col("close").alias("x"))
    out = pairs.join(y, "ticker_y").join(x, ["ticker_x", "date"])
    out = out.join(market(prices), "date") if with_market else out.withColumn("m", F.lit(None).cast("double"))
    # pairs are few and their work is long: by a number of its own the exchange is not folded into fewer tasks by its size
    out = out.repartition(int(prices.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair")
    return out.select("pair", "sector", "date", (F.row_number().over(Window.partitionBy("pair").orderBy("date")) - 1).alias("t"), "y", "x", "m")


def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = week_prices(spark, sf_dir)
    return align(sector_pairs(prices), prices)


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = day_prices(spark, sf_dir)
    return align(sector_pairs(prices), prices)
