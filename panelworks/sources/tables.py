"""The star-schema tables as a price panel and related views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, every: str = "week") -> DataFrame:
    """ticker, sector, date, open, high, low, close, volume: line items by supplier nation and week (or day)."""
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = item.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("p_retailprice") * (1 - F.col("l_discount"))
    rows = rows.withColumn("price", price)
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "price")
    date = F.to_date(F.date_trunc(every, "l_shipdate"))
    return rows.groupBy(F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"), date.alias("date")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )
