"""Exact ranks and quantiles of groups that are too wide for one task."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed, small

#: Rows of a date that one task sorts; dates of more are ranked over many tasks.
WIDE = 200_000


def value_places(rows: DataFrame, keys: list[str], x: str, most: int = WIDE) -> DataFrame:
    """(*keys, x, n, before, total) of every different value of a group: how often it occurs, how many rows are smaller, how many there are. NULLs are left out.

    Values are counted where they lie, then range-partitioned by (group, value),
    about ``most`` to a partition. A partition's running counts and the totals of
    the group's partitions before it give exact places; a value of any frequency
    is one row.
    """
    counts = checkpointed(rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n")))
    parts = max(1, math.ceil(counts.count() / most))
    at = checkpointed(counts.repartitionByRange(parts, *keys, x).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)  # a part of a partition
    past = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    whole = Window.partitionBy(*keys)
    sums = at.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_past"), F.sum("_n").over(whole).alias("total"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = at.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(small(checkpointed(sums)), same)
    return placed.select(*keys, x, "n", (F.col("_past") + F.col("_inside")).alias("before"), "total")


def _long(df: DataFrame, cols: list[str], *more: str) -> DataFrame:
    """(_d, *more, _f, _x): a row for each date, row and column."""
    return df.withColumn("_d", F.col("date")).select("_d", *more, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["_d", *more], cols, "_f", "_x")


def quantiles(df: DataFrame, cols: list[str], shares: list[float]) -> DataFrame:
    """(_d, _q): for each date a map from column to its interpolated quantiles at ``shares``."""
    at = value_places(_long(df, cols), ["_d", "_f"], "_x")

    def nth(i: Column) -> Column:
        return F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("_x")))

    places = [F.lit(s) * (F.col("total") - 1) for s in shares]
    ends = [nth(end(p)).alias(f"_{k}{i}") for i, p in enumerate(places) for k, end in (("a", F.floor), ("b", F.ceil))]
    each = at.groupBy("_d", "_f").agg(*ends, F.first("total").alias("total"))
    value = F.array(*[F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (p - F.floor(p)) for i, p in enumerate(places)])
    return each.select("_d", "_f", value.alias("_v")).groupBy("_d").agg(F.map_from_entries(F.collect_list(F.struct("_f", "_v"))).alias("_q"))  # an entry a column


def rank_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``_ranks``: a map from column to the row's average rank on its date as a share, without the missing ones."""
    df = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    long = _long(df, cols, "_row").where("_x is not null")
    at = value_places(long, ["_d", "_f"], "_x")
    share = (F.col("before") + (F.col("n") + 1) / 2) / F.col("total")
    at = at.select(F.col("_d").alias("_e"), F.col("_f").alias("_g"), F.col("_x").alias("_y"), share.alias("_share"))
    same = F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_f") == F.col("_g")) & (F.col("_x") == F.col("_y"))
    ranks = long.join(at, same).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_f", "_share"))).alias("_ranks"))  # an entry a column
    return df.join(ranks, "_row", "left").drop("_row")


def each_width(df: DataFrame, wide: int | None, narrow_: Callable[[DataFrame], DataFrame], broad: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``narrow_`` of the dates' rows, but ``broad`` of those of dates with over ``wide`` tickers; None: no date is."""
    if wide is None:
        return narrow_(df)
    df = checkpointed(df)
    dates = checkpointed(df.groupBy(F.col("date").alias("_d")).agg(F.count("*").alias("_n")).where(F.col("_n") > wide).select("_d"))
    if not dates.limit(1).count():
        return narrow_(df)
    dates, same = small(dates), F.col("date").eqNullSafe(F.col("_d"))
    return narrow_(df.join(dates, same, "left_anti")).unionByName(broad(checkpointed(df.join(dates, same, "left_semi"))))
