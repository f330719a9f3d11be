"""Contiguous shards of near-equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Cut ``docs`` in doc_id order into ``shards`` contiguous shards of near-equal byte size.

    A row's size is the UTF-8 length of its text plus 1 (null text: 1). Rows are
    range-partitioned by doc_id without their texts; the totals of the partitions
    give each partition's global offset, a running sum inside the partition gives
    each row's, and the row goes to the shard in whose equal target its middle
    byte falls. So a shard differs from its target by less than one row.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0
    in each shard), grown_shard (null). Null and repeated doc_ids are kept as
    rows of their own (nulls first); equal rows are interchangeable; an empty
    table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("doc_id", "size", "text_crc32")
    rows = checkpoint(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row for each partition: a window over all of them is small at any size.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.sum("bytes").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("upto", F.sum("size").over(within))
        .withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
        .join(totals, "part")
        .withColumn("middle", 2 * (F.col("bytes_ahead") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"middle * {shards} div (2 * total)")).cast("int"))
        .withColumn("row", F.col("rows_ahead") + F.col("rank") - 1)
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row a shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
