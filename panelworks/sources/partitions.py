"""Tables partitioned on disk: inserts that read the touched partitions alone, replaced and removed partitions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed, small

#: The partition column of dated tables.
MONTH = "month"


def month(date: str = "date") -> Column:
    return F.year(date) * 100 + F.month(date)


def table_at(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The parquet table at ``path``, None if there is none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def touched(target: DataFrame, rows: DataFrame) -> DataFrame:
    """``target`` in the months of ``rows``: a literal filter on the partition column, so that no other file is listed or read."""
    months = [r[MONTH] for r in rows.select(MONTH).distinct().collect()]  # one for each month of the batch
    return target.where(F.col(MONTH).isin(months)) if months else target.limit(0)


def absent(rows: DataFrame, target: DataFrame | None, keys: list[str]) -> DataFrame:
    """The rows whose key ``target`` lacks; both have ``month``, and ``rows`` should be checkpointed.

    Of the target, only keys that the batch brings go on: a batch of a checked
    size is sent to where the target lies, so that the target never moves; of a
    larger one Spark's own Bloom filter thins the target before the join.
    """
    if target is None:
        return rows
    asked = small(rows.select(*keys))
    there = checkpointed(touched(target, rows).select(*keys).join(asked, keys, "left_semi"))
    return rows.join(small(there), keys, "left_anti")


def insert(rows: DataFrame, path: str, keys: list[str], order: list[Column | str] | None = None) -> int:
    """Add the rows, the first of each key, whose key the table at ``path`` lacks; partitioned by month. How many were added."""
    rows = checkpointed(first_of(rows.withColumn(MONTH, month()), keys, order or [F.lit(0)]))
    new = checkpointed(absent(rows, table_at(rows.sparkSession, path), keys))
    n = new.count()
    if n:
        new.repartition(MONTH).write.mode("append").partitionBy(MONTH).parquet(path)
    return n


def replace(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions of the table at ``path`` that ``rows`` belong to; others keep their files. The old ones go when the new ones are whole."""
    checkpointed(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def remove(spark: SparkSession, path: str, names: list[str]) -> None:
    """Delete whole partitions (``column=value``, nested ones with slashes) of the table at ``path``; absent ones are no fault."""
    jvm = spark.sparkContext._jvm
    for name in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def retain(spark: SparkSession, path: str, as_of: str, days: int = 760) -> None:
    """Delete the rows of the table at ``path``, partitioned by month, that are older than ``days`` before ``as_of``.

    Months that end before are removed whole; the month on the boundary is written
    anew without its old rows, before anything is removed. No other file is touched.
    """
    table = table_at(spark, path)
    if table is None:
        return
    first, edge = spark.range(1).select(F.date_sub(F.lit(as_of).cast("date"), days).alias("date")).select("date", month()).first()
    months = {r[MONTH] for r in table.select(MONTH).distinct().collect()}  # from the folders' names
    left = checkpointed(table.where((F.col(MONTH) == edge) & (F.col("date") >= F.lit(first)))) if edge in months else None
    if left is not None and left.limit(1).count():
        replace(left, path, [MONTH])
        months.discard(edge)
    remove(spark, path, [f"{MONTH}={m}" for m in sorted(months) if m <= edge])
