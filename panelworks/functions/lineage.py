"""Materialised intermediate results and joins with tables of a checked size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a local folder in a session whose executors are threads
    of this process; elsewhere an error, as executors could not read one another's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master.startswith("local") and "cluster" not in master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder.

    For small tables that many joins read (dates, folds, baselines), and for
    results that would otherwise be planned and computed once a reader.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``most`` rows, else as it is.

    It is counted here, so it should be checkpointed or cheap.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
