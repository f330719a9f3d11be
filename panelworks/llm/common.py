"""Helpers shared by the corpus operators: checkpoints, words, shingles, components."""

from __future__ import annotations

import tempfile
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes that belong to words: 0-9, a-z and every byte of a non-ASCII character.
_WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xBF58476D1CE4E5B9)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost no recomputation.

    The folder is the session's ``spark.checkpoint.dir``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a local folder in a session whose executors are threads
    of this process (tests, notebooks); elsewhere an error, as executors could not
    read one another's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master.startswith("local") and "cluster" not in master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` checkpointed, and its rows, which are counted as they are written.

    A checkpoint keeps the size that its plan was estimated at, and a join's
    estimate is the product of its sides': over rounds of joins the estimates grow
    to numbers of millions of digits, which the driver multiplies. The frame given
    back stands on the checkpoint's rows alone and has none.
    """
    seen = Observation()
    out = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("n")))
    session = df.sparkSession
    rows = session._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False)
    return DataFrame(rows, session), seen.get["n"]


def compacted(df: DataFrame, rows: int = 50_000, least: int = 8) -> tuple[DataFrame, int]:
    """``df`` checkpointed, in partitions of about ``rows`` rows, and its rows: few rows in very many partitions cost a file each at every shuffle."""
    df, n = counted(df)
    parts = max(least, n // rows)
    out = df.coalesce(parts)
    out._parts = min(parts, df.rdd.getNumPartitions())
    return out, n


def compact(df: DataFrame, rows: int = 50_000, least: int = 8) -> DataFrame:
    return compacted(df, rows, least)[0]


def spread(df: DataFrame, n: int, rows: int) -> DataFrame:
    """``df``, which has ``n`` rows, in partitions of about ``rows`` rows whatever it came in: for rows that each cost much."""
    return df.repartition(max(8, n // rows))


def parts_of(df: DataFrame) -> int:
    """Partitions of a checkpointed table, 1 at least: as many tasks serve what is joined to it."""
    return max(1, getattr(df, "_parts", 0) or df.rdd.getNumPartitions())


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``most`` rows, else ``df`` as it is.

    ``df`` should be checkpointed: it is counted here.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_on_hot(left: DataFrame, right: DataFrame, key: str, size: str, hot: int = 1_000) -> DataFrame:
    """``left`` joined to ``right`` (one row a ``key``; ``size``: how many rows of ``left`` have it).

    Keys of over ``hot`` rows would each fill one task of a shuffled join; their
    rows of ``right`` are few and broadcast, if a count bears that out. ``right``
    should be checkpointed.
    """
    most = 500_000
    heavy = right.where(F.col(size) > hot)
    n = heavy.limit(most + 1).count()
    if not 0 < n <= most:
        return left.join(right, key)
    one = left.join(F.broadcast(heavy), key)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(right.where(F.col(size) <= hot), key)
    return one.unionByName(rest)


def words(text: str, lower: bool = True) -> list[bytes]:
    """UTF-8 words of a text: runs of digits, letters and non-ASCII characters, lower-cased."""
    return (text.lower() if lower else text).encode("utf-8", "replace").translate(_WORD_BYTES).split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 32-bit hash of each word, the same in every process."""
    return np.fromiter(map(crc32, ws), np.uint32, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _C
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, in text order; none if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = hashes.astype(np.uint64)
    out = x[:n].copy()
    for i in range(1, k):
        out = out * _M + x[i : i + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return x.view(np.int64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that it reaches.

    Rounds of contraction. Each label takes the first label, in the round's
    order, of itself and its neighbours; then the one that that label takes. An
    edge from a label to the one it took lies between their new labels, so none
    of the links is lost; edges inside a label go, others become one. The first
    round's order is that of the nodes, which ends stars at once; later ones are
    by a hash, so that no shape makes many rounds. Minima are found where the
    edges lie before they meet, so a hub's edges need not. Every round is
    checkpointed, and only whether edges are left reaches the driver. Nodes must
    not be null; self loops are ignored.
    """
    e, n = compacted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    turns: list[DataFrame] = []
    while n:
        parts, turn = parts_of(e), len(turns)  # few edges need few tasks, whatever the number of shuffle partitions

        def first(x: str, turn: int = turn) -> Column:
            order = F.lit(0) if turn == 0 else F.xxhash64(F.col(x), F.lit(turn))
            return F.struct(order.alias("o"), F.col(x).cast("long").alias("x"))

        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        took = both.groupBy("a").agg(F.least(first("a"), F.min(first("b"))).getField("x").alias("m")).coalesce(parts)
        again = took.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        took = compact(took.join(again, "m").coalesce(parts).select(F.col("a").alias("label"), F.col("mm").alias("now")))
        turns.append(took)
        x, y = took.toDF("a", "x"), took.toDF("b", "y")
        left = e.join(x, "a").coalesce(parts).join(y, "b").where("x <> y")
        e, n = compacted(left.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).coalesce(parts).distinct().coalesce(parts))
    if not turns:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = turns[0].toDF("node", "label")  # the labels of the rounds, one after another
    for took in turns[1:]:
        named = named.join(took, "label", "left").coalesce(parts_of(turns[0])).select("node", F.coalesce("now", "label").alias("label"))
    if len(turns) == 1:  # labels are the smallest nodes
        return named.withColumnRenamed("label", "component")
    named = compact(named)
    smallest = named.groupBy("label").agg(F.min("node").alias("component")).coalesce(parts_of(named))
    return named.join(smallest, "label").select("node", "component")
