"""The feature pipeline over a store that goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import CHUNK
from ..functions.ewm import end_states
from ..functions.lineage import checkpointed, small
from ..operators.features import MODEL_FEATURES, REACH, RECURSIONS, feature_pipeline
from ..sources.feeds import missing_keys, read_features, read_store, write_features
from ..sources.partitions import replace, table_at

#: Bars of a ticker that are read again before new ones: what frames and fills reach back, and bars that may still come late.
TAIL = REACH + 64
#: Dates before the first missing one whose returns its regime pools.
_DATES = 20
_BAR = ["ticker", "date", "close", "volume"]


def _save_states(bars: DataFrame, begun: DataFrame | None, path: str, version: str, size: int) -> None:
    """Store, of each ticker of over ``TAIL`` bars, the bar before its last ``TAIL`` ones and the state of the recursions behind it."""
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    tail = bars.select("ticker", "date").withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= TAIL + 1)
    edge = checkpointed(tail.where(F.col("_n") == TAIL + 1).select("ticker", F.col("date").alias("_edge")))
    rows = bars.join(small(edge), "ticker").where("date <= _edge").drop("_edge")
    states = end_states(rows.select(*_BAR), RECURSIONS, size, begun)
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("date", "close", "volume"), "date").alias("b")).select("ticker", "b.*")
    if begun is not None:  # a ticker whose edge has not moved
        last = last.unionByName(begun.select(*_BAR).join(last, "ticker", "left_anti"))
    replace(last.join(states, "ticker").withColumn("feature_version", F.lit(version)), f"{path}/_state", ["feature_version"])


def _resumed(bars: DataFrame, gone: DataFrame, begun: DataFrame, size: int) -> DataFrame | None:
    """The pipeline's rows from the stored states on; None if a missing bar lies where they do not lead to it."""
    known = bars.join(small(begun.select("ticker", F.col("date").alias("_edge"))), "ticker", "left").where("_edge is null or date > _edge")
    known = checkpointed(known)
    late = gone.groupBy("ticker").agg(F.min("date").alias("_first"))
    before = known.join(small(checkpointed(late)), "ticker").groupBy("ticker", "_edge", "_first").agg(F.count_if(F.col("date") < F.col("_first")).alias("n"))
    if before.where(F.col("_edge").isNotNull() & ((F.col("_first") <= F.col("_edge")) | (F.col("n") < REACH + 20))).limit(1).count():
        return None
    first = gone.agg(F.min("date")).first()[0]
    edge = begun.agg(F.max("date")).first()[0]
    widths = checkpointed(bars.groupBy("date").agg(F.count("*").alias("n")))
    pooled = widths.where(F.col("date") < F.lit(first)).orderBy(F.desc("date")).limit(_DATES).agg(F.min("date")).first()[0]
    if pooled is None or pooled <= edge or known.groupBy("ticker").count().where(F.col("count") > size).limit(1).count():
        return None
    return feature_pipeline(known.drop("_edge"), gate=False, size=size, begun=begun, widths=widths)


def stored_pipeline(bars: DataFrame, path: str, version: str, size: int = CHUNK) -> DataFrame:
    """ticker, date and the 64 model columns of ``bars`` from the store at ``path``; what it lacks is computed and stored first.

    Beside the features lies, for each ticker, the state of its recursions some
    ``TAIL`` bars back. Appended bars are computed from there, exactly as with the
    whole history: the frames see the bars since, the recursions go on, and the
    cross-sections have all of a date. Bars missing further back make it compute
    the whole. Rows of dates that are too narrow are not stored and asked for again.
    """
    spark = bars.sparkSession
    bars = checkpointed(bars.select(*_BAR))
    store, begun = read_store(spark, path), None
    made = None
    if store is not None:
        gone = checkpointed(missing_keys(bars, store, version, MODEL_FEATURES))
        narrow = bars.groupBy("date").count().where("count < 5").select("date")
        gone = checkpointed(gone.join(small(checkpointed(narrow)), "date", "left_anti"))
        if not gone.limit(1).count():
            return read_features(store, MODEL_FEATURES, version)
        states = table_at(spark, f"{path}/_state")
        if states is not None:
            begun = checkpointed(states.where(F.col("feature_version") == version).drop("feature_version"))
            made = _resumed(bars, gone, begun, size) if begun.limit(1).count() else None
        if made is not None:
            made = made.join(gone, ["ticker", "date"], "left_semi")
    if made is None:
        begun, made = None, feature_pipeline(bars, size=size)
    write_features(made, MODEL_FEATURES, version, path)
    after = bars if begun is None else bars.join(small(begun.select("ticker", F.col("date").alias("_edge"))), "ticker", "left").where("_edge is null or date > _edge").drop("_edge")
    _save_states(after, begun, path, version, size)
    return read_features(read_store(spark, path), MODEL_FEATURES, version)
