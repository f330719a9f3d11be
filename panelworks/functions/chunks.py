"""Long histories in chunks: exact places in an entity's order, rows that lead a chunk, states passed on from chunk to chunk."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed, small

#: Bars of a chunk. Entities with no more than that are one chunk.
CHUNK = 50_000


def in_order(rows: DataFrame, key: str, time: str, step: Callable[..., tuple[Any, tuple]], schema: str) -> DataFrame:
    """``step(state, *row) -> (state, made)`` along each key's rows in time order: a row of ``schema`` each, from the row's values in the order of its columns.

    A key's rows lie in one task, sorted, and pass in Arrow batches; only the
    state, which starts as None, stays between rows, so a key of any length fits
    and many short keys cost no more than as many rows of a long one.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for f in batches:
            made = []
            for k, row in zip(f[key].tolist(), zip(*(f[c].tolist() for c in f.columns))):
                if k != last and (k == k or last == last):  # a null key is not equal to itself
                    last, state = k, None
                state, one = step(state, *row)
                made.append(one)
            if made:
                yield pd.DataFrame(dict(zip(names, zip(*made))))

    return rows.repartition(key).sortWithinPartitions(key, time).mapInPandas(run, schema)


def places(rows: DataFrame, parts: int, entity: str, time: str) -> DataFrame:
    """``rows`` with ``_pos``: how many rows of the entity come before, in time order.

    The rows are range-partitioned by (entity, time) and numbered where they lie;
    the counts of the partitions before give what is missing. No task sees more
    than a partition, however long an entity is.
    """
    at = rows.repartitionByRange(parts, entity, time).sortWithinPartitions(entity, time).withColumn("_at", F.monotonically_increasing_id())
    at = checkpointed(at.withColumn("_part", F.shiftright("_at", 33)))
    runs = at.groupBy(F.col(entity).alias("_e"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_e").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    runs = small(checkpointed(runs.select("_e", "_p", (before - F.col("_first")).alias("_shift"))))
    joined = at.join(runs, F.col(entity).eqNullSafe(F.col("_e")) & (F.col("_part") == F.col("_p")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_pos"))


def chunked(df: DataFrame, reach: int, size: int = CHUNK, entity: str = "ticker", time: str = "date") -> tuple[DataFrame, bool]:
    """``df`` with ``_chunk`` and ``_lead``, and whether an entity has several chunks.

    A chunk is ``size`` rows of an entity in time order. The ``reach`` rows before
    it are in it too: ``_lead`` is their distance from its first row, and 0 for the
    chunk's own rows. ``df`` is read more than once and should be checkpointed.
    """
    if size < max(reach, 1):
        raise ValueError("a chunk holds as many rows as lead it, at least")
    long = checkpointed(df.groupBy(F.col(entity).alias("_e")).agg(F.count("*").alias("_n")).where(F.col("_n") > size))
    total = long.agg(F.sum("_n")).first()[0]
    if not total:
        return df.withColumns({"_chunk": F.lit(0).cast("long"), "_lead": F.lit(0)}), False
    long = small(long.select("_e"))
    same = F.col(entity).eqNullSafe(F.col("_e"))
    rows = places(df.join(long, same, "left_semi"), math.ceil(total / size), entity, time)
    own, left = F.floor(F.col("_pos") / size), (size - F.col("_pos") % size).cast("int")
    here, next_ = (F.struct(k.cast("long").alias("_chunk"), lead.alias("_lead")) for k, lead in ((own, F.lit(0)), (own + 1, left)))
    cut = rows.select(*df.columns, F.inline(F.when(left <= reach, F.array(here, next_)).otherwise(F.array(here))))
    short = df.join(long, same, "left_anti").withColumns({"_chunk": F.lit(0).cast("long"), "_lead": F.lit(0)})
    return cut.unionByName(short), True


def own_rows(df: DataFrame) -> DataFrame:
    """The chunks' own rows, without the columns of :func:`chunked`."""
    return df.where("_lead = 0").drop("_chunk", "_lead")


def passed_on(summaries: DataFrame, entity: str, step: Callable[[Any, list], Any], kind: str) -> DataFrame:
    """(_e, _k, _carry) for every row of ``summaries`` (``entity``, _chunk, _sum): the state in which the entity enters the chunk.

    ``step(state, sum)`` gives the state after a chunk; None is the state at the
    start. ``kind``: the state's type. There is a row a chunk.
    """

    def run(state: Any, e: Any, k: int, x: Any) -> tuple[Any, tuple]:
        return step(state, x), (e, k, state)

    rows = summaries.select(F.col(entity).alias("_e"), F.col("_chunk").alias("_k"), "_sum")
    return checkpointed(in_order(rows, "_e", "_k", run, f"_e {rows.schema['_e'].dataType.simpleString()}, _k long, _carry {kind}"))


def with_carry(rows: DataFrame, carries: DataFrame, entity: str, name: str) -> DataFrame:
    """``rows`` with the state in which their chunk is entered, as column ``name`` (null where there is none)."""
    states = small(carries.select("_e", "_k", F.col("_carry").alias(name)))
    return rows.join(states, F.col(entity).eqNullSafe(F.col("_e")) & (F.col("_chunk") == F.col("_k")), "left").drop("_e", "_k")
