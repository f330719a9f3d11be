"""Exponentially weighted recursions of every entity, chunk by chunk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import isnan, nan

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK, chunked, passed_on, with_carry
from .lineage import checkpointed

#: State of a mean before its first row: mean, rows since its last value, values.
NEW = (nan, 0.0, 0.0)


@dataclass(frozen=True)
class Mean:
    """y0 = x0, y = alpha x + (1 - alpha) y before; NULL until ``least`` values. Over missing values the old mean fades all the same."""

    x: pd.Series
    alpha: float
    least: int = 0

    @classmethod
    def of_span(cls, x: pd.Series, span: float, least: int = 0) -> Mean:
        return cls(x, 2 / (span + 1), least)


Values = dict[str, pd.Series]


@dataclass(frozen=True)
class Stage:
    """Means (their names, and what makes them from a chunk's rows and the stages before).

    Of the rows that lead a chunk the stage cannot do with the first ``skip``,
    whose inputs reach further back.
    """

    names: tuple[str, ...]
    make: Callable[[pd.DataFrame, Values], dict[str, Mean]]
    skip: int = 0


def entered(y: float, rows: float, x: float, alpha: float) -> float:
    """The mean at a value ``x`` that comes ``rows`` after the last one, when it was ``y``."""
    if isnan(y):
        return x
    w = (1 - alpha) ** rows
    return (w * y + alpha * x) / (w + alpha)


def _factors(at: np.ndarray, alpha: float) -> np.ndarray:
    """How much of a change of the first value's mean is left at each of the values, at rows ``at``."""
    w = (1 - alpha) ** np.diff(at).astype(float)
    return np.r_[1.0, np.cumprod(w / (w + alpha))]


def plain(m: Mean) -> pd.Series:
    """The mean from a fresh start."""
    return m.x.ewm(alpha=m.alpha, adjust=False, min_periods=m.least).mean()


def resumed(m: Mean, state: tuple[float, float, float]) -> pd.Series:
    """The mean that goes on from ``state``: what a fresh start gives, corrected by what is left of the difference at the first value."""
    y, gap, n = state
    if not n:
        return plain(m)
    known = m.x.notna().to_numpy()
    at = np.flatnonzero(known)
    out = np.full(len(m.x), y)
    if len(at):
        first = float(m.x.iloc[at[0]])
        more = entered(y, gap + at[0] + 1, first, m.alpha) - first
        row = np.searchsorted(at, np.arange(at[0], len(out)), side="right") - 1
        out[at[0] :] = plain(Mean(m.x, m.alpha)).to_numpy()[at[0] :] + _factors(at, m.alpha)[row] * more
    return pd.Series(np.where(n + np.cumsum(known) >= max(m.least, 1), out, nan), index=m.x.index)


def affine(m: Mean) -> list[float]:
    """What a stretch does to a mean: rows, values, rows before the first value, that value, the factor of the mean there, the end from a fresh start, rows after the last value.

    The mean at the end is ``end + factor * (mean at the first value - first value)``: an affine map, so that stretches compose.
    """
    at = np.flatnonzero(m.x.notna().to_numpy())
    if not len(at):
        return [float(len(m.x)), 0.0, 0.0, nan, nan, nan, 0.0]
    end = float(plain(Mean(m.x, m.alpha)).iloc[-1])
    return [float(len(m.x)), float(len(at)), float(at[0]), float(m.x.iloc[at[0]]), float(_factors(at, m.alpha)[-1]), end, float(len(m.x) - 1 - at[-1])]


def after(state: tuple[float, float, float], stretch: list[float], alpha: float) -> tuple[float, float, float]:
    """The state of a mean behind a stretch."""
    (y, gap, n), (rows, values, lead, first, factor, end, trail) = state, stretch
    if not values:
        return y, gap + rows, n
    return end + factor * (entered(y, gap + lead + 1, first, alpha) - first), trail, n + values


def _values(f: pd.DataFrame, stages: list[Stage]) -> tuple[Values, dict[str, Mean]]:
    """All means of a chunk's rows, each from the state in its column, and their definitions."""
    got: Values = {}
    means: dict[str, Mean] = {}
    lead = bool((f["_lead"] > 0).any())
    for i, stage in enumerate(stages):
        skip = stage.skip if lead else 0
        carry = f[f"_carry{i}"].iloc[0] if f"_carry{i}" in f else None
        made = stage.make(f, got)
        for k, name in enumerate(stage.names):
            m = made[name]
            m = means[name] = Mean(m.x.astype(float).iloc[skip:], m.alpha, m.least)
            got[name] = resumed(m, NEW if carry is None else tuple(carry[3 * k : 3 * k + 3])).reindex(f.index)
    return got, means


def _sorted(f: pd.DataFrame, time: str) -> pd.DataFrame:
    return f.sort_values(time, kind="stable", ignore_index=True)


def _chunk_sums(rows: DataFrame, done: list[Stage], reach: int, size: int, entity: str, time: str, last: bool = False) -> DataFrame:
    """(entity, _chunk, _sum): the affine maps of the last stage of ``done``, 8 numbers a mean, of every chunk that another one follows (of all, if ``last``)."""
    stage = done[-1]

    def summed(f: pd.DataFrame) -> pd.DataFrame:
        f = _sorted(f, time)
        own = (f["_lead"] == 0).sum()
        if not own or (own < size and not last):  # no chunk comes behind it
            return f.iloc[:0][[entity, "_chunk"]].assign(_sum=pd.Series(dtype=object))
        _, means = _values(f, done)
        end = len(f) - reach + stage.skip  # where the next chunk's rows begin for this stage
        sums = []
        for name in stage.names:
            m = means[name]
            sums += [*affine(Mean(m.x.loc[: end - 1], m.alpha)), m.alpha]
        return f.iloc[:1][[entity, "_chunk"]].assign(_sum=[sums])

    kind = rows.schema[entity].dataType.simpleString()
    return checkpointed(rows.groupBy(entity, "_chunk").applyInPandas(summed, f"`{entity}` {kind}, _chunk long, _sum array<double>"))


def _compose(state: list | None, x: list | None) -> list | None:
    """The state of all means of a stage, 3 numbers each, after a chunk; a chunk without a sum asks only, one with 3 numbers a mean says where to begin."""
    if x is None:
        return state
    if len(x) % 8:
        return list(x)
    out: list[float] = []
    for k in range(len(x) // 8):
        before = NEW if state is None else tuple(state[3 * k : 3 * k + 3])
        out += after(before, list(x[8 * k : 8 * k + 7]), x[8 * k + 7])
    return out


def end_states(rows: DataFrame, stage: Stage, size: int = CHUNK, begun: DataFrame | None = None, entity: str = "ticker", time: str = "date") -> DataFrame:
    """(entity, _carry0): the state of a stage's means behind the last row of each entity.

    For stages whose inputs reach back as many rows as lead a chunk (``skip``).
    ``begun``: (entity, time, inputs, _carry0), the row before the first one and
    the state behind it, of entities that have more history than ``rows``.
    """
    cut, _ = chunked(checkpointed(rows), stage.skip, size, entity, time)
    if begun is not None:
        cut = cut.unionByName(begun.select(*rows.columns).withColumns({"_chunk": F.lit(0).cast("long"), "_lead": F.lit(1)}))
    sums = _chunk_sums(cut, [stage], stage.skip, size, entity, time, last=True)
    last = sums.groupBy(entity).agg((F.max("_chunk") + 1).alias("_chunk")).withColumn("_sum", F.lit(None).cast("array<double>"))
    sums = sums.unionByName(last)
    if begun is not None:  # also of those without new rows
        sums = sums.unionByName(begun.select(entity, F.lit(-1).cast("long").alias("_chunk"), F.col("_carry0").alias("_sum")))
        sums = sums.unionByName(begun.join(last, entity, "left_anti").select(entity, F.lit(0).cast("long").alias("_chunk"), F.lit(None).cast("array<double>").alias("_sum")))
    states = passed_on(sums, entity, _compose, "array<double>")
    return states.groupBy(F.col("_e").alias(entity)).agg(F.max_by("_carry", "_k").alias("_carry0"))


def scan_chunks(
    rows: DataFrame, several: bool, stages: list[Stage], finish: Callable[[pd.DataFrame, Values], dict], added: str, reach: int = 0, size: int = CHUNK, entity: str = "ticker", time: str = "date"
) -> DataFrame:
    """The own rows of chunks (:func:`chunked`, ``reach`` rows lead each) with what ``finish`` makes of them and their means, as the columns ``added`` (DDL).

    A prefix scan. For each stage, chunks are summed up as affine maps; the maps
    are composed along the entity, a row a chunk, which gives the state in which
    each chunk is entered; then all chunks are filled side by side. Entities of a
    single chunk take the last step alone.
    """
    names = [f.name for f in rows.schema if f.name not in ("_chunk", "_lead", "_carry0")]
    fields = [f for f in rows.schema if f.name in names]

    for i in range(len(stages) if several else 0):
        sums = _chunk_sums(rows, stages[: i + 1], reach, size, entity, time)
        # The last chunk has no sum of its own: an empty one asks for the state before it.
        asked = sums.unionByName(sums.selectExpr(f"`{entity}`", "_chunk + 1 AS _chunk", "cast(null AS array<double>) AS _sum"))
        asked = asked.groupBy(entity, "_chunk").agg(F.first("_sum", ignorenulls=True).alias("_sum"))
        rows = with_carry(rows, passed_on(asked, entity, _compose, "array<double>"), entity, f"_carry{i}")

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f = _sorted(f, time)
        got, _ = _values(f, stages)
        out = f.assign(**finish(f, got))
        return out.loc[out["_lead"] == 0, [*names, *new]]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), added])
    new = [x.split()[0].strip("`") for x in added.split(", ")]
    return rows.groupBy(entity, "_chunk").applyInPandas(fill, schema)


def scan(df: DataFrame, stages: list[Stage], finish: Callable[[pd.DataFrame, Values], dict], added: str, reach: int = 0, size: int = CHUNK, entity: str = "ticker", time: str = "date") -> DataFrame:
    """:func:`scan_chunks` of the whole ``df``."""
    rows, several = chunked(checkpointed(df), reach, size, entity, time)
    return scan_chunks(rows, several, stages, finish, added, reach, size, entity, time)


def rsi_means(close: pd.Series, window: int = 14) -> dict[str, Mean]:
    """Wilder's means of gains and losses; their first row needs the close before it."""
    step = close.astype(float).diff()
    return {"gain": Mean(step.clip(lower=0), 1 / window, window), "loss": Mean((-step).clip(lower=0), 1 / window, window)}


def rsi(f: pd.DataFrame, got: Values, window: int = 14) -> pd.Series:
    """Relative strength index, 0 to 100, of a chunk's rows; 50 where it is not yet defined or the history is shorter than the window."""
    x = 100 - 100 / (1 + got["gain"] / (got["loss"] + 1e-9))
    short = len(f) < window and not (f["_lead"] > 0).any()
    return (x * nan if short else x).fillna(50.0).clip(0, 100)


def held(x: pd.Series, limit: float = 500) -> pd.Series:
    """Missing and infinite values 0, others held to +-``limit``."""
    return x.replace([np.inf, -np.inf], nan).fillna(0.0).clip(-limit, limit)
