"""Rank correlation and spreads of scores against returns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import pct_rank
from ..functions.wide import each_width, rank_shares
from ..functions.windows import by_date, ranked


def daily_ic(df: DataFrame, score: str = "score", ret: str = "forward_return", least: int = 5, by: str | list[str] = "date", wide: int | None = None) -> DataFrame:
    """ic (Spearman) and n of every date with ``least`` pairs and two different returns.

    With ``wide``, dates of more pairs are ranked over many tasks; ``by`` is then the date.
    """
    keys = [by] if isinstance(by, str) else by
    pairs = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())

    def narrow(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, ret, pct_rank(F.col(score), ranked(score, keys)).alias("_a"), pct_rank(F.col(ret), ranked(ret, keys)).alias("_b"))

    def broad(rows: DataFrame) -> DataFrame:
        rows = rank_shares(rows.select("date", score, ret), [score, ret])
        return rows.select("date", ret, F.col("_ranks")[score].alias("_a"), F.col("_ranks")[ret].alias("_b"))

    if wide is not None and keys != ["date"]:
        raise ValueError("wide groups are dates")
    ranks = each_width(pairs, wide, narrow, broad)
    each = ranks.groupBy(*keys).agg(F.corr("_a", "_b").alias("ic"), F.count("*").alias("n"), F.min(ret).alias("_lo"), F.max(ret).alias("_hi"))
    return each.where((F.col("n") >= least) & (F.col("_lo") < F.col("_hi"))).select(*keys, "ic", "n")


def quantile_spreads(df: DataFrame, score: str = "score", ret: str = "forward_return", least: int = 10) -> DataFrame:
    """Per date of ``least`` names: mean return of the top less the bottom fifth, and tenth."""
    w = by_date()
    low = Window.partitionBy("date").orderBy(F.col(score), F.col("ticker"))
    rows = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    rows = rows.select("date", ret, F.row_number().over(low).alias("_lo"), F.count("*").over(w).alias("n"))
    rows = rows.where(F.col("n") >= least).withColumn("_hi", F.col("n") - F.col("_lo") + 1)

    def spread(parts: int):
        k = F.greatest(F.lit(1), F.expr(f"n div {parts}"))
        return F.avg(F.when(F.col("_hi") <= k, F.col(ret))) - F.avg(F.when(F.col("_lo") <= k, F.col(ret)))

    return rows.groupBy("date").agg(spread(5).alias("quintile_spread"), spread(10).alias("decile_spread"), F.first("n").alias("n"))


def ranking_metrics(df: DataFrame, score: str = "score", ret: str = "forward_return", horizon: int = 5, bars_per_year: int = 252) -> DataFrame:
    """One row: mean IC, mean spreads, Sharpe of the quintile spreads, spreads of score and return, hit rate, counts."""
    rows = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    hit = F.avg(F.when(F.col(ret) != 0, (F.signum(score) == F.signum(ret)).cast("double")))
    whole = rows.agg(
        F.stddev_pop(score).alias("score_std"), F.stddev_pop(ret).alias("return_std"), hit.alias("hit_rate"), F.count("*").alias("samples"), F.countDistinct("date").alias("dates")
    )
    ic = daily_ic(rows, score, ret).agg(F.avg("ic").alias("mean_ic"))
    s = F.col("quintile_spread")
    sharpe = F.when(F.stddev_samp(s) > 1e-12, F.avg(s) / F.stddev_samp(s) * (bars_per_year / horizon) ** 0.5).otherwise(0.0)
    spread = quantile_spreads(rows, score, ret).agg(F.avg(s).alias("quintile_spread"), F.avg("decile_spread").alias("decile_spread"), sharpe.alias("spread_sharpe"))
    one = F.lit(1)
    # Three aggregates of one row each.
    return whole.withColumn("_", one).join(ic.withColumn("_", one), "_").join(spread.withColumn("_", one), "_").drop("_")


def ic_stats(predictions: DataFrame, returns: DataFrame, days: int | None = None, least: int = 10, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """(daily, summary): rounded daily ICs of the last ``days`` days, and their mean, spread, t value and verdict."""
    rows = predictions
    if days is not None:
        last = predictions.agg(F.max("date").alias("_last"))
        rows = rows.join(F.broadcast(last), F.col("date") >= F.date_sub("_last", days)).drop("_last")  # one row
    pairs = rows.join(returns.select("ticker", "date", "forward_return"), ["date", "ticker"])
    daily = daily_ic(pairs, score, least=least).withColumn("ic", F.round("ic", 6))
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("*")
    one = daily.agg(m.alias("mean_ic"), s.alias("ic_std"), n.alias("dates"))
    t = F.col("mean_ic") / (F.col("ic_std") / F.sqrt("dates") + 1e-9)
    a = F.abs("mean_ic")
    quality = F.when(a >= 0.08, "strong").when(a >= 0.04, "moderate").when(a >= 0.02, "weak").otherwise("noise")
    return daily, one.withColumn("t_value", t).withColumn("quality", quality)


def _t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    from math import lgamma

    out = np.empty(len(t))
    for k, (tv, nu) in enumerate(zip(t, df)):
        x, a, b = nu / (nu + tv * tv), nu / 2, 0.5
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            x, a, b = 1 - x, b, a
        if x <= 0:
            p = 0.0
        else:
            front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
            c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
            f = d
            for m in range(1, 300):
                for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d = 1 + num * d
                    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                    c = 1 + num / c
                    c = c if abs(c) > 1e-300 else 1e-300
                    f *= c * d
                if abs(c * d - 1) < 1e-14:
                    break
            p = front * f
        out[k] = 1 - p if flip else p
    return out


def _p_values(ic: pd.Series, n: pd.Series) -> pd.Series:
    r, nu = ic.to_numpy(dtype=float), n.to_numpy(dtype=float) - 2
    ok = np.isfinite(r) & (nu > 0)
    out = np.full(len(r), np.nan)
    sure = ok & (np.abs(r) >= 1)
    out[sure] = 0.0
    rest = ok & ~sure
    out[rest] = _t_tail(r[rest] * np.sqrt(nu[rest] / (1 - r[rest] ** 2)), nu[rest])
    return pd.Series(out)


def spearman_p(ic: Column, n: Column) -> Column:
    """Two-sided p value of a rank correlation over ``n`` pairs; NULL where it has none."""
    p = F.pandas_udf(_p_values, "double")(ic, n)
    return F.when(~F.isnan(p), p)


def ic_p_values(daily: DataFrame) -> DataFrame:
    """``daily`` (ic, n) with p_value: one row a date."""
    return daily.withColumn("p_value", spearman_p(F.col("ic"), F.col("n")))


