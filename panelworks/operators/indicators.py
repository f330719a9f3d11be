"""Technical indicators of a price column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ewm as E
from ..functions.chunks import CHUNK
from ..functions.ewm import Mean, Stage
from ..functions.expr import clean_num, clip, ratio, with_least
from ..functions.windows import by_entity, trailing


def sma(df: DataFrame, col: str = "close", window: int = 20) -> DataFrame:
    """``sma``: mean of ``window`` bars, all of them needed."""
    if window < 2:
        raise ValueError("a window has two bars at least")
    w = trailing(window)
    return df.withColumn("sma", with_least(window, F.col(col), w, F.avg(col).over(w)))


def bollinger(df: DataFrame, col: str = "close", window: int = 20, width: float = 2.0) -> DataFrame:
    """bb_mid, bb_upper, bb_lower: mean and ``width`` population standard deviations around it."""
    w = trailing(window)
    mid = with_least(window, F.col(col), w, F.avg(col).over(w))
    spread = F.greatest(F.stddev_pop(col).over(w), F.lit(1e-6)) * width
    return df.withColumn("bb_mid", mid).withColumn("_s", spread).withColumns({"bb_upper": F.col("bb_mid") + F.col("_s"), "bb_lower": F.col("bb_mid") - F.col("_s")}).drop("_s")


def ema(df: DataFrame, col: str = "close", span: int = 20, size: int = CHUNK) -> DataFrame:
    """``ema``: exponentially weighted mean; histories of over ``size`` bars are cut into chunks."""
    stage = Stage(("ema",), lambda f, _: {"ema": Mean.of_span(f[col], span)})
    return E.scan(df, [stage], lambda f, got: {"ema": got["ema"]}, "ema double", size=size)


def rsi(df: DataFrame, col: str = "close", window: int = 14, size: int = CHUNK) -> DataFrame:
    """``rsi``: Wilder's index, 0 to 100."""
    stage = Stage(("gain", "loss"), lambda f, _: E.rsi_means(f[col], window), skip=1)
    return E.scan(df, [stage], lambda f, got: {"rsi": E.rsi(f, got, window)}, "rsi double", reach=1, size=max(size, window))


def macd(df: DataFrame, col: str = "close", size: int = CHUNK) -> DataFrame:
    """``macd`` (EWM12 - EWM26) and ``macd_signal`` (its EWM9); missing 0, held to +-500."""

    def line(got: E.Values) -> pd.Series:
        return got["fast"] - got["slow"]

    stages = [
        Stage(("fast", "slow"), lambda f, _: {"fast": Mean.of_span(f[col], 12), "slow": Mean.of_span(f[col], 26)}),
        Stage(("signal",), lambda _, got: {"signal": Mean.of_span(line(got), 9)}),
    ]
    return E.scan(df, stages, lambda _, got: {"macd": E.held(line(got)), "macd_signal": E.held(got["signal"])}, "macd double, macd_signal double", size=size)


def sanitize_close(df: DataFrame, limit: float = 0.80) -> DataFrame:
    """Closes without holes; those of a ticker with a return over ``limit`` clipped to its 0.1 % and 99.9 % quantiles.

    Tickers with a close of 0 or less make the job fail.
    """
    w = by_entity()
    df = df.withColumn("_c", clean_num(F.col("close")))
    before = F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_c", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_c", F.coalesce(before, after))
    df = df.withColumn("close", F.when(F.col("_c") > 0, F.col("_c")).otherwise(F.raise_error(F.lit("a close is 0 or less")).cast("double"))).drop("_c")
    df = df.withColumn("_r", F.abs(ratio(F.col("close"), F.lag("close").over(w)) - 1))
    ends = df.groupBy("ticker").agg(F.max("_r").alias("_most"), F.percentile("close", F.array(F.lit(0.001), F.lit(0.999))).alias("_q"))
    held = F.when(F.col("_most") > limit, clip(F.col("close"), F.col("_q")[0], F.col("_q")[1])).otherwise(F.col("close"))
    return df.join(ends, "ticker").withColumn("close", held).drop("_r", "_most", "_q")
