"""Targets, forward returns and summaries of returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, ratio
from ..functions.windows import by_date, by_entity, trailing
from .quality import tail_per_ticker


def _log_ahead(df: DataFrame, horizon: int, entity: list[str]) -> DataFrame:
    ahead = F.log(F.lead("close", horizon).over(by_entity(entity))) - F.log("close")
    return df.withColumn("_ahead", ahead).where("_ahead is not null")


def cs_target(df: DataFrame, horizon: int = 5) -> DataFrame:
    """``target``: log return over the next ``horizon`` bars, standardised within the date and held to +-5."""
    w = by_date()
    z = ratio(F.col("_ahead") - F.avg("_ahead").over(w), F.stddev_samp("_ahead").over(w))
    return _log_ahead(df, horizon, ["ticker"]).withColumn("target", clip(z, -5, 5)).where("target is not null").drop("_ahead")


def fold_target(df: DataFrame, horizon: int = 5, fold: str = "fold") -> DataFrame:
    """``cs_target`` inside each fold, on positive closes; folds whose targets hardly vary give no rows."""
    rows = _log_ahead(df.where("close > 0"), horizon, [fold, "ticker"])
    w = by_date([fold, "date"])
    z = (F.col("_ahead") - F.avg("_ahead").over(w)) / (F.stddev_samp("_ahead").over(w) + 1e-9)
    rows = rows.withColumn("target", clip(z, -5, 5)).where("target is not null").drop("_ahead")
    alive = rows.groupBy(fold).agg(F.stddev_samp("target").alias("_s")).where("_s >= 1e-6")
    return rows.join(alive, fold, "left_semi")


def forward_return(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """``forward_return``: the next bar's change, held to +-``limit``; last bars drop out."""
    ahead = ratio(F.lead("close").over(by_entity()), F.col("close")) - 1
    return df.withColumn("forward_return", clip(ahead, -limit, limit)).where("forward_return is not null")


def last_n_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` latest dates of the panel."""
    latest = df.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return df.join(latest, "date", "left_semi")


def equal_weights(df: DataFrame) -> DataFrame:
    """``weight``: 1 / number of tickers on the date."""
    return df.withColumn("weight", 1 / F.count("*").over(by_date()))


def equity_summary(bars: DataFrame, bars_per_year: int = 252) -> DataFrame:
    """Per ticker: its latest bar, returns over 5 and 20 bars, annualised volatility of 20 returns, rows."""
    w = by_entity()
    df = bars.withColumn("_r", ratio(F.col("close"), F.lag("close").over(w)) - 1)
    t20 = trailing(20)
    df = df.withColumns({
        "return_5": ratio(F.col("close"), F.lag("close", 5).over(w)) - 1,
        "return_20": ratio(F.col("close"), F.lag("close", 20).over(w)) - 1,
        "volatility_20": F.when(F.count("_r").over(t20) >= 20, F.stddev_samp("_r").over(t20) * bars_per_year**0.5),
        "rows": F.count("*").over(Window.partitionBy("ticker")),
        "_n": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))),
    })
    return df.where("_n = 1").drop("_n", "_r")


def price_history(bars: DataFrame, ticker: str, n: int) -> DataFrame:
    """The ticker's last ``n`` bars, oldest first, prices rounded to 4 digits, volume whole."""
    rows = tail_per_ticker(bars.where(F.col("ticker") == ticker), n)
    return rows.select("ticker", "date", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long").alias("volume")).orderBy("date")
