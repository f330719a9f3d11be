"""Portfolio returns, curves and ratios, keyed by portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip

_EPS = 1e-12
_FIRST = Window.unboundedPreceding


def portfolio_daily(weights: DataFrame, returns: DataFrame, ret: str = "forward_return", key: str | None = None) -> DataFrame:
    """date, r: weighted returns summed per date (and ``key``); single returns held to +-0.8, sums to +-0.5."""
    rows = weights.join(returns.select("date", "ticker", ret), ["date", "ticker"]).dropna(subset=["weight", ret])
    keys = [*([key] if key else []), "date"]
    return rows.groupBy(*keys).agg(clip(F.sum(F.col("weight") * clip(F.col(ret), -0.8, 0.8)), -0.5, 0.5).alias("r"))


def _w(key: str | None):
    return Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))


def equity_curve(daily: DataFrame, key: str | None = None) -> DataFrame:
    """``daily`` with equity (product of 1 + r, floored at 0) and drawdown against its running maximum."""
    w = _w(key).orderBy("date").rowsBetween(_FIRST, 0)
    rows = daily.withColumn("equity", F.greatest(F.lit(0.0), F.product(1 + F.col("r")).over(w)))
    return rows.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(w)) - 1)


def drawdown_duration(curve: DataFrame, key: str | None = None) -> DataFrame:
    """duration: the longest run of dates under the running maximum (by more than rounding)."""
    w = _w(key).orderBy("date").rowsBetween(_FIRST, 0)
    rows = curve.withColumn("_u", F.col("equity") < F.max("equity").over(w) * (1 - 1e-12))
    rows = rows.withColumn("_island", F.sum((~F.col("_u")).cast("int")).over(w))
    keys = [key] if key else []
    runs = rows.groupBy(*keys, "_island").agg(F.count_if("_u").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("duration"))


def _ratio(a: Column, b: Column, factor: float) -> Column:
    return F.when(b > _EPS, a / b * factor).otherwise(0.0)


def performance_report(daily: DataFrame, benchmark: DataFrame | None = None, key: str | None = None, bars_per_year: int = 252) -> DataFrame:
    """One row a portfolio: returns, ratios and, against a benchmark (date, b), tracking error, beta, information ratio."""
    year = bars_per_year**0.5
    keys = [key] if key else []
    rows = equity_curve(daily, key)
    r = F.col("r")
    down = F.stddev_samp(F.when(r < 0, r))
    n = F.count(r)
    growth = F.product(1 + r)
    annual = F.pow(F.least(F.greatest(growth, F.lit(0.0)), F.lit(1e6)), bars_per_year / n) - 1
    one = rows.groupBy(*keys).agg(
        (growth - 1).alias("cumulative_return"),
        annual.alias("annual_return"),
        _ratio(F.avg(r), F.stddev_samp(r), year).alias("sharpe"),
        F.coalesce(_ratio(F.avg(r), down, year), F.lit(0.0)).alias("sortino"),
        F.when(F.stddev_samp(r) > _EPS, F.stddev_samp(r) * year).otherwise(0.0).alias("volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.when(n > 2, F.skewness(r) * F.sqrt(n * (n - 1.0)) / (n - 2)).otherwise(0.0).alias("skewness"),
        F.coalesce(down * year, F.lit(0.0)).alias("downside_deviation"),
        n.alias("days"),
    )
    one = one.withColumn("calmar", F.when(F.abs("max_drawdown") > _EPS, F.col("annual_return") / F.abs("max_drawdown")).otherwise(0.0))
    if benchmark is None:
        return one
    both = daily.join(benchmark.select("date", "b"), "date")
    gap = F.col("r") - F.col("b")
    spread = F.stddev_samp(gap)
    more = both.groupBy(*keys).agg(
        F.when(spread > _EPS, spread * year).alias("tracking_error"),
        F.when(F.var_samp("b") > _EPS, F.covar_samp("r", "b") / F.var_samp("b")).alias("beta"),
        F.when(spread > _EPS, F.avg(gap) / spread * year).alias("information_ratio"),
    )
    if key:
        return one.join(more, key, "left")
    return one.withColumn("_", F.lit(1)).join(more.withColumn("_", F.lit(1)), "_").drop("_")


def portfolio_turnover(weights: DataFrame) -> DataFrame:
    """turnover: mean over dates, from the second on, of half the absolute weight changes.

    A row counts with its weight on its date and against it on the next date of
    the panel, so one aggregate by (date, ticker) gives the changes; no pivot.
    """
    dates = weights.select("date").distinct()
    following = dates.withColumn("_next", F.lead("date").over(Window.orderBy("date")))  # a row a date
    moved = weights.select("date", "ticker", F.coalesce("weight", F.lit(0.0)).alias("weight")).join(following, "date")
    now = moved.select("date", "ticker", F.col("weight").alias("_d"))
    then = moved.where("_next is not null").select(F.col("_next").alias("date"), "ticker", (-F.col("weight")).alias("_d"))
    change = now.union(then).groupBy("date", "ticker").agg(F.sum("_d").alias("_d"))
    first = dates.agg(F.min("date").alias("_first"))
    each = change.join(F.broadcast(first), F.col("date") > F.col("_first")).groupBy("date").agg((F.sum(F.abs("_d")) * 0.5).alias("_t"))  # one row
    return each.agg(F.coalesce(F.avg("_t"), F.lit(0.0)).alias("turnover"))


def _rolling(daily: DataFrame, window: int, key: str | None, value, name: str) -> DataFrame:
    w = _w(key).orderBy("date").rowsBetween(-(window - 1), 0)
    full = F.count("r").over(w) >= window
    return daily.withColumn(name, F.coalesce(F.when(full, value(w)), F.lit(0.0)))


def rolling_sharpe(daily: DataFrame, window: int = 63, key: str | None = None, bars_per_year: int = 252) -> DataFrame:
    """``rolling_sharpe`` over full windows, 0 before."""
    return _rolling(daily, window, key, lambda w: F.try_divide(F.avg("r").over(w), F.stddev_samp("r").over(w)) * bars_per_year**0.5, "rolling_sharpe")


def rolling_volatility(daily: DataFrame, window: int = 63, key: str | None = None, bars_per_year: int = 252) -> DataFrame:
    """``rolling_volatility`` over full windows, 0 before."""
    return _rolling(daily, window, key, lambda w: F.stddev_samp("r").over(w) * bars_per_year**0.5, "rolling_volatility")


def performance_by_ticker(returns: DataFrame, ret: str = "forward_return") -> DataFrame:
    """The report of every ticker held alone with weight 1; one job keyed by ticker."""
    daily = returns.select("ticker", "date", clip(clip(F.col(ret), -0.8, 0.8), -0.5, 0.5).alias("r")).dropna(subset=["r"])
    report = performance_report(daily, key="ticker")
    return report.join(drawdown_duration(equity_curve(daily, "ticker"), "ticker"), "ticker")


def promotion_gates(metrics: DataFrame, baseline_sharpe: float | None = None) -> DataFrame:
    """``metrics`` (sharpe, max_drawdown, windows, drift) with the failed rules and whether it passes."""
    rules = {
        "sharpe": F.col("sharpe") < 0.10,
        "drawdown": F.col("max_drawdown") < -0.60,
        "windows": F.col("windows") < 5,
        "drift": F.col("drift") > 8,
        "sharpe_loss": F.lit(False) if baseline_sharpe is None else F.col("sharpe") < baseline_sharpe - 0.10,
    }
    failed = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return metrics.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)
