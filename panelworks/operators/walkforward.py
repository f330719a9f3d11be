"""Walk-forward evaluation: folds, positions, period returns and metrics, all folds in one job."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import clip
from ..functions.lineage import checkpointed

_EPS = 1e-9


def date_index(panel: DataFrame) -> DataFrame:
    """(idx, date): the panel's dates numbered from 0; a row a date."""
    return panel.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)


def folds(dates: DataFrame, window: int = 252, step: int = 63, embargo: int = 5, least_test: int = 20, horizon: int = 5) -> DataFrame:
    """(fold, train_lo, train_hi, test_lo, test_hi, train_end): index ranges of rolling folds over ``dates`` (idx, date).

    train_end: training rows must lie before this date, ``embargo`` calendar days
    before the test. A fold has ``least_test`` test dates, the last one may be shorter than a step.
    """
    n = dates.agg(F.count("*").alias("n"))
    starts = n.select("n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(n - {window + horizon}) div {step}")))).alias("fold"))
    start = F.col("fold") * step + window
    rows = starts.select("fold", (start - window).alias("train_lo"), (start - 1).alias("train_hi"), start.alias("test_lo"), F.least(start + step - 1, F.col("n") - 1).alias("test_hi"), "n")
    rows = rows.where((F.col("test_lo") < F.col("n") - horizon) & (F.col("test_hi") - F.col("test_lo") + 1 >= least_test)).drop("n")
    return rows.join(dates.select(F.col("idx").alias("test_lo"), F.date_sub("date", embargo).alias("train_end")), "test_lo").select(
        "fold", "train_lo", "train_hi", "test_lo", "test_hi", "train_end"
    )


def assign(panel: DataFrame, dates: DataFrame, plan: DataFrame, part: str = "test") -> DataFrame:
    """Rows of each fold's train or test range: the folds' date numbers, a row each, joined to those of the panel."""
    held = plan.select("fold", "train_end", F.explode(F.sequence(f"{part}_lo", f"{part}_hi")).alias("idx"))
    rows = panel.join(dates, "date").join(held, "idx")
    if part == "train":
        rows = rows.where(F.col("date") < F.col("train_end"))
    return rows.select("fold", "idx", *panel.columns)


def rebalance_dates(plan: DataFrame, dates: DataFrame, horizon: int = 5) -> DataFrame:
    """(fold, entry, exit): every ``horizon``-th test date and the one ``horizon`` later, both inside the test range."""
    steps = plan.withColumn("idx", F.explode(F.sequence("test_lo", "test_hi", F.lit(horizon)))).where(F.col("idx") + horizon <= F.col("test_hi"))
    entry = dates.select("idx", F.col("date").alias("entry"))
    exit_ = dates.select((F.col("idx") - horizon).alias("idx"), F.col("date").alias("exit"))
    return steps.select("fold", "idx").join(entry, "idx").join(exit_, "idx").select("fold", "entry", "exit")


def long_short_positions(scored: DataFrame, trades: DataFrame, k: int = 8, cap: float = 0.20, score: str = "score") -> DataFrame:
    """(fold, entry, exit, ticker, weight): softmax-weighted best and worst ``k`` names of every rebalance date.

    Only names that also trade on the exit date count, and at least ``k`` are
    needed. Scores are clipped to their 1 and 99 % quantiles and standardised;
    a name on both sides keeps its short weight.
    """
    at_exit = scored.select(F.col("date").alias("exit"), "ticker").distinct()
    rows = scored.select("ticker", F.col("date").alias("entry"), F.col(score).alias("s")).where("s is not null")
    rows = rows.join(trades, "entry").join(at_exit, ["exit", "ticker"], "left_semi")
    period = ["fold", "entry", "exit"]
    ends = rows.groupBy(*period).agg(F.count("*").alias("n"), F.stddev_pop("s").alias("raw"), F.percentile("s", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    rows = rows.join(ends.where((F.col("n") >= k) & (F.col("raw") >= 1e-6)), period)
    rows = rows.withColumn("s", F.when(F.col("n") >= 5, clip(F.col("s"), F.col("q")[0], F.col("q")[1])).otherwise(F.col("s")))
    w = Window.partitionBy(*period)
    rows = rows.withColumn("sd", F.stddev_pop("s").over(w)).where(F.col("sd") >= _EPS)
    rows = rows.withColumn("z", (F.col("s") - F.avg("s").over(w)) / (F.col("sd") + _EPS))
    up = F.row_number().over(w.orderBy(F.desc("z"), F.desc("ticker")))
    down = F.row_number().over(w.orderBy("z", "ticker"))
    rows = rows.withColumn("up", up).withColumn("down", down)
    sides = rows.where(F.col("up") <= k).select(*period, "ticker", F.lit(1.0).alias("side"), F.col("z").alias("x"))
    sides = sides.unionByName(rows.where(F.col("down") <= k).select(*period, "ticker", F.lit(-1.0).alias("side"), F.abs("z").alias("x")))
    v = Window.partitionBy(*period, "side")
    e = F.exp(F.col("x") - F.max("x").over(v))
    sides = sides.withColumn("e", e).withColumn("weight", F.col("side") * F.least(F.lit(cap), F.col("e") / (F.sum("e").over(v) + _EPS)))
    return sides.groupBy(*period, "ticker").agg(F.min_by("weight", "side").alias("weight"))


def period_returns(positions: DataFrame, bars: DataFrame, slippage: float = 0.0005, cost: float = 0.0008) -> DataFrame:
    """(fold, entry, exit, r): log return of each period after slippage and costs, held to +-0.25."""
    price_in = bars.select("ticker", F.col("date").alias("entry"), F.col("close").alias("p"))
    price_out = bars.select("ticker", F.col("date").alias("exit"), F.col("close").alias("q"))
    rows = positions.join(price_in, ["ticker", "entry"]).join(price_out, ["ticker", "exit"])
    r = F.log(F.col("q") * (1 - slippage)) - F.log(F.col("p") * (1 + slippage))
    each = F.sum(F.col("weight") * r - F.abs("weight") * cost)
    return rows.groupBy("fold", "entry", "exit").agg(clip(each, -0.25, 0.25).alias("r"))


def turnover(positions: DataFrame) -> DataFrame:
    """(fold, entry, turnover): absolute weight changes against the fold's period before, the first against nothing."""
    periods = positions.select("fold", "entry").distinct()
    periods = periods.withColumn("k", F.row_number().over(Window.partitionBy("fold").orderBy("entry")))
    rows = positions.join(periods, ["fold", "entry"])
    moves = rows.select("fold", "k", "ticker", F.col("weight").alias("d")).union(rows.select("fold", (F.col("k") + 1).alias("k"), "ticker", (-F.col("weight")).alias("d")))
    each = moves.groupBy("fold", "k", "ticker").agg(F.sum("d").alias("d")).groupBy("fold", "k").agg(F.sum(F.abs("d")).alias("turnover"))
    return each.join(periods, ["fold", "k"]).select("fold", "entry", "turnover")


def equity_from_log_returns(periods: DataFrame, start: float = 10_000.0, floor: float = 1.0, top: float = 10_000_000.0) -> DataFrame:
    """(step, fold, entry, r, equity): capital after each period, floored and capped at every step.

    The periods of one run are few (folds x periods a fold), so their ordered list
    is folded in one expression.
    """
    ordered = periods.agg(F.array_sort(F.collect_list(F.struct("fold", "entry", "r"))).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        value = F.least(F.lit(top), F.greatest(F.lit(floor), F.element_at(acc, -1) * F.exp(x["r"])))
        return F.concat(acc, F.array(value))

    curve = F.slice(F.aggregate("p", F.array(F.lit(start)), step), 2, F.greatest(F.size("p"), F.lit(1)))
    zipped = ordered.select(F.posexplode(F.arrays_zip(F.col("p"), curve.alias("equity"))).alias("step", "x"))
    return zipped.select("step", "x.p.fold", "x.p.entry", "x.p.r", "x.equity")


def fold_metrics(periods: DataFrame, turnovers: DataFrame, horizon: int = 5, bars_per_year: int = 252, least: int = 2) -> DataFrame:
    """Per fold of ``least`` periods: strategy_return, sharpe (+-5), turnover, trades, win_rate."""
    rows = periods.join(turnovers, ["fold", "entry"])
    sd = F.stddev_pop("r")
    sharpe = F.when(sd < _EPS, 0.0).otherwise(F.least(F.lit(5.0), F.greatest(F.lit(-5.0), F.avg("r") / sd * (bars_per_year / horizon) ** 0.5)))
    out = rows.groupBy("fold").agg(
        F.sum("r").alias("strategy_return"), sharpe.alias("sharpe"), F.avg("turnover").alias("turnover"), F.count("*").alias("trades"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate")
    )
    return out.where(F.col("trades") >= least)


def walk_forward_metrics(each: DataFrame, curve: DataFrame) -> DataFrame:
    """One row: means over folds, profit factor, spread, maximum drawdown, final equity, windows."""
    s = F.col("strategy_return")
    gains = F.coalesce(F.sum(F.when(s > 0, s)), F.lit(0.0))
    losses = F.abs(F.coalesce(F.sum(F.when(s < 0, s)), F.lit(0.0)))
    one = each.agg(
        F.avg(s).alias("avg_strategy_return"),
        F.avg("sharpe").alias("avg_sharpe"),
        (gains / F.when(losses == 0, 1e-6).otherwise(losses)).alias("profit_factor"),
        F.stddev_samp(s).alias("return_volatility"),
        F.avg("turnover").alias("avg_turnover"),
        F.avg("win_rate").alias("avg_win_rate"),
        F.avg("trades").alias("avg_trades_per_window"),
        F.count("*").alias("num_windows"),
    )
    peak = F.max("equity").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # a row a period
    curve = curve.withColumn("dd", F.col("equity") / peak - 1)
    end = curve.agg(F.min("dd").alias("max_drawdown"), F.max_by("equity", "step").alias("final_equity"))
    return one.withColumn("_", F.lit(1)).join(end.withColumn("_", F.lit(1)), "_").drop("_")


Trainer = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def side_by_side(tasks: list[Callable[[], DataFrame]], spark: SparkSession, at_once: int, pool: str = "folds") -> list[DataFrame]:
    """What the tasks give, in their order; up to ``at_once`` of them submit their jobs from threads of their own, to a scheduler pool of their own."""

    def run(task: Callable[[], DataFrame]) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            return task()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=at_once) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(spark)(run), t) for t in tasks]]


def walk_forward(panel: DataFrame, score: Column | Trainer, window: int = 252, step: int = 63, at_once: int = 1, **plan_options) -> dict[str, DataFrame]:
    """positions, periods, folds, curve and summary of a walk-forward run.

    score: a column expression, which needs no fit and keeps all folds in one
    job, or a trainer, called once a fold with the fold's training rows, whose
    result adds ``score`` to the fold's test rows. Folds do not depend on each
    other: up to ``at_once`` are fitted side by side, and the scores of each are
    checkpointed where it is fitted. The panel is read several times: hand over a
    table or a checkpointed frame.
    """
    dates = checkpointed(date_index(panel))  # a row a date, a fold, a period
    plan = checkpointed(folds(dates, window, step, **plan_options))
    trades = checkpointed(rebalance_dates(plan, dates))
    if isinstance(score, Column):
        scored = panel.select("ticker", "date", score.alias("score"))
        positions = long_short_positions(scored, trades)
    else:

        def fold(number: int) -> DataFrame:
            one = plan.where(F.col("fold") == number)
            predict = score(assign(panel, dates, one, "train"))
            test = checkpointed(predict(assign(panel, dates, one, "test")).select("ticker", "date", "score"))
            return long_short_positions(test, trades.where(F.col("fold") == number))

        numbers = sorted(r["fold"] for r in plan.select("fold").collect())  # tens of folds
        if not numbers:
            raise ValueError("too few dates for a fold")
        parts = side_by_side([lambda k=k: fold(k) for k in numbers], panel.sparkSession, at_once)
        positions = reduce(DataFrame.unionByName, parts)
    positions = checkpointed(positions)  # a few names a period
    periods = checkpointed(period_returns(positions, panel))
    each = fold_metrics(periods, checkpointed(turnover(positions)))
    curve = equity_from_log_returns(periods)
    return {"positions": positions, "periods": periods, "folds": each, "curve": curve, "summary": walk_forward_metrics(each, curve)}
