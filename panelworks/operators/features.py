"""Per-entity window features, cross-sectional features and the whole feature pipeline."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import windows
from ..functions.chunks import CHUNK, chunked, own_rows
from ..functions.ewm import Mean, Stage, Values, rsi, rsi_means, scan, scan_chunks
from ..functions.expr import clip, median3, pct_rank, ratio, with_least
from ..functions.lineage import checkpointed, small
from ..functions.wide import WIDE, each_width, quantiles, rank_shares
from ..functions.windows import by_date, ranked
from .quality import fill_missing, price_gates
from .regimes import regime_by_date

#: The order of the model's columns.
CORE_FEATURES = [
    "return", "return_lag1", "return_lag5", "return_mean_20", "reversal_5", "momentum_20", "momentum_60", "momentum_composite", "mom_vol_adj",
    "momentum_regime_interaction", "volatility", "volatility_20", "vol_of_vol", "return_skew_20", "volume_momentum", "dollar_volume", "amihud",
    "rsi", "ema_ratio", "dist_from_52w_high", "regime_feature", "market_dispersion", "breadth", "regime_multiplier",
]
CROSS_SECTIONAL = [
    "momentum_20", "momentum_60", "momentum_composite", "mom_vol_adj", "momentum_regime_interaction", "return_lag5", "return_mean_20", "reversal_5",
    "rsi", "volatility", "vol_of_vol", "return_skew_20", "ema_ratio", "volume_momentum", "dollar_volume", "dist_from_52w_high", "regime_feature",
    "amihud", "market_dispersion", "breadth",
]
MODEL_FEATURES = [*CORE_FEATURES, *(f"{c}_z" for c in CROSS_SECTIONAL), *(f"{c}_rank" for c in CROSS_SECTIONAL)]
_TINY = 1e-9


#: Bars before a chunk that its frames reach: the 52-week high looks 253 back; the level of volatility 60 + 21 + 3.
REACH = 256


def window_features(bars: DataFrame, size: int | None = None) -> DataFrame:
    """All features of a ticker's own history that frames can express; one shuffle and one sort by (ticker, date).

    With ``size``, histories of over that many bars are cut into chunks, so that
    one ticker is the work of many tasks; else a ticker is one task's, which spills.
    """
    if size is None:
        return _windows(bars, "ticker")
    rows, _ = chunked(checkpointed(bars), REACH, size)
    return own_rows(_windows(rows, ["ticker", "_chunk"]))


def _windows(bars: DataFrame, entity: str | list[str]) -> DataFrame:
    def trailing(n: int, lag: int = 0) -> WindowSpec:
        return windows.trailing(n, lag, entity)

    w = windows.by_entity(entity)
    r0 = F.coalesce(ratio(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))
    df = bars.withColumn("_r", r0)
    df = df.withColumn("return", clip(median3(F.col("_r"), F.lag("_r").over(w), F.lag("_r", 2).over(w)), -0.5, 0.5))
    r, c = F.col("return"), F.col("close")
    t20 = trailing(20, 1)

    def momentum(k: int) -> Column:
        return ratio(F.lag(c).over(w), F.lag(c, k + 1).over(w)) - 1

    n = F.count(r).over(t20)
    df = df.withColumns({
        "return_lag1": F.lag(r).over(w),
        "return_lag5": F.lag(r, 5).over(w),
        "reversal_5": -F.lag(r, 5).over(w),
        "return_mean_20": clip(with_least(5, r, t20, F.avg(r).over(t20)), -0.2, 0.2),
        "momentum_20": momentum(20),
        "momentum_60": momentum(60),
        "volatility_20": with_least(20, r, t20, F.stddev_pop(r).over(t20)),
        "return_skew_20": clip(
            F.coalesce(F.when(n >= 10, F.skewness(r).over(t20) * F.sqrt(n * (n - 1.0)) / (n - 2)), F.lit(0.0)), -3, 3
        ),
        "_volume": F.greatest(F.col("volume"), F.lit(1.0)),
        "dist_from_52w_high": clip(c / (with_least(60, c, trailing(252, 1), F.max(c).over(trailing(252, 1))) + _TINY) - 1, -1, 0),
    })
    df = df.withColumns({
        "momentum_composite": clip(0.6 * F.col("momentum_20") + 0.4 * F.col("momentum_60"), -2, 2),
        "volatility": F.coalesce(F.greatest(F.col("volatility_20"), F.lit(1e-4)), F.lit(1e-4)),
        "volume_mean_20": with_least(5, F.col("_volume"), t20, F.avg("_volume").over(t20)),
        "dollar_volume": c * F.col("_volume"),
    })
    df = df.withColumn("_illiquid", F.abs(r) / (F.col("dollar_volume") + _TINY))
    v, t60 = F.col("volatility"), trailing(60)
    level = (v - F.avg(v).over(t60)) / (F.stddev_samp(v).over(t60) + _TINY)
    df = df.withColumns({
        "mom_vol_adj": clip(F.col("momentum_composite") / (v + _TINY), -5, 5),
        "vol_of_vol": clip(F.coalesce(with_least(10, v, t20, F.stddev_pop(v).over(t20)), F.lit(0.0)), 0, 1),
        "volume_momentum": clip(F.col("_volume") / (F.col("volume_mean_20") + _TINY), 0, 5),
        "amihud": clip(F.log1p(1e6 * F.coalesce(with_least(5, F.col("_illiquid"), t20, F.avg("_illiquid").over(t20)), F.lit(0.0))), 0, 20),
        "regime_feature": F.coalesce(clip(with_least(20, v, t60, level), -3, 3), F.lit(0.0)),
    })
    df = df.withColumn("momentum_regime_interaction", clip(F.col("momentum_composite") * F.col("regime_feature"), -5, 5))
    return df.drop("_r", "_volume", "_illiquid")


#: Means behind the recursive features: one pass over a chunk, which the bar before it leads.
RECURSIONS = Stage(
    ("fast", "slow", "gain", "loss"), lambda f, _: {"fast": Mean.of_span(f["close"], 10), "slow": Mean.of_span(f["close"], 50), **rsi_means(f["close"])}, skip=1
)


def _recursions(f: pd.DataFrame, got: Values) -> dict[str, pd.Series]:
    return {"rsi": rsi(f, got), "ema_10": got["fast"], "ema_50": got["slow"], "ema_ratio": (got["fast"] / (got["slow"] + _TINY)).clip(0.5, 1.5)}


_RECURSIVE = "rsi double, ema_10 double, ema_50 double, ema_ratio double"


def recursive_features(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """rsi, ema_10, ema_50 and ema_ratio of every ticker: a prefix scan over chunks of ``size`` bars, one pass where a ticker has no more."""
    return scan(df, [RECURSIONS], _recursions, _RECURSIVE, reach=1, size=size)


def core_features(bars: DataFrame, size: int = CHUNK) -> DataFrame:
    """Window and recursive features and the market regime of every (ticker, date)."""
    rows, several = chunked(checkpointed(bars), REACH, size)
    rows = _windows(rows, ["ticker", "_chunk"]).where("_lead <= 1")
    rows = checkpointed(rows) if several else rows
    return regime_by_date(checkpointed(scan_chunks(rows, several, [RECURSIONS], _recursions, _RECURSIVE, 1, size)))


def min_width(df: DataFrame, n: int = 5) -> DataFrame:
    """Rows of dates with at least ``n`` tickers."""
    return df.withColumn("_n", F.count("*").over(by_date())).where(F.col("_n") >= n).drop("_n")


def market_width(df: DataFrame, wide: int | None = None) -> DataFrame:
    """market_dispersion and breadth of every date.

    With ``wide``, ``df`` is read twice (checkpoint it): sums of each date, which
    tasks add up first, join its rows. Without, they are windows over the date.
    """
    spread = F.coalesce(F.greatest(F.stddev_samp("return"), F.lit(1e-6)), F.lit(0.0))
    up = F.coalesce(F.avg(F.when(F.col("return") > 0, 1.0).otherwise(0.0)), F.lit(0.5))
    if wide is not None:
        each = df.groupBy("date").agg(spread.alias("market_dispersion"), up.alias("breadth"))
        return df.drop("market_dispersion", "breadth").join(small(checkpointed(each)), "date")
    w = by_date()
    spread = F.coalesce(F.greatest(F.stddev_samp("return").over(w), F.lit(1e-6)), F.lit(0.0))
    up = F.coalesce(F.avg(F.when(F.col("return") > 0, 1.0).otherwise(0.0)).over(w), F.lit(0.5))
    return df.withColumns({"market_dispersion": spread, "breadth": up})


def cs_winsorize(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99, wide: int | None = WIDE) -> DataFrame:
    """Each value clipped to its date's interpolated quantiles.

    Dates of up to ``wide`` tickers are windows over the date; those of more are
    ranked value by value over many tasks (:mod:`panelworks.functions.wide`).
    """

    def narrow(df: DataFrame) -> DataFrame:
        rows = df.withColumns({f"_{c}": F.percentile(c, F.array(F.lit(lo), F.lit(hi))).over(by_date()) for c in cols})
        return rows.withColumns({c: clip(F.col(c), F.col(f"_{c}")[0], F.col(f"_{c}")[1]) for c in cols}).drop(*[f"_{c}" for c in cols])

    def broad(df: DataFrame) -> DataFrame:
        bounds = small(checkpointed(quantiles(df, cols, [lo, hi])))
        rows = df.join(bounds, F.col("date").eqNullSafe(F.col("_d")), "left")
        return rows.withColumns({c: clip(F.col(c), F.col("_q")[c][0], F.col("_q")[c][1]) for c in cols}).drop("_d", "_q")

    return each_width(df, wide, narrow, broad)


def cs_zscore(df: DataFrame, cols: list[str], wide: int | None = WIDE) -> DataFrame:
    """``{col}_z``: standardised within the date, missing 0, held to +-5; dates of over ``wide`` tickers by sums that tasks add up first."""

    def z(c: str) -> Column:
        x = clip((F.col(c) - F.col(f"_m_{c}")) / (F.greatest(F.col(f"_s_{c}"), F.lit(1e-6)) + _TINY), -5, 5)
        return F.when(F.abs(x) > 1e-9, x).otherwise(0.0)  # the rounding of a mean of equal values is no deviation

    sums = {f"_{k}_{c}": f(c) for c in cols for k, f in (("m", F.avg), ("s", F.stddev_samp))}

    def scored(rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"{c}_z": z(c) for c in cols}).drop("_d", *sums)

    def broad(df: DataFrame) -> DataFrame:
        each = df.groupBy(F.col("date").alias("_d")).agg(*[x.alias(k) for k, x in sums.items()])
        return scored(df.join(small(checkpointed(each)), F.col("date").eqNullSafe(F.col("_d"))))

    return each_width(df, wide, lambda df: scored(df.withColumns({k: x.over(by_date()) for k, x in sums.items()})), broad)


def cs_pct_rank(df: DataFrame, cols: list[str], wide: int | None = WIDE) -> DataFrame:
    """``{col}_rank``: average rank within the date as a share, missing 0.5; dates of over ``wide`` tickers over many tasks."""

    def narrow(df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}_rank": F.coalesce(pct_rank(F.col(c), ranked(c)), F.lit(0.5)) for c in cols})

    def broad(df: DataFrame) -> DataFrame:
        rows = rank_shares(df, cols)
        return rows.withColumns({f"{c}_rank": F.coalesce(F.col("_ranks")[c], F.lit(0.5)) for c in cols}).drop("_ranks")

    return each_width(df, wide, narrow, broad)


def cross_section(df: DataFrame, cols: list[str], wide: int | None = None) -> DataFrame:
    """``_z`` and ``_rank`` of winsorised columns; the columns themselves stay as they were.

    With ``wide``, dates of more tickers are spread over many tasks; ``df`` is then read more than once.
    """

    def scored(wide: int | None) -> Callable[[DataFrame], DataFrame]:
        return lambda df: cs_pct_rank(cs_zscore(cs_winsorize(df, cols, wide=wide), cols, wide), cols, wide)

    kept = df.withColumns({f"_raw_{c}": F.col(c) for c in cols})
    out = each_width(kept, wide, scored(None), scored(0))
    return out.withColumns({c: F.col(f"_raw_{c}") for c in cols}).drop(*[f"_raw_{c}" for c in cols])


def _with_fills(f: pd.DataFrame, got: Values, cols: list[str], window: int = 20) -> dict[str, pd.Series]:
    """Recursive features of one ticker, and for rows of wide dates each column in ``cols`` with its holes filled, as :func:`fill_missing` does."""
    made = _recursions(f, got)
    wide = f["_wide"].to_numpy()
    for c in cols:
        x = made[c] if c in made else f[c]
        full = x[wide]
        if full.isna().any():
            full = full.fillna(full.rolling(window, min_periods=1).median()).fillna(0.0)
        made[f"_f_{c}"] = full.reindex(f.index)
    return made


def feature_pipeline(
    bars: DataFrame, width: int = 5, gate: bool = True, size: int = CHUNK, wide: int = WIDE, begun: DataFrame | None = None, widths: DataFrame | None = None
) -> DataFrame:
    """ticker, date, close and the 64 model columns of every bar on dates of at least ``width`` tickers.

    The bars are checkpointed once, and their dates counted on them. One exchange
    by ticker and chunk serves all windows and the pandas pass, which adds the
    recursions and fills holes; where histories are cut, the holes are filled after
    it, chunk by chunk of the wide dates' rows. The panel is checkpointed, as its
    returns give the dates' regimes and widths before they join it. The
    cross-section reads the unfilled columns.

    ``begun`` (ticker, date, close, volume, _carry0) is the bar before the first
    one of each ticker whose history began earlier, with the state of its
    recursions (:func:`panelworks.functions.ewm.end_states`); ``widths``: (date, n)
    of all tickers, where ``bars`` are not all of them.
    """
    names = ["ticker", "date", "close", "volume"]
    bars = checkpointed(bars.select(*names))
    if gate and not price_gates(bars).first()["ok"]:
        raise ValueError("too few bars, or closes of 0 or less")
    counts = bars.groupBy("date").agg(F.count("*").alias("n")) if widths is None else widths
    dates = checkpointed(counts.select("date", (F.col("n") >= width).alias("_wide"), (F.col("n") > wide).alias("_split")))
    split = wide if dates.where("_split").limit(1).count() else None
    dates = dates.drop("_split")
    cut, several = chunked(bars, REACH, size)
    if begun is not None:
        if several:
            raise ValueError(f"over {size} new bars of a ticker: compute its whole history")
        cut = cut.unionByName(begun.select(*names).withColumns({"_chunk": F.lit(0).cast("long"), "_lead": F.lit(1)}))
    rows = _windows(cut, ["ticker", "_chunk"]).where("_lead <= 1").join(small(dates), "date", "inner" if begun is None else "left")
    if begun is not None:
        carry = small(begun.select(F.col("ticker").alias("_t"), "_carry0"))
        rows = rows.withColumn("_wide", F.coalesce("_wide", F.lit(False))).join(carry, F.col("ticker").eqNullSafe(F.col("_t")), "left").drop("_t")
    filled = [c for c in CORE_FEATURES if c not in ("market_dispersion", "breadth", "regime_multiplier")]
    if several:
        panel = checkpointed(scan_chunks(checkpointed(rows), True, [RECURSIONS], _recursions, _RECURSIVE, 1, size))
    else:
        added = ", ".join([_RECURSIVE, *(f"_f_{c} double" for c in filled)])
        panel = checkpointed(scan_chunks(rows, False, [RECURSIONS], lambda f, got: _with_fills(f, got, filled), added, 1, size))
    df = regime_by_date(panel).where("_wide")
    if several:
        df = checkpointed(fill_missing(df.withColumns({f"_f_{c}": F.col(c) for c in filled}), [f"_f_{c}" for c in filled], size=size))
    df = cross_section(market_width(df, wide), CROSS_SECTIONAL, split)
    return df.select("ticker", "date", "close", *[F.col(f"_f_{c}").alias(c) if c in filled else c for c in MODEL_FEATURES])


def standardize_scores(df: DataFrame, score: str = "score", by: str | list[str] = "date") -> DataFrame:
    """Scores held to +-50 and standardised within the batch, unless they do not vary."""
    w = by_date(by)
    s = clip(F.col(score), -50, 50)
    rows = df.withColumn(score, s)
    spread = F.stddev_pop(score).over(w)
    return rows.withColumn(score, F.when(spread > 1e-6, (F.col(score) - F.avg(score).over(w)) / (spread + 1e-12)).otherwise(F.col(score)))


def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean, std, low, high, missing): one wide aggregate, then a row a feature."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "low": F.min, "high": F.max, "missing": lambda c: F.avg(F.col(c).isNull().cast("int"))}
    wide = df.agg(*[F.struct(*[f(c).cast("double").alias(k) for k, f in stats.items()]).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "s").select("feature", "s.*")
