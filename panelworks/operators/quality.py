"""Projections, filters and data-quality rules on bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import chunked, own_rows
from ..functions.expr import clean_num, ratio
from ..functions.lineage import checkpointed
from ..functions.windows import by_entity, trailing

TICKER = r"^[A-Z0-9._-]{1,12}$"
#: Words that give away a look into the future.
FORBIDDEN = frozenset("future next forward lead label target tomorrow ahead".split())


def normalize_dates(df: DataFrame, arrival: str) -> DataFrame:
    """Dates parsed to UTC days, unparsable ones dropped, the first arrival of each (ticker, date) kept."""
    day = F.to_date(F.try_to_timestamp(F.col("date").cast("string")))
    rows = df.withColumn("date", day).where("date is not null")
    first = Window.partitionBy("ticker", "date").orderBy(arrival)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def coerce_numeric(df: DataFrame, cols: list[str], needed: list[str]) -> DataFrame:
    """Text and non-finite values in ``cols`` become NULL; rows without a ``needed`` value go."""
    return df.withColumns({c: clean_num(F.col(c)) for c in cols}).dropna(subset=needed)


def returns(price: str = "close", entity: str = "ticker") -> Column:
    """Change against the entity's bar before."""
    return ratio(F.col(price), F.lag(price).over(by_entity(entity))) - 1


def price_gates(df: DataFrame, least: int = 120) -> DataFrame:
    """One row: bars, bars with a close of 0 or less, ok (enough bars and none of those)."""
    bad = F.count_if(F.col("close") <= 0)
    return df.agg(F.count("*").alias("bars"), bad.alias("bad_close")).withColumn("ok", (F.col("bars") >= least) & (F.col("bad_close") == 0))


def validate_prices(df: DataFrame, spike: float = 3.5) -> DataFrame:
    """Volume floored at 0 (missing: 0) and a flag for bars with an absolute return over ``spike``."""
    volume = F.greatest(F.coalesce(F.col("volume"), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("volume", volume).withColumn("spike", F.coalesce(F.abs(returns()) > spike, F.lit(False)))


def repair_ohlc(df: DataFrame, most: float = 0.20) -> DataFrame:
    """High and low made to hold open and close; tickers with over ``most`` of their bars in violation are rejected."""
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low"))
    share = F.avg(F.coalesce(bad, F.lit(False)).cast("int")).over(Window.partitionBy("ticker"))
    kept = df.withColumn("_share", share).where(F.col("_share") <= most).drop("_share")
    return kept.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})


def check_contract(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(rule, violations): missing and non-finite values, price order, empty tickers, duplicate keys."""
    prices = ["open", "high", "low", "close"]
    inf = float("inf")
    rules = {
        "missing": sum((F.count_if(F.col(c).isNull() | F.isnan(c)) for c in prices), F.lit(0)),
        "non_finite": sum((F.count_if(F.abs(F.col(c)) == inf) for c in prices), F.lit(0)),
        "high_below": F.count_if(F.col("high") + tolerance < F.greatest("open", "close", "low")),
        "low_above": F.count_if(F.col("low") - tolerance > F.least("open", "close", "high")),
        "empty_ticker": F.count_if(F.coalesce(F.trim("ticker"), F.lit("")) == ""),
    }
    wide = df.agg(*[c.cast("long").alias(n) for n, c in rules.items()])
    long = wide.unpivot([], list(rules), "rule", "violations")
    twice = df.groupBy("ticker", "date").count().where("count > 1")
    return long.unionByName(twice.agg(F.lit("duplicate_key").alias("rule"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations")))


def despike_close(df: DataFrame, limit: float = 0.85) -> DataFrame:
    """Closes with an absolute return over ``limit`` replaced by the last good one before, else the next one."""
    w = by_entity()
    rows = df.withColumn("_c", F.when(F.coalesce(F.abs(returns()), F.lit(0.0)) <= limit, F.col("close")))
    before = F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_c", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("close", F.coalesce(before, after)).drop("_c")


def reject_extreme_move(df: DataFrame, limit: float = 0.90) -> DataFrame:
    """Without tickers that moved more than ``limit`` in one bar."""
    wild = df.withColumn("_r", F.abs(returns())).groupBy("ticker").agg(F.max("_r").alias("_r")).where(F.col("_r") > limit)
    return df.join(wild, "ticker", "left_anti")


def reject_flat(df: DataFrame, least: int = 5) -> DataFrame:
    """Without tickers of fewer than ``least`` different closes."""
    alive = df.groupBy("ticker").agg(F.countDistinct("close").alias("_n")).where(F.col("_n") >= least)
    return df.join(alive, "ticker", "left_semi")


def min_history(df: DataFrame, n: int, soft: float | None = 0.7, delta_days: int = 30) -> DataFrame:
    """Tickers with at least ``n`` bars, or floor(soft * n), flagged ``short``; feeds of at most ``delta_days`` days are exempt."""
    span = F.datediff(F.max("date"), F.min("date"))
    each = df.groupBy("ticker").agg(F.count("*").alias("_n"), span.alias("_span"))
    need = int(n * soft) if soft else n
    ok = each.where((F.col("_n") >= need) | (F.col("_span") <= delta_days))
    return df.join(ok.select("ticker", (F.col("_n") < n).alias("short")), "ticker")


def trading_density(df: DataFrame, least: float = 0.55, days_per_bar: int = 1) -> DataFrame:
    """Per ticker: distinct dates, calendar span, their ratio and whether it is under ``least``."""
    span = ((F.datediff(F.max("date"), F.min("date"))) / days_per_bar).cast("long") + 1
    rows = df.groupBy("ticker").agg(F.countDistinct("date").alias("dates"), span.alias("span"))
    return rows.withColumn("density", F.col("dates") / F.col("span")).withColumn("sparse", F.col("density") < least)


def tail_per_ticker(df: DataFrame, n: int = 20_000) -> DataFrame:
    """The last ``n`` bars of each ticker."""
    last = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return df.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")


def cap_to_safe_date(df: DataFrame, as_of: str, end: str | None = None, lag: int = 2) -> DataFrame:
    """Bars up to the earlier of ``end`` and ``as_of`` less ``lag`` days; a plain filter that scans can use."""
    safe = F.date_sub(F.lit(as_of).cast("date"), lag)
    return df.where(F.col("date") <= (F.least(F.lit(end).cast("date"), safe) if end else safe))


def sanitize_ticker(c: Column) -> Column:
    """The ticker in upper case without blanks around it, NULL if it is none."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike(TICKER), t)


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of member tickers."""
    return df.join(universe.select("ticker").distinct(), "ticker", "left_semi")


def forbidden_names(names: list[str]) -> list[str]:
    """Column names that carry a forbidden word between underscores."""
    return [n for n in names if FORBIDDEN & set(n.lower().split("_"))]


def default_of(name: str) -> float:
    """What stands in for a missing feature when scoring."""
    return 0.5 if name.endswith("_rank") else 1.0 if name == "regime_multiplier" else 0.0


def enforce_schema(df: DataFrame, features: list[str], mode: str = "inference", keep: list[str] | None = None, least_rows: int = 300) -> DataFrame:
    """Ordered feature columns, finite, within +-1e9, as floats.

    training: missing columns, missing values and fewer than ``least_rows`` rows
    fail; inference: defaults stand in. Names that look ahead fail before a job starts.
    """
    if bad := forbidden_names(df.columns):
        raise ValueError(f"columns that look ahead: {bad}")
    absent = [f for f in features if f not in df.columns]
    keep = keep or []
    if mode != "inference":
        if absent:
            raise ValueError(f"missing features: {absent}")
        clean = {f: clean_num(F.col(f)) for f in features}
        gate = df.agg(F.count("*").alias("n"), *[F.count_if(c.isNull()).alias(f) for f, c in clean.items()]).first()
        if mode == "training" and gate["n"] < least_rows:
            raise ValueError(f"{gate['n']} rows, {least_rows} are needed")
        if holes := [f for f in features if gate[f]]:
            raise ValueError(f"missing values in {holes}")
    values = [F.lit(default_of(f)) if f in absent else F.coalesce(clean_num(F.col(f)), F.lit(default_of(f))) for f in features]
    bound = [F.greatest(F.lit(-1e9), F.least(F.lit(1e9), v)).cast("float").alias(f) for f, v in zip(features, values)]
    return df.select(*keep, *bound)


def low_variance_report(df: DataFrame, features: list[str], least: float = 1e-8) -> DataFrame:
    """(feature, variance) of features whose sample variance is under ``least``."""
    wide = df.agg(*[F.var_samp(f).alias(f) for f in features])
    return wide.unpivot([], features, "feature", "variance").where(F.col("variance") < least)


def sync_status(bars: DataFrame, as_of: str, stale_hours: int = 24) -> DataFrame:
    """Per ticker: rows, latest date, its age in hours at ``as_of``, stale."""
    age = F.datediff(F.lit(as_of).cast("date"), F.max("date")) * 24
    rows = bars.groupBy("ticker").agg(F.count("*").alias("rows"), F.max("date").alias("latest"), age.alias("age_hours"))
    return rows.withColumn("stale", F.col("age_hours") >= stale_hours)


def plan_sync(universe: DataFrame, bars: DataFrame, as_of: str, history: int = 730, overlap: int = 3, fresh: int = 1) -> DataFrame:
    """Per universe ticker: full, delta or skip, and the date to fetch from."""
    latest = bars.groupBy("ticker").agg(F.max("date").alias("latest"))
    day = F.lit(as_of).cast("date")
    rows = universe.select("ticker").distinct().join(latest, "ticker", "left")
    action = F.when(F.col("latest").isNull(), "full").when(F.datediff(day, "latest") <= fresh, "skip").otherwise("delta")
    start = F.when(F.col("latest").isNull(), F.date_sub(day, history)).when(F.datediff(day, "latest") > fresh, F.date_sub("latest", overlap))
    return rows.select("ticker", "latest", action.alias("action"), start.alias("start"))


def sync_report(results: DataFrame) -> DataFrame:
    """Tickers and inserted rows by status."""
    return results.groupBy("status").agg(F.count("*").alias("tickers"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"))


def fill_missing(df: DataFrame, cols: list[str], window: int = 20, size: int | None = None) -> DataFrame:
    """Missing values replaced by the trailing median of the ticker, else 0. With ``size``, histories of over that many rows are cut into chunks."""

    def filled(df: DataFrame, entity: str | list[str]) -> DataFrame:
        w = trailing(window, entity=entity)
        return df.withColumns({c: F.coalesce(F.col(c), F.percentile(c, F.lit(0.5)).over(w), F.lit(0.0)) for c in cols})

    if size is None:
        return filled(df, "ticker")
    rows, _ = chunked(checkpointed(df), window - 1, size)
    return own_rows(filled(rows, ["ticker", "_chunk"]))
