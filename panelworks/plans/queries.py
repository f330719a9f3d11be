"""The registered queries of the panel operators: each over the whole tables, most with a DuckDB oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..functions.lineage import checkpointed, shared_folder
from ..operators import evaluate, features, indicators, quality, regimes, targets
from ..sources import feeds, partitions
from ..sources.tables import bars, table
from . import oracles as O
from .oracles import nums, rnd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

KEY = ["ticker", "date"]
OHLCV = ["open", "high", "low", "close", "volume"]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def out(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """The columns (all, if none are named), doubles rounded."""
    kinds = dict(df.dtypes)
    names = cols or df.columns
    return df.select(*[rounded(F.col(f"`{c}`"), digits).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in names])


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with made-up faults: missing, jumping and sunken closes, highs under lows, missing and negative volumes."""
    df = bars(spark, sf_dir)
    weeks = F.floor(F.datediff("date", F.lit("1990-01-01").cast("date")) / 7) + F.length("ticker")
    df = df.withColumn("k", F.pmod(weeks, F.lit(97)))
    k, high, low = F.col("k"), F.col("high"), F.col("low")
    return df.select(
        "ticker", "sector", "date", "open", F.when(k == 11, low * 0.9).otherwise(high).alias("high"), F.when(k == 12, high * 1.1).otherwise(low).alias("low"),
        F.when(k == 3, F.lit(None).cast("double")).when(k == 5, F.col("close") * 6).when(k == 9, F.col("close") * 0.05).otherwise(F.col("close")).alias("close"),
        F.when(k == 13, F.lit(None).cast("double")).when(k == 17, -F.col("volume")).otherwise(F.col("volume")).alias("volume"), "k",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, score (the date's z of 20-bar momentum), model_version."""
    df = features.cross_section(features.window_features(bars(spark, sf_dir)), ["momentum_20"])
    return df.where("momentum_20 is not null").select("ticker", "date", F.col("momentum_20_z").alias("score"), F.lit("m20").alias("model_version"))


def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.forward_return(bars(spark, sf_dir)).select("ticker", "date", "forward_return")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).join(forward(spark, sf_dir), ["ticker", "date"])


# Sources and the bars view


@register("bars", f"WITH {O.BARS} SELECT ticker, sector, date, {nums(OHLCV)} FROM bars")
def q_bars(s: SparkSession, d: str) -> DataFrame:
    return out(bars(s, d))


@register("bars_daily", f"WITH {O.bars_cte('day')} SELECT ticker, sector, date, {nums(OHLCV)} FROM bars")
def q_bars_daily(s: SparkSession, d: str) -> DataFrame:
    return out(bars(s, d, "day"))


_SOME = "SELECT n_name FROM nation WHERE n_nationkey % 3 = 0"


def universe(s: SparkSession, d: str) -> DataFrame:
    """Every third nation's name."""
    return table(s, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("ticker"))


@register("a1_read_bars", f"WITH {O.BARS} SELECT ticker, sector, date, {nums(OHLCV)} FROM bars WHERE ticker IN ({_SOME}) AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def q_a1(s: SparkSession, d: str) -> DataFrame:
    return out(feeds.read_bars(bars(s, d), universe(s, d), "1996-01-01", "1999-12-31"))


@register(
    "a2_append_bars",
    f"""WITH {O.RAW}, old AS (SELECT ticker, date FROM bars WHERE date < DATE '1998-01-01')
SELECT ticker, date, {nums(["open", "close"])}, {rnd('coalesce(volume, 0)')} AS volume, 'feed' AS source FROM raw
WHERE (ticker, date) NOT IN (SELECT (ticker, date) FROM old)""",
)
def q_a2(s: SparkSession, d: str) -> DataFrame:
    rows = raw_feed(s, d)
    twice = rows.withColumn("try", F.lit(0)).union(rows.withColumn("try", F.lit(1)))
    target = bars(s, d).where("date < '1998-01-01'")
    return out(feeds.append_bars(twice, target, order=["try"]), "ticker", "date", "open", "close", "volume", "source")


_STORED = ["momentum_20", "volatility", "amihud"]


@register("a3_feature_store", f"WITH {O.FEATURES} SELECT ticker, date, {', '.join(f'{rnd(f'coalesce({c}, 0)')} AS {c}' for c in _STORED)} FROM feat WHERE date >= DATE '1997-01-01'")
def q_a3(s: SparkSession, d: str) -> DataFrame:
    store = feeds.to_store(features.window_features(bars(s, d)), _STORED, "v1")
    return out(feeds.read_features(store, _STORED, "v1", "1997-01-01"))


@register("a3_write_features", f"WITH {O.FEATURES} SELECT ticker, date, {', '.join(f'{rnd(f'coalesce({c}, 0)')} AS {c}' for c in _STORED)} FROM feat")
def q_a3w(s: SparkSession, d: str) -> DataFrame:
    """Written in two parts that overlap, the whole once more, and read again: nothing stands there twice."""
    path = f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    rows = checkpointed(features.window_features(bars(s, d)).select("ticker", "date", *_STORED))
    for part in (rows.where("date < '1998-01-01'"), rows.where("date >= '1997-01-01'"), rows):
        feeds.write_features(part, _STORED, "v1", path)
    feeds.write_features(rows, ["amihud"], "v2", path)
    return out(feeds.read_features(feeds.read_store(s, path), _STORED, "v1"))


@register("a4_stored_or_computed", f"WITH {O.FEATURES} SELECT ticker, date, {', '.join(f'{rnd(f'coalesce({c}, 0)', 5)} AS {c}' for c in _STORED)} FROM feat")
def q_a4s(s: SparkSession, d: str) -> DataFrame:
    """The store has the bars before 2000; the others are computed from 253 weekly bars before them on, and stored."""
    path = f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    rows = checkpointed(bars(s, d))
    for some in (rows.where("date < '2000-01-01'"), rows):
        df = feeds.stored_or_computed(some, path, "v1", _STORED, features.window_features, days=7 * 300)
    return out(df, digits=5)


@register(
    "a4_missing_features",
    f"""WITH {O.BARS}, miss AS (SELECT ticker, date FROM bars WHERE NOT (date < DATE '2000-01-01' AND volume > 50)),
firsts AS (SELECT ticker, min(date) AS f FROM miss GROUP BY ticker)
SELECT b.ticker, b.date, (m.date IS NOT NULL) AS is_missing FROM bars b JOIN firsts USING (ticker)
LEFT JOIN miss m ON m.ticker = b.ticker AND m.date = b.date WHERE b.date >= f - 380""",
)
def q_a4(s: SparkSession, d: str) -> DataFrame:
    rows = bars(s, d)
    store = feeds.to_store(rows.where("date < '2000-01-01' and volume > 50"), ["close"], "v1")
    gone = feeds.missing_keys(rows, store, "v1")
    need = feeds.with_warmup(rows, gone).select("ticker", "date")
    return need.join(gone.withColumn("is_missing", F.lit(True)), KEY, "left").fillna({"is_missing": False})


@register("a5_drop_version", f"WITH {O.BARS} SELECT ticker, date, 'v2' AS feature_version FROM bars WHERE year(date) % 2 <> 0")
def q_a5(s: SparkSession, d: str) -> DataFrame:
    """Two versions on disk, of which one goes."""
    path = f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    rows = checkpointed(bars(s, d))
    feeds.write_features(rows.where("year(date) % 2 = 0"), ["close"], "v1", path)
    feeds.write_features(rows.where("year(date) % 2 <> 0"), ["close"], "v2", path)
    feeds.drop_version_on_disk(s, path, "v1")
    return feeds.read_store(s, path).select("ticker", "date", "feature_version")


@register(
    "a6_append_predictions",
    f"""WITH {O.PREDICTIONS}, new AS (SELECT ticker, date, coalesce(CASE WHEN month(date) = 5 THEN NULL ELSE score END, 0) AS score,
  coalesce(CASE WHEN month(date) = 6 THEN NULL ELSE model_version END, 'unknown') AS model_version FROM pred)
SELECT ticker, date, {rnd('score')} AS score, model_version FROM new WHERE NOT (date < DATE '1997-06-01' AND model_version = 'm20')""",
)
def q_a6(s: SparkSession, d: str) -> DataFrame:
    rows = predictions(s, d)
    new = rows.withColumn("score", F.when(F.month("date") != 5, F.col("score"))).withColumn("model_version", F.when(F.month("date") != 6, F.col("model_version")))
    return out(feeds.append_predictions(new, rows.where("date < '1997-06-01'")), "ticker", "date", "score", "model_version")


@register("a6_read_predictions", f"WITH {O.PREDICTIONS} SELECT ticker, date, {rnd('score')} AS score, model_version FROM pred WHERE date = (SELECT max(date) FROM pred) AND model_version = 'm20'")
def q_a6r(s: SparkSession, d: str) -> DataFrame:
    rows = predictions(s, d)
    last = rows.agg(F.max("date")).first()[0]
    return out(feeds.read_predictions(rows, str(last), "m20"))


@register("a7_retention", f"WITH {O.BARS} SELECT ticker, date, {rnd('close')} AS close FROM bars WHERE date >= DATE '2000-06-01' - 760")
def q_a7(s: SparkSession, d: str) -> DataFrame:
    """Bars on disk, by month; the months before the boundary go whole."""
    path = f"{shared_folder(s)}/bars-{uuid.uuid4().hex}"
    partitions.insert(bars(s, d), path, KEY)
    partitions.retain(s, path, "2000-06-01")
    return out(s.read.parquet(path), "ticker", "date", "close")


@register("a8_wide_feed", f"WITH {O.BARS} SELECT ticker, date, {rnd('close * 0.5')} AS close, {rnd('open')} AS open, {rnd('volume')} AS volume FROM bars")
def q_a8(s: SparkSession, d: str) -> DataFrame:
    df = bars(s, d)
    feed = df.select(F.col("ticker").alias("Symbol"), F.col("date").alias("Datetime"), F.col("open").alias("Open"), F.col("close").alias("Close"), (F.col("close") * 0.5).alias("Adj Close"), F.col("volume").alias("Vol"))
    return out(feeds.normalize_wide_feed(feed), "ticker", "date", "close", "open", "volume")


@register("a9_json_feed", f"WITH {O.RAW} SELECT ticker, date, {nums(OHLCV)} FROM raw WHERE high >= low AND close > 0 AND date >= DATE '1996-01-01'")
def q_a9(s: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("date").cast("string").alias("datetime"), *[F.col(c).cast("string").alias(c) for c in OHLCV])
    packed = raw_feed(s, d).groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(item).alias("values"))).alias("payload"))
    return out(feeds.normalize_json_feed(packed, start="1996-01-01"))


@register("a10_universe", "SELECT upper(trim(n_name)) AS ticker FROM nation ORDER BY 1")
def q_a10(s: SparkSession, d: str) -> DataFrame:
    """A universe document, written as JSON over several lines and read from there."""
    names = table(s, d, "nation").agg(F.collect_list(F.concat(F.lit(" "), F.lower("n_name"))).alias("tickers"))
    docs = names.select(F.lit("1").alias("version"), F.lit("2022-01-03").alias("created_utc"), F.lit("nations").alias("description"), F.lit(120).alias("min_history_days"), "tickers")
    path = f"{shared_folder(s)}/universe-{uuid.uuid4().hex}"
    docs.select(F.to_json(F.struct("*"), {"pretty": "true"})).coalesce(1).write.text(path)
    return feeds.read_universe_file(s, path)


@register(
    "a12_pick_provider",
    f"""WITH {O.RAW}, ok AS (SELECT ticker FROM raw GROUP BY ticker HAVING count(close) >= 52 AND coalesce(min(close), 0) > 42)
SELECT b.ticker, b.date, {rnd('b.close')} AS close, CASE WHEN b.ticker IN (SELECT ticker FROM ok) THEN 'one' ELSE 'two' END AS provider
FROM raw r JOIN bars b ON r.ticker = b.ticker AND r.date = b.date WHERE b.ticker NOT IN (SELECT ticker FROM ok)
UNION ALL SELECT ticker, date, {rnd('close')}, 'one' FROM raw WHERE ticker IN (SELECT ticker FROM ok)""",
)
def q_a12(s: SparkSession, d: str) -> DataFrame:
    one = raw_feed(s, d).select("ticker", "date", "close")
    two = bars(s, d).select("ticker", "date", "close")
    gate = (F.count("close") >= 52) & (F.coalesce(F.min("close"), F.lit(0.0)) > 42) | (F.first("provider") == "two")
    return out(feeds.pick_provider({"one": one, "two": two}, ["one", "two"], gate), "ticker", "date", "close", "provider")


# Quality


@register("b1_normalize_dates", f"WITH {O.RAW} SELECT ticker, date, k FROM raw WHERE k <> 20")
def q_b1(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("k") == 20, "not a day").otherwise(F.concat(F.col("date").cast("string"), F.lit(" 15:30:00")))
    rows = raw_feed(s, d).withColumn("date", text)
    twice = rows.withColumn("arrival", F.lit(0)).union(rows.withColumn("arrival", F.lit(1)).withColumn("k", F.lit(-1).cast("bigint")))
    return quality.normalize_dates(twice, "arrival").select("ticker", "date", "k")


@register("b2_coerce_numeric", f"WITH {O.RAW} SELECT ticker, date, {nums(['close'])}, {rnd('CASE WHEN k IN (30, 31) THEN NULL ELSE volume END')} AS volume FROM raw WHERE close IS NOT NULL AND k <> 32")
def q_b2(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = raw_feed(s, d).withColumn("volume", F.when(k == 30, "n/a").when(k == 31, "Infinity").otherwise(F.col("volume").cast("string")))
    rows = rows.withColumn("close", F.when(k == 32, "NaN").otherwise(F.col("close").cast("string")))
    return out(quality.coerce_numeric(rows, ["close", "volume"], ["close"]), "ticker", "date", "close", "volume")


@register("b3_price_gates", f"WITH {O.RAW} SELECT count(*) AS bars, count(*) FILTER (close <= 0) AS bad_close, count(*) >= 120 AND count(*) FILTER (close <= 0) = 0 AS ok FROM raw")
def q_b3g(s: SparkSession, d: str) -> DataFrame:
    return quality.price_gates(raw_feed(s, d))


@register("b3_validate_prices", f"WITH {O.RAW} SELECT ticker, date, {rnd('greatest(coalesce(volume, 0), 0)')} AS volume, coalesce(abs(close / nullif(lag(close) {O.W}, 0) - 1) > 3.5, false) AS spike FROM raw")
def q_b3(s: SparkSession, d: str) -> DataFrame:
    return out(quality.validate_prices(raw_feed(s, d)), "ticker", "date", "volume", "spike")


@register(
    "b4_repair_ohlc",
    f"""WITH {O.RAW}, v AS (SELECT *, avg(CASE WHEN coalesce(high < greatest(open, close) OR low > least(open, close) OR high < low, false) THEN 1.0 ELSE 0 END) OVER (PARTITION BY ticker) AS bad FROM raw)
SELECT ticker, date, {rnd('greatest(high, open, close)')} AS high, {rnd('least(low, open, close)')} AS low FROM v WHERE bad <= 0.2""",
)
def q_b4(s: SparkSession, d: str) -> DataFrame:
    return out(quality.repair_ohlc(raw_feed(s, d)), "ticker", "date", "high", "low")


@register(
    "b5_check_contract",
    f"""WITH {O.RAW}, r AS (SELECT CASE WHEN k = 40 THEN ' ' ELSE ticker END AS ticker, date, open, CASE WHEN k = 41 THEN 'Infinity'::DOUBLE ELSE high END AS high, CASE WHEN k = 42 THEN '-Infinity'::DOUBLE ELSE low END AS low, close FROM raw)
SELECT 'missing' AS rule, count(*) FILTER (open IS NULL) + count(*) FILTER (high IS NULL) + count(*) FILTER (low IS NULL) + count(*) FILTER (close IS NULL) AS violations FROM r
UNION ALL SELECT 'non_finite', count(*) FILTER (isinf(high)) + count(*) FILTER (isinf(low)) FROM r
UNION ALL SELECT 'high_below', count(*) FILTER (high + 1e-6 < greatest(open, close, low)) FROM r
UNION ALL SELECT 'low_above', count(*) FILTER (low - 1e-6 > least(open, close, high)) FROM r
UNION ALL SELECT 'empty_ticker', count(*) FILTER (trim(ticker) = '') FROM r
UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM r GROUP BY ticker, date HAVING count(*) > 1)""",
)
def q_b5(s: SparkSession, d: str) -> DataFrame:
    k, inf = F.col("k"), float("inf")
    rows = raw_feed(s, d).withColumns({"high": F.when(k == 41, inf).otherwise(F.col("high")), "low": F.when(k == 42, -inf).otherwise(F.col("low"))})
    return quality.check_contract(rows.withColumn("ticker", F.when(k == 40, " ").otherwise(F.col("ticker"))))


@register(
    "b6_despike",
    f"""WITH {O.RAW}, c AS (SELECT *, CASE WHEN coalesce(abs(close / nullif(lag(close) {O.W}, 0) - 1), 0) <= 0.85 THEN close END AS c FROM raw)
SELECT ticker, date, {rnd("coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")} AS close FROM c""",
)
def q_b6(s: SparkSession, d: str) -> DataFrame:
    return out(quality.despike_close(raw_feed(s, d)), "ticker", "date", "close")


@register(
    "b7_extreme_move",
    f"""WITH {O.BARS}, r AS (SELECT ticker, date, close, abs(close / nullif(lag(close) {O.W}, 0) - 1) AS r FROM bars)
SELECT ticker, date, {rnd('close')} AS close FROM r WHERE ticker NOT IN (SELECT ticker FROM r GROUP BY ticker HAVING max(r) > 0.17)""",
)
def q_b7(s: SparkSession, d: str) -> DataFrame:
    return out(quality.reject_extreme_move(bars(s, d), 0.17), "ticker", "date", "close")


@register("b8_flat", f"WITH {O.BARS} SELECT ticker, date FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(DISTINCT close) >= 340)")
def q_b8(s: SparkSession, d: str) -> DataFrame:
    return quality.reject_flat(bars(s, d), 340).select("ticker", "date")


@register(
    "b9_min_history",
    f"""WITH {O.BARS}, e AS (SELECT ticker, count(*) AS n, date_diff('day', min(date), max(date)) AS span FROM bars GROUP BY ticker)
SELECT b.ticker, b.date, n < 355 AS short FROM bars b JOIN e ON b.ticker = e.ticker WHERE n >= floor(355 * 0.7) OR span <= 30""",
)
def q_b9(s: SparkSession, d: str) -> DataFrame:
    return quality.min_history(bars(s, d), 355).select("ticker", "date", "short")


@register(
    "b10_density",
    f"""WITH {O.BARS} SELECT ticker, count(DISTINCT date) AS dates, date_diff('day', min(date), max(date)) + 1 AS span,
  {rnd("count(DISTINCT date) / (date_diff('day', min(date), max(date)) + 1)")} AS density, count(DISTINCT date) / (date_diff('day', min(date), max(date)) + 1) < 0.55 AS sparse FROM bars GROUP BY ticker""",
)
def q_b10(s: SparkSession, d: str) -> DataFrame:
    return out(quality.trading_density(bars(s, d)))


@register("b11_tail", f"WITH {O.BARS} SELECT ticker, date, {rnd('close')} AS close FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 50")
def q_b11(s: SparkSession, d: str) -> DataFrame:
    return out(quality.tail_per_ticker(bars(s, d), 50), "ticker", "date", "close")


@register("b12_safe_date", f"WITH {O.BARS} SELECT ticker, date FROM bars WHERE date <= least(DATE '1999-06-30', DATE '1999-03-01' - 2)")
def q_b12(s: SparkSession, d: str) -> DataFrame:
    return quality.cap_to_safe_date(bars(s, d), "1999-03-01", "1999-06-30").select("ticker", "date")


@register("b13_sanitize_ticker", "SELECT p_partkey, CASE WHEN regexp_full_match(upper(trim(p_brand)), '[A-Z0-9._-]{1,12}') THEN upper(trim(p_brand)) END AS brand, CASE WHEN regexp_full_match(upper(trim(replace(p_name, ' ', '-'))), '[A-Z0-9._-]{1,12}') THEN upper(trim(replace(p_name, ' ', '-'))) END AS name FROM part")
def q_b13(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", quality.sanitize_ticker(F.col("p_brand")).alias("brand"), quality.sanitize_ticker(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"))


@register("b14_in_universe", f"WITH {O.BARS} SELECT ticker, date FROM bars WHERE ticker IN ({_SOME})")
def q_b14(s: SparkSession, d: str) -> DataFrame:
    return quality.in_universe(bars(s, d), universe(s, d)).select("ticker", "date")


@register(
    "b15_schema",
    f"WITH {O.FEATURES} SELECT ticker, date, {', '.join(f'round(CAST(CAST(greatest(-1e9, least(1e9, coalesce({c}, {v}))) AS FLOAT) AS DOUBLE), 4) + 0.0 AS {c}' for c, v in (('momentum_20', 0.0), ('volatility', 0.0)))}, 0.5 AS extra_rank, 1.0 AS regime_multiplier FROM feat",
)
def q_b15(s: SparkSession, d: str) -> DataFrame:
    names = ["momentum_20", "volatility", "extra_rank", "regime_multiplier"]
    df = quality.enforce_schema(features.window_features(bars(s, d)).select("ticker", "date", "momentum_20", "volatility"), names, keep=KEY)
    return out(df.select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in names]), digits=4)


@register("b17_low_variance", f"WITH {O.FEATURES} SELECT 'one' AS feature, CAST(0 AS DOUBLE) AS variance UNION ALL SELECT 'amihud', {rnd('var_samp(amihud)', 9)} FROM feat HAVING var_samp(amihud) < 1e-2")
def q_b17(s: SparkSession, d: str) -> DataFrame:
    df = features.window_features(bars(s, d)).withColumn("one", F.lit(1.0))
    return out(quality.low_variance_report(df, ["one", "amihud", "dollar_volume"], 1e-2), digits=9)


@register("b18_sync_status", f"WITH {O.BARS} SELECT ticker, count(*) AS rows, max(date) AS latest, date_diff('day', max(date), DATE '2001-10-20') * 24 AS age_hours, date_diff('day', max(date), DATE '2001-10-20') * 24 >= 24 AS stale FROM bars GROUP BY ticker")
def q_b18(s: SparkSession, d: str) -> DataFrame:
    return quality.sync_status(bars(s, d), "2001-10-20")


_PLAN = f"""WITH {O.BARS}, l AS (SELECT ticker, max(date) AS latest FROM bars WHERE date < DATE '1998-01-05' OR ticker < 'NATION_2' GROUP BY ticker),
u AS (SELECT n_name AS ticker FROM nation UNION SELECT 'NEW_NAME'),
plan AS (SELECT u.ticker, latest, CASE WHEN latest IS NULL THEN 'full' WHEN date_diff('day', latest, DATE '1998-01-06') <= 1 THEN 'skip' ELSE 'delta' END AS action,
  CASE WHEN latest IS NULL THEN DATE '1998-01-06' - 730 WHEN date_diff('day', latest, DATE '1998-01-06') > 1 THEN latest - 3 END AS start
  FROM u LEFT JOIN l ON u.ticker = l.ticker)"""


def _plan(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "nation").select(F.col("n_name").alias("ticker"))
    names = names.union(names.select(F.lit("NEW_NAME")).limit(1))
    return quality.plan_sync(names, bars(s, d).where("date < '1998-01-05' or ticker < 'NATION_2'"), "1998-01-06")


@register("b19_plan_sync", f"{_PLAN} SELECT ticker, latest, action, start FROM plan")
def q_b19(s: SparkSession, d: str) -> DataFrame:
    return _plan(s, d)


@register("b20_sync_report", f"{_PLAN} SELECT action AS status, count(*) AS tickers, CAST(coalesce(sum(length(ticker)), 0) AS BIGINT) AS inserted FROM plan GROUP BY action")
def q_b20(s: SparkSession, d: str) -> DataFrame:
    return quality.sync_report(_plan(s, d).select(F.col("action").alias("status"), F.length("ticker").alias("inserted")))


@register("b21_fill_missing", f"WITH {O.RAW} SELECT ticker, date, {rnd(f'coalesce(close, quantile_cont(close, 0.5) {O.trail(20)}, 0)')} AS close FROM raw")
def q_b21(s: SparkSession, d: str) -> DataFrame:
    return out(quality.fill_missing(raw_feed(s, d), ["close"]), "ticker", "date", "close")


# Per-entity features

_C = {
    "c1_return": ["return"], "c2_lags": ["return_lag1", "return_lag5", "reversal_5"], "c3_return_mean": ["return_mean_20"], "c4_momentum": ["momentum_20", "momentum_60"],
    "c5_composite": ["momentum_composite"], "c6_volatility": ["volatility_20", "volatility"], "c7_mom_vol_adj": ["mom_vol_adj"], "c8_vol_of_vol": ["vol_of_vol"],
    "c9_skew": ["return_skew_20"], "c10_volume": ["volume_mean_20", "volume_momentum"], "c11_amihud": ["dollar_volume", "amihud"], "c14_52w_high": ["dist_from_52w_high"],
    "c15_regime_feature": ["regime_feature"], "c16_interaction": ["momentum_regime_interaction"],
}


def _feature_query(cols: list[str]) -> Query:
    return lambda s, d: out(features.window_features(bars(s, d)), "ticker", "date", *cols, digits=5)


for _name, _cols in _C.items():
    register(_name, f"WITH {O.FEATURES} SELECT ticker, date, {nums(_cols, 5)} FROM feat")(_feature_query(_cols))


@register("c12_rsi", f"WITH RECURSIVE {O.BARS}, {O.EWM} SELECT ticker, date, {rnd('rsi', 5)} AS rsi FROM ewm")
def q_c12(s: SparkSession, d: str) -> DataFrame:
    return out(features.recursive_features(bars(s, d)), "ticker", "date", "rsi", digits=5)


@register("c13_ema_ratio", f"WITH RECURSIVE {O.BARS}, {O.EWM} SELECT ticker, date, {nums(['ema_10', 'ema_50', 'ema_ratio'], 4)} FROM ewm")
def q_c13(s: SparkSession, d: str) -> DataFrame:
    return out(features.recursive_features(bars(s, d)), "ticker", "date", "ema_10", "ema_50", "ema_ratio", digits=4)


_CORE = [c for c in features.CORE_FEATURES if c not in ("market_dispersion", "breadth")]
_LABEL = "CASE WHEN sd > 2 * ref AND up / n < 0.30 THEN 'CRISIS' WHEN up / n > 0.60 AND s / n > 0 THEN 'BULL' WHEN up / n < 0.40 AND s / n < 0 THEN 'BEAR' ELSE 'SIDEWAYS' END"
_DAILY = 'daily AS (SELECT date, count("return") AS n, count(*) FILTER ("return" > 0) AS up, sum("return") AS s, sum("return" * "return") AS q FROM feat GROUP BY date)'


def _dated(reference: str) -> str:
    """CTEs up to dated: the regime of each date and its multiplier."""
    past = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ref = "sd" if reference == "window" else "refh"
    return f"""{_DAILY}, roll AS (SELECT date, sum(n) OVER w AS n, sum(up) OVER w AS up, sum(s) OVER w AS s,
  sqrt(greatest((sum(q) OVER w - (sum(s) OVER w) * (sum(s) OVER w) / sum(n) OVER w) / (sum(n) OVER w - 1), 0)) AS sd,
  sqrt(greatest((sum(q) OVER {past} - (sum(s) OVER {past}) * (sum(s) OVER {past}) / sum(n) OVER {past}) / (sum(n) OVER {past} - 1), 0)) AS refh
  FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), dated0 AS (SELECT date, {_LABEL.replace("ref", ref)} AS regime FROM roll),
dated AS (SELECT date, regime, regime AS market_regime, CASE regime WHEN 'BULL' THEN 1.2 WHEN 'BEAR' THEN 0.6 WHEN 'CRISIS' THEN 0.3 ELSE 1.0 END::DOUBLE AS regime_multiplier FROM dated0)"""


@register("c17_core_features", f"WITH RECURSIVE {O.FEATURES}, {O.EWM}, {_dated('window')} SELECT f.ticker, f.date, {nums(_CORE, 4)} FROM feat f JOIN ewm ON ewm.ticker = f.ticker AND ewm.date = f.date JOIN dated ON dated.date = f.date")
def q_c17(s: SparkSession, d: str) -> DataFrame:
    return out(features.core_features(bars(s, d)), "ticker", "date", *_CORE, digits=4)


# Indicators


@register("d1_sma", f"WITH {O.BARS} SELECT ticker, date, {rnd(f'CASE WHEN count(close) {O.trail(20)} >= 20 THEN avg(close) {O.trail(20)} END')} AS sma FROM bars")
def q_d1(s: SparkSession, d: str) -> DataFrame:
    return out(indicators.sma(bars(s, d)), "ticker", "date", "sma")


@register("d2_ema", f"WITH RECURSIVE {O.BARS}, {O.EWM} SELECT ticker, date, {nums(['ema'], 4)} FROM ewm")
def q_d2(s: SparkSession, d: str) -> DataFrame:
    return out(indicators.ema(bars(s, d)), "ticker", "date", "ema", digits=4)


@register("d3_rsi", f"WITH RECURSIVE {O.BARS}, {O.EWM} SELECT ticker, date, {nums(['rsi'], 4)} FROM ewm")
def q_d3(s: SparkSession, d: str) -> DataFrame:
    return out(indicators.rsi(bars(s, d)), "ticker", "date", "rsi", digits=4)


_BB = f"CASE WHEN count(close) {O.trail(20)} >= 20 THEN avg(close) {O.trail(20)} END"
_SD = f"2 * greatest(stddev_pop(close) {O.trail(20)}, 1e-6)"


@register("d4_bollinger", f"WITH {O.BARS} SELECT ticker, date, {rnd(_BB)} AS bb_mid, {rnd(f'({_BB}) + {_SD}')} AS bb_upper, {rnd(f'({_BB}) - {_SD}')} AS bb_lower FROM bars")
def q_d4(s: SparkSession, d: str) -> DataFrame:
    return out(indicators.bollinger(bars(s, d)), "ticker", "date", "bb_mid", "bb_upper", "bb_lower")


@register("d5_macd", f"WITH RECURSIVE {O.BARS}, {O.EWM} SELECT ticker, date, {nums(['macd', 'macd_signal'], 4)} FROM ewm")
def q_d5(s: SparkSession, d: str) -> DataFrame:
    return out(indicators.macd(bars(s, d)), "ticker", "date", "macd", "macd_signal", digits=4)


@register(
    "d6_sanitize_close",
    f"""WITH {O.RAW}, c AS (SELECT ticker, date, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM raw),
r AS (SELECT *, abs(close / lag(close) {O.W} - 1) AS r FROM c), e AS (SELECT ticker, max(r) AS most, quantile_cont(close, 0.001) AS lo, quantile_cont(close, 0.999) AS hi FROM r GROUP BY ticker)
SELECT r.ticker, date, {rnd('CASE WHEN most > 0.8 THEN greatest(lo, least(hi, close)) ELSE close END')} AS close FROM r JOIN e ON r.ticker = e.ticker""",
)
def q_d6(s: SparkSession, d: str) -> DataFrame:
    return out(indicators.sanitize_close(raw_feed(s, d)), "ticker", "date", "close")


# Cross-section


@register("e1_min_width", f"WITH {O.BARS} SELECT ticker, date FROM bars QUALIFY count(*) OVER (PARTITION BY date) >= 24")
def q_e1(s: SparkSession, d: str) -> DataFrame:
    return features.min_width(bars(s, d), 24).select("ticker", "date")


@register(
    "e2_e3_market_width",
    f"""WITH {O.FEATURES} SELECT ticker, date, {rnd('coalesce(greatest(stddev_samp("return") OVER (PARTITION BY date), 1e-6), 0)')} AS market_dispersion,
  {rnd('coalesce(avg(CASE WHEN "return" > 0 THEN 1.0 ELSE 0 END) OVER (PARTITION BY date), 0.5)')} AS breadth FROM feat""",
)
def q_e2(s: SparkSession, d: str) -> DataFrame:
    return out(features.market_width(features.window_features(bars(s, d))), "ticker", "date", "market_dispersion", "breadth")


_X = [c for c in features.CROSS_SECTIONAL if c not in ("rsi", "ema_ratio", "market_dispersion", "breadth")]


def _frame(s: SparkSession, d: str) -> DataFrame:
    return features.window_features(bars(s, d))


@register("e4_winsorize", f"WITH {O.FEATURES}, {O.cross_section(_X)} SELECT ticker, date, {nums(_X, 5)} FROM xw")
def q_e4(s: SparkSession, d: str) -> DataFrame:
    return out(features.cs_winsorize(_frame(s, d), _X), "ticker", "date", *_X, digits=5)


_Z = [f"{c}_z" for c in _X]


@register("e5_zscore", f"WITH {O.FEATURES}, {O.cross_section(_X)} SELECT ticker, date, {nums(_Z, 4)} FROM xs")
def q_e5(s: SparkSession, d: str) -> DataFrame:
    return out(features.cs_zscore(features.cs_winsorize(_frame(s, d), _X), _X), "ticker", "date", *_Z, digits=4)


_R = [f"{c}_rank" for c in _X]


@register("e6_pct_rank", f"WITH {O.FEATURES}, {O.cross_section([r[:-5] for r in _R])} SELECT ticker, date, {nums(_R)} FROM xs")
def q_e6(s: SparkSession, d: str) -> DataFrame:
    cols = [r[:-5] for r in _R]
    return out(features.cs_pct_rank(features.cs_winsorize(_frame(s, d), cols), cols), "ticker", "date", *_R)


_FILLED = [c for c in features.CORE_FEATURES if c not in ("market_dispersion", "breadth", "regime_multiplier")]
#: CTEs up to mf: ticker, date, close and the 64 model columns. Needs WITH RECURSIVE.
MODEL = f"""{O.FEATURES}, {O.EWM}, {_dated('window')}, core AS MATERIALIZED (SELECT f.*, rsi, ema_ratio, regime_multiplier,
  coalesce(greatest(stddev_samp("return") OVER (PARTITION BY f.date), 1e-6), 0) AS market_dispersion, coalesce(avg(CASE WHEN "return" > 0 THEN 1.0 ELSE 0 END) OVER (PARTITION BY f.date), 0.5) AS breadth
  FROM feat f JOIN ewm ON ewm.ticker = f.ticker AND ewm.date = f.date JOIN dated ON dated.date = f.date QUALIFY count(*) OVER (PARTITION BY f.date) >= 5), {O.cross_section(features.CROSS_SECTIONAL, "core")},
fi AS (SELECT ticker, date, close, market_dispersion, breadth, regime_multiplier, {", ".join(f'coalesce("{c}", quantile_cont("{c}", 0.5) {O.trail(20)}, 0) AS "{c}"' for c in _FILLED)} FROM core),
mf AS MATERIALIZED (SELECT fi.*, {", ".join(f'"{c}_{k}"' for k in ("z", "rank") for c in features.CROSS_SECTIONAL)} FROM fi JOIN xs ON xs.ticker = fi.ticker AND xs.date = fi.date)"""


@register("e7_feature_pipeline", f"WITH RECURSIVE {MODEL} SELECT ticker, date, {nums(['close', *features.MODEL_FEATURES], 4)} FROM mf")
def q_e7(s: SparkSession, d: str) -> DataFrame:
    return out(features.feature_pipeline(bars(s, d)), digits=4)


@register(
    "e8_standardize",
    f"""WITH {O.FEATURES}, c AS (SELECT ticker, date, greatest(-50, least(50, momentum_20 * 100)) AS s FROM feat WHERE momentum_20 IS NOT NULL)
SELECT ticker, date, {rnd('CASE WHEN stddev_pop(s) OVER d > 1e-6 THEN (s - avg(s) OVER d) / (stddev_pop(s) OVER d + 1e-12) ELSE s END')} AS score FROM c WINDOW d AS (PARTITION BY date)""",
)
def q_e8(s: SparkSession, d: str) -> DataFrame:
    df = _frame(s, d).where("momentum_20 is not null").withColumn("score", F.col("momentum_20") * 100)
    return out(features.standardize_scores(df), "ticker", "date", "score")


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, " + ", ".join(f"""{rnd(x.replace("@", f'"{c}"'), 4)} AS {k}""" for k, x in {"mean": "avg(@)", "std": "stddev_samp(@)", "low": "min(@)", "high": "max(@)", "missing": "avg(CASE WHEN @ IS NULL THEN 1.0 ELSE 0 END)"}.items()) + " FROM mf"
    for c in features.MODEL_FEATURES
)


@register("e9_feature_stats", f"WITH RECURSIVE {MODEL} {_STATS}")
def q_e9(s: SparkSession, d: str) -> DataFrame:
    return out(features.feature_stats(features.feature_pipeline(bars(s, d)), features.MODEL_FEATURES), digits=4)


# Regimes

@register(
    "f1_market_regime",
    f"""WITH {O.FEATURES}, {_DAILY}, recent AS (SELECT * FROM daily ORDER BY date DESC LIMIT 20),
one AS (SELECT sum(n) AS n, sum(up) AS up, sum(s) AS s, sqrt(greatest((sum(q) - sum(s) * sum(s) / sum(n)) / (sum(n) - 1), 0)) AS sd,
  (SELECT stddev_samp("return") FROM feat) AS ref FROM recent)
SELECT {_LABEL} AS regime, {rnd('up / n', 4)} AS breadth, {rnd('s / n')} AS mean, {rnd('sd')} AS std FROM one""",
)
def q_f1(s: SparkSession, d: str) -> DataFrame:
    return out(regimes.market_regime(_frame(s, d)))


def _f2(reference: str) -> str:
    return f"WITH {O.FEATURES}, {_dated(reference)} SELECT f.ticker, f.date, regime, market_regime, regime_multiplier FROM feat f JOIN dated ON f.date = dated.date"


@register("f2_regime_by_date", _f2("window"))
def q_f2(s: SparkSession, d: str) -> DataFrame:
    return regimes.regime_by_date(_frame(s, d)).select("ticker", "date", "regime", "market_regime", "regime_multiplier")


@register("f2_regime_by_date_history", _f2("history"))
def q_f2h(s: SparkSession, d: str) -> DataFrame:
    return regimes.regime_by_date(_frame(s, d), vol_reference="history").select("ticker", "date", "regime", "market_regime", "regime_multiplier")


@register(
    "f3_asset_regime",
    f"""WITH RECURSIVE {O.BARS}, {O.ASSET} SELECT n.ticker, n.date, held AS regime, CASE held WHEN 'BULL' THEN 1.2 WHEN 'BEAR' THEN 0.8 WHEN 'CRISIS' THEN 0.4 ELSE 1.0 END::DOUBLE AS regime_multiplier
FROM asset JOIN asset_n n ON n.ticker = asset.ticker AND n.i = asset.i""",
)
def q_f3(s: SparkSession, d: str) -> DataFrame:
    return regimes.asset_regime(bars(s, d)).select("ticker", "date", "regime", "regime_multiplier")


@register(
    "f4_confirm_regime",
    f"""WITH RECURSIVE {O.FEATURES}, lb AS (SELECT ticker, date, CASE WHEN "return" > 0.01 THEN 'BULL' WHEN "return" < -0.01 THEN 'BEAR' ELSE 'SIDEWAYS' END AS label FROM feat), {O.confirmed("cf", "lb", 2)}
SELECT n.ticker, n.date, label, held AS confirmed, CASE held WHEN 'BULL' THEN 1.2 WHEN 'BEAR' THEN 0.8 ELSE 1.0 END::DOUBLE AS multiplier FROM cf JOIN cf_n n ON n.ticker = cf.ticker AND n.i = cf.i""",
)
def q_f4(s: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("return") > 0.01, "BULL").when(F.col("return") < -0.01, "BEAR").otherwise("SIDEWAYS")
    return regimes.confirm_regime(_frame(s, d).select("ticker", "date", label.alias("label")), 2)


# Targets

_AHEAD = f"ahead AS (SELECT * FROM (SELECT ticker, date, close, ln(lead(close, 5) {O.W}) - ln(close) AS a FROM bars) WHERE a IS NOT NULL)"


@register("g1_target", f"WITH {O.BARS}, {_AHEAD} SELECT ticker, date, {rnd(O.clip('(a - avg(a) OVER d) / nullif(stddev_samp(a) OVER d, 0)', -5, 5))} AS target FROM ahead WINDOW d AS (PARTITION BY date) QUALIFY stddev_samp(a) OVER d > 0")
def q_g1(s: SparkSession, d: str) -> DataFrame:
    return out(targets.cs_target(bars(s, d)), "ticker", "date", "target")


@register(
    "g2_fold_target",
    f"""WITH {O.BARS}, ahead AS (SELECT * FROM (SELECT ticker, date, year(date) % 2 AS fold, ln(lead(close, 5) OVER (PARTITION BY year(date) % 2, ticker ORDER BY date)) - ln(close) AS a FROM bars WHERE close > 0) WHERE a IS NOT NULL)
SELECT ticker, date, CAST(fold AS INT) AS fold, {rnd(O.clip('(a - avg(a) OVER d) / (stddev_samp(a) OVER d + 1e-9)', -5, 5))} AS target FROM ahead WINDOW d AS (PARTITION BY fold, date) QUALIFY stddev_samp(a) OVER d IS NOT NULL""",
)
def q_g2(s: SparkSession, d: str) -> DataFrame:
    return out(targets.fold_target(bars(s, d).withColumn("fold", F.year("date") % 2)), "ticker", "date", "fold", "target")


@register("g3_forward_return", f"{'WITH ' + O.PREDICTIONS} SELECT ticker, date, {rnd('forward_return')} AS forward_return FROM fwd")
def q_g3(s: SparkSession, d: str) -> DataFrame:
    return out(forward(s, d))


@register("g4_last_dates", f"WITH {O.BARS} SELECT ticker, date FROM bars WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 30)")
def q_g4(s: SparkSession, d: str) -> DataFrame:
    return targets.last_n_dates(bars(s, d), 30).select("ticker", "date")


@register("g5_equal_weights", f"WITH {O.BARS} SELECT ticker, date, {rnd('1.0 / count(*) OVER (PARTITION BY date)')} AS weight FROM bars")
def q_g5(s: SparkSession, d: str) -> DataFrame:
    return out(targets.equal_weights(bars(s, d)), "ticker", "date", "weight")


@register(
    "g6_equity_summary",
    f"""WITH {O.BARS}, r AS (SELECT *, close / nullif(lag(close) {O.W}, 0) - 1 AS r FROM bars), x AS (SELECT ticker, date, {nums(OHLCV)}, {rnd(f'close / lag(close, 5) {O.W} - 1')} AS return_5,
  {rnd(f'close / lag(close, 20) {O.W} - 1')} AS return_20, {rnd(f'CASE WHEN count(r) {O.trail(20)} >= 20 THEN stddev_samp(r) {O.trail(20)} * sqrt(252) END')} AS volatility_20,
  count(*) OVER (PARTITION BY ticker) AS rows, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM r) SELECT * EXCLUDE (n) FROM x WHERE n = 1""",
)
def q_g6(s: SparkSession, d: str) -> DataFrame:
    return out(targets.equity_summary(bars(s, d)).drop("sector"))


@register("g7_price_history", f"WITH {O.BARS} SELECT ticker, date, {nums(OHLCV[:4], 4)}, CAST(volume AS BIGINT) AS volume FROM bars WHERE ticker = 'NATION_3' QUALIFY row_number() OVER (ORDER BY date DESC) <= 60")
def q_g7(s: SparkSession, d: str) -> DataFrame:
    return out(targets.price_history(bars(s, d), "NATION_3", 60), digits=4)


# Evaluation


@register("daily_ic", f"WITH {O.IC} SELECT date, {rnd('ic')} AS ic, n FROM ic")
def q_k1(s: SparkSession, d: str) -> DataFrame:
    return out(evaluate.daily_ic(pairs(s, d)))


_SPREADS = O.PREDICTIONS + """, rk AS (SELECT date, forward_return AS r, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS lo, count(*) OVER (PARTITION BY date) AS n FROM pairs),
sp AS (SELECT date, avg(r) FILTER (n - lo + 1 <= greatest(1, n // 5)) - avg(r) FILTER (lo <= greatest(1, n // 5)) AS quintile_spread,
  avg(r) FILTER (n - lo + 1 <= greatest(1, n // 10)) - avg(r) FILTER (lo <= greatest(1, n // 10)) AS decile_spread, max(n) AS n FROM rk WHERE n >= 10 GROUP BY date)"""


@register("k2_spreads", f"WITH {_SPREADS} SELECT date, {nums(['quintile_spread', 'decile_spread'])}, n FROM sp")
def q_k2(s: SparkSession, d: str) -> DataFrame:
    return out(evaluate.quantile_spreads(pairs(s, d)))


@register(
    "k3_ranking_metrics",
    f"""WITH {O.IC}, {_SPREADS[len(O.PREDICTIONS) + 2 :]} SELECT {rnd('(SELECT stddev_pop(score) FROM pairs)')} AS score_std, {rnd('(SELECT stddev_pop(forward_return) FROM pairs)')} AS return_std,
  {rnd('(SELECT avg(CASE WHEN sign(score) = sign(forward_return) THEN 1.0 ELSE 0 END) FROM pairs WHERE forward_return <> 0)')} AS hit_rate, (SELECT count(*) FROM pairs) AS samples,
  (SELECT count(DISTINCT date) FROM pairs) AS dates, {rnd('(SELECT avg(ic) FROM ic)')} AS mean_ic, {rnd('avg(quintile_spread)')} AS quintile_spread, {rnd('avg(decile_spread)')} AS decile_spread,
  {rnd('avg(quintile_spread) / stddev_samp(quintile_spread) * sqrt(252 / 5)')} AS spread_sharpe FROM sp""",
)
def q_k3(s: SparkSession, d: str) -> DataFrame:
    return out(evaluate.ranking_metrics(pairs(s, d)))


@register(
    "k4_ic_stats",
    f"""WITH {O.IC}, i AS (SELECT round(ic, 6) AS ic FROM ic WHERE n >= 10 AND date >= (SELECT max(date) FROM pred) - 700), m AS (SELECT avg(ic) AS m, stddev_samp(ic) AS s, count(*) AS n FROM i)
SELECT {rnd('m')} AS mean_ic, {rnd('s')} AS ic_std, n AS dates, {rnd('m / (s / sqrt(n) + 1e-9)', 4)} AS t_value,
  CASE WHEN abs(m) >= 0.08 THEN 'strong' WHEN abs(m) >= 0.04 THEN 'moderate' WHEN abs(m) >= 0.02 THEN 'weak' ELSE 'noise' END AS quality FROM m""",
)
def q_k4(s: SparkSession, d: str) -> DataFrame:
    one = evaluate.ic_stats(predictions(s, d), forward(s, d), 700)[1]
    return out(one.withColumn("t_value", F.round("t_value", 4)))


#: The two-sided tail of Student's t for whole degrees of freedom v, as a finite series in the angle's cosine.
_TAIL = """x AS (SELECT date, ic, n, n - 2 AS v, CASE WHEN n > 2 AND abs(ic) < 1 THEN atan(abs(ic) / sqrt(1 - ic * ic)) END AS a FROM ic),
terms AS (SELECT date, sum(c * cos(a) ^ (CASE WHEN v % 2 = 1 THEN 2 * k + 1 ELSE 2 * k END)) AS s FROM (
  SELECT date, a, v, k, coalesce(list_aggregate(list_transform(range(1, k + 1), lambda j: CASE WHEN v % 2 = 1 THEN 2 * j / (2 * j + 1) ELSE (2 * j - 1) / (2 * j) END), 'product'), 1.0) AS c
  FROM (SELECT date, a, v, unnest(range(0, CASE WHEN v % 2 = 1 THEN (v - 1) // 2 ELSE v // 2 END)) AS k FROM x WHERE a IS NOT NULL)) GROUP BY date),
tail AS (SELECT x.*, CASE WHEN n > 2 AND abs(ic) >= 1 THEN 0.0 WHEN a IS NULL THEN NULL WHEN v % 2 = 1 THEN 1 - 2 / pi() * (a + sin(a) * coalesce(s, 0)) ELSE 1 - sin(a) * s END AS p FROM x LEFT JOIN terms USING (date))"""


@register("k5_ic_p_values", f"WITH {O.IC}, {_TAIL} SELECT date, {rnd('ic')} AS ic, n, {rnd('p')} AS p_value FROM tail")
def q_k5(s: SparkSession, d: str) -> DataFrame:
    return out(evaluate.ic_p_values(evaluate.daily_ic(pairs(s, d))))
