"""Sources and sinks: bars, feature store, prediction log, universe, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clean_num
from ..functions.lineage import checkpointed
from ..operators.quality import sanitize_ticker
from .partitions import MONTH, absent, first_of, month, remove, table_at

BARS = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()), T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()), T.StructField("source", T.StringType()),
])

#: Provider column names (lower case, blanks as underscores) that mean a canonical one.
NAMES = {"adj_close": "close", "adjclose": "close", "adjusted_close": "close", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume", "timestamp": "date", "datetime": "date", "symbol": "ticker"}


def read_bars(bars: DataFrame, tickers: DataFrame | list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the tickers between two dates, ordered by (ticker, date); both filters reach the scan.

    A list of tickers is a literal filter; a DataFrame (ticker) is a semi join.
    """
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    if isinstance(tickers, list):
        bars = bars.where(F.col("ticker").isin([t.upper() for t in tickers]))
    elif tickers is not None:
        bars = bars.join(tickers.select(F.upper("ticker").alias("ticker")), "ticker", "left_semi")
    return bars.orderBy("ticker", "date")


def new_rows(new: DataFrame, target: DataFrame, keys: list[str], order: list[Column | str], prune: str | None = "date") -> DataFrame:
    """Rows of ``new``, the first of each key in ``order``, whose key ``target`` lacks.

    The target is cut to the batch's range of ``prune`` before the anti join.
    """
    fresh = first_of(new, keys, order)
    have = target.select(*keys)
    if prune:
        span = new.agg(F.min(prune).alias("_lo"), F.max(prune).alias("_hi"))
        have = have.join(F.broadcast(span), F.col(prune).between(F.col("_lo"), F.col("_hi"))).select(*keys)  # one row
    return fresh.join(have, keys, "left_anti")


def append_bars(new: DataFrame, target: DataFrame, source: str = "feed", order: list[Column | str] | None = None) -> DataFrame:
    """The bars that ``target`` lacks by (ticker, date), volume 0 where missing, with a source tag: the rows to append."""
    tagged = new.withColumn("volume", F.coalesce(F.col("volume"), F.lit(0.0))).withColumn("source", F.lit(source))
    return new_rows(tagged, target, ["ticker", "date"], order or ["close"])


def to_store(df: DataFrame, features: list[str], version: str) -> DataFrame:
    """(ticker, date, feature_version, features map): non-finite features as 0."""
    pairs = [x for f in features for x in (F.lit(f), F.coalesce(clean_num(F.col(f)), F.lit(0.0)))]
    return df.select("ticker", "date", F.lit(version).alias("feature_version"), F.create_map(*pairs).alias("features"))


def write_features(df: DataFrame, features: list[str], version: str, path: str) -> None:
    """Append the features that the store at ``path`` lacks, partitioned by version and month.

    A (ticker, date) that is there without some of the features gets another row
    with all of them; readers take each feature from the row that has it.
    """
    rows = checkpointed(first_of(to_store(df, features, version).withColumn(MONTH, month()), ["ticker", "date"], [F.lit(0)]))
    have = read_store(df.sparkSession, path)
    if have is not None:
        rows = absent(rows, with_all(have.where(F.col("feature_version") == version), features, MONTH), ["ticker", "date"])
    rows.repartition(MONTH).write.mode("append").partitionBy("feature_version", MONTH).parquet(path)


def with_all(store: DataFrame, features: list[str], *more: str) -> DataFrame:
    """(ticker, date, *more) of the keys for which each of ``features`` is stored, in one row or in several."""
    has = [F.max(F.map_contains_key("features", f)).alias(f"_{i}") for i, f in enumerate(features)]
    every = F.least(*[F.col(f"_{i}") for i in range(len(features))], F.lit(True))
    return store.groupBy("ticker", "date", *more).agg(*has).where(every).select("ticker", "date", *more)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The feature store at ``path``, None if there is none yet."""
    return table_at(spark, path, f"ticker string, date date, features map<string,double>, feature_version string, {MONTH} int")


def stored_or_computed(bars: DataFrame, path: str, version: str, features: list[str], compute: Callable[[DataFrame], DataFrame], days: int = 380) -> DataFrame:
    """Features of all bars from the store at ``path``; what it lacks is computed and stored first.

    A bar counts as stored if all ``features`` are. ``compute`` maps bars to rows
    (ticker, date, features). It sees the bars of all tickers from ``days`` before
    the first missing date on, as cross-sections need all of a date, and only
    missing keys are appended. Recursions need more than that:
    :func:`panelworks.operators.features.resumed_pipeline`.
    """
    spark = bars.sparkSession
    store = read_store(spark, path)
    if store is None:
        write_features(compute(bars), features, version, path)
    else:
        gone = checkpointed(missing_keys(bars, store, version, features))
        first = gone.agg(F.min("date")).first()[0]
        if first is not None:
            recent = bars.where(F.col("date") >= F.date_sub(F.lit(first), days))
            fresh = compute(recent).join(gone, ["ticker", "date"], "left_semi")
            write_features(fresh, features, version, path)
    return read_features(read_store(spark, path), features, version)


def read_features(store: DataFrame, features: list[str], version: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Wide features of a version between two dates; the version prunes partitions."""
    rows = store.where(F.col("feature_version") == version)
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows.groupBy("ticker", "date").agg(*[F.max(F.col("features")[f]).alias(f) for f in features])  # a row each time that columns were added


def missing_keys(bars: DataFrame, store: DataFrame, version: str, features: list[str] | None = None) -> DataFrame:
    """(ticker, date) of bars without stored features of the version: without any row, or without one of ``features``."""
    have = store.where(F.col("feature_version") == version)
    have = have.select("ticker", "date") if features is None else with_all(have, features)
    return bars.select("ticker", "date").join(have, ["ticker", "date"], "left_anti")


def with_warmup(bars: DataFrame, missing: DataFrame, days: int = 380) -> DataFrame:
    """The bars needed to compute the missing keys: from ``days`` before each ticker's first missing date on."""
    first = missing.groupBy("ticker").agg(F.min("date").alias("_first"))
    return bars.join(first, "ticker").where(F.col("date") >= F.date_sub("_first", days)).drop("_first")


def drop_feature_version(store: DataFrame, version: str) -> DataFrame:
    """The store without a version; on disk, one partition folder."""
    return store.where(F.col("feature_version") != version)


def drop_version_on_disk(spark: SparkSession, path: str, version: str) -> None:
    """Delete a version's folder of the store at ``path``; the files of other versions stay as they are."""
    remove(spark, path, [f"feature_version={version}"])


def append_predictions(new: DataFrame, target: DataFrame) -> DataFrame:
    """Predictions that ``target`` lacks by (ticker, date, model_version), defaults in place of missing values."""
    filled = new.withColumns({"model_version": F.coalesce("model_version", F.lit("unknown")), "score": F.coalesce("score", F.lit(0.0))})
    return new_rows(filled, target, ["ticker", "date", "model_version"], [F.desc("score")])


def read_predictions(log: DataFrame, date: str, model_version: str | None = None) -> DataFrame:
    """A date's predictions (of a model version), best score first."""
    rows = log.where(F.col("date") == F.lit(date).cast("date"))
    if model_version:
        rows = rows.where(F.col("model_version") == model_version)
    return rows.orderBy(F.desc("score"), "ticker")


def apply_retention(df: DataFrame, as_of: str, days: int = 760) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return df.where(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def normalize_wide_feed(df: DataFrame) -> DataFrame:
    """Provider columns renamed to the canonical ones; an adjusted close replaces the close; the first of equal names stays."""
    seen: dict[str, str] = {}
    names = [(c, c.strip().lower().replace(" ", "_")) for c in df.columns]
    adjusted = [c for c, n in names if NAMES.get(n) == "close" and n != "c"]
    for c, n in names:
        name = NAMES.get(n, n)
        if name == "close" and adjusted and c != adjusted[0]:
            continue
        seen.setdefault(name, c)
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in seen.items()])


_PAYLOAD = "struct<values:array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>>"


def normalize_json_feed(df: DataFrame, payload: str = "payload", start: str | None = None, end: str | None = None) -> DataFrame:
    """Typed bars from a JSON payload per ticker; unparsable dates, high < low and closes of 0 or less are dropped."""
    rows = df.select("ticker", F.explode(F.from_json(payload, _PAYLOAD)["values"]).alias("v"))
    day = F.to_date(F.try_to_timestamp("v.datetime"))
    rows = rows.select("ticker", day.alias("date"), *[clean_num(F.col(f"v.{c}")).alias(c) for c in ("open", "high", "low", "close", "volume")])
    rows = rows.where("date is not null and high >= low and close > 0")
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows


def read_universe_file(spark: SparkSession, path: str, **limits) -> DataFrame:
    """:func:`read_universe` of a JSON document at ``path``, which may span lines."""
    return read_universe(spark.read.option("multiLine", True).json(path), **limits)


def read_universe(documents: DataFrame, most: int = 150, final: int = 120) -> DataFrame:
    """(ticker) of a universe document (version, created_utc, description, min_history_days, tickers): clean, distinct, sorted.

    A document without its fields, with an invalid or repeated ticker, or with over ``most`` of them makes the job fail.
    """
    need = ["version", "created_utc", "description", "min_history_days", "tickers"]
    if absent := [c for c in need if c not in documents.columns]:
        raise ValueError(f"universe without {absent}")
    rows = documents.select(F.explode("tickers").alias("raw"))
    rows = rows.select(sanitize_ticker(F.col("raw")).alias("ticker"), "raw")
    bad = F.raise_error(F.concat(F.lit("invalid ticker: "), F.coalesce(F.col("raw"), F.lit("null")))).cast("string")
    rows = rows.select(F.when(F.col("ticker").isNull(), bad).otherwise(F.col("ticker")).alias("ticker"))
    each = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.count("*")).over(Window.partitionBy(F.lit(0))).alias("all"))
    wrong = (F.col("n") > 1) | (F.col("all") > most)
    return each.select(F.when(wrong, F.raise_error(F.lit("repeated tickers, or too many")).cast("string")).otherwise(F.col("ticker")).alias("ticker")).orderBy("ticker").limit(final)


def snapshot_documents(signals: DataFrame, exposure: DataFrame, model_version: str = "m20") -> DataFrame:
    """(date, document): one nested JSON document per date with meta, summary, drift and signals.

    signals: date, ticker, score, hybrid, weight; exposure: date, longs, shorts,
    gross, net, bias, drift_state, severity, exposure_scale.
    """
    item = F.struct((-F.col("score")).alias("_o"), "ticker", F.round("score", 6).alias("raw_model_score"), F.col("hybrid").alias("hybrid_consensus_score"), "weight")
    lists = signals.groupBy("date").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    rows = lists.join(exposure, "date").withColumn("signals", F.transform("_l", lambda x: x.dropFields("_o")))
    document = F.struct(
        F.struct(F.lit(model_version).alias("model_version"), "drift_state", F.col("longs").alias("long_signals"), F.col("shorts").alias("short_signals")).alias("meta"),
        F.struct(F.transform(F.slice("signals", 1, 5), lambda x: x["ticker"]).alias("top_5_tickers"), F.col("bias").alias("portfolio_bias"), F.round("gross", 4).alias("gross_exposure"), F.round("net", 4).alias("net_exposure")).alias("executive_summary"),
        F.struct(F.col("date").cast("string").alias("snapshot_date"), F.struct("drift_state", F.col("severity").alias("severity_score"), "exposure_scale").alias("drift"), "signals").alias("snapshot"),
    )
    return rows.select("date", F.to_json(document).alias("document"), F.size("signals").alias("n_signals"))


def write_snapshot(documents: DataFrame, path: str) -> None:
    """Append one document a line, partitioned by date."""
    documents.select("date", "document").write.mode("append").partitionBy("date").text(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(date, document) of the snapshots at ``path``; a filter on the date prunes folders."""
    return spark.read.schema("document string, date date").text(path).select("date", "document")


def pick_provider(feeds: dict[str, DataFrame], priority: list[str], gate: Column) -> DataFrame:
    """Rows of the first provider, in priority order, whose feed of the ticker passes ``gate``.

    gate: an aggregate condition over a (ticker, provider) feed.
    """
    rows = None
    for i, name in enumerate(priority):
        if name in feeds:
            part = feeds[name].withColumns({"provider": F.lit(name), "_p": F.lit(i)})
            rows = part if rows is None else rows.unionByName(part)
    valid = rows.groupBy("ticker", "_p").agg(gate.alias("_ok")).where("_ok").groupBy("ticker").agg(F.min("_p").alias("_p"))
    return rows.join(valid, ["ticker", "_p"]).drop("_p")


