"""Streaming ingestion, snapshots, request metrics, anchored usage counters and cooldown decisions."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.chunks import in_order
from ..functions.expr import clean_num
from ..functions.lineage import checkpointed, small
from ..operators.drift import decision
from ..operators.features import REACH
from ..operators.quality import normalize_dates, sanitize_ticker
from ..sources.partitions import MONTH, insert, replace, table_at

#: Upper bounds of the latency buckets in seconds.
BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)


def clean_stream(source: DataFrame, overlap: str = "3 days") -> DataFrame:
    """Bars of a stream by row-local rules only, re-deliveries within ``overlap`` removed."""
    prices = ["open", "high", "low", "close", "volume"]
    rows = source.withColumns({c: clean_num(F.col(c)) for c in prices}).withColumn("ticker", sanitize_ticker(F.col("ticker")))
    rows = rows.where("ticker is not null and date is not null and close > 0")
    rows = rows.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close"), "bar_ts": F.to_timestamp("date")})
    return rows.withWatermark("bar_ts", overlap).dropDuplicatesWithinWatermark(["ticker", "date"])


def _started(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_bars(source: DataFrame, target: str, checkpoint: str, overlap: str = "3 days", once: bool = True) -> StreamingQuery:
    """Append a stream of bars to the table ``target``, partitioned by month, inserting only absent (ticker, date); a batch reads the months that it touches."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = normalize_dates(batch.drop("bar_ts"), "close")
        rows = rows.withColumns({"volume": F.coalesce("volume", F.lit(0.0)), "source": F.lit("stream")})
        insert(rows, target, ["ticker", "date"], ["close"])

    return _started(clean_stream(source, overlap).writeStream.foreachBatch(write), checkpoint, None if once else "1 minute")


def moved_dates(bars: DataFrame, keys: DataFrame, reach: int) -> tuple[Any, Any, Any]:
    """(warm, lo, hi) for new bars ``keys`` (ticker, date): the dates from lo to hi that they can move, and the first date needed to compute those.

    A bar moves its own date and the ``reach`` following bars of its ticker, and by
    the cross-section all tickers of these dates; every ticker's frames reach
    ``reach`` bars back. Both tables should be checkpointed or stored.
    """
    ends = checkpointed(keys.groupBy("ticker").agg(F.min("date").alias("_from"), F.max("date").alias("_to")))  # a row a ticker of the batch
    lo, last = ends.agg(F.min("_from"), F.max("_to")).first()
    if lo is None:
        return None, None, None
    at = bars.select("ticker", "date")
    ahead, back = Window.partitionBy("ticker").orderBy("date"), Window.partitionBy("ticker").orderBy(F.desc("date"))
    later = at.where(F.col("date") > F.lit(lo)).join(small(ends.select("ticker", "_to")), "ticker").where("date > _to")
    hi = later.withColumn("_n", F.row_number().over(ahead)).where(F.col("_n") <= reach).agg(F.max("date")).first()[0]
    before = at.where(F.col("date") < F.lit(lo)).withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= reach)
    return before.agg(F.min("date")).first()[0] or lo, lo, max(x for x in (hi, last) if x is not None)


def stream_snapshot(
    source: DataFrame, bars: str, snapshot: Callable[[DataFrame], DataFrame], published: str, checkpoint: str, reach: int = REACH, log: str | None = None, version: str = "live", every: str | None = None
) -> StreamingQuery:
    """For each batch of bars: store the absent ones at ``bars``, compute the snapshot of all dates that they move, and replace these dates at ``published``.

    ``snapshot`` maps bars to rows with a date. It sees the bars from the warm-up
    before those dates on, so that a late bar changes the dates after it as a
    computation of everything would. Dates are partitions and replaced whole: a
    batch that comes twice leaves the same table. With ``log``, the scores of the
    dates (column ``score``) go to the prediction log there, unless it has them.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = checkpointed(batch)
        insert(rows, bars, ["ticker", "date"])
        stored = table_at(spark, bars)
        if stored is None:
            return
        warm, lo, hi = moved_dates(stored, rows.select("ticker", "date"), reach)
        if lo is None:
            return
        part = stored.where(F.col("date").between(F.lit(warm), F.lit(hi)) & F.col(MONTH).between(*(100 * x.year + x.month for x in (warm, hi)))).drop(MONTH)
        made = checkpointed(snapshot(part).where(F.col("date").between(F.lit(lo), F.lit(hi))))
        replace(made.repartition("date"), published, ["date"])
        if log:
            insert(made.select("ticker", "date", "score", F.lit(version).alias("model_version")), log, ["ticker", "date", "model_version"])

    return _started(source.writeStream.foreachBatch(write), checkpoint, every)


def bucket_quantile(q: float) -> Column:
    """Quantile of a latency histogram (le_0.05 ...) by linear interpolation inside the bucket."""
    n = F.col("requests")
    want = n * q
    out = F.lit(BUCKETS[-1])
    for i in range(len(BUCKETS) - 1, -1, -1):
        hi, lo = BUCKETS[i], (BUCKETS[i - 1] if i else 0.0)
        below = F.col(f"`le_{BUCKETS[i - 1]}`") if i else F.lit(0)
        upto = F.col(f"`le_{hi}`")
        out = F.when(upto >= want, lo + (hi - lo) * F.coalesce(F.try_divide(want - below, upto - below), F.lit(0.0))).otherwise(out)
    return out


def request_metrics(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", watermark: str | None = "10 minutes") -> DataFrame:
    """Per endpoint and sliding window: requests, errors, error share, rate, latency buckets and 95 % quantile.

    events: ts, endpoint, latency (seconds), error. Works on a stream and on a table.
    """
    if events.isStreaming and watermark:
        events = events.withWatermark("ts", watermark)
    counts = [F.count_if(F.col("latency") <= b).alias(f"le_{b}") for b in BUCKETS]
    rows = events.groupBy(F.window("ts", window, slide).alias("w"), "endpoint").agg(F.count("*").alias("requests"), F.count_if("error").alias("errors"), *counts)
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return rows.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "endpoint", "requests", "errors", (F.col("errors") / F.col("requests") * 100).alias("error_percent"),
        (F.col("requests") / seconds).alias("rate"), *[F.col(f"`le_{b}`") for b in BUCKETS], bucket_quantile(0.95).alias("p95"),
    )


def prefix_lookup(events: DataFrame, rules: DataFrame, exempt: list[str] | None = None, path: str = "path") -> DataFrame:
    """``events`` with the value and prefix of the first rule (order, prefix, value) whose prefix equals the path or ends before '/' or '?'.

    The rules are few and fixed; paths match once per distinct path, and exempt ones get none.
    """
    paths = events.select(path).distinct()
    p = F.col(path)
    hit = (p == F.col("prefix")) | (F.startswith(p, F.concat("prefix", F.lit("/")))) | (F.startswith(p, F.concat("prefix", F.lit("?"))))
    free = F.lit(False)
    for e in exempt or []:
        free = free | (p == e) | F.startswith(p, F.lit(e + "/")) | F.startswith(p, F.lit(e + "?"))
    found = paths.where(~free).join(small(rules, 10_000), hit).groupBy(path).agg(F.min_by(F.struct("prefix", "value"), "order").alias("_r"))
    return events.join(found, path, "left").select(*events.columns, F.col("_r.prefix").alias("rule"), F.col("_r.value").alias("rule_value"))


def count_one(state: tuple[float, float] | None, t: float, ttl: float, limit: int, blocked_over: bool) -> tuple[tuple[float, int], tuple[int, int, bool, float]]:
    """The counter (start, used) after an event at ``t``, and its (used, remaining, locked, seconds to reset): it starts with the first event and ends ``ttl`` later."""
    start, used = (t, 1) if state is None or t >= state[0] + ttl else (state[0], int(state[1]) + 1)
    return (start, used), (used, max(0, limit - used), used > limit if blocked_over else used >= limit, start + ttl - t)


def count_anchored(times: list[float], ttl: float, limit: int, blocked_over: bool, state: tuple[float, int] | None = None) -> tuple[list[tuple[int, int, bool, float]], tuple[float, int] | None]:
    """What :func:`count_one` gives after each event, and the last counter."""
    out = []
    for t in times:
        state, one = count_one(state, t, ttl, limit, blocked_over)
        out.append(one)
    return out, state


USAGE = "key string, t double, used int, remaining int, locked boolean, reset_in double"


def _usage_rows(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    return events.select(F.concat_ws("|", *keys).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("u"))


def _usage(ttl: float, limit: int, blocked_over: bool) -> Callable[..., tuple[Any, tuple]]:
    """A step along a key's events (key, u in microseconds), which gives a row of ``USAGE`` each."""

    def step(state: Any, key: str, u: int, _: int = 0) -> tuple[Any, tuple]:
        t = u / 1e6
        state, made = count_one(state, t, ttl, limit, blocked_over)
        return state, (key, t, *made)

    return step


def anchored_usage(events: DataFrame, keys: list[str], ttl: float, limit: int, blocked_over: bool = False, time: str = "ts") -> DataFrame:
    """The counter of every key after each of its events (batch twin); sequential per key."""
    return in_order(_usage_rows(events, keys, time), "key", "u", _usage(ttl, limit, blocked_over), USAGE)


def rate_limits(events: DataFrame, rules: DataFrame, exempt: list[str] | None = None, ttl: float = 60.0, client: str = "client", path: str = "path", time: str = "ts") -> DataFrame:
    """(client, rule, t, used, limit, remaining, blocked, reset_in) after each request that a rule (order, prefix, value) limits.

    A request counts for the first rule whose prefix it has; a client has one
    counter a rule, which starts with its first request and ends ``ttl`` seconds
    later. Requests without a rule, or exempt, are not counted.
    """
    ruled = prefix_lookup(events, rules, exempt, path).where("rule is not null")
    usage = anchored_usage(ruled, [client, "rule"], ttl, 1, True, time)
    limits = small(rules.select(F.col("prefix").alias("rule"), F.col("value").alias("limit")), 10_000)
    at = F.instr("key", "|")
    rows = usage.select(F.substring("key", F.lit(1), at - 1).alias(client), F.substring("key", at + 1, F.length("key")).alias("rule"), "t", "used", "reset_in").join(limits, "rule")
    left = F.greatest(F.lit(0), F.col("limit") - F.col("used"))
    return rows.select(client, "rule", "t", "used", "limit", left.alias("remaining"), (F.col("used") > F.col("limit")).alias("blocked"), "reset_in")


def locked_clients(events: DataFrame, features: list[str], ttl: float, limit: int, as_of: float, client: str = "client", feature: str = "endpoint", time: str = "ts") -> DataFrame:
    """Per client at ``as_of`` (epoch seconds): used (feature -> count), locked (features, sorted) and fully_locked (all of ``features``).

    A counter that has ended by then counts nothing; a feature is locked from ``limit`` uses on.
    """
    rows = events.where(F.col(feature).isin(features) & (F.unix_micros(F.col(time).cast("timestamp")) <= int(as_of * 1e6)))
    usage = anchored_usage(rows, [client, feature], ttl, limit, time=time)
    last = usage.groupBy("key").agg(F.max_by(F.struct("t", "used", "reset_in"), F.struct("t", "used")).alias("x"))
    parts = F.split("key", "\\|")
    live = last.where(F.col("x.t") + F.col("x.reset_in") > as_of).select(parts[0].alias(client), parts[1].alias(feature), F.col("x.used").alias("used"))
    clients = events.select(F.col(client).cast("string").alias(client)).distinct()
    each = live.groupBy(client).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(feature, "used")))).alias("used"),  # at most one entry a feature
        F.array_sort(F.collect_list(F.when(F.col("used") >= limit, F.col(feature)))).alias("locked"),
    )
    none = F.array().cast("array<string>")
    out = clients.join(each, client, "left").withColumn("locked", F.coalesce("locked", none))
    return out.withColumn("fully_locked", F.size("locked") == len(set(features)))


#: Groups of keys whose state a stream keeps together.
GROUPS = 1024


def _in_time_order(rows: DataFrame, step: Callable[..., tuple[Any, tuple]], ends: Callable[[list], float], schema: str, groups: int = GROUPS) -> DataFrame:
    """``step(state, key, u, x) -> (state, made)`` along each key's rows (key, u, x, _at) of a stream, in the order of ``u`` (microseconds), however they come.

    Events wait in the state until the watermark has passed them, as none can come
    before them any more; they are then taken in time order. The state (numbers)
    that the last event left stays until the watermark has passed ``ends`` of it,
    when it can change nothing more, and goes. Keys are dealt by their hash to
    ``groups`` and their state lies in that of the group, as a call of Python costs
    far more than a key's few events; a group without any goes as well.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (us, xs, now) for k, us, xs, now in zip(*state.get)} if state.exists else {}
        if not state.hasTimedOut:
            for f in batches:
                for k, u, x in zip(f["key"].tolist(), f["u"].tolist(), f["x"].tolist()):
                    if k not in held:
                        held[k] = ([], [], [])
                    held[k][0].append(u)
                    held[k][1].append(x)
        mark = state.getCurrentWatermarkMs()
        passed, made, left, dues = mark * 1000, [], [], []
        for k, (us, xs, now) in held.items():
            waiting = sorted(zip(us, xs), key=itemgetter(0))
            n = bisect_right(waiting, passed, key=itemgetter(0))
            now = now or None
            for u, x in waiting[:n]:
                now, one = step(now, k, u, x)
                made.append(one)
            due = -(-waiting[n][0] // 1000) if n < len(waiting) else int(ends(now) * 1000) if now else 0
            if n < len(waiting) or due > mark:
                left.append((k, [u for u, _ in waiting[n:]], [x for _, x in waiting[n:]], [float(v) for v in now or []]))
                dues.append(due)
        if left:
            state.update(tuple(map(list, zip(*left))))
            state.setTimeoutTimestamp(max(min(dues), mark + 1))
        elif state.exists:
            state.remove()
        if made:
            yield pd.DataFrame(dict(zip(names, zip(*made))))

    grouped = rows.withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("_group")
    kept = "keys array<string>, us array<array<long>>, xs array<array<long>>, now array<array<double>>"
    return grouped.applyInPandasWithState(run, schema, kept, "append", "EventTimeTimeout")


def stream_anchored_usage(events: DataFrame, keys: list[str], ttl: float, limit: int, blocked_over: bool = False, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The counters of a stream of events, which may come in any order within ``late``; a counter is kept until the watermark has passed its end."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    rows = rows.select(F.concat_ws("|", *keys).alias("key"), F.unix_micros("_at").alias("u"), F.lit(0).cast("long").alias("x"), "_at")
    return _in_time_order(rows, _usage(ttl, limit, blocked_over), lambda now: now[0] + ttl, USAGE)


DECISIONS = "key string, t long, severity int, decision string, retrain_required boolean"


def _decided(cooldown: int) -> Callable[..., tuple[Any, tuple]]:
    """A step along a key's severities (key, t, severity), which gives a row of ``DECISIONS`` each."""

    def step(last: list | None, key: str, t: int, severity: int) -> tuple[list | None, tuple]:
        told, at = decision(t, severity, cooldown, int(last[0]) if last else None)
        return None if at is None else [at], (key, t, severity, told, severity >= 10)

    return step


def stream_retrain_decisions(events: DataFrame, cooldown: int = 3600, late: str = "1 hour") -> DataFrame:
    """Decisions on a stream of severity events (key, t, severity), which may come in any order within ``late``; a trigger is remembered for the cooldown."""
    one = _decided(cooldown)
    rows = events.withColumn("_at", F.timestamp_seconds("t")).withWatermark("_at", late)
    rows = rows.select("key", (F.col("t").cast("long") * 1_000_000).alias("u"), F.col("severity").cast("long").alias("x"), "_at")
    return _in_time_order(rows, lambda last, key, u, x: one(last, key, u // 1_000_000, x), lambda now: now[0] + cooldown, DECISIONS)


def retrain_decisions(events: DataFrame, cooldown: int = 3600, key: str = "key") -> DataFrame:
    """(key, t, severity, decision, retrain_required) of severity events in time order (batch twin); sequential per key."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("t").cast("long").alias("t"), F.col("severity").cast("int").alias("severity"))
    return in_order(rows, "key", "t", _decided(cooldown), DECISIONS)
