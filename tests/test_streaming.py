"""Streams give the rows of their batch twins."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pytest
from panelworks.streaming import jobs
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture()
def feed(spark, tmp_path):
    """Requests as a table and as a stream of two files, the second one later."""
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=37 * i), f"c{i % 3}", "/a" if i % 2 else "/b", (i % 11) / 10, i % 7 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "ts timestamp, client string, endpoint string, latency double, error boolean")
    for part in (df.where("ts < '2024-01-01 00:40:00'"), df.where("ts >= '2024-01-01 00:40:00'")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), str(tmp_path)


def drain(spark, stream, name, path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_request_metrics(spark, feed):
    df, stream, path = feed
    got = drain(spark, jobs.request_metrics(stream, watermark=None), "metrics", path, "complete")
    assert rows(got) == rows(jobs.request_metrics(df)) and got.count() > 50


def shuffled(spark, df, path, end):
    """``df`` as a stream of four files in which events come up to half an hour late, and a fifth one with ``end``, which moves the watermark past all."""
    at = F.unix_timestamp("ts") + F.pmod(F.xxhash64("ts", "client"), F.lit(1800))  # when it comes
    files = df.withColumn("_file", F.floor(F.percent_rank().over(Window.orderBy(at)) * 3.999)).cache()
    for k in range(4):
        files.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(f"{path}/late")
    spark.createDataFrame([end], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/late")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/late")


END = (dt.datetime(2024, 3, 1), "end", "/end", 0.0, False)


def drained(spark, stream, name, path):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_usage_of_a_shuffled_stream_is_that_of_its_batch_twin(spark, feed):
    df, _, path = feed
    stream = shuffled(spark, df, path, END)
    got, left = drained(spark, jobs.stream_anchored_usage(stream, ["client", "endpoint"], 600.0, 2, late="40 minutes"), "usage", path)
    want = jobs.anchored_usage(df, ["client", "endpoint"], 600.0, 2)
    assert rows(got) == rows(want) and got.where("locked").count() > 10 and got.where("used = 1").count() > 6
    assert left == 1  # the last event waits; all other state is gone


def test_decisions_of_a_shuffled_stream_are_those_of_their_batch_twin(spark, feed):
    df, _, path = feed

    def severity(d):
        return d.select(F.col("endpoint").alias("key"), F.unix_timestamp("ts").alias("t"), (F.second("ts") % 12).cast("int").alias("severity"))

    got, left = drained(spark, jobs.stream_retrain_decisions(severity(shuffled(spark, df, path, END)), 900, "40 minutes"), "decisions", path)
    assert rows(got) == rows(jobs.retrain_decisions(severity(df), 900)) and got.select("decision").distinct().count() == 4
    assert left == 1


def test_a_late_bar_moves_the_dates_after_it(spark, tmp_path):
    start = dt.date(2023, 1, 2)
    rng = np.random.default_rng(5)
    all_ = [(t, start + dt.timedelta(days=i), 100 + float(rng.normal())) for t in "ABCD" for i in range(60) if t != "D" or i < 40]
    schema = "ticker string, date date, close double"
    late = [r for r in all_ if r[0] == "B" and r[1] == start + dt.timedelta(days=20)]
    first, second = [r for r in all_ if r not in late and r[1] < start + dt.timedelta(days=50)], late
    third = [r for r in all_ if r[1] >= start + dt.timedelta(days=50)]
    seen = []

    def snapshot(bars):
        seen.append(bars.agg(F.min("date"), F.max("date")).first())
        mean = F.avg("close").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(-7, 0))
        return bars.withColumn("m", mean).withColumn("score", F.col("m") - F.avg("m").over(Window.partitionBy("date"))).select("date", "ticker", "score")

    whole = {(r["ticker"], r["date"]): round(r["score"], 9) for r in snapshot(spark.createDataFrame(all_, schema)).collect()}
    seen.clear()
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    paths = [f"{tmp_path}/{x}" for x in ("bars", "out", "state", "log")]

    def run(state):
        jobs.stream_snapshot(source, paths[0], snapshot, paths[1], state, reach=7, log=paths[3]).awaitTermination()
        return {(r["ticker"], r["date"]): round(r["score"], 9) for r in spark.read.parquet(paths[1]).collect()}

    assert run(paths[2]) == whole
    assert seen[1] == (start + dt.timedelta(days=13), start + dt.timedelta(days=27))  # the late bar: its date and seven bars after it, from seven before
    count = spark.read.parquet(paths[1]).count()
    assert run(f"{tmp_path}/again") == whole and spark.read.parquet(paths[1]).count() == count == len(all_)  # every batch once more
    log = spark.read.parquet(paths[3])
    assert log.count() == log.select("ticker", "date").distinct().count() == len(all_)


def test_state_passes_from_batch_to_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(f"k{i % 3}" if i % 4 else None, 10 * i, i % 13) for i in range(200)], "key string, t long, severity int")
    whole = rows(jobs.retrain_decisions(df, 300))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows(jobs.retrain_decisions(df, 300)) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_client_is_fully_locked_when_all_its_features_are(spark):
    at = dt.datetime(2024, 1, 1)
    uses = [("x", "a")] * 3 + [("x", "b")] * 3 + [("y", "a")] * 3 + [("z", "c")] * 9
    df = spark.createDataFrame([(at + dt.timedelta(seconds=i), c, f) for i, (c, f) in enumerate(uses)], "ts timestamp, client string, endpoint string")
    now = df.agg(F.max(F.unix_micros("ts"))).first()[0] / 1e6
    got = {r["client"]: (r["locked"], r["fully_locked"]) for r in jobs.locked_clients(df, ["a", "b"], 600.0, 3, now).collect()}
    assert got == {"x": (["a", "b"], True), "y": (["a"], False), "z": ([], False)}
    later = {r["client"]: r["fully_locked"] for r in jobs.locked_clients(df, ["a", "b"], 600.0, 3, now + 700).collect()}
    assert not any(later.values())


def many_clients(spark, clients, n):
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("id") * 7_919_000_003) % 10_000_000_000)
    return spark.range(n).select(at.alias("ts"), F.concat(F.lit("c"), F.col("id") % clients).alias("client"), F.lit("/a").alias("endpoint"))


def test_many_short_keys_cost_no_more_than_few_long_ones(spark):
    def seconds(clients):
        start = time.monotonic()
        got = jobs.anchored_usage(many_clients(spark, clients, 40_000), ["client", "endpoint"], 600.0, 2).agg(F.count("*"), F.countDistinct("key"), F.count_if(F.col("used") == 1)).first()
        assert got[:2] == (40_000, clients) and got[2] >= clients
        return time.monotonic() - start

    seconds(10)
    few = min(seconds(10) for _ in range(2))
    assert min(seconds(20_000) for _ in range(2)) < 3 * few + 2


def test_a_stream_keeps_the_state_of_many_keys_in_few_groups(spark, tmp_path):
    df = many_clients(spark, 3000, 9000).cache()
    for k in range(2):
        df.where(F.pmod(F.xxhash64("ts"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    _, left = drained(spark, jobs.stream_anchored_usage(stream, ["client", "endpoint"], 600.0, 2, late="6 hours"), "waiting", str(tmp_path))
    assert 0 < left <= 1024  # not a row a key
    spark.createDataFrame([(END[0], "end", "/end")], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, left = drained(spark, jobs.stream_anchored_usage(stream, ["client", "endpoint"], 600.0, 2, late="6 hours"), "whole", str(tmp_path))
    assert rows(got) == rows(jobs.anchored_usage(df, ["client", "endpoint"], 600.0, 2)) and left == 1
