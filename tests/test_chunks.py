"""Histories cut into chunks, and dates spread over tasks, give what whole ones give."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from panelworks.functions import chunks, wide
from panelworks.functions import ewm as E
from panelworks.operators import evaluate, features, indicators, quality, regimes
from panelworks.sources.tables import bars
from pyspark.sql import functions as F

KEY = ["ticker", "date"]


@pytest.fixture(scope="module")
def daily(spark, sf_dir):
    """Daily bars, with tickers of very different lengths and holes in the closes of one."""
    df = bars(spark, sf_dir, "day").select("ticker", "date", "open", "high", "low", "close", "volume")
    hole = (F.col("ticker") == "NATION_3") & (F.dayofmonth("date") % 9 < 2)
    df = df.withColumn("close", F.when(~hole, F.col("close"))).where("ticker <> 'NATION_8' or year(date) = 1995")
    return df.checkpoint()


def same(a, b, exact=()):
    a, b = (x.select(*sorted(x.columns)).toPandas().sort_values(KEY, ignore_index=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for c in a.columns:
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            assert a[c].equals(b[c]), c


def test_places_are_exact_and_spread(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"ticker": np.where(rng.random(5000) < 0.8, "hot", rng.choice(["a", "b", None], 5000)), "date": rng.permutation(5000)})
    got = chunks.places(spark.createDataFrame(pdf), 9, "ticker", "date").withColumn("task", F.spark_partition_id()).toPandas()
    want = got.sort_values("date").groupby("ticker", dropna=False).cumcount()
    assert (got["_pos"] == want.reindex(got.index)).all()


def test_chunks_have_their_rows_and_the_rows_before(spark, daily):
    rows, several = chunks.chunked(daily, 7, 50)
    assert several
    f = rows.select("ticker", "date", "_chunk", "_lead").toPandas()
    own = f[f["_lead"] == 0].sort_values(KEY)
    assert len(own) == daily.count() and own.groupby(["ticker", "_chunk"]).size().max() == 50
    assert (own["_chunk"] == own.groupby("ticker").cumcount() // 50).all()
    for (t, k), g in f[f["_chunk"] > 0].groupby(["ticker", "_chunk"]):
        before = own[(own["ticker"] == t) & (own["_chunk"] == k - 1)]["date"].tail(7).tolist()
        assert g[g["_lead"] > 0].sort_values("_lead", ascending=False)["date"].tolist() == before
    assert not chunks.chunked(daily, 7, 10_000)[1]
    with pytest.raises(ValueError):
        chunks.chunked(daily, 7, 5)


def test_window_features_in_chunks(spark, daily):
    whole, cut = features.window_features(daily), features.window_features(daily, features.REACH)
    same(whole, cut)
    one = daily.where("ticker = 'NATION_3'")
    rows, _ = chunks.chunked(one.withColumn("ticker", F.lit("X")), 1, 8)
    assert rows.select("ticker", "_chunk").distinct().count() >= 8
    same(quality.fill_missing(daily, ["close"]), quality.fill_missing(daily, ["close"], size=40))


def test_recursions_in_chunks(spark, daily):
    same(features.recursive_features(daily), features.recursive_features(daily, 37))
    same(indicators.macd(daily), indicators.macd(daily, size=31))
    same(indicators.ema(indicators.rsi(daily)), indicators.ema(indicators.rsi(daily, size=16), size=101))


def test_regimes_in_chunks(spark, daily):
    whole, cut = regimes.asset_regime(daily.where("close is not null or ticker = 'NATION_3'")), regimes.asset_regime(daily, size=190)
    same(whole, cut)
    assert whole.select("regime").distinct().count() > 1
    labels = daily.select("ticker", "date", F.when(F.dayofmonth("date") % 13 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, "abc")), F.pmod(F.hash(F.floor(F.dayofyear("date") / 3)), F.lit(3)) + 1)).alias("label"))
    for days in (1, 3):
        same(regimes.confirm_regime(labels, days), regimes.confirm_regime(labels, days, size=5))


def test_state_maps_compose_to_the_confirmation():
    rng = np.random.default_rng(3)
    for _ in range(200):
        labels = rng.choice([*"abc", None], rng.integers(2, 40), p=[0.5, 0.3, 0.1, 0.1]).astype(object)
        days, cut = int(rng.integers(1, 5)), int(rng.integers(1, len(labels)))
        whole = regimes.confirm(labels, days)
        moves = {(a, n): (b, m) for a, n, b, m in regimes.state_map(labels[:cut], days)}
        told, waited = moves[regimes._told(labels[0]), 0]
        assert list(regimes.confirm(labels[cut:], days, (regimes._label_of(told), waited))) == list(whole[cut:])


def test_stretches_of_a_mean_compose():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = pd.Series(np.where(rng.random(30) < rng.random(), np.nan, rng.normal(100, 9, 30)))
        alpha, least = float(rng.uniform(0.01, 0.9)), int(rng.integers(0, 9))
        want, state, got = x.ewm(alpha=alpha, adjust=False, min_periods=least).mean(), E.NEW, []
        ends = [0, *sorted(rng.integers(0, 31, 3)), 30]
        for a, b in zip(ends, ends[1:]):
            m = E.Mean(x.iloc[a:b].reset_index(drop=True), alpha, least)
            got += E.resumed(m, state).tolist()
            state = E.after(state, E.affine(m), alpha)
        assert np.allclose(got, want, equal_nan=True, rtol=1e-11)


def test_a_ticker_of_two_million_bars_in_sixteen_chunks(spark):
    n = 2_000_000
    one = spark.range(n, numPartitions=8).select(F.lit("LONG").alias("ticker"), F.col("id").alias("date"), (100 + 20 * F.sin(F.col("id") / 5000) + F.rand(5)).alias("close")).checkpoint()
    x = one.toPandas().sort_values("date")["close"].reset_index(drop=True)
    want = x.ewm(span=50, adjust=False).mean()
    got = features.recursive_features(one, n // 16)
    rows, _ = chunks.chunked(one, 1, n // 16)
    per = rows.where("_lead = 0").groupBy("_chunk").count().collect()
    assert len(per) == 16 and max(r["count"] for r in per) == n // 16
    tail = got.where("date % 99991 = 7").select("date", "ema_50", "rsi").toPandas()
    assert np.allclose(tail["ema_50"], want[tail["date"]], rtol=1e-12)
    step = x.diff()
    gain, loss = (s.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for s in (step, -step))
    assert np.allclose(tail["rsi"], (100 - 100 / (1 + gain / (loss + 1e-9))).fillna(50)[tail["date"]], rtol=1e-9)


def test_the_pipeline_in_chunks_and_over_split_dates(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 330)))
        skip = rng.random(330) < 0.1
        rows += [(f"T{k}", dt.date(2020, 1, 1) + dt.timedelta(days=i), None if rng.random() < 0.02 and i > 5 else float(c), float(rng.integers(1, 99))) for i, c in enumerate(close) if not skip[i] or k < 4]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, volume double").checkpoint()
    whole = features.feature_pipeline(df, gate=False).checkpoint()
    same(whole, features.feature_pipeline(df, gate=False, size=features.REACH))
    same(whole, features.feature_pipeline(df, gate=False, wide=11))


def test_wide_cross_sections_are_exact(spark):
    """A million names on one date, a third of them with the same value, beside dates of usual width."""
    n = 1_000_000
    big = spark.range(n, numPartitions=8).select(F.concat(F.lit("T"), "id").alias("ticker"), F.lit("2024-01-02").cast("date").alias("date"), F.when(F.col("id") % 3 == 0, 1.5).when(F.col("id") % 101 != 0, F.randn(3)).alias("x"))
    few = spark.range(300).select(F.concat(F.lit("S"), F.floor(F.col("id") / 3)).alias("ticker"), F.expr("date_add(date '2024-02-01', int(id % 3))").alias("date"), F.when(F.col("id") % 7 != 0, F.round(F.randn(4), 1)).alias("x"))
    df = big.unionByName(few).withColumn("y", -F.col("x") + F.lit(0.25)).checkpoint()
    pdf = df.toPandas()
    held = features.cs_winsorize(df, ["x", "y"]).checkpoint()
    out = features.cs_pct_rank(features.cs_zscore(held, ["x", "y"]), ["x", "y"]).toPandas().set_index(KEY).sort_index()
    pdf = pdf.set_index(KEY).sort_index()
    for c in ("x", "y"):
        g = pdf.groupby("date")[c]
        w = pdf[c].clip(g.transform(lambda v: v.quantile(0.01)), g.transform(lambda v: v.quantile(0.99)))
        assert np.allclose(out[c], w, equal_nan=True, rtol=1e-12)
        h = w.groupby("date")
        z = ((w - h.transform("mean")) / (h.transform("std").clip(lower=1e-6) + 1e-9)).clip(-5, 5).fillna(0)
        assert np.allclose(out[f"{c}_z"], z, atol=1e-9)
        # Values held to a bound differ in their last digits between the two ways: ranks of the rows between the bounds are compared.
        assert np.allclose(out[f"{c}_rank"], out[c].groupby("date").rank(pct=True).fillna(0.5), rtol=1e-12)
    pairs = df.where("x is not null").withColumn("score", F.col("x")).withColumn("forward_return", F.col("x") + F.sin("y") + 0.3 * F.sign(F.col("x") - 0.2))
    split = {r["date"]: (r["ic"], r["n"]) for r in evaluate.daily_ic(pairs, wide=1_000).collect()}
    whole = {r["date"]: (r["ic"], r["n"]) for r in evaluate.daily_ic(pairs).collect()}
    assert split.keys() == whole.keys() and all(abs(split[d][0] - whole[d][0]) < 1e-9 and split[d][1] == whole[d][1] for d in whole)
    counts = spark.range(100_000).select((F.col("id") % 2).alias("d"), (F.col("id") % 5000).cast("double").alias("v"))
    at = wide.value_places(counts, ["d"], "v", most=500)
    f = at.toPandas().sort_values(["d", "v"])
    assert (f["before"] == f.groupby("d")["n"].cumsum() - f["n"]).all() and (f["total"] == 50_000).all()
