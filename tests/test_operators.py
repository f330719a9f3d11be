"""Operators beyond SQL against literal pandas or NumPy formulas, and invariants."""

from __future__ import annotations

import datetime as dt
import json
import time

import numpy as np
import pandas as pd
import pytest
from panelworks.functions import ewm as E
from panelworks.operators import drift, evaluate, features, fingerprint, indicators, model, quality, regimes, scoring, walkforward
from panelworks.sources import feeds, partitions
from panelworks.streaming import jobs
from pyspark.sql import functions as F

START = dt.date(2022, 1, 3)


def series(n: int, names=("A", "B", "C"), seed: int = 42) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for t in names:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        rows += [(t, START + dt.timedelta(days=i), c * 0.99, c * 1.01, c * 0.98, c, float(v)) for i, (c, v) in enumerate(zip(close, rng.integers(1000, 5000, n)))]
    return pd.DataFrame(rows, columns=["ticker", "date", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def panel(spark):
    pdf = series(300)
    return pdf, spark.createDataFrame(pdf).cache()


def test_ewm_and_rsi_follow_the_recursion():
    x = pd.Series([1.0, 2.0, 4.0, 3.0])
    want, alpha = [1.0], 2 / 4
    for v in x[1:]:
        want.append(alpha * v + (1 - alpha) * want[-1])
    assert np.allclose(E.plain(E.Mean.of_span(x, 3)), want)

    def rsi(close):
        return E.rsi(pd.DataFrame({"_lead": 0}, index=close.index), {k: E.plain(m) for k, m in E.rsi_means(close).items()})

    assert (rsi(pd.Series(np.linspace(100, 200, 60))).iloc[20:] > 70).all()
    assert (rsi(pd.Series(np.linspace(200, 100, 60))).iloc[20:] < 30).all()
    assert (rsi(pd.Series([1.0] * 5)) == 50).all()


def test_indicators_match_pandas(panel):
    pdf, df = panel
    got = indicators.macd(indicators.ema(df, span=20)).toPandas().sort_values(["ticker", "date"])
    for t, f in pdf.groupby("ticker"):
        c = f.sort_values("date")["close"]
        g = got[got["ticker"] == t]
        assert np.allclose(g["ema"], c.ewm(span=20, adjust=False).mean())
        line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        assert np.allclose(g["macd_signal"], line.ewm(span=9, adjust=False).mean())


def test_feature_pipeline_is_complete_and_finite(spark):
    pdf = series(150, "ABCDEF")
    pdf.loc[10:20, "close"] = None
    out = features.feature_pipeline(spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))).toPandas()
    assert list(out.columns) == ["ticker", "date", "close", *features.MODEL_FEATURES]
    assert len(features.MODEL_FEATURES) == len(set(features.MODEL_FEATURES)) == 64
    assert np.isfinite(out[features.MODEL_FEATURES].astype(float)).all().all()
    assert (out["volatility"] > 0).all()


def test_core_features_do_not_leak_between_tickers(panel):
    pdf, df = panel
    alone = features.window_features(df.where("ticker = 'B'")).select("date", "momentum_20", "volatility", "return").toPandas()
    both = features.window_features(df).where("ticker = 'B'").select("date", "momentum_20", "volatility", "return").toPandas()
    pd.testing.assert_frame_equal(alone.sort_values("date", ignore_index=True), both.sort_values("date", ignore_index=True))


def test_results_do_not_depend_on_partitions(spark, panel):
    _, df = panel
    a = features.market_width(features.window_features(df)).select("ticker", "date", F.round("amihud", 8).alias("x"), F.round("breadth", 8).alias("b")).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        b = features.market_width(features.window_features(df.repartition(7))).select("ticker", "date", F.round("amihud", 8).alias("x"), F.round("breadth", 8).alias("b")).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = ["ticker", "date"]
    pd.testing.assert_frame_equal(a.sort_values(key, ignore_index=True), b.sort_values(key, ignore_index=True))


def test_one_pass_serves_the_feature_pipeline(spark):
    plans = []
    before = features.checkpointed

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return before(df)

    features.checkpointed = kept
    try:
        out = features.feature_pipeline(spark.createDataFrame(series(150, "ABCDEF")))
    finally:
        features.checkpointed = before
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("FlatMapGroupsInPandas ") for p in plans) == 1
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 4


def test_fills_of_the_pipeline_are_those_of_the_operator(spark):
    pdf = series(90, "ABCDEF")
    df = spark.createDataFrame(pdf)
    got = features.feature_pipeline(df).select("ticker", "date", "momentum_60", "rsi", "dist_from_52w_high").toPandas()
    core = features.recursive_features(features.window_features(df))
    want = quality.fill_missing(core, ["momentum_60", "rsi", "dist_from_52w_high"]).select(*got.columns).toPandas()
    key = ["ticker", "date"]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True))


def test_confirmation_by_its_definition():
    rng = np.random.default_rng(7)
    for _ in range(300):
        labels = rng.choice(list("abc"), rng.integers(0, 40), p=[0.6, 0.3, 0.1]).astype(object)
        days = int(rng.integers(1, 6))
        held, since, want = None, 0, []
        for i, x in enumerate(labels):
            held = x if held is None else held
            waited = labels[max(since, i - days + 1) : i + 1]
            if len(waited) == days and all(w != held for w in waited):
                held, since = x, i + 1
            want.append(held)
        assert list(regimes.confirm(labels, days)) == want


def test_confirmation_needs_four_differing_rows(spark):
    raw = np.array(list("aabbbbba"), dtype=object)
    assert list(regimes.confirm(raw, 4)) == list("aaaaabbb")
    flat = pd.DataFrame({"ticker": "A", "date": [START + dt.timedelta(days=i) for i in range(200)], "close": np.linspace(100, 400, 200)})
    got = regimes.asset_regime(spark.createDataFrame(flat)).toPandas().sort_values("date")
    assert set(got["regime"].iloc[:149]) == {"SIDEWAYS"} and got["regime"].iloc[-1] == "BULL"


def test_t_tail_matches_known_values():
    p = evaluate._t_tail(np.array([2.228, 0.0, 12.706]), np.array([10.0, 5.0, 1.0]))
    assert np.allclose(p, [0.05, 1.0, 0.05], atol=2e-4)


def test_rank_correlation_signs(spark):
    rng = np.random.default_rng(99)
    rows = [(START + dt.timedelta(days=i), f"T{j}", float(r + rng.normal(0, 0.001)), float(r)) for i in range(20) for j, r in enumerate(rng.normal(0, 0.02, 20))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["date", "ticker", "score", "forward_return"]))
    assert evaluate.ranking_metrics(df).first()["mean_ic"] > 0.9
    assert evaluate.ranking_metrics(df.withColumn("score", -F.col("score"))).first()["mean_ic"] < -0.9


def test_drift_sees_a_shift_and_not_the_same_data(spark):
    rng = np.random.default_rng(7)
    cols = [f"f{i}" for i in range(12)]
    pdf = pd.DataFrame(rng.normal(size=(300, 12)), columns=cols).assign(ticker="A", date=[START + dt.timedelta(days=i) for i in range(300)])
    df = spark.createDataFrame(pdf)
    base = drift.drift_baseline(df, cols)
    counts = base.orderBy("feature").first()
    assert sum(counts["counts"]) == 300 and list(counts["counts"]) == list(np.histogram(pdf[counts["feature"]], bins=20)[0])
    same = drift.drift_state(drift.drift_report(df, base, cols), 12).first()
    moved = drift.drift_state(drift.drift_report(df.withColumns({c: F.col(c) + 10 for c in cols}), base, cols), 12).first()
    assert same["severity"] <= 4 and moved["drift_detected"] and moved["severity"] > same["severity"]


def test_baseline_needs_ten_features(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": np.arange(30.0), "ticker": "A", "date": START}))
    with pytest.raises(Exception, match="too few features"):
        drift.drift_baseline(df, ["a"]).collect()


def test_cooldown_decisions():
    f = pd.DataFrame({"t": [0, 10, 3700, 3800, 3900], "severity": [8, 9, 10, 7, 2]})
    assert drift.decide(f, 3600)[0] == ["triggered", "suppressed", "triggered", "logged", "none"]


def test_schema_modes(spark):
    df = spark.createDataFrame([(1.0, float("nan"))], "a double, b double")
    assert quality.enforce_schema(df, ["a", "b", "c_rank"]).first().asDict() == {"a": 1.0, "b": 0.0, "c_rank": 0.5}
    with pytest.raises(ValueError, match="missing features"):
        quality.enforce_schema(df, ["a", "z"], "strict_contract")
    with pytest.raises(ValueError, match="look ahead"):
        quality.enforce_schema(df.withColumn("forward_return", F.lit(0.0)), ["a"])
    with pytest.raises(ValueError, match="missing values"):
        quality.enforce_schema(df, ["a", "b"], "strict_contract")


def test_sector_cap_equals_the_greedy_walk(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"date": START, "ticker": [f"T{i:02d}" for i in range(40)], "sector": rng.choice(list("WXYZ"), 40), "hybrid": rng.normal(size=40).round(2)})
    got = {r["ticker"] for r in scoring.sector_neutral_top_k(spark.createDataFrame(pdf)).collect()}
    want, used = [], {}
    for r in pdf.sort_values(["hybrid", "ticker"], ascending=[False, True]).itertuples():
        if len(want) < 5 and used.get(r.sector, 0) < 2:
            want.append(r.ticker)
            used[r.sector] = used.get(r.sector, 0) + 1
    assert got == set(want)


def test_equity_is_capped_at_each_step(spark):
    rows = [(0, START + dt.timedelta(days=i), r) for i, r in enumerate([-20.0, 0.5, 30.0, -1.0])]
    got = walkforward.equity_from_log_returns(spark.createDataFrame(rows, "fold int, entry date, r double")).orderBy("step").toPandas()["equity"]
    assert np.allclose(got, [1.0, np.exp(0.5), 1e7, 1e7 * np.exp(-1)])


def test_fitted_model_and_importance(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)), columns=["a", "b", "c"]).assign(date=[START + dt.timedelta(days=i // 10) for i in range(400)])
    pdf["target"] = 2 * pdf["a"] + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame(pdf)
    fitted = model.fit_model(df, ["a", "b", "c"], trees=4)
    gains = model.feature_importance(fitted, ["a", "b", "c"], spark).toPandas()
    assert gains["feature"].iloc[0] == "a" and abs(gains["importance"].sum() - 1) < 1e-4
    assert model.predict(fitted, df, ["a", "b", "c"]).where("score is null").count() == 0
    with pytest.raises(ValueError, match="too little"):
        model.fit_model(df.limit(50), ["a", "b", "c"])


def test_patience_decides_the_rounds(spark):
    assert model.best_round([5, 4, 3, 3.5, 3.2, 2, 9], 2) == (3, True) and model.best_round([5, 4, 3, 3.5, 2.9], 2) == (5, False)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.uniform(-1, 1, size=(600, 2)), columns=["a", "b"]).assign(date=[START + dt.timedelta(days=i // 10) for i in range(600)])
    pdf["target"] = np.sin(3 * pdf["a"]) * (1 + pdf["b"]) + rng.normal(0, 0.1, 600)
    df = spark.createDataFrame(pdf)
    held = df.where(F.col("date") > START + dt.timedelta(days=51))

    def error(fitted):
        scored = fitted.transform(held).toPandas()
        return float(((scored["score"] - scored["target"]) ** 2).mean())

    few, many = (model.fit_model(df, ["a", "b"], trees=n, eta=0.05, first=40, patience=20) for n in (40, 100))
    assert few.stages[-1].getNumTrees <= 40 and many.stages[-1].getNumTrees > 60  # the best round lies beyond the first fit
    assert error(many) < error(few)
    whole = model.fit_model(df, ["a", "b"], trees=100, eta=0.05, first=100, patience=100).stages[-1]
    rules = [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in (many.stages[-1], whole)]
    n = min(map(len, rules))
    assert rules[0][:n] == rules[1][:n]
    cut = model.first_trees(whole, 7)
    assert cut.getNumTrees == 7 and cut.treeWeights == whole.treeWeights[:7] and abs(sum(cut.featureImportances.toArray()) - 1) < 1e-9


def test_fits_of_several_lengths_run_side_by_side_and_longer_ones_end_with_the_search(spark):
    assert model.lengths(100, 2000) == [100, 251, 628, 2000] and model.lengths(40, 40) == [40] and model.lengths(40, 100) == [40, 100]
    sc, ran, ended = spark.sparkContext, [], []

    def task(n):
        def run():
            ran.append(n)
            try:
                for _ in range(n):
                    sc.parallelize(range(4), 4).map(lambda x: time.sleep(0.02) or x).count()
                return n
            finally:
                ended.append(n)

        return run

    found = []
    turns = model.in_turn([task(n) for n in (2, 4, 5000, 6000)], spark, 3)
    for n in turns:
        found.append(n)
        if n == 4:
            break
    turns.close()
    assert found == [2, 4] and 5000 in ran and set(ended) == set(ran)  # a longer one began meanwhile, and none goes on
    assert list(model.in_turn([task(1), task(3), task(2)], spark, 1)) == [1, 3, 2]
    with pytest.raises(ZeroDivisionError):
        list(model.in_turn([task(1), lambda: 1 / 0, task(5000)], spark, 3))
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.uniform(-1, 1, size=(300, 2)), columns=["a", "b"]).assign(date=[START + dt.timedelta(days=i // 5) for i in range(300)])
    pdf["target"] = np.sin(3 * pdf["a"]) + rng.normal(0, 0.1, 300)
    one, four = (model.fit_model(spark.createDataFrame(pdf).coalesce(1), ["a", "b"], trees=60, eta=0.2, first=5, patience=5, at_once=n).stages[-1] for n in (1, 4))
    assert one.getNumTrees == four.getNumTrees and one.toDebugString.split("\n", 1)[1] == four.toDebugString.split("\n", 1)[1]


def test_training_rows_read_the_line_items_once(spark, sf_dir, monkeypatch):
    from panelworks.plans import queries_more

    asked, bars = [], queries_more.bars
    monkeypatch.setattr(queries_more, "bars", lambda *a: asked.append(a) or bars(*a))
    panel, rows = queries_more._training(spark, sf_dir)
    assert len(asked) == 1 and "l_shipdate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < rows.count() < panel.count()


def test_fingerprint_ignores_order_and_sees_changes(spark, panel):
    _, df = panel
    a = fingerprint.dataset_fingerprint(df).first()
    assert a == fingerprint.dataset_fingerprint(df.repartition(5).orderBy(F.desc("date"))).first()
    changed = df.withColumn("close", F.when(F.col("date") == START, F.col("close") + 1e-6).otherwise(F.col("close")))
    assert a["fingerprint"] != fingerprint.dataset_fingerprint(changed).first()["fingerprint"]


def test_anchored_counter():
    out, state = jobs.count_anchored([0.0, 10.0, 59.0, 60.0, 61.0], 60, 2, False)
    assert [(u, r, k) for u, r, k, _ in out] == [(1, 1, False), (2, 0, True), (3, 0, True), (1, 1, False), (2, 0, True)]
    assert state == (60.0, 2)
    assert [x[2] for x in jobs.count_anchored([0.0, 1.0, 2.0], 60, 2, True)[0]] == [False, False, True]


def test_walk_forward_with_a_trainer(spark):
    rng = np.random.default_rng(42)
    rows = [(f"T{j:02d}", START + dt.timedelta(days=i), 100 + rng.normal(0, 0.5), rng.normal()) for i in range(260) for j in range(12)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ticker", "date", "close", "f"])).cache()
    seen = []

    def trainer(train):
        seen.append(train.agg(F.max("date")).first()[0])
        return lambda test: test.withColumn("score", 2 * F.col("f"))

    got = walkforward.walk_forward(df, trainer, 150, 60)["summary"].first()
    want = walkforward.walk_forward(df, 2 * F.col("f"), 150, 60)["summary"].first()
    assert got["num_windows"] == want["num_windows"] == 2 and abs(got["final_equity"] - want["final_equity"]) < 1e-6
    assert seen[0] < START + dt.timedelta(days=145)
    pooled = walkforward.walk_forward(df, trainer, 150, 60, at_once=4)["summary"].first()
    assert pooled == got and len(seen) == 4 and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    with pytest.raises(ValueError):
        walkforward.walk_forward(df, trainer, 9_000, 60)
    assert -1 <= got["max_drawdown"] <= 0 and 0 <= got["avg_win_rate"] <= 1


def test_headlines_are_scored_to_their_end(spark, tmp_path):
    from panelworks.plans.queries_more import QUERIES

    rows = [(1, "x" * 300 + " Schule", "de", "s"), (2, "x" * 300, "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["risk"] for r in QUERIES["j11_headline_score_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.4, 2: 0.0}


def test_universe_documents_that_break_the_rules_fail(spark, tmp_path):
    good = {"version": "1", "created_utc": "x", "description": "y", "min_history_days": 1, "tickers": [" aa ", "BB"]}

    def read(change, i):
        (tmp_path / f"{i}.json").write_text(json.dumps({**good, **change}, indent=2))
        return [r["ticker"] for r in feeds.read_universe_file(spark, str(tmp_path / f"{i}.json")).collect()]

    assert read({}, 0) == ["AA", "BB"]
    for i, tickers in enumerate((["AA", "aa"], ["AA", "no good!"], [f"T{k}" for k in range(151)]), 1):
        with pytest.raises(Exception, match="ticker"):
            read({"tickers": tickers}, i)
    assert len(read({"tickers": [f"T{k}" for k in range(150)]}, 4)) == 120
    (tmp_path / "5.json").write_text(json.dumps({"tickers": ["AA"]}))
    with pytest.raises(ValueError, match="universe without"):
        feeds.read_universe_file(spark, str(tmp_path / "5.json"))


def test_a_store_computes_only_what_it_lacks(spark, tmp_path, panel):
    _, df = panel
    asked = []

    def compute(bars):
        asked.append((bars.agg(F.min("date")).first()[0], bars.count()))
        return features.window_features(bars)

    path, names = str(tmp_path / "store"), ["momentum_20", "volatility"]
    cut = START + dt.timedelta(days=250)
    feeds.stored_or_computed(df.where(F.col("date") < cut), path, "v1", names, compute, days=100)
    got = feeds.stored_or_computed(df, path, "v1", names, compute, days=100)
    assert got.count() == df.count() and asked[1] == (cut - dt.timedelta(days=100), 3 * 150)
    feeds.stored_or_computed(df, path, "v1", names, compute, days=100)
    assert len(asked) == 2 and feeds.read_store(spark, path).count() == df.count()
    want = {(r["ticker"], r["date"]): r["momentum_20"] or 0.0 for r in features.window_features(df).collect()}
    assert all(abs(r["momentum_20"] - want[r["ticker"], r["date"]]) < 1e-12 for r in got.collect())
    assert feeds.read_store(spark, str(tmp_path / "none")) is None


def test_an_added_column_is_computed_for_a_filled_store(spark, tmp_path, panel):
    _, df = panel
    path, asked = str(tmp_path / "store"), []

    def compute(bars):
        asked.append(bars.count())
        return features.window_features(bars)

    feeds.stored_or_computed(df, path, "v1", ["momentum_20"], compute)
    got = feeds.stored_or_computed(df, path, "v1", ["momentum_20", "volatility"], compute)
    want = features.window_features(df).select("ticker", "date", F.coalesce("momentum_20", F.lit(0.0)).alias("momentum_20"), "volatility")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.where("volatility is null").count() == 0
    feeds.stored_or_computed(df, path, "v1", ["volatility"], compute)
    assert len(asked) == 2 and feeds.missing_keys(df, feeds.read_store(spark, path), "v1", ["volatility", "momentum_20"]).count() == 0


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_versions_and_old_rows_are_deleted_on_disk(spark, tmp_path, panel):
    _, df = panel
    store = tmp_path / "store"
    for version in ("v1", "v2"):
        feeds.write_features(df, ["close"], version, str(store))
    before = _files(store)
    feeds.drop_version_on_disk(spark, str(store), "v1")
    assert _files(store) == {f: t for f, t in before.items() if "v2" in f} and feeds.read_store(spark, str(store)).select("feature_version").distinct().collect() == [("v2",)]

    bars = tmp_path / "bars"
    assert partitions.insert(df, str(bars), ["ticker", "date"]) == df.count()
    before = _files(bars)
    as_of, days = START + dt.timedelta(days=299), 150
    partitions.retain(spark, str(bars), str(as_of), days)
    left = spark.read.parquet(str(bars))
    first = as_of - dt.timedelta(days=days)
    assert left.agg(F.min("date")).first()[0] == first and left.count() == df.where(F.col("date") >= first).count()
    edge = f"month={first.year * 100 + first.month}"
    after = _files(bars)
    assert {f: t for f, t in after.items() if edge not in f} == {f: t for f, t in before.items() if f.split("/")[0] > edge}
    partitions.retain(spark, str(bars), str(as_of), days)
    assert _files(bars).keys() - {f for f in _files(bars) if edge in f} == after.keys() - {f for f in after if edge in f}
    partitions.retain(spark, str(tmp_path / "none"), str(as_of))


def test_a_failed_replacement_leaves_the_table(spark, tmp_path, panel):
    _, df = panel
    path = tmp_path / "bars"
    partitions.insert(df, str(path), ["ticker", "date"])
    before = _files(path)
    bad = df.withColumn("month", partitions.month()).withColumn("close", F.when(F.col("close") > 0, F.raise_error(F.lit("no"))).cast("double"))
    with pytest.raises(Exception, match="no"):
        partitions.replace(bad, str(path), ["month"])
    assert _files(path) == before and spark.read.parquet(str(path)).count() == df.count()


def test_an_insert_reads_only_the_months_that_it_touches(spark, tmp_path, panel):
    _, df = panel
    path = str(tmp_path / "bars")
    partitions.insert(df.where("date <> '2022-03-15'"), path, ["ticker", "date"])
    batch = df.where("date between '2022-03-10' and '2022-04-05'").union(df.where("date = '2022-03-15'")).withColumn("month", partitions.month()).checkpoint()
    read = partitions.touched(spark.read.parquet(path), batch)
    assert {r[0].split("month=")[1].split("/")[0] for r in read.select(F.input_file_name()).distinct().collect()} == {"202203", "202204"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month#" in plan or "PartitionFilters: [isnotnull(month#" in plan
    assert partitions.insert(batch, path, ["ticker", "date"]) == 3 and spark.read.parquet(path).count() == df.count()
    assert partitions.insert(df, path, ["ticker", "date"]) == 0 and partitions.insert(df.limit(0), path, ["ticker", "date"]) == 0
