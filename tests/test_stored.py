"""The stored pipeline in steps is the pipeline at once."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from panelworks.functions import ewm as E
from panelworks.operators.features import MODEL_FEATURES, RECURSIONS, feature_pipeline
from panelworks.plans import stored
from pyspark.sql import functions as F

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(8):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 420)))
        first = 400 if k == 7 else 40 * k  # one ticker begins late
        rows += [(f"T{k}", START + dt.timedelta(days=i), None if i % 37 == k else float(close[i]), float(rng.integers(1, 99))) for i in range(first, 420) if k < 5 or rng.random() > 0.1]
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume double").checkpoint()


def test_steps_equal_one_computation(spark, tmp_path, bars, monkeypatch):
    resumed = []
    plain = stored._resumed
    monkeypatch.setattr(stored, "_resumed", lambda *a: resumed.append(plain(*a)) or resumed[-1])
    monkeypatch.setattr(stored, "feature_pipeline", lambda b, **o: feature_pipeline(b, **{**o, "gate": False}))
    path = f"{tmp_path}/store"
    for day in (395, 410, 410, 420):
        got = stored.stored_pipeline(bars.where(F.col("date") < START + dt.timedelta(days=day)), path, "v1")
    assert len(resumed) == 2 and all(r is not None for r in resumed)  # of 395, 410, 410 and 420 the second and the last one go on
    key = ["ticker", "date"]
    want = feature_pipeline(bars, gate=False).select(*key, *MODEL_FEATURES).toPandas().sort_values(key, ignore_index=True)
    got = got.toPandas().sort_values(key, ignore_index=True)
    assert got[key].equals(want[key]) and len(got) > 1600
    for c in MODEL_FEATURES:
        assert np.allclose(got[c], want[c].fillna(0.0), rtol=1e-9, atol=1e-9), c
    late = bars.unionByName(spark.createDataFrame([("T9", START + dt.timedelta(days=9), 5.0, 5.0)], bars.schema))
    stored.stored_pipeline(late, path, "v1")  # too far back for the states: the whole is computed
    assert len(resumed) == 3 and resumed[-1] is None


def test_states_at_the_end_do_not_depend_on_steps(bars):
    whole = {r["ticker"]: r["_carry0"] for r in E.end_states(bars, RECURSIONS).collect()}
    cut = {r["ticker"]: r["_carry0"] for r in E.end_states(bars, RECURSIONS, size=33).collect()}
    early = bars.where("date < '2020-10-10'").checkpoint()
    last = early.groupBy("ticker").agg(F.max_by(F.struct("date", "close", "volume"), "date").alias("b")).select("ticker", "b.*")
    begun = last.join(E.end_states(early, RECURSIONS), "ticker").checkpoint()
    steps = {r["ticker"]: r["_carry0"] for r in E.end_states(bars.where("date >= '2020-10-10'"), RECURSIONS, begun=begun).collect()}
    assert whole.keys() == cut.keys() == steps.keys()
    for t, state in whole.items():
        assert np.allclose(state, cut[t], rtol=1e-11) and np.allclose(state, steps[t], rtol=1e-11)
