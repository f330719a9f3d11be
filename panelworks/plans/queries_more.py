"""Registered queries of drift, models, scoring, walk-forward, performance, fingerprints and streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed, shared_folder, small
from ..operators import drift, fingerprint, model, performance, scoring, walkforward
from ..operators.features import MODEL_FEATURES, feature_pipeline, window_features
from ..operators.targets import cs_target
from ..sources import feeds
from ..sources.tables import bars, table
from ..streaming import jobs
from . import oracles as O
from .oracles import nums, rnd
from .queries import MODEL, QUERIES, forward, out, pairs, predictions, register  # noqa: F401
from .snapshot import agents, scored_panel, snapshot_all_dates
from .stored import stored_pipeline

# The stored pipeline


@register("a4_stored_pipeline", f"WITH RECURSIVE {MODEL} SELECT ticker, date, {nums(MODEL_FEATURES, 4)} FROM mf")
def q_a4p(s: SparkSession, d: str) -> DataFrame:
    """All model columns, stored in two steps: the bars up to 2000, and then all."""
    path = f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    rows = checkpointed(bars(s, d))
    stored_pipeline(rows.where("date < '2000-09-01'"), path, "v1")
    return out(stored_pipeline(rows, path, "v1"), digits=4)


# Drift

H = MODEL_FEATURES
_HQ = ", ".join(f'"{c}"' for c in H)


def _clipped(name: str, source: str) -> str:
    stats = ", ".join(f'avg("{c}") AS "m_{c}", stddev_samp("{c}") AS "s_{c}"' for c in H)
    held = ", ".join(f'CASE WHEN "s_{c}" >= 1e-8 AND "{c}" IS NOT NULL THEN greatest("m_{c}" - 6 * "s_{c}", least("m_{c}" + 6 * "s_{c}", "{c}")) ELSE "{c}" END AS "{c}"' for c in H)
    return f"{name}_s AS (SELECT {stats} FROM {source}), {name} AS (SELECT ticker, date, {held} FROM {source}, {name}_s)"


_BIN = "least(CAST(floor(20 * (x - lo) / (hi - lo)) AS INT) + 1, 20)"
_BASE = f"""{MODEL}, before AS (SELECT * FROM mf WHERE date < DATE '2000-01-01'), after AS (SELECT * FROM mf WHERE date >= DATE '2000-01-01'),
{_clipped("bc", "before")}, bl AS MATERIALIZED (SELECT feature, x FROM (UNPIVOT (SELECT {_HQ} FROM bc) ON {_HQ} INTO NAME feature VALUE x)),
st0 AS (SELECT feature, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS variance, min(x) AS a, max(x) AS b, count(*) AS n FROM bl GROUP BY feature),
st AS MATERIALIZED (SELECT feature, mean, std, variance, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi, n FROM st0),
bins AS (SELECT feature, {_BIN} AS bin, count(*) AS e FROM bl JOIN st USING (feature) GROUP BY ALL),
full_grid AS (SELECT s.feature, CAST(r.b AS INT) AS bin, coalesce(bins.e, 0) AS e, s.n FROM st s CROSS JOIN (SELECT unnest(range(1, 21)) AS b) r LEFT JOIN bins ON bins.feature = s.feature AND bins.bin = r.b)"""


def _report(keys: list[str], rows: str) -> str:
    """CTEs up to rep: z, variance_ratio, psi, drift by ``keys`` and feature of the long values ``rows``."""
    k = "".join(f"{c}, " for c in keys)
    same = "".join(f" AND a.{c} = b.{c}" for c in keys)
    return f"""w AS (SELECT {k}feature, x, count(*) OVER (PARTITION BY {k}feature) AS n, row_number() OVER (PARTITION BY {k}feature ORDER BY date, ticker) - 1 AS i FROM {rows}),
tw AS (SELECT {k}feature, sum(x * CASE WHEN n < 5 THEN 1.0 ELSE 1.0 + 0.5 * i / (n - 1) END) / sum(CASE WHEN n < 5 THEN 1.0 ELSE 1.0 + 0.5 * i / (n - 1) END) AS tw_mean, max(n) AS n, var_samp(x) AS v FROM w GROUP BY ALL),
ab AS (SELECT {k}feature, CASE WHEN x BETWEEN lo AND hi THEN {_BIN} END AS bin FROM {rows} JOIN st USING (feature)),
att AS (SELECT {k}feature, count(*) AS all_n, count(bin) AS inside FROM ab GROUP BY ALL), ac AS (SELECT {k}feature, bin, count(*) AS c FROM ab WHERE bin IS NOT NULL GROUP BY ALL),
terms AS (SELECT {"".join(f"a.{c}, " for c in keys)}a.feature, a.all_n, greatest(coalesce(b.c / nullif(a.inside, 0), 0), 0.01) AS p, greatest(g.e / g.n, 0.01) AS q FROM att a JOIN full_grid g ON g.feature = a.feature
  LEFT JOIN ac b ON b.feature = a.feature AND b.bin = g.bin{same}),
ps AS (SELECT {k}feature, CASE WHEN max(all_n) >= 5 THEN greatest(sum((p - q) * ln((p + 1e-8) / (q + 1e-8))), 0) ELSE 0 END AS psi FROM terms GROUP BY ALL),
rep0 AS (SELECT {"".join(f"a.{c}, " for c in keys)}a.feature, abs(tw_mean - mean) / greatest(std, 1e-8) AS z, greatest(v, 1e-8) / greatest(variance, 1e-8) AS variance_ratio, psi, a.n AS cnt
  FROM tw a JOIN st ON st.feature = a.feature JOIN ps b ON b.feature = a.feature{same}),
rep AS (SELECT *, z > 4 OR variance_ratio > 4 OR variance_ratio < 0.25 OR psi > 0.45 AS drift FROM rep0)"""


_CUR = f"""{_BASE}, cur AS (SELECT * FROM after ORDER BY date DESC, ticker DESC LIMIT 800), {_clipped("cc", "cur")},
cl AS (SELECT ticker, date, feature, x FROM (UNPIVOT (SELECT ticker, date, {_HQ} FROM cc) ON {_HQ} INTO NAME feature VALUE x)), {_report([], "cl")}"""
_HIST = f"""{_BASE}, al AS (SELECT ticker, date, feature, x FROM (UNPIVOT (SELECT ticker, date, {_HQ} FROM after) ON {_HQ} INTO NAME feature VALUE x)),
{_report(["date"], "al").replace("GROUP BY ALL", "GROUP BY ALL")}"""


def _state(keys: str, rows: str, least: int) -> str:
    return f"""sv AS (SELECT {keys}CASE WHEN count(*) / {len(H)} >= 0.3 THEN CAST(least(floor(sqrt(coalesce(sum(CASE WHEN drift THEN least(z / 4, 4) + least(abs(ln(variance_ratio + 1e-8)), 4) + least(psi / 0.45, 4) END), 0))), 15) AS INT) ELSE 0 END AS severity,
  count(*) FILTER (drift) > 0 AND count(*) / {len(H)} >= 0.3 AS drift_detected, count(*) / {len(H)} AS coverage FROM {rows} WHERE cnt >= {least} GROUP BY ALL),
state AS (SELECT *, CASE WHEN severity >= 10 THEN 'hard' WHEN severity >= 4 THEN 'soft' ELSE 'none' END AS drift_state, CASE WHEN severity >= 10 THEN 0.25 WHEN severity >= 4 THEN 0.6 ELSE 1.0 END AS exposure_scale FROM sv)"""


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = checkpointed(feature_pipeline(bars(s, d)).select("ticker", "date", *H))
    return f.where("date < '2000-01-01'"), f.where("date >= '2000-01-01'")


@register("h1_sigma_clip", f"WITH RECURSIVE {MODEL}, {_clipped('bc', 'mf')} SELECT ticker, date, {nums(H, 4)} FROM bc")
def q_h1(s: SparkSession, d: str) -> DataFrame:
    return out(drift.sigma_clip(checkpointed(feature_pipeline(bars(s, d)).select("ticker", "date", *H)), H), digits=4)


@register("h2_drift_baseline", f"WITH RECURSIVE {_BASE} SELECT feature, bin, {rnd('mean', 4)} AS mean, {rnd('std', 4)} AS std, CAST(e AS BIGINT) AS expected FROM full_grid JOIN st USING (feature)")
def q_h2(s: SparkSession, d: str) -> DataFrame:
    base = drift.drift_baseline(_halves(s, d)[0], H)
    return out(base.select("feature", "mean", "std", F.posexplode("counts").alias("bin", "expected")).withColumn("bin", F.col("bin") + 1), digits=4)


@register("h3_psi", f"WITH RECURSIVE {_CUR} SELECT feature, {rnd('psi')} AS psi FROM ps")
def q_h3(s: SparkSession, d: str) -> DataFrame:
    before, after = _halves(s, d)
    rows = after.orderBy(F.desc("date"), F.desc("ticker")).limit(800)
    return out(drift.psi(drift.long(drift.sigma_clip(rows, H), H, []), checkpointed(drift.drift_baseline(before, H))))


@register("h4_time_weighted_mean", f"WITH RECURSIVE {_CUR} SELECT feature, {rnd('tw_mean', 4)} AS tw_mean, n FROM tw")
def q_h4(s: SparkSession, d: str) -> DataFrame:
    rows = _halves(s, d)[1].orderBy(F.desc("date"), F.desc("ticker")).limit(800)
    long = drift.long(drift.sigma_clip(rows, H), H, ["ticker", "date"])
    return out(drift.time_weighted_mean(long, ["date", "ticker"]), "feature", "tw_mean", "n", digits=4)


@register("h5_drift_report", f"WITH RECURSIVE {_CUR} SELECT feature, {nums(['z', 'variance_ratio', 'psi'], 5)}, drift FROM rep WHERE cnt >= 25")
def q_h5(s: SparkSession, d: str) -> DataFrame:
    before, after = _halves(s, d)
    return out(drift.drift_report(after, checkpointed(drift.drift_baseline(before, H)), H), digits=5)


@register("h6_drift_state", f"WITH RECURSIVE {_CUR}, {_state('', 'rep', 25)} SELECT severity, drift_detected, {rnd('coverage')} AS coverage, drift_state, {rnd('least(1.0, severity / 15)')} AS confidence, CAST(exposure_scale AS DOUBLE) AS exposure_scale FROM state")
def q_h6(s: SparkSession, d: str) -> DataFrame:
    before, after = _halves(s, d)
    return out(drift.drift_state(drift.drift_report(after, checkpointed(drift.drift_baseline(before, H)), H), len(H)))


@register("h7_drift_history", f"WITH RECURSIVE {_HIST}, {_state('date, ', 'rep', 10)} SELECT date, severity, drift_detected, {rnd('coverage')} AS coverage, drift_state, {rnd('least(1.0, severity / 15)')} AS confidence, CAST(exposure_scale AS DOUBLE) AS exposure_scale FROM state")
def q_h7(s: SparkSession, d: str) -> DataFrame:
    before, after = _halves(s, d)
    return out(drift.drift_history(after, checkpointed(drift.drift_baseline(before, H)), H, ["date"], least=10))


_DECIDED = """WITH RECURSIVE hours AS (SELECT event_type AS key, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS t, CAST(count(*) % 16 AS INT) AS severity FROM events GROUP BY ALL),
ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM hours),
dc AS (SELECT key, t, severity, i, CASE WHEN severity < 6 THEN 'none' WHEN severity < 8 THEN 'logged' ELSE 'triggered' END AS decision, CASE WHEN severity >= 8 THEN t END AS last FROM ev WHERE i = 1 UNION ALL
  SELECT n.key, n.t, n.severity, n.i, CASE WHEN n.severity < 6 THEN 'none' WHEN n.severity < 8 THEN 'logged' WHEN coalesce(n.t - e.last < 10800, false) THEN 'suppressed' ELSE 'triggered' END,
    CASE WHEN n.severity >= 8 AND NOT coalesce(n.t - e.last < 10800, false) THEN n.t ELSE e.last END FROM dc e JOIN ev n ON n.key = e.key AND n.i = e.i + 1)
SELECT key, t, severity, decision, severity >= 10 AS retrain_required FROM dc"""


def _severities(s: SparkSession, d: str) -> DataFrame:
    hourly = table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("h"), F.col("event_type").alias("key")).agg((F.count("*") % 16).cast("int").alias("severity"))
    return hourly.select("key", F.unix_timestamp("h").alias("t"), "severity")


def _streamed(s: SparkSession, rows: DataFrame, early: Column, end: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``job`` makes of ``rows``, read twice, as a stream of two parts, ``early`` ones first; a third one with ``end`` moves the watermark past them.

    A part is as many files as it has tasks, and one batch: the stream stops after it and goes on from its checkpoint.
    """
    root = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    for part in (rows.where(early), rows.where(~early), end.select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes])):
        part.write.mode("append").parquet(f"{root}/in")
        stream = job(s.readStream.schema(rows.schema).parquet(f"{root}/in")).writeStream.format("parquet").option("path", f"{root}/out")
        stream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{root}/out")


@register("h8_retrain_decisions", _DECIDED)
def q_h8(s: SparkSession, d: str) -> DataFrame:
    return jobs.retrain_decisions(_severities(s, d), 3 * 3600)


@register("h8_stream_decisions", _DECIDED)
def q_h8s(s: SparkSession, d: str) -> DataFrame:
    """Two parts that overlap by four hours: the second one has events of every second hour of the first one's last four, late."""
    rows = checkpointed(_severities(s, d))
    middle, last = rows.agg(((F.min("t") + F.max("t")) / 2).cast("long"), F.max("t")).first()
    end = s.createDataFrame([(None, (last or 0) + 30 * 86400, 0)], "key string, t long, severity int")
    late = F.col("t").between(middle - 4 * 3600, middle) & (F.floor(F.col("t") / 3600) % 2 == 0)
    return _streamed(s, rows, (F.col("t") < middle) & ~late, end, lambda stream: jobs.stream_retrain_decisions(stream, 3 * 3600, "6 hours"))


# Models

def _training(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The model columns of all bars, and those with a target before 2000."""
    given = checkpointed(bars(s, d))
    panel = checkpointed(feature_pipeline(given).drop("close"))
    rows = cs_target(given).select("ticker", "date", "target").join(small(panel), ["ticker", "date"])  # in the order of the targets: sums, and ties of mirrored columns, follow it
    return panel, rows.where("date < '2000-01-01'")


@register("i1_i2_fit_predict")
def q_i1(s: SparkSession, d: str) -> DataFrame:
    panel, train = _training(s, d)
    fitted = model.fit_model(train, MODEL_FEATURES)
    return out(model.predict(fitted, panel.where("date >= '2000-01-01'"), MODEL_FEATURES), "ticker", "date", "score")


@register("i2_predict_column", f"WITH {O.FEATURES}, c AS (SELECT ticker, date, greatest(-50, least(50, momentum_20 - volatility)) AS s FROM feat WHERE momentum_20 IS NOT NULL) SELECT ticker, date, {rnd('CASE WHEN stddev_pop(s) OVER d > 1e-6 THEN (s - avg(s) OVER d) / (stddev_pop(s) OVER d + 1e-12) ELSE s END')} AS score FROM c WINDOW d AS (PARTITION BY date)")
def q_i2(s: SparkSession, d: str) -> DataFrame:
    rows = window_features(bars(s, d)).where("momentum_20 is not null")
    return out(model.predict(F.col("momentum_20") - F.col("volatility"), rows, []), "ticker", "date", "score")


@register("i3_importance")
def q_i3(s: SparkSession, d: str) -> DataFrame:
    return model.feature_importance(model.fit_model(_training(s, d)[1], MODEL_FEATURES), MODEL_FEATURES, s)


# Scoring

_PANEL = f"""{O.FEATURES}, {O.cross_section(["momentum_20"])}, p0 AS (SELECT f.* EXCLUDE (momentum_20), f.momentum_20, x.momentum_20_z, greatest(-50, least(50, f.momentum_20)) AS raw FROM feat f JOIN xs x ON f.ticker = x.ticker AND f.date = x.date WHERE f.momentum_20 IS NOT NULL),
panel AS (SELECT *, CASE WHEN stddev_pop(raw) OVER d > 1e-6 THEN (raw - avg(raw) OVER d) / (stddev_pop(raw) OVER d + 1e-12) ELSE raw END AS score FROM p0 WINDOW d AS (PARTITION BY date)),
given AS (SELECT *, CASE WHEN score > 0.5 THEN 'LONG' WHEN score < -0.5 THEN 'SHORT' ELSE 'NEUTRAL' END AS signal,
  CASE WHEN month(date) = 1 THEN 'soft' WHEN month(date) = 2 THEN 'hard' ELSE 'none' END AS drift_state, CASE WHEN month(date) = 1 THEN 6 WHEN month(date) = 2 THEN 12 ELSE 0 END AS severity,
  CASE WHEN month(date) = 1 THEN 0.6 WHEN month(date) = 2 THEN 0.25 ELSE 1.0 END AS exposure_scale, CASE WHEN day(date) = 3 THEN 'CRITICAL' WHEN day(date) = 4 THEN 'HIGH' ELSE 'LOW' END AS political_label FROM panel),
sa0 AS (SELECT *, greatest(-10, least(10, score)) AS sc, stddev_samp(score) OVER (PARTITION BY date) AS score_std FROM given),
sa1 AS (SELECT *, abs(sc) AS a, least(1, abs(sc) / 2) * (CASE WHEN volatility <= 0 THEN 1 ELSE 1 - 0.3 * least(1, greatest(0, volatility / 2)) END) * CASE WHEN drift_state IN ('soft', 'hard') THEN 0.75 ELSE 1 END AS sa_confidence,
  CASE signal WHEN 'LONG' THEN CAST(momentum_20_z > 0 AS INT) WHEN 'SHORT' THEN CAST(momentum_20_z < 0 AS INT) ELSE 0 END AS sa_alignment,
  CASE WHEN regime_feature > 1.5 THEN 'high_volatility' WHEN regime_feature < -0.5 THEN 'low_volatility' ELSE 'normal' END AS sa_volatility_regime,
  CASE WHEN regime_feature > 1.5 THEN 'elevated' WHEN abs(sc) < 0.5 THEN 'high' WHEN abs(sc) < 1 THEN 'moderate' ELSE 'low' END AS sa_risk,
  CASE WHEN political_label = 'CRITICAL' THEN 'NEUTRAL' ELSE signal END AS sa_signal,
  list_filter([CASE WHEN score_std < 0.05 THEN 'narrow_dispersion' END, CASE WHEN signal = 'LONG' AND momentum_20_z < -0.5 THEN 'momentum_against_long' END,
    CASE WHEN signal = 'SHORT' AND momentum_20_z > 0.5 THEN 'momentum_against_short' END, CASE WHEN drift_state IN ('soft', 'hard') THEN 'drift' END,
    CASE WHEN political_label = 'CRITICAL' THEN 'political_block' END], lambda x: x IS NOT NULL) AS sa_warnings FROM sa0),
sa2 AS (SELECT *, least(1, greatest(0, 0.5 * sa_confidence + 0.3 * sa_alignment / 2 + CASE WHEN drift_state IN ('soft', 'hard') THEN 0 ELSE 0.2 END)) AS sa_score,
  sa_signal <> 'NEUTRAL' AND sa_confidence > CASE WHEN sa_volatility_regime = 'low_volatility' THEN 0.2 ELSE 0.3 END AND drift_state NOT IN ('soft', 'hard') AND political_label <> 'CRITICAL' AS sa_approved,
  least(1, greatest(0, sa_confidence * CASE sa_risk WHEN 'elevated' THEN 0.7 WHEN 'high' THEN 0.8 ELSE 1 END * CASE sa_volatility_regime WHEN 'high_volatility' THEN 0.7 WHEN 'low_volatility' THEN 1.1 ELSE 1 END)) AS sa_position_size FROM sa1),
ta0 AS (SELECT *, least(1, abs(momentum_20_z) / 3) AS strength, CASE WHEN dollar_volume < 5e5 THEN 0.5 ELSE 1 END * CASE drift_state WHEN 'soft' THEN 0.85 WHEN 'hard' THEN 0.7 ELSE 1 END * CASE WHEN regime_feature > 1.5 THEN 0.7 WHEN regime_feature < -0.5 THEN 1.1 ELSE 1 END AS gate FROM sa2),
ta AS (SELECT *, least(1, greatest(0, (strength + 0 + 1) / 3 * gate)) AS ta_score, least(1, greatest(0, (CAST(strength > 0.5 AS INT) + 1) / 3 * gate)) AS ta_confidence,
  CASE WHEN momentum_20_z > 1 THEN 'bullish' WHEN momentum_20_z < -1 THEN 'bearish' ELSE 'neutral' END AS ta_bias,
  list_filter([CASE WHEN abs(momentum_20_z) < 0.5 THEN 'weak_momentum' END, CASE WHEN regime_feature > 1.5 THEN 'high_volatility' END,
    CASE WHEN dollar_volume < 5e5 THEN 'low_liquidity' END, CASE drift_state WHEN 'soft' THEN 'soft_drift' WHEN 'hard' THEN 'hard_drift' END], lambda x: x IS NOT NULL) AS ta_warnings FROM ta0),
hy0 AS (SELECT *, greatest(-1, least(1, 0.5 * score + 0.3 * sa_score + 0.2 * ta_score)) AS mixed FROM ta),
hy1 AS (SELECT *, CASE political_label WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN mixed * 0.5 ELSE mixed END AS h FROM hy0),
sig AS (SELECT *, round(h, 6) AS hybrid, round(greatest(-1, least(1, h * exposure_scale)), 6) AS weight FROM hy1)"""


def panel(s: SparkSession, d: str) -> DataFrame:
    """The scored panel with made-up signals, drift states and political labels."""
    return marked(scored_panel(bars(s, d)))


def marked(df: DataFrame) -> DataFrame:
    """A scored panel with made-up signals, drift states and political labels."""
    m, day = F.month("date"), F.dayofmonth("date")
    return df.withColumns({
        "signal": F.when(F.col("score") > 0.5, "LONG").when(F.col("score") < -0.5, "SHORT").otherwise("NEUTRAL"),
        "drift_state": F.when(m == 1, "soft").when(m == 2, "hard").otherwise("none"), "severity": F.when(m == 1, 6).when(m == 2, 12).otherwise(0),
        "exposure_scale": F.when(m == 1, 0.6).when(m == 2, 0.25).otherwise(1.0), "political_label": F.when(day == 3, "CRITICAL").when(day == 4, "HIGH").otherwise("LOW"),
    })


@register("j1_latest", f"WITH {O.BARS} SELECT ticker, date, {rnd('close')} AS close FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
def q_j1(s: SparkSession, d: str) -> DataFrame:
    return out(scoring.latest_per_ticker(bars(s, d)), "ticker", "date", "close")


@register("j2_signal_agent", f"WITH {_PANEL} SELECT ticker, date, sa_signal, {nums(['sa_confidence', 'sa_score', 'sa_position_size'], 5)}, CAST(sa_alignment AS INT) AS sa_alignment, sa_volatility_regime, sa_risk, sa_approved, array_to_string(sa_warnings, '; ') AS sa_warnings FROM sig")
def q_j2(s: SparkSession, d: str) -> DataFrame:
    df = agents(panel(s, d)).withColumn("sa_warnings", F.array_join("sa_warnings", "; "))
    return out(df, "ticker", "date", "sa_signal", "sa_confidence", "sa_score", "sa_position_size", "sa_alignment", "sa_volatility_regime", "sa_risk", "sa_approved", "sa_warnings", digits=5)


@register("j3_technical_agent", f"WITH {_PANEL} SELECT ticker, date, {nums(['ta_score', 'ta_confidence'], 5)}, ta_bias, array_to_string(ta_warnings, '; ') AS ta_warnings FROM sig")
def q_j3(s: SparkSession, d: str) -> DataFrame:
    df = scoring.technical_agent(panel(s, d).drop("signal")).withColumn("ta_warnings", F.array_join("ta_warnings", "; "))
    return out(df, "ticker", "date", "ta_score", "ta_confidence", "ta_bias", "ta_warnings", digits=5)


@register("j4_hybrid_score", f"WITH {_PANEL} SELECT ticker, date, {nums(['hybrid', 'weight'])}, CASE WHEN weight > 0.01 THEN 'LONG' WHEN weight < -0.01 THEN 'SHORT' ELSE 'NEUTRAL' END AS direction FROM sig")
def q_j4(s: SparkSession, d: str) -> DataFrame:
    return out(agents(panel(s, d)), "ticker", "date", "hybrid", "weight", "direction")


_EXPO = """ex0 AS (SELECT date, count(*) FILTER (weight > 0.01) AS longs, count(*) FILTER (weight < -0.01) AS shorts, sum(abs(weight)) AS g, sum(weight) AS n, avg(hybrid) AS mean_hybrid, max(severity) AS severity FROM sig GROUP BY date),
ex AS (SELECT date, longs, shorts, least(g, 1) AS gross, CASE WHEN g > 1 THEN n / g ELSE n END AS net, CASE WHEN longs > 1.5 * shorts THEN 'LONG_BIASED' WHEN shorts > 1.5 * longs THEN 'SHORT_BIASED' ELSE 'BALANCED' END AS bias, mean_hybrid, severity FROM ex0)"""


@register("j5_exposure", f"WITH {_PANEL}, {_EXPO} SELECT date, longs, shorts, {nums(['gross', 'net'], 4)}, bias, {rnd('mean_hybrid', 4)} AS mean_hybrid FROM ex")
def q_j5(s: SparkSession, d: str) -> DataFrame:
    return out(scoring.exposure_summary(agents(panel(s, d))), digits=4)


@register("j6_top_k", f"WITH {_PANEL} SELECT date, ticker, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS INT) AS rank, {rnd('score')} AS score FROM panel QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 5")
def q_j6(s: SparkSession, d: str) -> DataFrame:
    return out(scoring.top_k(panel(s, d)), "date", "ticker", "rank", "score")


@register(
    "j7_rationale",
    f"""WITH {_PANEL}, tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS INT) AS rank, sa_score > 0.3 AND sa_risk <> 'high' AS ok_s, ta_score > 0.3 AS ok_t, political_label NOT IN ('HIGH', 'CRITICAL') AS ok_p,
  list_sort(list_distinct(list_concat(sa_warnings, ta_warnings))) AS wn FROM sig QUALIFY rank <= 5)
SELECT date, ticker, rank, array_to_string(list_filter([CASE WHEN ok_s THEN 'signal' END, CASE WHEN ok_t THEN 'technical' END, CASE WHEN ok_p THEN 'political' END], lambda x: x IS NOT NULL), ',') AS approved,
  array_to_string(list_filter([CASE WHEN NOT ok_s THEN 'signal' END, CASE WHEN NOT ok_t THEN 'technical' END, CASE WHEN NOT ok_p THEN 'political' END], lambda x: x IS NOT NULL), ',') AS flagged,
  array_to_string(wn, ',') AS warnings, array_to_string(wn[1:3], ',') AS first_warnings, CASE WHEN weight > 0.01 THEN 'LONG' WHEN weight < -0.01 THEN 'SHORT' ELSE 'NEUTRAL' END AS direction,
  sa_risk AS risk, ta_bias AS bias, CASE WHEN regime_feature > 1.5 THEN 'high_volatility' WHEN regime_feature < -0.5 THEN 'low_volatility' ELSE 'normal' END AS volatility, drift_state AS drift, political_label AS political,
  {rnd('weight', 4)} AS weight, {rnd('hybrid', 4)} AS hybrid FROM tk""",
)
def q_j7(s: SparkSession, d: str) -> DataFrame:
    df = scoring.rationale(scoring.top_k(agents(panel(s, d))))
    told = F.from_json("selection", "rank int, hybrid double, direction string, risk string, bias string, volatility string, drift string, political string, weight double, warnings array<string>")
    df = df.select("date", "ticker", told.alias("t"), *[F.array_join(c, ",").alias(c) for c in ("approved", "flagged", "warnings")])
    same = ["rank", "direction", "risk", "bias", "volatility", "drift", "political"]
    return out(df.select("date", "ticker", "approved", "flagged", "warnings", F.array_join("t.warnings", ",").alias("first_warnings"), *[f"t.{c}" for c in same], "t.hybrid", "t.weight"), digits=4)


_SEL = """sel AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY hybrid DESC, ticker) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY hybrid DESC, ticker) AS k FROM sig) WHERE k <= 2 QUALIFY rk <= 5)"""


@register("j8_sector_neutral", f"WITH {_PANEL}, {_SEL} SELECT date, ticker, sector, CAST(rk AS INT) AS rank FROM sel")
def q_j8(s: SparkSession, d: str) -> DataFrame:
    return scoring.sector_neutral_top_k(agents(panel(s, d))).select("date", "ticker", "sector", "rank")


@register(
    "j9_findings",
    f"""WITH {_PANEL}, {_EXPO}, {_SEL}, sec AS (SELECT date, sector, string_agg(ticker, '+' ORDER BY ticker) AS names FROM sel GROUP BY ALL), secs AS (SELECT date, string_agg(sector || ':' || names, ',' ORDER BY sector) AS sectors FROM sec GROUP BY date),
rk AS (SELECT date, string_agg(sa_risk || ':' || n, ',' ORDER BY sa_risk) AS risks FROM (SELECT date, sa_risk, count(*) AS n FROM sel GROUP BY ALL) GROUP BY date),
f AS (SELECT date, avg(sa_confidence) AS c, stddev_pop(sa_confidence) AS cd, stddev_pop(hybrid) AS hd, max(abs(weight)) AS w, count(*) FILTER (sa_signal = 'LONG') AS long_positions, count(*) FILTER (sa_signal = 'SHORT') AS short_positions,
  count(*) FILTER (list_contains(ta_warnings, 'low_liquidity')) AS liquidity_warnings FROM sel GROUP BY date)
SELECT f.date, {rnd('c', 4)} AS average_confidence, {rnd('cd', 4)} AS confidence_dispersion, {rnd('hd', 4)} AS hybrid_dispersion, CASE WHEN net > 0.05 THEN 'long_bias' WHEN net < -0.05 THEN 'short_bias' ELSE 'market_neutral' END AS bias,
  CASE WHEN w > 0.18 THEN 'high' WHEN w > 0.12 THEN 'moderate' ELSE 'low' END AS concentration, liquidity_warnings, long_positions, short_positions,
  CASE WHEN severity > 7 THEN 'high' WHEN severity > 3 THEN 'moderate' ELSE 'low' END AS drift_risk, risks, sectors FROM f JOIN ex ON ex.date = f.date JOIN rk ON rk.date = f.date JOIN secs ON secs.date = f.date""",
)
def q_j9(s: SparkSession, d: str) -> DataFrame:
    signals = agents(panel(s, d))
    exposure = scoring.exposure_summary(signals).drop("bias", "longs", "shorts").join(signals.groupBy("date").agg(F.first("severity").alias("severity")), "date")
    df = scoring.portfolio_findings(scoring.sector_neutral_top_k(signals), exposure)
    risks = F.array_join(F.transform(F.map_entries("risk_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    sectors = F.array_join(F.transform(F.map_entries("sector_allocation"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "+"))), ",")
    return out(df.withColumns({"risks": risks, "sectors": sectors}).drop("gross", "net", "risk_distribution", "sector_allocation"), digits=4)


@register(
    "j10_portfolio_view",
    f"""WITH {_PANEL} SELECT date, ticker, {rnd('weight')} AS weight, CAST(row_number() OVER (PARTITION BY date ORDER BY abs(weight) DESC, ticker) AS INT) AS position, count(*) FILTER (weight > 0.01) OVER d AS longs, count(*) FILTER (weight < -0.01) OVER d AS shorts,
  count(*) FILTER (abs(weight) <= 0.01) OVER d AS neutrals, CAST(CASE drift_state WHEN 'hard' THEN greatest(0, 40 - 2 * severity) WHEN 'soft' THEN greatest(40, 75 - 3 * severity) ELSE 92 END AS INT) AS health FROM sig WINDOW d AS (PARTITION BY date)""",
)
def q_j10(s: SparkSession, d: str) -> DataFrame:
    return out(scoring.portfolio_view(agents(panel(s, d))))


_LEX = {"high": ["sch", "tion"], "medium": ["der", "que"], "low": ["the", "en"]}
_RISK = "least(1.0, " + " + ".join(f"CASE WHEN contains(lower(title), '{w}') THEN CAST({v} AS DOUBLE) ELSE 0 END" for k, v in (("high", 0.4), ("medium", 0.2), ("low", 0.1)) for w in _LEX[k]) + ")"
_WHOLE = f"hd AS (SELECT doc_id, text AS title FROM documents), hs AS (SELECT *, {_RISK} AS risk FROM hd)"
_HEAD = f"hd AS (SELECT doc_id, lang, source, substring(trim(text), 1, 200) AS title FROM documents), hs AS (SELECT *, {_RISK} AS risk FROM hd)"


def headlines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", "source", F.col("text").alias("title"))


@register("j11_headline_score", f"WITH {_WHOLE} SELECT doc_id, {rnd('risk')} AS risk FROM hs")
def q_j11(s: SparkSession, d: str) -> DataFrame:
    return out(scoring.headline_score(headlines(s, d), _LEX), "doc_id", "risk")


@register(
    "j12_political_risk",
    f"""WITH {_HEAD}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY risk DESC, doc_id) AS b, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS e FROM hs WHERE length(title) > 0),
g AS (SELECT lang, source, least(1, 0.6 * max(risk) FILTER (b <= 5) + 0.4 * avg(risk) FILTER (b <= 5)) AS s, count(*) FILTER (e <= 5) AS n_events, string_agg(title, '|' ORDER BY e) FILTER (e <= 5) AS events FROM r GROUP BY ALL)
SELECT lang, source, events, {rnd('s')} AS score, CASE WHEN s >= 0.75 THEN 'CRITICAL' WHEN s >= 0.5 THEN 'HIGH' WHEN s >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS label, n_events FROM g""",
)
def q_j12(s: SparkSession, d: str) -> DataFrame:
    df = scoring.political_risk(headlines(s, d), _LEX, ["lang", "source"], ["doc_id"])
    return out(df.withColumns({"n_events": F.size("events").cast("long"), "events": F.array_join("events", "|")}))


_PRIO = ["src3", "src0", "src7"]


@register(
    "j13_first_source",
    """WITH h AS (SELECT doc_id, lang, source, list_position(['src3', 'src0', 'src7'], source) AS p FROM documents WHERE length(trim(text)) > 0 AND source IN ('src3', 'src0', 'src7'))
SELECT doc_id, lang, source FROM h WHERE p = (SELECT min(p) FROM h g WHERE g.lang = h.lang)""",
)
def q_j13(s: SparkSession, d: str) -> DataFrame:
    return scoring.first_available_source(headlines(s, d), _PRIO, ["lang"]).select("doc_id", "lang", "source")


@register(
    "j13_stale_fallback",
    """WITH e AS (SELECT event_type, date_trunc('hour', ts) AS ts, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE count(*) END AS score FROM events GROUP BY ALL),
k AS (SELECT *, last_value(CASE WHEN score IS NOT NULL THEN {'t': ts, 's': score} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM e)
SELECT event_type, ts, CAST(CASE WHEN score IS NULL AND epoch(ts) - epoch(k.t) <= 10800 THEN k.s ELSE score END AS BIGINT) AS score, score IS NULL AND coalesce(epoch(ts) - epoch(k.t) <= 10800, false) AS stale FROM k""",
)
def q_j13b(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("n"))
    e = e.select("event_type", "ts", F.when(F.col("n") % 3 != 0, F.col("n")).alias("score"))
    return scoring.with_stale_fallback(e, ["event_type"], 3).select("event_type", "ts", "score", "stale")


@register("j14_snapshot", f"WITH {_PANEL.replace('FROM panel),', 'FROM panel), ')}, {_EXPO} SELECT s.date, s.ticker, {nums(['hybrid', 'weight'])}, longs, shorts, bias FROM sig s JOIN ex ON ex.date = s.date")
def q_j14(s: SparkSession, d: str) -> DataFrame:
    rows = panel(s, d)
    state = rows.groupBy("date").agg(F.first("severity").alias("severity"), F.first("drift_state").alias("drift_state"), F.first("exposure_scale").alias("exposure_scale"))
    signals, exposure, _ = snapshot_all_dates(rows.drop("severity", "drift_state", "exposure_scale"), state)
    return out(signals.join(exposure.select("date", "longs", "shorts", "bias"), "date"), "date", "ticker", "hybrid", "weight", "longs", "shorts", "bias")


@register(
    "a11_snapshot_documents",
    f"""WITH {_PANEL}, {_EXPO}, rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS k FROM sig)
SELECT s.date, count(*) AS n_signals, any_value(bias) AS bias, {rnd('any_value(gross)', 4)} AS gross, {rnd('any_value(net)', 4)} AS net, any_value(longs) AS longs, any_value(shorts) AS shorts,
  any_value(s.drift_state) AS drift_state, any_value(s.severity) AS severity, string_agg(ticker, ',' ORDER BY k) FILTER (k <= 5) AS top_5, string_agg(ticker, ',' ORDER BY k) AS tickers, {rnd('sum(weight)', 4)} AS weight, 'm20' AS model_version
FROM rk s JOIN ex ON ex.date = s.date GROUP BY s.date""",
)
def q_a11(s: SparkSession, d: str) -> DataFrame:
    """Snapshots written, a file a date, and read again."""
    rows = panel(s, d)
    signals = agents(rows)
    state = rows.groupBy("date").agg(F.first("severity").alias("severity"), F.first("drift_state").alias("drift_state"), F.first("exposure_scale").alias("exposure_scale"))
    docs = feeds.snapshot_documents(signals, scoring.exposure_summary(signals).join(state, "date"))
    path = f"{shared_folder(s)}/snapshots-{uuid.uuid4().hex}"
    feeds.write_snapshot(docs.repartition("date"), path)
    schema = """meta struct<model_version:string,drift_state:string,long_signals:long,short_signals:long>, executive_summary struct<top_5_tickers:array<string>,portfolio_bias:string,gross_exposure:double,net_exposure:double>,
      snapshot struct<snapshot_date:date,drift:struct<drift_state:string,severity_score:int>,signals:array<struct<ticker:string,weight:double>>>"""
    told = feeds.read_snapshots(s, path).select("date", F.from_json("document", schema).alias("j")).where("date = j.snapshot.snapshot_date")
    total = F.aggregate("j.snapshot.signals", F.lit(0.0), lambda x, e: x + e["weight"])
    return out(told.select(
        "date", F.size("j.snapshot.signals").cast("long").alias("n_signals"), F.col("j.executive_summary.portfolio_bias").alias("bias"), F.col("j.executive_summary.gross_exposure").alias("gross"),
        F.col("j.executive_summary.net_exposure").alias("net"), F.col("j.meta.long_signals").alias("longs"), F.col("j.meta.short_signals").alias("shorts"), F.col("j.snapshot.drift.drift_state").alias("drift_state"),
        F.col("j.snapshot.drift.severity_score").alias("severity"), F.array_join("j.executive_summary.top_5_tickers", ",").alias("top_5"), F.array_join("j.snapshot.signals.ticker", ",").alias("tickers"),
        total.alias("weight"), F.col("j.meta.model_version").alias("model_version"),
    ), digits=4)


# Walk-forward

_WF = f"""{O.FEATURES}, {O.cross_section(["momentum_20"])}, sc AS (SELECT ticker, date, momentum_20_z AS s FROM xs WHERE momentum_20 IS NOT NULL),
di AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT date FROM bars)), nn AS (SELECT count(*) AS n FROM di),
fo AS (SELECT * FROM (SELECT f AS fold, f * 30 AS train_lo, f * 30 + 119 AS train_hi, f * 30 + 120 AS test_lo, least(f * 30 + 149, n - 1) AS test_hi, n FROM nn, (SELECT unnest(range(0, 200)) AS f)) WHERE test_lo < n - 5 AND test_hi - test_lo + 1 >= 20),
fd AS (SELECT fold, train_lo, train_hi, test_lo, test_hi, CAST(date - 5 AS DATE) AS train_end FROM fo JOIN di ON di.idx = fo.test_lo),
rb AS (SELECT fold, a.date AS entry, b.date AS exit FROM fo JOIN di a ON a.idx BETWEEN test_lo AND test_hi AND (a.idx - test_lo) % 5 = 0 AND a.idx + 5 <= test_hi JOIN di b ON b.idx = a.idx + 5),
c0 AS (SELECT fold, entry, exit, sc.ticker, s FROM rb JOIN sc ON sc.date = rb.entry WHERE (sc.ticker, exit) IN (SELECT (ticker, date) FROM sc)),
c1 AS (SELECT *, count(*) OVER p AS n, stddev_pop(s) OVER p AS raw, quantile_cont(s, 0.01) OVER p AS lo, quantile_cont(s, 0.99) OVER p AS hi FROM c0 WINDOW p AS (PARTITION BY fold, entry)),
c2 AS (SELECT fold, entry, exit, ticker, CASE WHEN n >= 5 THEN greatest(lo, least(hi, s)) ELSE s END AS s FROM c1 WHERE n >= 8 AND raw >= 1e-6),
c3 AS (SELECT *, (s - avg(s) OVER p) / (stddev_pop(s) OVER p + 1e-9) AS z FROM c2 WINDOW p AS (PARTITION BY fold, entry)),
c4 AS (SELECT *, row_number() OVER (PARTITION BY fold, entry ORDER BY z DESC, ticker DESC) AS up, row_number() OVER (PARTITION BY fold, entry ORDER BY z, ticker) AS dn FROM c3),
c5 AS (SELECT fold, entry, exit, ticker, 1.0 AS side, z AS x FROM c4 WHERE up <= 8 UNION ALL SELECT fold, entry, exit, ticker, -1.0, abs(z) FROM c4 WHERE dn <= 8),
c6 AS (SELECT *, exp(x - max(x) OVER (PARTITION BY fold, entry, side)) AS e FROM c5),
c7 AS (SELECT *, side * least(0.2, e / (sum(e) OVER (PARTITION BY fold, entry, side) + 1e-9)) AS weight FROM c6),
pos AS (SELECT fold, entry, exit, ticker, arg_min(weight, side) AS weight FROM c7 GROUP BY ALL),
per AS (SELECT fold, entry, exit, greatest(-0.25, least(0.25, sum(weight * (ln(q.close * (1 - 0.0005)) - ln(p.close * (1 + 0.0005))) - abs(weight) * 0.0008))) AS r FROM pos JOIN bars p ON p.ticker = pos.ticker AND p.date = entry JOIN bars q ON q.ticker = pos.ticker AND q.date = exit GROUP BY fold, entry, exit),
pk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY entry) AS k FROM (SELECT DISTINCT fold, entry FROM pos)),
mv AS (SELECT fold, k, ticker, sum(d) AS d FROM (SELECT pos.fold, k, ticker, weight AS d FROM pos JOIN pk ON pk.fold = pos.fold AND pk.entry = pos.entry UNION ALL SELECT pos.fold, k + 1, ticker, -weight FROM pos JOIN pk ON pk.fold = pos.fold AND pk.entry = pos.entry) GROUP BY ALL),
tn AS (SELECT pk.fold, entry, sum(abs(d)) AS turnover FROM mv JOIN pk ON pk.fold = mv.fold AND pk.k = mv.k GROUP BY ALL),
fm AS (SELECT fold, sum(r) AS strategy_return, CASE WHEN stddev_pop(r) < 1e-9 THEN 0 ELSE least(5, greatest(-5, avg(r) / stddev_pop(r) * sqrt(252 / 5))) END AS sharpe, avg(turnover) AS turnover, count(*) AS trades, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate
  FROM per JOIN tn USING (fold, entry) GROUP BY fold HAVING count(*) >= 2)"""


def _walk(s: SparkSession, d: str) -> dict[str, DataFrame]:
    scored = predictions(s, d).select("ticker", "date", "score").join(bars(s, d).select("ticker", "date", "close"), ["ticker", "date"], "right")
    return walkforward.walk_forward(checkpointed(scored), F.col("score"), 120, 30)


def _plan(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dates = walkforward.date_index(bars(s, d))
    return walkforward.folds(dates, 120, 30), dates


@register("k6_folds", f"WITH {_WF} SELECT CAST(fold AS INT) AS fold, train_lo, train_hi, test_lo, test_hi, train_end FROM fd")
def q_k6(s: SparkSession, d: str) -> DataFrame:
    return _plan(s, d)[0].selectExpr("cast(fold as int) as fold", "cast(train_lo as bigint) as train_lo", "cast(train_hi as bigint) as train_hi", "cast(test_lo as bigint) as test_lo", "cast(test_hi as bigint) as test_hi", "train_end")


@register("k6_assign_train", f"WITH {_WF} SELECT CAST(fold AS INT) AS fold, b.ticker, b.date FROM bars b JOIN di USING (date) JOIN fd ON idx BETWEEN train_lo AND train_hi AND b.date < train_end")
def q_k6b(s: SparkSession, d: str) -> DataFrame:
    plan, dates = _plan(s, d)
    return walkforward.assign(bars(s, d).select("ticker", "date"), dates, plan, "train").selectExpr("cast(fold as int) as fold", "ticker", "date")


@register("k7_rebalance_dates", f"WITH {_WF} SELECT CAST(fold AS INT) AS fold, entry, exit FROM rb")
def q_k7(s: SparkSession, d: str) -> DataFrame:
    plan, dates = _plan(s, d)
    return walkforward.rebalance_dates(plan, dates).withColumn("fold", F.col("fold").cast("int"))


def _fold(df: DataFrame) -> DataFrame:
    return df.withColumn("fold", F.col("fold").cast("int"))


@register("k8_positions", f"WITH {_WF.replace('FROM xs WHERE momentum_20 IS NOT NULL', 'FROM xs WHERE momentum_20 IS NOT NULL')} SELECT CAST(fold AS INT) AS fold, entry, exit, ticker, {rnd('weight')} AS weight FROM pos")
def q_k8(s: SparkSession, d: str) -> DataFrame:
    return out(_fold(_walk(s, d)["positions"]))


@register("k9_period_returns", f"WITH {_WF} SELECT CAST(fold AS INT) AS fold, entry, exit, {rnd('r')} AS r FROM per")
def q_k9(s: SparkSession, d: str) -> DataFrame:
    return out(_fold(_walk(s, d)["periods"]))


@register("k10_turnover", f"WITH {_WF} SELECT CAST(fold AS INT) AS fold, entry, {rnd('turnover')} AS turnover FROM tn")
def q_k10(s: SparkSession, d: str) -> DataFrame:
    return out(_fold(walkforward.turnover(_walk(s, d)["positions"])))


@register("k11_equity", f"WITH {_WF} SELECT CAST(row_number() OVER (ORDER BY fold, entry) - 1 AS INT) AS step, CAST(fold AS INT) AS fold, entry, {rnd('r')} AS r, {rnd('10000 * exp(sum(r) OVER (ORDER BY fold, entry))', 4)} AS equity FROM per")
def q_k11(s: SparkSession, d: str) -> DataFrame:
    df = _fold(_walk(s, d)["curve"])
    return out(df.withColumn("equity", F.round("equity", 4)))


_FM = ["strategy_return", "sharpe", "turnover", "win_rate"]


@register("k12_fold_metrics", f"WITH {_WF} SELECT CAST(fold AS INT) AS fold, {nums(_FM, 5)}, trades FROM fm")
def q_k12(s: SparkSession, d: str) -> DataFrame:
    return out(_fold(_walk(s, d)["folds"]), digits=5)


@register(
    "k13_walk_forward",
    f"""WITH {_WF}, cv AS (SELECT fold, entry, 10000 * exp(sum(r) OVER (ORDER BY fold, entry)) AS eq FROM per), dd AS (SELECT *, eq / max(eq) OVER (ORDER BY fold, entry) - 1 AS dd FROM cv)
SELECT {rnd('avg(strategy_return)', 5)} AS avg_strategy_return, {rnd('avg(sharpe)', 5)} AS avg_sharpe, {rnd('coalesce(sum(strategy_return) FILTER (strategy_return > 0), 0) / coalesce(nullif(abs(sum(strategy_return) FILTER (strategy_return < 0)), 0), 1e-6)', 5)} AS profit_factor,
  {rnd('stddev_samp(strategy_return)', 5)} AS return_volatility, {rnd('avg(turnover)', 5)} AS avg_turnover, {rnd('avg(win_rate)', 5)} AS avg_win_rate, {rnd('avg(trades)', 5)} AS avg_trades_per_window, count(*) AS num_windows,
  {rnd('(SELECT min(dd) FROM dd)', 5)} AS max_drawdown, {rnd('(SELECT arg_max(eq, entry) FROM cv)', 3)} AS final_equity FROM fm""",
)
def q_k13(s: SparkSession, d: str) -> DataFrame:
    return out(_walk(s, d)["summary"].withColumn("final_equity", F.round("final_equity", 3)), digits=5)


@register("k13_fitted_folds")
def q_k13f(s: SparkSession, d: str) -> DataFrame:
    """A model fitted on every fold, two folds at a time."""
    panel = checkpointed(feature_pipeline(bars(s, d)))
    target = cs_target(bars(s, d)).select("ticker", "date", "target")
    rows = checkpointed(panel.join(target, ["ticker", "date"], "left"))

    def trainer(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        fitted = model.fit_model(train, MODEL_FEATURES, eta=0.1, patience=5, first=10, at_once=1)
        return lambda test: model.predict(fitted, test, MODEL_FEATURES)

    found = walkforward.walk_forward(rows, trainer, 180, 60, at_once=2)
    return out(found["folds"], digits=5)


# Performance

_PF = O.PREDICTIONS + """, wt AS (SELECT date, ticker, 0.2 AS weight FROM (SELECT p.date, p.ticker, sector, score, row_number() OVER (PARTITION BY p.date, sector ORDER BY score DESC, p.ticker) AS k FROM pred p JOIN bars b ON b.ticker = p.ticker AND b.date = p.date)
  WHERE k <= 2 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 5),
daily AS (SELECT w.date, greatest(-0.5, least(0.5, sum(weight * greatest(-0.8, least(0.8, forward_return))))) AS r FROM wt w JOIN fwd f ON w.ticker = f.ticker AND w.date = f.date GROUP BY w.date),
bm AS (SELECT date, avg(forward_return) AS b FROM fwd GROUP BY date),
eqc AS (SELECT *, product(1 + r) OVER (ORDER BY date) AS equity FROM daily), curve AS (SELECT *, max(equity) OVER (ORDER BY date) AS top, equity / max(equity) OVER (ORDER BY date) - 1 AS drawdown FROM eqc)"""


def weights(s: SparkSession, d: str) -> DataFrame:
    df = predictions(s, d).join(bars(s, d).select("ticker", "date", "sector"), ["ticker", "date"])
    return scoring.sector_neutral_top_k(df, score="score").select("date", "ticker", F.lit(0.2).alias("weight"))


def daily(s: SparkSession, d: str) -> DataFrame:
    return performance.portfolio_daily(weights(s, d), forward(s, d))


@register("k15_portfolio_daily", f"WITH {_PF} SELECT date, {rnd('r')} AS r FROM daily")
def q_k15(s: SparkSession, d: str) -> DataFrame:
    return out(daily(s, d))


@register("k16_equity_curve", f"WITH {_PF} SELECT date, {nums(['r', 'equity', 'drawdown'])} FROM curve")
def q_k16(s: SparkSession, d: str) -> DataFrame:
    return out(performance.equity_curve(daily(s, d)))


@register("k17_drawdown_duration", f"WITH {_PF}, i AS (SELECT *, equity < top * (1 - 1e-12) AS u, sum(CAST(equity >= top * (1 - 1e-12) AS INT)) OVER (ORDER BY date) AS island FROM curve) SELECT max(n) AS duration FROM (SELECT count(*) FILTER (u) AS n FROM i GROUP BY island)")
def q_k17(s: SparkSession, d: str) -> DataFrame:
    return performance.drawdown_duration(performance.equity_curve(daily(s, d)))


def _perf(source: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""SELECT {g}{rnd('product(1 + r) - 1')} AS cumulative_return, {rnd('pow(least(greatest(product(1 + r), 0), 1e6), 252 / count(r)) - 1')} AS annual_return, {rnd('avg(r) / stddev_samp(r) * sqrt(252)')} AS sharpe,
  {rnd('coalesce(avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(252), 0)')} AS sortino, {rnd('stddev_samp(r) * sqrt(252)')} AS volatility, {rnd('min(drawdown)')} AS max_drawdown, {rnd('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END)')} AS hit_rate,
  {rnd('skewness(r)')} AS skewness, {rnd('coalesce(stddev_samp(r) FILTER (r < 0) * sqrt(252), 0)')} AS downside_deviation, count(r) AS days,
  {rnd('CASE WHEN abs(min(drawdown)) > 1e-12 THEN (pow(least(greatest(product(1 + r), 0), 1e6), 252 / count(r)) - 1) / abs(min(drawdown)) ELSE 0 END', 5)} AS calmar FROM {source}"""


@register(
    "k18_performance_report",
    f"""WITH {_PF}, one AS ({_perf('curve')}), two AS (SELECT {rnd('stddev_samp(r - b) * sqrt(252)')} AS tracking_error, {rnd('covar_samp(r, b) / var_samp(b)')} AS beta, {rnd('avg(r - b) / stddev_samp(r - b) * sqrt(252)')} AS information_ratio FROM daily JOIN bm USING (date)) SELECT * FROM one, two""",
)
def q_k18(s: SparkSession, d: str) -> DataFrame:
    bench = forward(s, d).groupBy("date").agg(F.avg("forward_return").alias("b"))
    return out(performance.performance_report(daily(s, d), bench).withColumn("calmar", F.round("calmar", 5)))


@register(
    "k19_turnover",
    f"""WITH {_PF}, ds AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM wt)),
m AS (SELECT date, ticker, sum(d) AS d FROM (SELECT date, ticker, weight AS d FROM wt UNION ALL SELECT nx, ticker, -weight FROM wt JOIN ds USING (date) WHERE nx IS NOT NULL) GROUP BY ALL)
SELECT {rnd('avg(t)')} AS turnover FROM (SELECT date, 0.5 * sum(abs(d)) AS t FROM m WHERE date > (SELECT min(date) FROM wt) GROUP BY date)""",
)
def q_k19(s: SparkSession, d: str) -> DataFrame:
    return out(performance.portfolio_turnover(weights(s, d)))


_R63 = "OVER (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"


@register("k20_rolling", f"WITH {_PF} SELECT date, {rnd(f'coalesce(CASE WHEN count(r) {_R63} >= 63 THEN avg(r) {_R63} / nullif(stddev_samp(r) {_R63}, 0) * sqrt(252) END, 0)')} AS rolling_sharpe, {rnd(f'coalesce(CASE WHEN count(r) {_R63} >= 63 THEN stddev_samp(r) {_R63} * sqrt(252) END, 0)')} AS rolling_volatility FROM daily")
def q_k20(s: SparkSession, d: str) -> DataFrame:
    return out(performance.rolling_volatility(performance.rolling_sharpe(daily(s, d))), "date", "rolling_sharpe", "rolling_volatility")


@register(
    "k21_by_ticker",
    f"""WITH {_PF}, td AS (SELECT ticker, date, forward_return AS r FROM fwd), te AS (SELECT *, product(1 + r) OVER (PARTITION BY ticker ORDER BY date) AS equity FROM td),
tc AS (SELECT *, equity / max(equity) OVER (PARTITION BY ticker ORDER BY date) - 1 AS drawdown, equity < max(equity) OVER (PARTITION BY ticker ORDER BY date) * (1 - 1e-12) AS u FROM te),
ti AS (SELECT ticker, u, sum(CAST(NOT u AS INT)) OVER (PARTITION BY ticker ORDER BY date) AS island FROM tc), du AS (SELECT ticker, max(n) AS duration FROM (SELECT ticker, island, count(*) FILTER (u) AS n FROM ti GROUP BY ALL) GROUP BY ticker)
SELECT p.*, duration FROM ({_perf('tc', 'ticker')} GROUP BY ticker) p JOIN du USING (ticker)""",
)
def q_k21(s: SparkSession, d: str) -> DataFrame:
    return out(performance.performance_by_ticker(forward(s, d)).withColumn("calmar", F.round("calmar", 5)))


@register(
    "k22_promotion_gates",
    f"""WITH {_PF}, m AS (SELECT avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, min(drawdown) AS max_drawdown, CAST(count(*) // 63 AS BIGINT) AS windows FROM curve),
f AS (SELECT *, list_filter([CASE WHEN sharpe < 0.10 THEN 'sharpe' END, CASE WHEN max_drawdown < -0.60 THEN 'drawdown' END, CASE WHEN windows < 5 THEN 'windows' END, CASE WHEN sharpe < 1.9 THEN 'sharpe_loss' END], lambda x: x IS NOT NULL) AS l FROM m)
SELECT {nums(['sharpe', 'max_drawdown'])}, windows, array_to_string(l, ',') AS failed, len(l) = 0 AS passed FROM f""",
)
def q_k22(s: SparkSession, d: str) -> DataFrame:
    report = performance.performance_report(daily(s, d)).select("sharpe", "max_drawdown", F.expr("days div 63").alias("windows"), F.lit(3).alias("drift"))
    return out(performance.promotion_gates(report, 2.0).withColumn("failed", F.array_join("failed", ",")).drop("drift"))


_PRINTED = ["close", "date", "high", "low", "open", "sector", "ticker", "volume"]
_PRINT = ", ".join(f"CAST(CAST(floor({c} * 1e8 + 0.5) AS BIGINT) AS VARCHAR)" if c not in ("date", "sector", "ticker") else f"coalesce(CAST({c} AS VARCHAR), '')" for c in _PRINTED)


@register(
    "m1_fingerprint",
    f"""WITH {O.BARS}, h AS (SELECT md5(concat_ws(chr(31), {_PRINT})) AS h FROM bars),
sums AS (SELECT count(*) AS rows, coalesce(sum(('0x' || h[1:15])::UBIGINT), 0) AS s, coalesce(sum(('0x' || h[17:31])::UBIGINT), 0) AS t FROM h)
SELECT rows, sha256('{",".join(_PRINTED)}|' || rows || '|' || s || '|' || t) AS fingerprint FROM sums""",
)
def q_m1(s: SparkSession, d: str) -> DataFrame:
    return fingerprint.dataset_fingerprint(bars(s, d))


# Streaming and its batch twins


def requests(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("ts", F.col("user_id").alias("client"), F.col("event_type").alias("endpoint"), (F.col("value") / 100).alias("latency"), (F.col("event_type") == "error").alias("error"))


@register("s1_stream_bars", f"WITH {O.RAW} SELECT ticker, date, {rnd('close')} AS close, {rnd('greatest(high, open, close)')} AS high, 'stream' AS source FROM raw WHERE close > 0")
def q_s1(s: SparkSession, d: str) -> DataFrame:
    root = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    from .queries import raw_feed

    rows = raw_feed(s, d).select("ticker", "date", "open", "high", "low", "close", "volume")
    rows.union(rows.where("month(date) = 3")).repartition(4).write.parquet(f"{root}/in")  # March is delivered twice
    query = jobs.stream_bars(s.readStream.schema(rows.schema).parquet(f"{root}/in"), f"{root}/bars", f"{root}/state")
    query.awaitTermination()
    return out(s.read.parquet(f"{root}/bars"), "ticker", "date", "close", "high", "source")


@register("s2_snapshot_of_dates", f"WITH {_PANEL} SELECT date, ticker, {nums(['hybrid', 'weight'])} FROM sig")
def q_s2(s: SparkSession, d: str) -> DataFrame:
    """Bars come as a stream of two files, the second one with late bars of the first one's dates; each batch publishes all dates that it moves."""
    root = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    rows = checkpointed(bars(s, d))
    early = (F.col("date") < "1999-01-01") & ~(F.col("ticker").endswith("3") & (F.col("date") > "1998-03-01"))
    for part in (rows.where(early), rows.where(~early)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")

    def snapshot(part: DataFrame) -> DataFrame:
        return agents(marked(scored_panel(part))).select("date", "ticker", "score", "hybrid", "weight")

    jobs.stream_snapshot(source, f"{root}/bars", snapshot, f"{root}/out", f"{root}/state", log=f"{root}/log").awaitTermination()
    return out(s.read.parquet(f"{root}/out"), "date", "ticker", "hybrid", "weight")


_BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0]  # by hand, not the operator's
_LE = ", ".join(f'count(*) FILTER (value / 100 <= {b}) AS "le_{b}"' for b in _BOUNDS)
_P95 = "CASE " + " ".join(
    f'WHEN "le_{hi}" >= 0.95 * requests THEN {lo} + ({hi} - {lo}) * coalesce((0.95 * requests - {below}) / nullif("le_{hi}" - {below}, 0), 0)'
    for lo, hi, below in zip([0.0, *_BOUNDS], _BOUNDS, ["0", *(f'"le_{b}"' for b in _BOUNDS)])
) + " ELSE 10.0 END"


@register(
    "s3_request_metrics",
    f"""WITH w AS (SELECT date_trunc('minute', ts) - to_minutes(CAST(i AS INT)) AS s, event_type AS endpoint, value FROM events, (SELECT unnest(range(0, 5)) AS i)),
g AS (SELECT s AS window_start, s + INTERVAL 5 MINUTE AS window_end, endpoint, count(*) AS requests, count(*) FILTER (endpoint = 'error') AS errors, {_LE} FROM w GROUP BY ALL)
SELECT window_start, window_end, endpoint, requests, errors, {rnd('errors / requests * 100')} AS error_percent, {rnd('requests / 300')} AS rate, {', '.join(f'"le_{b}"' for b in _BOUNDS)}, {rnd(_P95, 5)} AS p95 FROM g""",
)
def q_s3(s: SparkSession, d: str) -> DataFrame:
    return out(jobs.request_metrics(requests(s, d)).withColumn("p95", F.round("p95", 5)))


@register(
    "s3_minute_rates",
    f"""SELECT date_trunc('minute', ts) AS window_start, event_type AS endpoint, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, {rnd('count(*) / 60')} AS rate FROM events GROUP BY ALL""",
)
def q_s3m(s: SparkSession, d: str) -> DataFrame:
    return out(jobs.request_metrics(requests(s, d), "1 minute", "1 minute"), "window_start", "endpoint", "requests", "errors", "rate")


_USED = """WITH RECURSIVE us AS MATERIALIZED (SELECT user_id || '|' || event_type AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM events),
ct AS (SELECT key, t, i, t AS start, 1 AS used FROM us WHERE i = 1 UNION ALL
  SELECT n.key, n.t, n.i, CASE WHEN n.t >= e.start + 604800 THEN n.t ELSE e.start END, CASE WHEN n.t >= e.start + 604800 THEN 1 ELSE e.used + 1 END FROM ct e JOIN us n ON n.key = e.key AND n.i = e.i + 1)"""
_USED_ROWS = f"{_USED} SELECT key, {rnd('t', 3)} AS t, CAST(used AS INT) AS used, CAST(greatest(0, 3 - used) AS INT) AS remaining, used >= 3 AS locked, {rnd('start + 604800 - t', 3)} AS reset_in FROM ct"


@register("s4_anchored_usage", _USED_ROWS)
def q_s4(s: SparkSession, d: str) -> DataFrame:
    return out(jobs.anchored_usage(requests(s, d), ["client", "endpoint"], 7 * 86400.0, 3), digits=3)


@register("s4_stream_usage", _USED_ROWS)
def q_s4s(s: SparkSession, d: str) -> DataFrame:
    """Two parts, the second one with every third event of the first one's last two hours."""
    rows = requests(s, d).select(F.col("ts").cast("timestamp").alias("ts"), "client", "endpoint")
    middle, last = rows.agg(F.timestamp_micros(((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2).cast("long")), F.max("ts")).first()
    late = F.col("ts").between(F.lit(middle) - F.expr("INTERVAL 2 HOURS"), F.lit(middle)) & (F.xxhash64("ts") % 3 == 0)
    end = rows.limit(1).withColumns({"ts": F.lit(last) + F.expr("INTERVAL 30 DAYS"), "client": F.lit(None).cast("string"), "endpoint": F.lit("end")})
    usage = _streamed(s, rows, (F.col("ts") < F.lit(middle)) & ~late, end, lambda stream: jobs.stream_anchored_usage(stream, ["client", "endpoint"], 7 * 86400.0, 3, late="3 hours"))
    return out(usage, digits=3)


@register(
    "s4_locked_clients",
    f"""{_USED}, now AS (SELECT max(epoch_us(ts)) / 1e6 AS a FROM events), ls AS (SELECT * FROM ct, now WHERE key LIKE '%|click' OR key LIKE '%|view' QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1),
lk AS (SELECT split_part(key, '|', 1) AS client, split_part(key, '|', 2) AS f, used FROM ls WHERE start + 604800 > a),
g AS (SELECT client, string_agg(f || ':' || used, ',' ORDER BY f) AS used, coalesce(string_agg(f, ',' ORDER BY f) FILTER (used >= 3), '') AS locked, count(*) FILTER (used >= 3) = 2 AS fully_locked FROM lk GROUP BY client)
SELECT c.client, coalesce(used, '') AS used, coalesce(locked, '') AS locked, coalesce(fully_locked, false) AS fully_locked FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS client FROM events) c LEFT JOIN g USING (client)""",
)
def q_s4l(s: SparkSession, d: str) -> DataFrame:
    rows = requests(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    now = rows.agg(F.max(F.unix_micros("ts"))).first()[0] or 0
    df = jobs.locked_clients(rows, ["click", "view"], 7 * 86400.0, 3, now / 1e6)
    used = F.array_join(F.transform(F.map_entries("used"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return df.select("client", F.coalesce(used, F.lit("")).alias("used"), F.array_join("locked", ",").alias("locked"), "fully_locked")


@register(
    "s6_prefix_lookup",
    """WITH p AS (SELECT event_id, '/api/' || event_type || CASE WHEN user_id % 3 = 0 THEN '/' || user_id WHEN user_id % 3 = 1 THEN '?u=' || user_id ELSE 'x' END AS path FROM events), r(o, prefix, value) AS (VALUES (1, '/api/click', 10), (2, '/api/error/', 1), (3, '/api/error', 5), (4, '/api', 60)),
m AS (SELECT event_id, path, arg_min({'p': prefix, 'v': value}, o) AS b FROM p LEFT JOIN r ON (path = prefix OR starts_with(path, prefix || '/') OR starts_with(path, prefix || '?')) AND NOT (path = '/api/view' OR starts_with(path, '/api/view/') OR starts_with(path, '/api/view?')) GROUP BY ALL)
SELECT event_id, path, b.p AS rule, b.v AS rule_value FROM m""",
)
def q_s6(s: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    tail = F.when(u % 3 == 0, F.concat(F.lit("/"), u)).when(u % 3 == 1, F.concat(F.lit("?u="), u)).otherwise("x")
    events = table(s, d, "events").select("event_id", F.concat(F.lit("/api/"), F.col("event_type"), tail).alias("path"))
    rules = s.createDataFrame([(1, "/api/click", 10), (2, "/api/error/", 1), (3, "/api/error", 5), (4, "/api", 60)], "order int, prefix string, value int")
    return jobs.prefix_lookup(events, rules, ["/api/view"])


_RATED = """p AS (SELECT user_id AS client, epoch_us(ts) / 1e6 AS t, '/api/' || event_type || CASE WHEN user_id % 3 = 0 THEN '/' || user_id WHEN user_id % 3 = 1 THEN '?u=' || user_id ELSE 'x' END AS path FROM events), r(o, prefix, lim) AS (VALUES (1, '/api/click', 2), (2, '/api/error', 1), (3, '/api', 3)),
m AS (SELECT client, t, path, arg_min({'p': prefix, 'v': lim}, o) AS b FROM p JOIN r ON (path = prefix OR starts_with(path, prefix || '/') OR starts_with(path, prefix || '?')) WHERE NOT (path = '/api/view' OR starts_with(path, '/api/view/') OR starts_with(path, '/api/view?')) GROUP BY ALL),
us AS MATERIALIZED (SELECT client, b.p AS rule, b.v AS lim, t, row_number() OVER (PARTITION BY client, b.p ORDER BY t) AS i FROM m)"""


@register(
    "s4_rate_limits",
    f"""WITH RECURSIVE {_RATED}, ct AS (SELECT client, rule, lim, t, i, t AS start, 1 AS used FROM us WHERE i = 1 UNION ALL
  SELECT n.client, n.rule, n.lim, n.t, n.i, CASE WHEN n.t >= c.start + 86400 THEN n.t ELSE c.start END, CASE WHEN n.t >= c.start + 86400 THEN 1 ELSE c.used + 1 END FROM ct c JOIN us n ON n.client = c.client AND n.rule = c.rule AND n.i = c.i + 1)
SELECT CAST(client AS VARCHAR) AS client, rule, {rnd('t', 3)} AS t, used, lim AS "limit", greatest(0, lim - used) AS remaining, used > lim AS blocked, {rnd('start + 86400 - t', 3)} AS reset_in FROM ct""",
)
def q_s4r(s: SparkSession, d: str) -> DataFrame:
    """The rate preset (one counter a client and rule), with a day in place of its minute, as the events of a client are days apart."""
    u = F.col("user_id")
    tail = F.when(u % 3 == 0, F.concat(F.lit("/"), u)).when(u % 3 == 1, F.concat(F.lit("?u="), u)).otherwise("x")
    events = table(s, d, "events").select("ts", u.alias("client"), F.concat(F.lit("/api/"), F.col("event_type"), tail).alias("path"))
    rules = s.createDataFrame([(1, "/api/click", 2), (2, "/api/error", 1), (3, "/api", 3)], "order int, prefix string, value int")
    return out(jobs.rate_limits(events, rules, ["/api/view"], 86400.0), digits=3)
