"""The snapshot of every date: scores, agents, weights, exposure and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scoring
from ..operators.features import cross_section, standardize_scores, window_features


def scored_panel(bars: DataFrame, raw: Column | None = None) -> DataFrame:
    """Window features, ``momentum_20_z`` and the standardised ``score`` of every bar that has one."""
    df = window_features(bars)
    df = cross_section(df, ["momentum_20"])
    df = df.withColumn("score", raw if raw is not None else F.col("momentum_20")).where("score is not null")
    return standardize_scores(df, "score")


def agents(df: DataFrame) -> DataFrame:
    """The agents' columns, hybrid score, weight and direction of scored rows."""
    spread = F.stddev_samp("score").over(Window.partitionBy("date"))
    return scoring.hybrid_score(scoring.technical_agent(scoring.signal_agent(df.withColumn("score_std", spread))))


def snapshot_all_dates(panel: DataFrame, drift: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, exposure, selection) of every date of a scored panel.

    drift: date, severity, drift_state, exposure_scale; without it nothing drifts.
    """
    if drift is None:
        panel = panel.withColumns({"severity": F.lit(0), "drift_state": F.lit("none"), "exposure_scale": F.lit(1.0)})
    else:
        panel = panel.join(drift.select("date", "severity", "drift_state", "exposure_scale"), "date", "left").fillna({"severity": 0, "drift_state": "baseline_missing", "exposure_scale": 1.0})
    signals = agents(panel)
    state = signals.groupBy("date").agg(F.first("severity").alias("severity"), F.first("drift_state").alias("drift_state"), F.first("exposure_scale").alias("exposure_scale"))
    exposure = scoring.exposure_summary(signals).join(state, "date")
    return signals, exposure, scoring.rationale(scoring.top_k(signals))
