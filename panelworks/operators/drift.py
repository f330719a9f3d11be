"""Feature drift against a stored baseline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip

BINS = 20
_EPS = 1e-8


def sigma_clip(df: DataFrame, cols: list[str], k: float = 6.0) -> DataFrame:
    """Each column clipped to its mean and ``k`` sample standard deviations over the whole frame; one aggregate row joined back."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    rows = df.withColumn("_", F.lit(1)).join(F.broadcast(stats.withColumn("_", F.lit(1))), "_")  # one row

    def held(c: str):
        m, s = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        return F.when(s >= _EPS, clip(F.col(c), m - k * s, m + k * s)).otherwise(F.col(c))

    return rows.withColumns({c: held(c) for c in cols}).select(*df.columns)


def long(df: DataFrame, cols: list[str], ids: list[str]) -> DataFrame:
    """(ids, feature, x) of non-missing values."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, "feature", "x").where("x is not null")


def drift_baseline(df: DataFrame, cols: list[str], least: int = 20, least_features: int = 10) -> DataFrame:
    """Per feature: mean, std, variance, lo, hi and the counts of 20 equal-width bins.

    Fails, when it runs, if fewer than ``least_features`` features have ``least`` values.
    """
    rows = long(sigma_clip(df, cols), cols, [])
    stats = rows.groupBy("feature").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.var_samp("x").alias("variance"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")
    )
    flat = F.col("lo") == F.col("hi")
    stats = stats.where(F.col("n") >= least).withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    bins = rows.join(F.broadcast(stats.select("feature", "lo", "hi")), "feature")  # a row a feature
    counts = bins.groupBy("feature", bin_of().alias("bin")).agg(F.count("*").alias("n"))
    packed = counts.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_b"))
    filled = F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.coalesce(F.try_element_at("_b", i), F.lit(0).cast("long")))
    enough = F.count("*").over(Window.partitionBy(F.lit(0))) >= least_features
    out = stats.join(packed, "feature").select("feature", "mean", "std", "variance", "lo", "hi", "n", filled.alias("counts"))
    return out.withColumn("n", F.when(enough, F.col("n")).otherwise(F.raise_error(F.lit("too few features for a baseline")).cast("long")))


def bin_of():
    """Bin 1 to 20 of x between lo and hi, the last one closed; NULL outside."""
    inside = F.col("x").between(F.col("lo"), F.col("hi"))
    return F.when(inside, F.least(F.width_bucket(F.col("x"), F.col("lo"), F.col("hi"), F.lit(BINS)), F.lit(BINS))).cast("int")


def _edges(baseline: DataFrame) -> DataFrame:
    return F.broadcast(baseline.select("feature", "mean", "std", "variance", "lo", "hi", "counts"))  # a row a feature


def psi(values: DataFrame, baseline: DataFrame, keys: list[str] | None = None, least: int = 5) -> DataFrame:
    """(keys, feature, psi) of long values (keys, feature, x) against the baseline's bins."""
    keys = keys or []
    rows = values.join(_edges(baseline), "feature").withColumn("bin", bin_of())
    total = rows.groupBy(*keys, "feature").agg(F.count("*").alias("n"), F.count("bin").alias("inside"))
    counts = rows.where("bin is not null").groupBy(*keys, "feature", "bin").agg(F.count("*").alias("k"))
    each = baseline.select("feature", F.posexplode("counts").alias("pos", "e"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
    each = F.broadcast(each.select("feature", (F.col("pos") + 1).alias("bin"), F.greatest(F.col("e") / F.col("all"), F.lit(0.01)).alias("e")))  # 20 rows a feature
    grid = total.join(each, "feature").join(counts, [*keys, "feature", "bin"], "left")
    a = F.greatest(F.coalesce(F.try_divide(F.col("k"), F.col("inside")), F.lit(0.0)), F.lit(0.01))
    term = (a - F.col("e")) * F.log((a + _EPS) / (F.col("e") + _EPS))
    value = F.when(F.first("n") >= least, F.greatest(F.sum(term), F.lit(0.0))).otherwise(0.0)
    return grid.groupBy(*keys, "feature").agg(value.alias("psi"))


def time_weighted_mean(values: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, tw_mean, n, variance): weights rise linearly from 1 to 1.5 in row order; plain mean under 5 values."""
    keys = keys or []
    w = Window.partitionBy(*keys, "feature")
    rows = values.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1)
    weight = F.when(F.col("_n") < 5, 1.0).otherwise(1.0 + 0.5 * F.col("_k") / (F.col("_n") - 1))
    return rows.groupBy(*keys, "feature").agg(
        (F.sum(F.col("x") * weight) / F.sum(weight)).alias("tw_mean"), F.count("*").alias("n"), F.var_samp("x").alias("current_var")
    )


def drift_report(current: DataFrame, baseline: DataFrame, cols: list[str], last: int | None = 800, keys: list[str] | None = None, least: int = 25, z_limit: float = 4.0) -> DataFrame:
    """(keys, feature, z, variance_ratio, psi, drift) of the last rows, or of every group of ``keys``, against the baseline."""
    keys = keys or []
    order = ["date", "ticker"]
    thin = current.select("ticker", "date", *cols)
    if keys:
        rows = long(thin, cols, ["ticker", "date"])
    else:
        if last:
            thin = thin.orderBy(F.desc("date"), F.desc("ticker")).limit(last)
        rows = long(sigma_clip(thin, cols), cols, ["ticker", "date"])
    means = time_weighted_mean(rows, order, keys).where(F.col("n") >= least)
    base = baseline.select("feature", F.col("mean").alias("_m"), F.greatest("std", F.lit(_EPS)).alias("_s"), F.greatest("variance", F.lit(_EPS)).alias("_v"))
    out = means.join(F.broadcast(base), "feature").join(psi(rows, baseline, keys), [*keys, "feature"])  # a row a feature
    z = F.abs(F.col("tw_mean") - F.col("_m")) / F.col("_s")
    ratio = F.greatest("current_var", F.lit(_EPS)) / F.col("_v")
    out = out.select(*keys, "feature", z.alias("z"), ratio.alias("variance_ratio"), "psi")
    moved = (F.col("z") > z_limit) | (F.col("variance_ratio") > 4) | (F.col("variance_ratio") < 0.25) | (F.col("psi") > 0.45)
    return out.withColumn("drift", moved)


def drift_state(report: DataFrame, total_features: int, keys: list[str] | None = None, z_limit: float = 4.0) -> DataFrame:
    """Per key one row: severity, state, confidence, coverage, exposure_scale."""
    keys = keys or []
    part = F.least(F.col("z") / z_limit, F.lit(4.0)) + F.least(F.abs(F.log(F.col("variance_ratio") + _EPS)), F.lit(4.0)) + F.least(F.col("psi") / 0.45, F.lit(4.0))
    one = report.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("drift"), part)), F.lit(0.0)).alias("_a"), F.count_if("drift").alias("drifted"), (F.count("*") / total_features).alias("coverage"))
    enough = F.col("coverage") >= 0.3
    severity = F.least(F.floor(F.sqrt(F.when(enough, F.col("_a")).otherwise(0.0))), F.lit(15)).cast("int")
    one = one.withColumn("severity", severity).withColumn("drift_detected", enough & (F.col("drifted") > 0))
    state = F.when(F.col("severity") >= 10, "hard").when(F.col("severity") >= 4, "soft").otherwise("none")
    one = one.withColumn("drift_state", state).withColumn("confidence", F.least(F.lit(1.0), F.col("severity") / 15))
    return one.withColumn("exposure_scale", exposure_scale(F.col("drift_state"))).drop("_a", "drifted")


def exposure_scale(state):
    """Share of the exposure that a drift state leaves."""
    return F.when(state == "none", 1.0).when(state == "soft", 0.6).when(state == "hard", 0.25).when(state == "detector_failure", 0.4).when(state == "baseline_missing", 1.0).otherwise(0.5)


def drift_history(panel: DataFrame, baseline: DataFrame, cols: list[str], keys: list[str], least: int = 25) -> DataFrame:
    """Drift state of every group of ``keys`` (a date, or date and segment), as one backfill job."""
    report = drift_report(panel, baseline, cols, keys=keys, least=least)
    return drift_state(report, len(cols), keys)


def decision(t: int, severity: int, cooldown: int, triggered: int | None = None) -> tuple[str, int | None]:
    """Decision for a severity at ``t`` (epoch seconds), and the last trigger."""
    if severity < 6:
        return "none", triggered
    if severity < 8:
        return "logged", triggered
    if triggered is not None and t - triggered < cooldown:
        return "suppressed", triggered
    return "triggered", int(t)


def decide(rows: pd.DataFrame, cooldown: int, triggered: int | None = None) -> tuple[list[str], int | None]:
    """Decisions for severities in time order (epoch seconds ``t``), and the last trigger."""
    out = []
    for t, severity in zip(rows["t"], rows["severity"]):
        one, triggered = decision(t, severity, cooldown, triggered)
        out.append(one)
    return out, triggered
