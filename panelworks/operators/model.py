"""Gradient-boosted scores on the model columns; any column expression can stand in for a fitted model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, wait

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import clip
from .features import standardize_scores


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the least error, and whether ``patience`` rounds without a lesser one came after it; later rounds are not looked at."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The ensemble of the first ``n`` trees of a model."""
    gateway, java = SparkContext._active_spark_context._gateway, model._java_obj
    regression = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:n], list(java.treeWeights())[:n])):
        trees[i], weights[i] = tree, weight
    cut = GBTRegressionModel(regression.GBTRegressionModel(java.uid(), trees, weights, model.numFeatures))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def lengths(first: int, most: int) -> list[int]:
    """Ensemble sizes to fit while the patience is not used up: ``first``, two and a half times as many ..., ``most``; none over half of ``most`` but that."""
    out = []
    while first < most and (not out or first <= most / 2):
        out.append(first)
        first = first * 5 // 2 + 1
    return [*out, most]


def in_turn(tasks: list[Callable[[], GBTRegressionModel]], spark: SparkSession, at_once: int) -> Iterator[GBTRegressionModel]:
    """What the tasks give, in their order, ``at_once`` of them running ahead; when the caller ends the iteration, the jobs of those that still run are cancelled."""
    sc, started = spark.sparkContext, []

    def run(task: Callable[[], GBTRegressionModel], tag: str) -> GBTRegressionModel:
        sc.addJobTag(tag)
        return task()

    def start(task: Callable[[], GBTRegressionModel]) -> tuple[Future, str]:
        tag = f"fit-{uuid.uuid4().hex}"
        return threads.submit(inheritable_thread_target(spark)(run), task, tag), tag

    with ThreadPoolExecutor(max_workers=at_once) as threads:
        try:
            for i in range(len(tasks)):
                started += [start(t) for t in tasks[len(started) : i + at_once]]
                yield started[i][0].result()
        finally:
            for future, tag in started:
                future.cancel()
                while not future.done():  # a fit may be between two jobs
                    sc.cancelJobsWithTag(tag)
                    wait([future], 0.1)


def fit_model(
    train: DataFrame, features: list[str], target: str = "target", valid: float = 0.15, trees: int = 2000, depth: int = 3, eta: float = 0.01, seed: int = 42, patience: int = 50, first: int = 100, at_once: int = 4
) -> PipelineModel:
    """Boosted trees on ``features``, cut to the round whose error on the last ``valid`` share of dates is the least.

    The search ends when ``patience`` rounds have brought no lesser error, or at
    ``trees`` rounds. MLlib cannot go on with an ensemble, and the same seed gives
    the same trees again: ensembles of ``lengths(first, trees)`` are fitted,
    ``at_once`` of them side by side, as a round is a few short jobs that leave
    most cores idle. The shortest one in which the patience is used up counts;
    the fits of longer ones are then cancelled, so the search takes the time of that one.
    Fails on fewer than 80 rows or a target that hardly varies; targets are held
    to +-50. Without rows on the held dates all rounds stay.
    """
    rows = train.select("date", *features, clip(F.col(target), -50, 50).alias("label")).where("label is not null").persist()
    try:
        n, spread = rows.agg(F.count("*"), F.stddev_samp("label")).first()
        if n < 80 or (spread or 0.0) < 1e-6:
            raise ValueError(f"{n} rows with a target spread of {spread}: too little to fit")
        dates = rows.select("date").distinct()
        share = F.percent_rank().over(Window.orderBy("date"))  # a row a date
        split = rows.join(dates.select("date", (share > 1 - valid).alias("held")), "date")
        assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
        # Every round reads the rows once a level: few rows in few partitions.
        ready = assembler.transform(split).select("features", "label", "held").coalesce(max(1, n // 2_000)).persist()
        try:
            held = ready.where("held")
            checked = held.limit(1).count() > 0
            part = ready.where("not held") if checked else ready
            part.count()  # all rows are kept before fits read them side by side

            def fit(rounds: int) -> GBTRegressionModel:
                return GBTRegressor(maxDepth=depth, maxIter=rounds, stepSize=eta, seed=seed, predictionCol="score").fit(part)

            sizes = lengths(first, trees) if checked else [trees]
            fits = in_turn([lambda k=k: fit(k) for k in sizes], train.sparkSession, at_once)
            try:
                for rounds, fitted in zip(sizes, fits):
                    best, ended = best_round(fitted.evaluateEachIteration(held, "squared"), patience) if checked else (rounds, True)
                    if ended:
                        break
            finally:
                fits.close()
        finally:
            ready.unpersist()
        return PipelineModel([assembler, first_trees(fitted, best)])
    finally:
        rows.unpersist()


def predict(model: PipelineModel | Column, df: DataFrame, features: list[str], by: str = "date") -> DataFrame:
    """``score``, standardised within the date; missing columns are 0, missing values fail for a fitted model."""
    if isinstance(model, Column):
        return standardize_scores(df.withColumn("score", model), "score", by)
    absent = {f: F.lit(0.0) for f in features if f not in df.columns}
    scored = model.transform(df.withColumns(absent)) if absent else model.transform(df)
    return standardize_scores(scored.drop("features", *absent), "score", by)


def feature_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """(feature, importance): gain shares that sum to 1, largest first; a row a feature."""
    gains = model.stages[-1].featureImportances.toArray()
    rows = [(f, round(float(g), 6)) for f, g in zip(features, gains)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
