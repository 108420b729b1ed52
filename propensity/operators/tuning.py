"""Hyper-parameter search: stratified cross-validation over a sampled grid.

One frame serves the whole search: features are binned once (approximate quantiles of all
numeric columns in one pass), assembled, dealt into folds and kept; every trial filters it.
Trials run in parallel from a pool of driver threads, each a distributed fit.

A boosted ensemble of 300 rounds holds those of 100 and 200 rounds as its first trees, so grid
points that differ only in ``n_estimators`` share one fit per fold, whose prefixes are evaluated:
the 27 points of the default grid take 9 fits a fold.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensity.constants import (DEFAULT_HYPERPARAMETERS, DEFAULT_PARAM_GRID, MODEL_FEATURES, TUNING_FOLDS,
                                  TUNING_ITERATIONS)
from propensity.operators.model import (LABEL, _gbt, _prepared, assemble_features, sample_param_maps, sized_for_training,
                                        stratified_folds)
from propensity.session import checkpoint

ROUNDS = "n_estimators"
TUNABLE = (ROUNDS, "max_depth", "learning_rate")
BINS = 32


@dataclass
class Search:
    """``trials``: one row per point and fold (point, its parameters, fold, n_rows, n_positive,
    auc, mean_auc, best); ``best``: the point with the largest mean AUC, the first of equal ones."""

    trials: DataFrame
    best: dict


def binned(df: DataFrame, cols, bins: int = BINS) -> DataFrame:
    """Numeric columns replaced by the number of their quantile bin (a double); others as they are."""
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    if not numeric:
        return df
    df = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    edges = df.approxQuantile(numeric, [i / bins for i in range(1, bins)], 1 / (8 * bins))
    splits = [[-float("inf"), *sorted(set(e)), float("inf")] for e in edges]
    wide = [c for c, s in zip(numeric, splits) if len(s) > 2]  # a column without values has no edges
    out = Bucketizer(splitsArray=[s for s in splits if len(s) > 2], inputCols=wide, outputCols=[f"_bin_{c}" for c in wide],
                     handleInvalid="keep").transform(df)
    return out.select(*[F.col(f"_bin_{c}").alias(c) if c in wide else F.col(c) for c in df.columns])


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble of the first ``n`` trees."""
    j, gateway = model._java_obj, SparkContext.getOrCreate()._gateway
    trees, weights = j.trees(), j.treeWeights()
    cut = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    by = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        cut[i], by[i] = trees[i], weights[i]
    short = GBTClassificationModel(gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(j.uid(), cut, by))
    return short.setFeaturesCol(model.getFeaturesCol())


def search_hyperparameters(train: DataFrame, param_grid: dict | None = None, cv_folds: int = TUNING_FOLDS,
                           n_iter: int = TUNING_ITERATIONS, label: str = LABEL, key: str = "lead_id",
                           feature_columns=MODEL_FEATURES, parallelism: int = 4, seed: int = 42) -> Search:
    """Random search over the grid (``n_iter`` seeded points, all where there are fewer) with
    stratified folds, by exact AUC on the held-out fold; no class weight, no refit.

    A fold without rows of both classes has no AUC and doesn't count in the means."""
    grid = param_grid or DEFAULT_PARAM_GRID
    if unknown := set(grid) - set(TUNABLE):
        raise ValueError(f"no such parameter to tune: {sorted(unknown)}; there are {sorted(TUNABLE)}")
    if cv_folds < 2:
        raise ValueError("cross-validation needs two folds or more")
    base = {**DEFAULT_HYPERPARAMETERS, "colsample_bytree": "all"}  # the search samples no columns
    points = [{**{k: base[k] for k in TUNABLE}, **p} for p in sample_param_maps(grid, n_iter, seed)]
    folds = stratified_folds(_prepared(train, label, None), cv_folds, label, key)
    data = assemble_features(feature_columns).transform(binned(folds, feature_columns)).select("_label", "fold", "features")
    data = checkpoint(sized_for_training(data, rows=folds.count())).persist()  # written: a lost executor costs a read
    try:
        sizes = {r["fold"]: (r["n"], int(r["pos"])) for r in data.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_label").alias("pos")).collect()}
        evaluator = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="probability",
                                                  metricName="areaUnderROC", numBins=0)
        shared: dict[tuple, list[int]] = {}
        for i, p in enumerate(points):
            shared.setdefault(tuple(p[k] for k in TUNABLE if k != ROUNDS), []).append(i)

        def fit(task: tuple[list[int], int]) -> list[tuple[int, int, float | None]]:
            mine, fold = task
            n, pos = sizes.get(fold, (0, 0))
            learn = [v for k, v in sizes.items() if k != fold]
            if pos in (0, n) or sum(p for _, p in learn) in (0, sum(m for m, _ in learn)):
                return [(i, fold, None) for i in mine]
            most = max(points[i][ROUNDS] for i in mine)
            model = _gbt({**base, **points[mine[0]], ROUNDS: most}, None).fit(data.where(F.col("fold") != fold))
            held = data.where(F.col("fold") == fold)
            cut = {r: evaluator.evaluate((model if r == most else first_trees(model, r)).transform(held))
                   for r in {points[i][ROUNDS] for i in mine}}
            return [(i, fold, cut[points[i][ROUNDS]]) for i in mine]

        tasks = [(mine, fold) for mine in shared.values() for fold in range(cv_folds)]
        with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
            aucs = {(i, fold): auc for part in pool.imap_unordered(inheritable_thread_target(train.sparkSession)(fit), tasks)
                    for i, fold, auc in part}
    finally:
        data.unpersist()
    means = []
    for i in range(len(points)):
        known = [a for fold in range(cv_folds) if (a := aucs[i, fold]) is not None]
        means.append(sum(known) / len(known) if known else None)
    best = max(range(len(points)), key=lambda i: (means[i] is not None, means[i] or 0.0, -i))
    rows = [(i, int(p[ROUNDS]), int(p["max_depth"]), float(p["learning_rate"]), fold, *sizes.get(fold, (0, 0)), aucs[i, fold],
             means[i], i == best) for i, p in enumerate(points) for fold in range(cv_folds)]
    trials = train.sparkSession.createDataFrame(
        rows, "point int, n_estimators int, max_depth int, learning_rate double, fold int, n_rows long, n_positive long, "
              "auc double, mean_auc double, best boolean")
    return Search(trials, {k: points[best][k] for k in grid})


def tune_hyperparameters(train: DataFrame, *args, **kwargs) -> dict:
    """The best point of :func:`search_hyperparameters`: values of the grid's parameters."""
    return search_hyperparameters(train, *args, **kwargs).best
