"""Training, selection and evaluation of the priority, closure and resolution models."""

from __future__ import annotations

import contextvars
import itertools
import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F

from curbsight import settings as S
from curbsight.functions.lineage import cut
from curbsight.learning import forest as large_forest, metrics as M
from curbsight.learning.prepare import (ImportanceSelector, balanced_weights, folds, label_table,
                                        preprocessing, split)

TREE_MEMORY_MB = 1024
# Fits of one run that go on side by side, and partitions of the table they share. A level of a forest
# is one small job; its rows are its work, and its statistics of all open nodes are sent once per partition.
# So partitions grow with the root of the rows. Each fit keeps its rows and their nodes in memory, some
# 2 KB a row with 120 trees, so that fits of large tables wait for each other instead of reading them from disk.
PARALLEL_FITS, ROWS_OF_ALL_FITS = 4, 4_000_000
LEAST_PARTITIONS, ROWS_OF_FIRST_PARTITION = 2, 20_000


def estimator(family: str, task: str, **params):
    spec = S.TASKS[task]
    clf = spec["kind"] == "classification"
    shared = {"featuresCol": "features", "labelCol": "label", "seed": S.SEED,
              "maxMemoryInMB": TREE_MEMORY_MB, "maxBins": 32, "cacheNodeIds": True}
    if family == "random_forest":
        if clf and spec["balanced"]:
            shared["weightCol"] = "weight"
        return (RandomForestClassifier if clf else RandomForestRegressor)(**shared, **params)
    if family == "boosting":
        return (GBTClassifier if clf else GBTRegressor)(**shared, **params)
    raise KeyError(f"no model family '{family}'")


def pipeline(family: str, task: str, columns: list[str], select: bool = True,
             selector: dict | None = None, **params) -> Pipeline:
    stages = preprocessing(task, columns, "prepared" if select else "features")
    if select:
        stages.append(ImportanceSelector(kind=S.TASKS[task]["kind"], **(selector or {})))
    return Pipeline(stages=[*stages, estimator(family, task, **params)])


def training_table(df: DataFrame, task: str) -> DataFrame:
    """Label table with ``is_test`` and ``weight``, written once for all fits."""
    table = split(label_table(df, task), task)
    if S.TASKS[task]["kind"] == "classification":
        table = balanced_weights(table)
    return few_partitions(cut(table))


def few_partitions(written: DataFrame) -> DataFrame:
    """A written table in as many partitions as a fit of its rows is worth."""
    return written.coalesce(partitions_for(written.count()))


def partitions_for(rows: int) -> int:
    return max(LEAST_PARTITIONS, math.ceil(math.sqrt(rows / ROWS_OF_FIRST_PARTITION)))


def side_by_side(fits: list[Callable], rows: int) -> list:
    """The results of ``fits`` over ``rows`` rows each. At most ``PARALLEL_FITS`` of a call run at a time,
    and no more than hold ``ROWS_OF_ALL_FITS`` together, but always one."""
    with ThreadPoolExecutor(max(1, min(PARALLEL_FITS, ROWS_OF_ALL_FITS // max(rows, 1)))) as pool:
        waiting = [pool.submit(contextvars.copy_context().run, fit) for fit in fits]
        return [w.result() for w in waiting]


def fitted(pipe: Pipeline, table: DataFrame, rows: int) -> PipelineModel:
    """``pipe`` fitted to the ``rows`` rows of ``table``; a forest of many rows grows whole trees in tasks."""
    *before, last = pipe.getStages()
    if not large_forest.suits(last, rows):
        return pipe.fit(table)
    prepared = Pipeline(stages=before).fit(table)
    return PipelineModel([*prepared.stages, large_forest.fit(last, prepared.transform(table))])


def scored(model: PipelineModel, table: DataFrame, task: str) -> DataFrame:
    """(id, label, score) or (id, actual, predicted)."""
    if S.TASKS[task]["kind"] == "classification":
        return large_forest.with_score(
            model, table, ["id", "label"], "score").withColumn("label", F.col("label").cast("int"))
    return large_forest.with_score(model, table, ["id", "label"], "predicted").withColumnRenamed("label", "actual")


def fold_fits(pipe: Pipeline, train: DataFrame, task: str) -> tuple[DataFrame, list[Callable]]:
    """The training rows with their fold, and a fit without each fold."""
    parts = few_partitions(cut(folds(train, S.THRESHOLD_FOLDS, S.SEED + 7, task)))
    counts = {r["fold"]: r["count"] for r in parts.groupBy("fold").count().collect()}
    return parts, [lambda i=i: fitted(pipe, parts.filter(F.col("fold") != i),
                                      sum(counts.values()) - counts.get(i, 0))
                   for i in range(S.THRESHOLD_FOLDS)]


def out_of_fold_threshold(models: list[PipelineModel], parts: DataFrame, task: str) -> float:
    """The F1-best threshold of out-of-fold training scores; model i has not seen fold i."""
    scores = None
    for i, model in enumerate(models):
        part = scored(model, parts.filter(F.col("fold") == i), task)
        scores = part if scores is None else scores.unionByName(part)
    return float(M.optimal_threshold(cut(scores)).first()["threshold"])


def _evaluator(task: str):
    if S.TASKS[task]["kind"] == "classification":
        return BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC",
                                             numBins=0)
    return RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="r2")


def cv_scores(train: DataFrame, task: str, families: dict[str, dict],
              k: int = S.CV_FOLDS, selector: dict | None = None,
              select: bool = True) -> dict[str, float]:
    """Mean score over the folds per model family; a fold is prepared and selected from once for all of them."""
    parts = few_partitions(cut(folds(train, k, task=task)))
    pipes = {f: pipeline(f, task, train.columns, select, selector, **params).getStages()
             for f, params in families.items()}
    evaluator = _evaluator(task)

    def of_fold(i: int) -> list[float]:
        own, held = parts.filter(F.col("fold") != i).persist(), parts.filter(F.col("fold") == i)
        prepared = None
        try:
            before = Pipeline(stages=next(iter(pipes.values()))[:-1]).fit(own)
            used = [c for c in ("label", "weight", "features") if c in own.columns or c == "features"]
            prepared = before.transform(own).select(*used).persist()
            judged = before.transform(held).select(*used)
            return [evaluator.evaluate(stages[-1].fit(prepared).transform(judged)) for stages in pipes.values()]
        finally:
            own.unpersist()
            if prepared is not None:
                prepared.unpersist()

    scores = side_by_side([lambda i=i: of_fold(i) for i in range(k)], parts.count()) if pipes else []
    return {f: float(np.mean(own)) for f, own in zip(pipes, zip(*scores))}


def random_search(train: DataFrame, task: str, family: str, draws: int = S.SEARCH_DRAWS,
                  k: int = S.CV_FOLDS, space: dict | None = None, selector: dict | None = None,
                  parallelism: int = 2) -> tuple[dict, float, PipelineModel]:
    """Seeded draws from the search space; the best by cross-validation, refitted."""
    space = space or S.SEARCH_SPACE[(family, S.TASKS[task]["kind"])]
    combos = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    chosen = random.Random(S.SEED).sample(combos, min(draws, len(combos)))
    pipe = pipeline(family, task, train.columns, True, selector)
    model = pipe.getStages()[-1]
    maps = [{model.getParam(p): v for p, v in c.items()} for c in chosen]
    search = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=_evaluator(task),
                            numFolds=k, foldCol="fold", parallelism=parallelism)
    fitted = search.fit(few_partitions(cut(folds(train, k, task=task))))
    scores = fitted.avgMetrics
    best = max(range(len(scores)), key=lambda i: scores[i])
    return chosen[best], float(scores[best]), fitted.bestModel


def importances(model: PipelineModel, spark) -> DataFrame:
    """(feature, importance), descending; one row per slot of the feature vector."""
    names = feature_slots(model)
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(names, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def feature_slots(model: PipelineModel) -> list[str]:
    """Names of the vector slots, from the fitted stages."""
    from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler, VectorSlicer

    stages = model.stages
    numbers = next(s for s in stages if isinstance(s, VectorAssembler)).getInputCols()
    names = []
    indexer = next((s for s in stages if isinstance(s, StringIndexerModel)), None)
    if indexer is not None and any(isinstance(s, OneHotEncoderModel) for s in stages):
        for column, labels in zip(indexer.getInputCols(), indexer.labelsArray):
            names += [f"{column.removesuffix('_level')}={v}" for v in labels]
    names += [c.removesuffix("_filled") for c in numbers]
    slicer = next((s for s in stages if isinstance(s, VectorSlicer)), None)
    return [names[i] for i in slicer.getIndices()] if slicer else names


def train_task(df: DataFrame, task: str, fast: bool = True, families: dict | None = None,
               draws: int = S.SEARCH_DRAWS, forest: dict | None = None,
               selector: dict | None = None, tune_threshold: bool = True) -> dict:
    """Train and evaluate one task.

    Fast: one forest without selection. Otherwise the family with the best cross-validation
    score is tuned by random search. Returns the model and its record.
    """
    spec = S.TASKS[task]
    table = training_table(df, task)
    train = table.filter(~F.col("is_test")).drop("is_test")
    test = table.filter("is_test").drop("is_test")
    scores: dict[str, float] = {}
    if fast:
        family, params = "random_forest", dict(forest or S.FAST_FOREST)
        pipe, model = pipeline(family, task, train.columns, False, **params), None
    else:
        families = families or S.COMPARED_FAMILIES
        scores = cv_scores(train, task, families, selector=selector)
        family = max(scores, key=scores.get)
        params, _, model = random_search(train, task, family, draws, selector=selector)
        pipe = pipeline(family, task, train.columns, True, selector, **params)
    counts = {r["is_test"]: r["count"] for r in table.groupBy("is_test").count().collect()}
    fits = [] if model else [lambda: fitted(pipe, train, counts.get(False, 0))]
    tuned = tune_threshold and spec["kind"] == "classification"
    parts, more = fold_fits(pipe, train, task) if tuned else (None, [])
    models = side_by_side([*fits, *more], counts.get(False, 0))
    model = model or models[0]
    held = cut(scored(model, test, task))
    threshold = 0.5
    if spec["kind"] == "classification":
        if tuned:
            threshold = out_of_fold_threshold(models[len(fits):], parts, task)
        result = M.clf_metrics(held, threshold)
    else:
        result = M.reg_metrics(held)
    return {
        "task": task, "model": model, "best_model": family, "params": params,
        "threshold": threshold, "cv_scores": scores, "metrics": result.first().asDict(),
        "n_train": counts.get(False, 0), "n_test": counts.get(True, 0),
        "features": [c for c in train.columns if c not in ("id", "label", "weight")],
        "importances": [tuple(r) for r in importances(model, df.sparkSession).collect()],
        "held_out": held,
    }


def train_all(df: DataFrame, tasks: list[str] | None = None, **options) -> dict[str, dict]:
    """All tasks side by side."""
    tasks = tasks or list(S.TASKS)
    return dict(zip(tasks, side_by_side(
        [lambda t=t: train_task(df, t, **options) for t in tasks], df.count())))


def evaluate_task(run: dict) -> dict[str, DataFrame]:
    """Report tables of a trained task over its held-out rows."""
    held = run["held_out"]
    if S.TASKS[run["task"]]["kind"] == "regression":
        return {"metrics": M.reg_metrics(held), "residuals": M.residual_stats(held),
                "scatter": M.residual_sample(held)}
    threshold = F.lit(run["threshold"])
    confusion = M.confusion_matrix(held, threshold)
    return {"metrics": M.clf_metrics(held, threshold), "confusion": confusion,
            "report": M.class_report(confusion), "roc": M.roc_curve(held), "pr": M.pr_curve(held)}
