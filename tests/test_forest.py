"""Forests of large tables: grown in tasks, scored tree by tree, and folds that are prepared once."""

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from curbsight.functions.lineage import cut
from curbsight.learning import forest, metrics as M, train
from curbsight.plans import catalog

SIZE = {"numTrees": 12, "maxDepth": 7}


def _tables(spark, sf, task):
    known = catalog.features_of(spark, sf)
    table = train.training_table(known, task)
    return table.filter(~F.col("is_test")).drop("is_test"), table.filter("is_test").drop("is_test")


def _rows(spark, n=3_000):
    """Rows with a number, a rare number, missing values, ids that repeat or are null, and a label with a plain rule."""
    return spark.range(n).select(
        F.when(F.col("id") % 50 != 0, (F.col("id") % 700).cast("string")).alias("id"),
        F.when((F.col("id") % 10 < 3) | (F.col("id") % 7 == 1), 1.0).otherwise(0.0).alias("label"),
        F.element_at(F.array(*map(F.lit, "abcdefghij")), (F.col("id") % 10 + 1).cast("int")).alias("event_cause"),
        F.when(F.col("id") % 31 != 0, (F.col("id") % 7).cast("double")).alias("hour"),
        F.pmod(F.xxhash64("id"), F.lit(1_000)).cast("double").alias("latitude"))


def _fit(table, task="closure", **size):
    pipe = train.pipeline("random_forest", task, table.columns, False, **(size or SIZE))
    *before, last = pipe.getStages()
    prepared = Pipeline(stages=before).fit(table)
    return PipelineModel([*prepared.stages, forest.fit(last, prepared.transform(table))])


def _nodes(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.stages[-1].trees]


def test_grown_forest_learns_like_sparks(spark, sf):
    for task, measure in (("closure", "roc_auc"), ("resolution", "rmse")):
        table, test = _tables(spark, sf, task)
        here = _fit(table, task)
        sparks = train.pipeline("random_forest", task, table.columns, False, **SIZE).fit(table)
        last = here.stages[-1]
        assert last.getNumTrees == 12 and last.numFeatures == sparks.stages[-1].numFeatures
        assert abs(sum(last.featureImportances.toArray()) - 1) < 1e-9 and max(t.depth for t in last.trees) <= 7
        judge = M.reg_metrics if task == "resolution" else lambda t: M.clf_metrics(t, 0.5)
        a, b = (judge(cut(train.scored(m, test, task))).first()[measure] for m in (here, sparks))
        assert abs(a - b) < (0.15 if task == "closure" else 0.15 * b)


def test_grown_forest_finds_a_plain_rule_and_does_not_depend_on_partitions(spark):
    rows = _rows(spark)
    table = rows.withColumn("weight", F.when(F.col("label") == 1, 2.0).otherwise(0.5))
    model = _fit(table, numTrees=30, maxDepth=12)
    out = train.scored(model, rows.withColumn("weight", F.lit(1.0)), "closure")
    right = out.agg(F.avg(((F.col("score") > 0.5) == (F.col("label") == 1)).cast("int"))).first()[0]
    assert out.count() == 3_000 and right > 0.97
    again = _fit(table.repartition(5, "latitude"), numTrees=30, maxDepth=12)
    assert _nodes(model) == _nodes(again)


def test_best_cut_equals_brute_force(monkeypatch):
    monkeypatch.setattr(forest, "pruned", lambda nodes: nodes)
    rng = np.random.default_rng(3)
    bins = forest.Bins({0: np.arange(5.0)}, [1, 2])
    x = np.stack([rng.integers(0, 6, 400), rng.integers(0, 2, 400), rng.integers(0, 2, 400)], 1).astype(float)
    for weights, y in (((0.5, 3.0), (rng.random(400) < 0.3 + 0.1 * x[:, 0]).astype(float)), (None, x[:, 1] + rng.random(400))):
        rows = forest.Rows(bins.codes(x), y, forest.Growth(bins, weights, 1, 3, 7))
        expected = []
        counts = np.random.default_rng([7, 4]).poisson(1.0, 400).astype(float)
        w = counts * (1.0 if weights is None else np.array(weights)[y.astype(int)])
        spread = lambda m: w[m].sum() * (y[m] ** 2 @ w[m] / w[m].sum() - (y[m] @ w[m] / w[m].sum()) ** 2)
        scale = 1 if weights is None else 2  # Gini impurity is twice the variance of a class
        every = counts > 0
        for slot, cuts in ((0, bins.cuts[0]), (1, [0.0]), (2, [0.0])):
            for c in cuts:
                left = every & (x[:, slot] <= c)
                expected.append(scale * (spread(every) - spread(left) - spread(every & ~left)) / w.sum())
        for large in (1, 10_000):  # the node on its own, and among small ones
            monkeypatch.setattr(forest, "LARGE_NODE", large)
            nodes = forest.Tree(rows, forest.Growth(bins, weights, 1, 3, 7), 4).grown()
            assert len(nodes["left"]) == 3 and abs(nodes["gain"][0] - max(expected)) < 1e-9
            assert nodes["raw"][0] == counts.sum() == nodes["raw"][1] + nodes["raw"][2]


def test_tree_by_tree_scores_are_sparks(spark, sf, monkeypatch):
    monkeypatch.setattr(forest, "NODES_OF_LARGE_FOREST", 0)
    for task, name in (("closure", "score"), ("resolution", "predicted")):
        table, _ = _tables(spark, sf, task)
        model = train.pipeline("random_forest", task, table.columns, False, **SIZE).fit(table)
        theirs = model.transform(table)
        value = vector_to_array("probability")[1] if task == "closure" else F.col("prediction")
        expected = sorted((r[0], r[1]) for r in theirs.select("id", value).collect())
        found = sorted((r["id"], r[name]) for r in train.scored(model, table, task).collect())
        assert found == expected


def test_large_tables_grow_whole_trees(spark, sf, monkeypatch):
    """The training of a job takes the forest of this module for a table of many rows, in all its fits."""
    fits, own = [], forest.fit
    monkeypatch.setattr(forest, "ROWS_OF_TASK", (100, 10_000_000))
    monkeypatch.setattr(forest, "fit", lambda *a: fits.append(1) or own(*a))
    run = train.train_task(catalog.features_of(spark, sf), "closure", forest={"numTrees": 4, "maxDepth": 3})
    assert len(fits) == 4 and 0 < run["threshold"] < 1 and run["held_out"].count() == run["n_test"]


def test_folds_are_prepared_once_for_all_families(spark, sf, monkeypatch):
    fits, own = [], train.ImportanceSelector._fit
    monkeypatch.setattr(train.ImportanceSelector, "_fit", lambda self, d: fits.append(1) or own(self, d))
    table, _ = _tables(spark, sf, "closure")
    small = {"numTrees": 3, "maxDepth": 2}
    scores = train.cv_scores(table, "closure", {"random_forest": small, "boosting": {"maxIter": 2, "maxDepth": 2}},
                             k=2, selector=small)
    assert len(fits) == 2 and list(scores) == ["random_forest", "boosting"] and all(0 < s <= 1 for s in scores.values())
