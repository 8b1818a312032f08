"""Evaluation of scores as distributed aggregates.

Scores are merged into distinct values first; cumulative counts run over even buckets of
them (``functions.ordered.running_totals``), never over all rows in one task. The table of distinct
scores with running counts is written once, and all measures of a call read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curbsight.functions import columns as C
from curbsight.functions.lineage import cut
from curbsight.functions.ordered import running_totals

CURVE_POINTS = 100


def cumulative_counts(scores: DataFrame) -> DataFrame:
    """Per distinct score from high to low: pos, neg, tp, fp (score and above), idx from 1; written."""
    grouped = cut(scores.groupBy("score").agg(
        C.tally(F.col("label") == 1).alias("pos"), C.tally(F.col("label") != 1).alias("neg")
    ).withColumn("one", F.lit(1).cast("long")))
    return cut(running_totals(grouped, "score", ["pos", "neg", "one"]).select(
        "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("cum_one").alias("idx")))


def _sum(values: Column) -> Column:
    return F.coalesce(F.sum(values), F.lit(0).cast("long"))


def _totals(points: DataFrame) -> Column:
    return points.agg(F.struct(_sum(F.col("pos")).alias("p"), _sum(F.col("neg")).alias("n"))).scalar()


def optimal_threshold(scores: DataFrame) -> DataFrame:
    """(threshold, f1): the score with the best F1, the lowest on ties; 0.5 if there is none."""
    points = cumulative_counts(scores)
    total = _totals(points)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp").cast("double"), total["p"])
    f1 = precision * recall * 2 / (precision + recall + 1e-9)
    best = points.withColumn("f1", f1).agg(
        F.max_by(F.struct("score", "f1"), F.struct("f1", (-F.col("score")).alias("s"))).alias("b"))
    return best.select(
        F.coalesce(F.when(F.col("b.f1").isNotNull(), F.col("b.score")), F.lit(0.5))
        .alias("threshold"), F.col("b.f1").alias("f1"))


def confusion_matrix(scores: DataFrame, threshold: Column) -> DataFrame:
    return scores.groupBy(
        F.col("label").cast("int").alias("label"),
        (F.col("score") >= threshold).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where that is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0))


def clf_metrics(scores: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 at the threshold; ROC-AUC and average precision."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    hit = F.col("score") >= threshold
    points = cumulative_counts(scores)
    at = points.agg(
        _sum(F.when(hit, F.col("pos"))).alias("tp"), _sum(F.when(hit, F.col("neg"))).alias("fp"),
        _sum(F.when(~hit, F.col("pos"))).alias("fn"), _sum(F.when(~hit, F.col("neg"))).alias("tn"))
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    area = points.agg(F.struct(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("wins"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("gain"))).scalar()
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return at.select(
        _ratio(F.col("tp") + F.col("tn"), p + n).alias("accuracy"), precision.alias("precision"),
        recall.alias("recall"), _f1(precision, recall).alias("f1"),
        F.try_divide(area["wins"], (p * n).cast("double")).alias("roc_auc"),
        F.try_divide(area["gain"], p.cast("double")).alias("pr_auc"),
        threshold.cast("double").alias("threshold"),
    ).select(*[C.half_even(F.col(c), 4).alias(c) for c in (
        "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "threshold")])


def class_report(confusion: DataFrame) -> DataFrame:
    """precision, recall, f1 and support per class, with macro and weighted averages."""
    n = lambda a, b: F.coalesce(F.sum(F.when(
        (F.col("label") == a) & (F.col("predicted") == b), F.col("n"))), F.lit(0))
    cells = confusion.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"),
                          n(0, 0).alias("tn"))
    rows = []
    for name, hit, wrong, lost in (("0", "tn", "fn", "fp"), ("1", "tp", "fp", "fn")):
        p = _ratio(F.col(hit), F.col(hit) + F.col(wrong))
        r = _ratio(F.col(hit), F.col(hit) + F.col(lost))
        rows.append({"class": F.lit(name), "precision": p, "recall": r, "f1": _f1(p, r),
                     "support": F.col(hit) + F.col(lost)})
    total = rows[0]["support"] + rows[1]["support"]
    measures = ("precision", "recall", "f1")
    rows.append({"class": F.lit("macro avg"), "support": total, **{
        m: (rows[0][m] + rows[1][m]) / 2 for m in measures}})
    rows.append({"class": F.lit("weighted avg"), "support": total, **{
        m: _ratio(rows[0][m] * rows[0]["support"] + rows[1][m] * rows[1]["support"], total)
        for m in measures}})
    return cells.select(F.explode(F.array(*[
        F.struct(r["class"].alias("class"), *[C.half_even(r[m], 4).alias(m) for m in measures],
                 r["support"].cast("long").alias("support")) for r in rows])).alias("r")).select("r.*")


def _roc_corners(points: DataFrame) -> DataFrame:
    """Points where the curve bends: first, last, and those whose next step differs."""
    after = points.select((F.col("idx") - 1).alias("idx"), F.col("pos").alias("next_pos"),
                          F.col("neg").alias("next_neg"))
    return points.join(after, "idx", "left").filter(
        (F.col("idx") == 1) | F.col("next_pos").isNull()
        | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))


def _thinning(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / CURVE_POINTS)).cast("long")


def _corner_points(points: DataFrame) -> DataFrame:
    corners = cut(_roc_corners(points).withColumn("kept", F.lit(1).cast("long")))
    return cut(running_totals(corners, "score", ["kept"]))


def roc_curve(scores: DataFrame) -> DataFrame:
    """(position, fpr, tpr), thinned to about 100 points; position 0 is the origin."""
    points = cumulative_counts(scores)
    total = _totals(points)
    kept = _corner_points(points)
    curve = kept.select(
        F.col("cum_kept").alias("position"), F.try_divide("fp", total["n"]).alias("fpr"),
        F.try_divide("tp", total["p"]).alias("tpr"))
    origin = scores.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("position"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    step = _thinning(kept.agg(F.count(F.lit(1)) + 1).scalar())
    return curve.unionByName(origin).filter(F.col("position") % step == 0).select(
        "position", C.half_even(F.col("fpr"), 4).alias("fpr"),
        C.half_even(F.col("tpr"), 4).alias("tpr"))


def pr_curve(scores: DataFrame) -> DataFrame:
    """(position, precision, recall) from the lowest score up, ending at (1, 0); the thinning
    is that of the ROC curve."""
    points = cumulative_counts(scores)
    total = _totals(points)
    step = _thinning(_corner_points(points).agg(F.count(F.lit(1)) + 1).scalar())
    m = points.agg(F.count(F.lit(1))).scalar()
    curve = points.select(
        (m - F.col("idx")).alias("position"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", total["p"]).alias("recall"))
    end = points.agg(F.count(F.lit(1)).alias("position")).select(
        "position", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end).filter(F.col("position") % step == 0).select(
        "position", C.half_even(F.col("precision"), 4).alias("precision"),
        C.half_even(F.col("recall"), 4).alias("recall"))


def reg_metrics(pairs: DataFrame) -> DataFrame:
    """R2, MAE and RMSE of (actual, predicted)."""
    error = F.col("actual") - F.col("predicted")
    return pairs.agg(
        (F.lit(1.0) - F.try_divide(F.avg(error * error), F.var_pop("actual"))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
    ).select(*[C.half_even(F.col(c), 4).alias(c) for c in ("r2", "mae", "rmse")])


def residual_stats(pairs: DataFrame) -> DataFrame:
    error = F.col("actual") - F.col("predicted")
    return pairs.agg(
        C.half_even(F.avg(error), 4).alias("mean"),
        C.half_even(F.stddev_pop(error), 4).alias("std"), F.count(F.lit(1)).alias("n"))


def residual_sample(pairs: DataFrame, size: int = 500, seed: int = 42) -> DataFrame:
    return pairs.orderBy(C.spread(F.col("id"), seed), "id").limit(size).select(
        "id", C.half_even(F.col("actual"), 2).alias("actual"),
        C.half_even(F.col("predicted"), 2).alias("predicted"))
