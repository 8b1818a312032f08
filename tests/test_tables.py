"""Order statistics, measures, fleet and forecasts on small hand-made tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbsight import settings as S
from curbsight.functions.ordered import quantiles, running_totals, value_counts
from curbsight.learning import metrics as M
from curbsight.operators import fleet, forecasting as FC


@pytest.mark.parametrize("n", [1, 2, 57, 400])
def test_quantiles_equal_numpy(spark, n):
    r = np.random.RandomState(n)
    values = np.concatenate([r.gamma(2, 3, n), np.full(n // 2, 4.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = quantiles(value_counts(df, [], "x"), [], "x", {"a": 0.95, "b": 0.5, "c": 0.0}, 0.5).first()
    assert np.allclose([got.a, got.b, got.c], np.percentile(values, [95, 50, 0]))


def test_running_totals_over_many_buckets(spark):
    df = spark.range(1, 2001).select(F.col("id").cast("double").alias("x"), F.lit(1).cast("long").alias("one"))
    out = running_totals(df, "x", ["one"], buckets=16).toPandas()
    assert (out.cum_one == 2001 - out.x).all()


@pytest.mark.parametrize("labels", [[1, 1, 1], [0, 0], []])
def test_degenerate_labels(spark, labels):
    df = spark.createDataFrame([(y, 0.1 * i) for i, y in enumerate(labels)], "label int, score double")
    row = M.clf_metrics(df, 0.05).first()
    assert row.roc_auc is None
    assert M.optimal_threshold(df).first().threshold == (0.0 if labels and labels[0] else 0.5) or not labels


@pytest.mark.parametrize("labels,empty", [([1, 1, 1], "fpr"), ([0, 0], "tpr")])
def test_curves_of_one_class(spark, labels, empty):
    df = spark.createDataFrame([(y, 0.1 * i) for i, y in enumerate(labels)], "label int, score double")
    points = M.roc_curve(df).filter("position > 0").collect()
    assert points and all(p[empty] is None for p in points)
    recalls = {p.recall for p in M.pr_curve(df).collect()}
    assert (None in recalls) == (empty == "tpr")


def test_measures_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, score double")
    row = M.clf_metrics(df, 0.5).first()
    assert (row.accuracy, row.precision, row.recall, row.roc_auc) == (0.75, 0.6667, 1.0, 0.875)
    assert row.pr_auc == round(0.5 + 0.5 * 2 / 3, 4)


def shares(spark, values):
    return spark.createDataFrame(
        [(f"z{i}", r, float(v)) for r in S.FLEET for i, v in enumerate(values)],
        "zone string, resource string, demand double")


@pytest.mark.parametrize("values", [[1, 1, 1], [0, 0, 0, 0], [5, 0, 0.1], list(np.arange(13) ** 2)])
def test_fleet_is_conserved_and_floors_hold(spark, values):
    out = fleet.largest_remainder(shares(spark, values)).toPandas()
    assert out.groupby("resource").units.sum().to_dict() == S.FLEET
    assert (out[out.resource == "traffic_police"].units >= 1).all()


def test_floors_above_the_fleet(spark):
    out = fleet.largest_remainder(shares(spark, [3, 2, 1]), {r: 2 for r in S.FLEET},
                                  {r: 1 for r in S.FLEET}).toPandas()
    assert (out.units == 1).all()


def series(spark, scope, values, start=dt.date(2024, 1, 1)):
    return spark.createDataFrame(
        [(scope, start + dt.timedelta(days=i), int(v)) for i, v in enumerate(values)],
        "scope string, date date, y long")


def holt_winters(y, a, b, g):
    y = np.maximum(np.asarray(y, float), 0) + 1e-6
    level, trend = y[:7].mean(), (y[7:14].mean() - y[:7].mean()) / 7
    season, sse = list(y[:7] - level), 0.0
    for v in y:
        s = season.pop(0)
        sse += (v - level - trend - s) ** 2
        new = a * (v - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        level = new
        season.append(g * (v - level) + (1 - g) * s)
    return sse, [max(0.0, level + trend * h + season[(h - 1) % 7]) for h in range(1, 31)]


def test_ets_equals_numpy(spark):
    y = 20 + 5 * np.sin(np.arange(60) * 2 * np.pi / 7) + np.arange(60) * 0.3
    y = y.astype(int)
    best = min((holt_winters(y, *w) for w in FC.SMOOTHING_GRID), key=lambda t: t[0])
    got = FC.forecast_ets(series(spark, "A", y)).orderBy("step").toPandas().yhat
    assert np.allclose(got, best[1], atol=1e-6)


def test_gaps_short_series_and_zero_days(spark):
    rows = [("A", dt.date(2024, 1, 1)), ("A", dt.date(2024, 1, 4)), ("A", dt.date(2024, 1, 4))]
    got = FC.daily_series(spark.createDataFrame(rows, "scope string, date date")).orderBy("date").toPandas()
    assert list(got.y) == [1, 0, 0, 2]
    short = series(spark, "A", [1] * 14)
    assert FC.supervised_frame(short).count() == 0
    assert FC.supervised_frame(series(spark, "A", [1] * 15)).count() == 1
    split = FC.backtest_split(series(spark, "A", range(20))).toPandas()
    assert split.step.notna().sum() == 7
    zero = FC.forecast_metrics(FC.backtest(series(spark, "A", [0] * 40), ["naive"])).first()
    assert zero.mae == 0 and zero.mape is None


def test_naive_repeats_the_week_and_gbt_runs(spark):
    two = series(spark, "A", range(50)).union(series(spark, "B", [3] * 50))
    naive = FC.forecast_naive(two, 9).filter("scope = 'A'").orderBy("step").toPandas()
    assert list(naive.yhat) == [43, 44, 45, 46, 47, 48, 49, 43, 44]
    out = FC.forecast_gbt(two, 6, maxIter=3).toPandas()
    assert len(out) == 12 and (out.yhat >= 0).all()
