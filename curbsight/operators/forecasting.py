"""Daily incident forecasts for all areas at once.

A series is a set of rows (scope, date, y); no step handles one scope at a time. Each scope
has one row per day, so windows and arrays per scope are bounded by the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C
from curbsight.functions.lineage import cut

HORIZON = max(S.HORIZONS.values())
SMOOTHING_GRID = [
    (a, b, g) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.0, 0.05, 0.2) for g in (0.05, 0.2, 0.5)]
GBT_DEFAULTS = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 4, "subsamplingRate": 0.9}


def city_events(df: DataFrame, scope_column: str = "corridor",
                top_scopes: int | None = S.TOP_SCOPES) -> DataFrame:
    """(scope, date) per incident: CITY, and the busiest areas (all areas for ``None``)."""
    area = F.col(scope_column)
    scoped = df.filter(area.isNotNull() & (area != S.UNKNOWN)).select(
        area.alias("scope"), "date")
    if top_scopes is not None:
        busiest = scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).orderBy(
            F.desc("n"), "scope").limit(top_scopes)
        scoped = scoped.join(busiest.select("scope"), "scope", "left_semi")
    return df.select(F.lit(S.CITY_SCOPE).alias("scope"), "date").unionByName(scoped)


def daily_series(scoped: DataFrame) -> DataFrame:
    """Counts per scope and day, days without incidents included as 0, within its own span."""
    counts = scoped.groupBy("scope", "date").agg(F.count(F.lit(1)).alias("y"))
    days = counts.groupBy("scope").agg(
        F.min("date").alias("d0"), F.max("date").alias("d1")).select(
        "scope", F.explode(F.sequence("d0", "d1")).alias("date"))
    return days.join(counts, ["scope", "date"], "left").select(
        "scope", "date", F.coalesce("y", F.lit(0)).cast("long").alias("y"))


def forecast_series(df: DataFrame, scope_column: str = "corridor",
                    top_scopes: int | None = S.TOP_SCOPES) -> DataFrame:
    """Series of the scopes worth a forecast: CITY, and areas with enough active days."""
    series = daily_series(city_events(df, scope_column, top_scopes))
    active = series.groupBy("scope").agg(C.tally(F.col("y") > 0).alias("days")).filter(
        (F.col("days") >= S.MIN_ACTIVE_DAYS) | (F.col("scope") == S.CITY_SCOPE))
    return series.join(active.select("scope"), "scope", "left_semi")


def calendar(date: Column) -> dict[str, Column]:
    return {
        "dow": F.weekday(date).cast("int"), "day": F.dayofmonth(date).cast("int"),
        "month": F.month(date).cast("int"),
        "is_weekend": (F.weekday(date) >= 5).cast("int"),
        "weekofyear": F.weekofyear(date).cast("int"),
    }


def supervised_frame(series: DataFrame) -> DataFrame:
    """Calendar, lags and mean of the previous week; the first 14 days of a scope drop out."""
    past = Window.partitionBy("scope").orderBy("date")
    week = past.rowsBetween(-S.SEASON, -1)
    y = F.col("y").cast("double")
    return (
        series.withColumns({
            **calendar(F.col("date")),
            **{f"lag_{n}": F.lag(y, n).over(past) for n in S.LAGS},
            "roll7": F.when(F.count("y").over(week) == S.SEASON, F.avg(y).over(week)),
        }).dropna(subset=[f"lag_{n}" for n in S.LAGS] + ["roll7"])
    )


def backtest_split(series: DataFrame) -> DataFrame:
    """Adds ``step`` (1.. for held-out days, null for training days), ``n`` and ``test_days``."""
    whole = Window.partitionBy("scope")
    newest = whole.orderBy(F.desc("date"))
    n = F.count(F.lit(1)).over(whole)
    test = F.least(F.lit(S.TEST_DAYS), F.greatest(F.lit(7), F.floor(n / 4))).cast("int")
    back = F.row_number().over(newest)
    return series.withColumns({"n": n, "test_days": test, "_back": back}).withColumn(
        "step", F.when(F.col("_back") <= F.col("test_days"),
                       F.col("test_days") - F.col("_back") + 1).cast("int")).drop("_back")


def training_part(split: DataFrame) -> DataFrame:
    return split.filter(F.col("step").isNull()).select("scope", "date", "y")


def _as_arrays(series: DataFrame) -> DataFrame:
    """(scope, last_date, ys): the series in date order, one value per day."""
    packed = series.groupBy("scope").agg(
        F.sort_array(F.collect_list(F.struct("date", F.col("y").cast("double").alias("y"))))
        .alias("s"))
    return packed.select(
        "scope", F.element_at("s", -1)["date"].alias("last_date"),
        F.transform("s", lambda r: r["y"]).alias("ys"))


def _steps(df: DataFrame, values: Column, model: str) -> DataFrame:
    """One row per step from an array of forecasts."""
    return df.select("scope", "last_date", F.posexplode(values).alias("i", "yhat")).select(
        "scope", F.lit(model).alias("model"), (F.col("i") + 1).cast("int").alias("step"),
        F.date_add("last_date", F.col("i") + 1).alias("date"),
        F.col("yhat").cast("double").alias("yhat"))


def forecast_naive(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The last week repeated."""
    arrays = _as_arrays(series)
    week = F.slice("ys", -S.SEASON, S.SEASON)
    held = arrays.filter(F.size("ys") >= S.SEASON).withColumn("week", week)
    return _steps(held, F.transform(
        F.sequence(F.lit(0), F.lit(horizon - 1)),
        lambda i: F.get("week", i % S.SEASON)), "naive")


def forecast_ets(series: DataFrame, horizon: int = HORIZON,
                 grid: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """Additive trend and additive weekly season.

    Level, trend and season start from the first two weeks. The smoothing weights are those
    of the grid with the least squared one-step error; every (scope, weights) pair is a row
    of its own, so the search is spread over the executors. Needs two weeks of data.
    """
    m = S.SEASON
    weights = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"),
                 F.lit(g).alias("g"))
        for i, (a, b, g) in enumerate(grid or SMOOTHING_GRID)])
    arrays = _as_arrays(series).filter(F.size("ys") >= 2 * m).withColumn(
        "ys", F.transform("ys", lambda y: F.greatest(y, F.lit(0.0)) + F.lit(1e-6)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
    first, second = F.slice("ys", 1, m), F.slice("ys", m + 1, m)
    started = arrays.withColumns({
        "level0": total(first) / m,
        "trend0": (total(second) / m - total(first) / m) / m,
    }).withColumn("season0", F.transform(first, lambda y: y - F.col("level0"))).withColumn(
        "w", F.explode(weights))
    state = F.struct(F.col("level0").alias("l"), F.col("trend0").alias("t"),
                     F.col("season0").alias("s"), F.lit(0.0).alias("sse"))

    def step(st: Column, y: Column) -> Column:
        w, s0 = F.col("w"), F.get(st["s"], F.lit(0))
        error = y - (st["l"] + st["t"] + s0)
        level = w["a"] * (y - s0) + (F.lit(1.0) - w["a"]) * (st["l"] + st["t"])
        trend = w["b"] * (level - st["l"]) + (F.lit(1.0) - w["b"]) * st["t"]
        season = w["g"] * (y - level) + (F.lit(1.0) - w["g"]) * s0
        return F.struct(level.alias("l"), trend.alias("t"),
                        F.concat(F.slice(st["s"], 2, m - 1), F.array(season)).alias("s"),
                        (st["sse"] + error * error).alias("sse"))

    fitted = started.withColumn("fit", F.aggregate("ys", state, step))
    best = fitted.groupBy("scope", "last_date").agg(
        F.min_by("fit", F.struct("fit.sse", "w.i")).alias("fit"))
    values = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda h: F.greatest(F.lit(0.0), F.col("fit.l") + F.col("fit.t") * h
                             + F.get(F.col("fit.s"), (h - 1) % m)))
    return _steps(best, values, "ets")


GBT_FEATURES = ["dow", "day", "month", "is_weekend", "weekofyear",
                *[f"lag_{n}" for n in S.LAGS], "roll7", "scope_index"]


def fit_gbt(series: DataFrame, **params) -> PipelineModel | None:
    """One boosted model for all scopes together, the scope being a feature."""
    data = cut(supervised_frame(series))
    if data.limit(S.MIN_TRAIN_ROWS).count() < S.MIN_TRAIN_ROWS:
        return None
    indexer = StringIndexer(inputCol="scope", outputCol="scope_index", handleInvalid="keep")
    assembler = VectorAssembler(inputCols=GBT_FEATURES, outputCol="features")
    options = {**GBT_DEFAULTS, **params}
    model = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="yhat",
                         seed=S.SEED, maxMemoryInMB=512, **options)
    indexed = indexer.fit(data)
    ready = assembler.transform(indexed.transform(data)).select("features", "y").cache()
    try:
        return PipelineModel([indexed, assembler, model.fit(ready)])
    finally:
        ready.unpersist()


def forecast_gbt(series: DataFrame, horizon: int = HORIZON, cut_every: int = 5,
                 **params) -> DataFrame:
    """Recursive forecast: every round predicts one day for all scopes from their last days."""
    model = fit_gbt(series, **params)
    longest = max(S.LAGS)
    state = _as_arrays(series).select(
        "scope", "last_date", F.aggregate("ys", F.lit(0.0), lambda s, y: s + y).alias("total"),
        F.size("ys").alias("n"), F.slice("ys", -F.least(F.size("ys"), F.lit(longest)),
                                         F.lit(longest)).alias("recent"),
        F.expr("CAST(array() AS ARRAY<DOUBLE>)").alias("out"))
    if model is None:
        return _steps(state, F.col("out"), "gbt").limit(0)
    for h in range(1, horizon + 1):
        mean = F.col("total") / F.col("n")
        lag = {f"lag_{k}": F.when(F.size("recent") >= k, F.element_at(
            F.col("recent"), -k)).otherwise(mean) for k in S.LAGS}
        week = F.slice("recent", -S.SEASON, S.SEASON)
        roll = F.when(F.size("recent") >= S.SEASON, F.aggregate(
            week, F.lit(0.0), lambda s, y: s + y) / S.SEASON).otherwise(mean)
        rows = state.withColumns({
            **calendar(F.date_add("last_date", h)),
            **{k: F.when(F.size("recent") == 0, F.lit(0.0)).otherwise(v) for k, v in lag.items()},
            "roll7": roll})
        predicted = model.transform(rows).withColumn("yhat", F.greatest(F.lit(0.0), "yhat"))
        grown = F.concat("recent", F.array("yhat"))
        state = predicted.select(
            "scope", "last_date", (F.col("total") + F.col("yhat")).alias("total"),
            (F.col("n") + 1).alias("n"),
            F.slice(grown, F.greatest(F.size(grown) - longest + 1, F.lit(1)),
                    F.lit(longest)).alias("recent"),
            F.concat("out", F.array("yhat")).alias("out"))
        if h % cut_every == 0:
            state = cut(state)
    return _steps(state, F.col("out"), "gbt")


MODELS = {"naive": forecast_naive, "ets": forecast_ets, "gbt": forecast_gbt}


def run_models(series: DataFrame, models: list[str], horizon: int = HORIZON,
               options: dict | None = None) -> DataFrame:
    options = options or {}
    return reduce(DataFrame.unionByName, [
        MODELS[m](series, horizon, **options.get(m, {})) for m in models])


def backtest(series: DataFrame, models: list[str], options: dict | None = None) -> DataFrame:
    """Held-out days with the forecast of each model fitted on the days before them."""
    split = backtest_split(series)
    predicted = run_models(training_part(split), models, S.TEST_DAYS, options)
    actual = split.filter(F.col("step").isNotNull()).select("scope", "date", "step", "y")
    return actual.join(predicted.select("scope", "step", "model", "yhat"), ["scope", "step"])


def forecast_metrics(tested: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE (days with incidents only) per scope and model."""
    error = F.col("y") - F.col("yhat")
    return tested.groupBy("scope", "model").agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.when(F.col("y") > 0, F.abs(error / F.col("y")))) * 100).alias("mape"))


def best_models(metrics: DataFrame) -> DataFrame:
    """(scope, model, rmse) with the lowest error; nearly equal errors go to the first name."""
    return metrics.groupBy("scope").agg(
        F.min(F.struct(C.half_even(F.col("mae"), 6).alias("mae"), "model", "rmse"))
        .alias("b")).select("scope", "b.model", "b.rmse")


def forecasts(series: DataFrame, metrics: DataFrame, models: list[str],
              options: dict | None = None) -> DataFrame:
    """30-day forecast of each scope by its best model, refitted on the whole series."""
    chosen = best_models(metrics)
    ahead = run_models(series, models, HORIZON, options).join(chosen, ["scope", "model"])
    width = F.col("rmse") * S.INTERVAL_Z
    return ahead.select(
        "scope", "date", "model", "step",
        C.half_even(F.col("yhat"), 2).alias("yhat"),
        C.half_even(F.greatest(F.lit(0.0), F.col("yhat") - width), 2).alias("yhat_lower"),
        C.half_even(F.col("yhat") + width, 2).alias("yhat_upper"))


def forecast_summary(ahead: DataFrame) -> DataFrame:
    """Totals of the rounded forecast for the next day, week and month."""
    return ahead.groupBy("scope", F.col("model").alias("best_model")).agg(*[
        (C.fixed_sum(F.when(F.col("step") <= days, F.col("yhat")), 2) / 100).alias(name)
        for name, days in S.HORIZONS.items()])


def forecast_of(ahead: DataFrame, totals: DataFrame, scope: str) -> DataFrame:
    """The forecast of one scope with its totals; an unknown scope is an error."""
    found = ahead.filter(F.col("scope") == scope)
    if found.isEmpty():
        near = [r[0] for r in totals.select("scope").distinct().orderBy(
            F.levenshtein("scope", F.lit(scope)), "scope").limit(5).collect()]
        raise KeyError(f"no forecast for scope '{scope}' among "
                       f"{totals.select('scope').distinct().count()}; nearest names: {near}")
    return found.join(totals, "scope", "left").drop("model", "step")


def run_forecasts(df: DataFrame, models: list[str] | None = None,
                  top_scopes: int | None = S.TOP_SCOPES,
                  options: dict | None = None) -> dict[str, DataFrame]:
    """All forecast tables: history, metrics, forecasts, summary."""
    models = models or list(MODELS)
    series = cut(forecast_series(df, top_scopes=top_scopes))
    metrics = cut(forecast_metrics(backtest(series, models, options)))
    ahead = cut(forecasts(series, metrics, models, options))
    return {"history": series, "metrics": metrics, "forecasts": ahead,
            "summary": forecast_summary(ahead)}
