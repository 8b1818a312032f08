"""Scoring of incidents and requests, batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C
from curbsight.learning import forest
from curbsight.operators.features import day_segment, geo_features, severity_features

# Used only where a request has no time, corridor or cell of its own.
FALLBACK = {"dayofweek": 2, "month": 1, "corridor_load_norm": 0.3, "cell_repeat_count": 1}
REQUEST_SCHEMA = (
    "id string, event_cause string, corridor string, zone string, veh_type string, "
    "event_type string, status string, hour int, latitude double, longitude double")


def align(df: DataFrame, names: list[str]) -> DataFrame:
    """Give ``df`` every feature a model asks for; missing ones are null."""
    absent = {c: F.lit(None).cast("string" if c in S.CATEGORICAL_FEATURES else "double")
              for c in names if c not in df.columns}
    numbers = {c: F.col(c).cast("double") for c in names
               if c in S.NUMERIC_FEATURES and c in df.columns}
    return df.withColumns({**absent, **numbers}) if absent or numbers else df


def score(df: DataFrame, runs: dict[str, dict]) -> DataFrame:
    """Adds ``<task>_proba``, ``_pred`` and ``_label`` (or ``_pred`` in hours) per trained task.

    The models see a copy of the features; the columns of ``df`` come out unchanged.
    """
    own = df.columns
    for task, run in runs.items():
        names = run["features"]
        kept = F.struct(*df.columns)
        view = align(df.select(kept.alias("_row"), *[c for c in names if c in df.columns]), names)
        out = forest.with_score(run["model"], view, ["_row"], "_score")
        if S.TASKS[task]["kind"] == "classification":
            p = F.col("_score")
            hit = p >= F.lit(float(run["threshold"]))
            added = [C.half_even(p, 4).alias(f"{task}_proba"), hit.cast("int").alias(f"{task}_pred"),
                     F.when(hit, S.TASKS[task]["positive"]).otherwise("other")
                     .alias(f"{task}_label")]
        else:
            added = [C.half_even(F.col("_score"), 2).alias(f"{task}_pred")]
        df = out.select("_row.*", *added)
    return df.select(*own, *[c for c in df.columns if c not in own])


def validate_requests(requests: DataFrame) -> DataFrame:
    """Fill defaults and add ``accepted`` and ``reason`` (the failed conditions)."""
    filled = requests.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) for c, v in S.REQUEST_DEFAULTS.items()
        if c in requests.columns})
    absent = {c: F.lit(v) for c, v in S.REQUEST_DEFAULTS.items() if c not in requests.columns}
    filled = filled.withColumns(absent) if absent else filled
    box = S.BBOX
    reason = F.concat_ws(
        "; ",
        F.when(F.col("event_cause").isNull(), "event_cause missing"),
        F.when(~F.col("hour").between(0, 23), "hour out of range"),
        F.when(~F.col("latitude").between(box["lat_min"], box["lat_max"]), "latitude out of range"),
        F.when(~F.col("longitude").between(box["lon_min"], box["lon_max"]),
               "longitude out of range"))
    return filled.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


def corridor_loads(features: DataFrame) -> DataFrame:
    return features.groupBy("corridor").agg(F.max("corridor_load_norm").alias("corridor_load_norm"))


def cell_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("geo_cell").agg(F.max("cell_repeat_count").alias("cell_repeat_count"))


def enrich_requests(accepted: DataFrame, loads: DataFrame, cells: DataFrame) -> DataFrame:
    """Model features of accepted requests from their own hour, place, cause and the current
    corridor and cell counts."""
    hour = F.col("hour")
    if "start_datetime" in accepted.columns:
        local = C.local_time(F.col("start_datetime"))
        day = F.coalesce(F.weekday(local), F.lit(FALLBACK["dayofweek"]))
        month = F.coalesce(F.month(local), F.lit(FALLBACK["month"]))
    else:
        day, month = F.lit(FALLBACK["dayofweek"]), F.lit(FALLBACK["month"])
    rows = accepted.withColumns({
        "gba_identifier": F.lit(S.UNKNOWN), "dayofweek": day.cast("int"), "month": month.cast("int"),
        "is_weekend": (day >= 5).cast("int"), "is_rush_hour": hour.isin(S.RUSH_HOURS).cast("int"),
        "day_segment": day_segment(hour), "is_segment_event": F.lit(0),
        "hour_sin": F.sin(hour * (2 * F.pi()) / 24), "hour_cos": F.cos(hour * (2 * F.pi()) / 24),
        "dow_sin": F.sin(day * (2 * F.pi()) / 7), "dow_cos": F.cos(day * (2 * F.pi()) / 7),
    }).transform(geo_features).transform(severity_features)
    return (
        rows.join(loads, "corridor", "left").join(cells, "geo_cell", "left").fillna({
            "corridor_load_norm": FALLBACK["corridor_load_norm"],
            "cell_repeat_count": FALLBACK["cell_repeat_count"]})
    )


def respond(scored: DataFrame, runs: dict[str, dict]) -> DataFrame:
    """(id, response): label and probability per task, hours to one decimal, model names."""
    def part(task: str) -> Column:
        if task == "resolution":
            return F.struct(C.half_even(F.col("resolution_pred"), 1).alias("value"),
                            F.lit("hours").alias("unit"))
        label = F.col(f"{task}_label")
        if task == "closure":
            label = F.when(F.col("closure_pred") == 1, "required").otherwise("not_required")
        return F.struct(label.alias("label"), F.col(f"{task}_proba").alias("probability"))

    versions = F.struct(*[F.lit(r["best_model"]).alias(t) for t, r in runs.items()])
    return scored.select("id", F.struct(
        *[part(t).alias(t) for t in runs], versions.alias("model_versions")).alias("response"))


def what_if(df: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Each row under each scenario: overrides of cause, corridor, vehicle type and hour.

    The scenarios are a short list given by the caller; ``scenario`` is their position.
    """
    def one(i: int, s: dict) -> Column:
        return F.struct(
            F.lit(i).alias("scenario"),
            *[(F.lit(s[c]) if c in s else F.col(c)).alias(c)
              for c in ("event_cause", "corridor", "veh_type")],
            (F.lit(s["hour"]) if "hour" in s else F.col("hour")).cast("int").alias("hour"))

    changed = ["event_cause", "corridor", "veh_type", "hour"]
    rest = [c for c in df.columns if c not in changed and c != "is_rush_hour"]
    return df.select(
        *rest, F.explode(F.array(*[one(i, s) for i, s in enumerate(scenarios)])).alias("o")
    ).select(*rest, "o.*").withColumn(
        "is_rush_hour", F.col("hour").isin(S.RUSH_HOURS).cast("int"))
