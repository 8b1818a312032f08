"""Feature columns for clean incidents: time, place, severity, risk, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C
from curbsight.functions.lookups import join_by_key
from curbsight.functions.ordered import column_or, quantiles, value_counts

# 1.6 s buckets split the 720 h range into as many buckets as a bucket has microseconds.
DURATION_BUCKET_MICROS = 1_600_000


def temporal_features(df: DataFrame) -> DataFrame:
    """Calendar columns of the local time (Mon = 0, ISO week)."""
    local = C.local_time(F.col("start_datetime"))
    df = df.withColumns({
        "hour": F.hour(local).cast("int"),
        "dayofweek": F.weekday(local).cast("int"),
        "day_name": F.date_format(local.cast("date"), "EEEE"),
        "month": F.month(local).cast("int"),
        "day": F.dayofmonth(local).cast("int"),
        "week": F.weekofyear(local).cast("int"),
        "date": local.cast("date"),
    })
    hour = F.col("hour")
    return df.withColumns({
        "is_weekend": (F.col("dayofweek") >= 5).cast("int"),
        "is_rush_hour": hour.isin(S.RUSH_HOURS).cast("int"),
        "day_segment": day_segment(hour),
    })


def day_segment(hour):
    return (F.when(hour <= 5, "night").when(hour <= 11, "morning").when(hour <= 16, "afternoon")
            .when(hour <= 21, "evening").when(hour <= 24, "night"))


def cyclic_features(df: DataFrame) -> DataFrame:
    hour = F.col("hour") * (2 * F.pi()) / 24
    day = F.col("dayofweek") * (2 * F.pi()) / 7
    return df.withColumns({
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour),
        "dow_sin": F.sin(day), "dow_cos": F.cos(day),
    })


def geo_features(df: DataFrame) -> DataFrame:
    """Distance to the centre, and the 0.001 degree cell as text (null coordinates: ``nan``)."""
    lat, lon = F.col("latitude"), F.col("longitude")
    part = lambda x: F.coalesce(C.half_even(x, 3).cast("string"), F.lit("nan"))
    return df.withColumns({
        "dist_centre_km": C.haversine_km(
            lat, lon, F.lit(S.CITY_CENTRE[0]), F.lit(S.CITY_CENTRE[1])),
        "geo_cell": F.concat_ws("_", part(lat), part(lon)),
    })


def severity_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "cause_severity": C.lookup(
            F.col("event_cause"), S.CAUSE_SEVERITY, S.CAUSE_SEVERITY_DEFAULT),
        "veh_mass": C.lookup(F.col("veh_type"), S.VEH_MASS, S.VEH_MASS_DEFAULT),
    })


def duration_scale(df: DataFrame) -> DataFrame:
    """One row: ``cap`` (P95 of the hours, 1.0 if there are none) and ``fill`` (the clipped
    median, 0.3 if there are none). The median is not divided by the cap."""
    spans = value_counts(
        df.select(F.rint(F.col("resolution_hours") * 3.6e9).cast("long").alias("span")), [], "span")
    found = quantiles(
        spans, [], "span", {"cap": S.DURATION_CAP_QUANTILE, "median": 0.5}, DURATION_BUCKET_MICROS)
    return found.select(
        F.coalesce(F.col("cap") / 3.6e9, F.lit(1.0)).alias("cap"),
        F.coalesce(C.clip(F.col("median") / 3.6e9, 0.0, 1.0), F.lit(S.DURATION_DEFAULT))
        .alias("fill"))


def duration_norm(df: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """Hours as a share of the cap in [0, 1]; missing ones get the median fill.

    ``scale`` may come from another table, as in streaming.
    """
    if "resolution_hours" not in df.columns:
        return df.withColumn("duration_norm", F.lit(S.DURATION_DEFAULT))
    scale = duration_scale(df) if scale is None else scale
    both = scale.select(F.struct("cap", "fill")).scalar()
    return df.withColumn("duration_norm", F.coalesce(
        C.clip(F.try_divide(F.col("resolution_hours"), both["cap"]), 0.0, 1.0), both["fill"]))


def risk_score(df: DataFrame) -> DataFrame:
    """Weighted blend in [0, 100]; a null closure flag gives a null score."""
    w = S.RISK_WEIGHTS
    closure = column_or(df, "requires_road_closure", F.lit(False)).cast("double")
    high = (F.lower(column_or(df, "priority", F.lit("Low"))) == "high").cast("double")
    risk = (
        F.col("cause_severity") * w["severity"] + closure * w["closure"]
        + F.coalesce(high, F.lit(0.0)) * w["priority_high"]
        + F.col("duration_norm") * w["duration"] + F.col("veh_mass") * w["veh_mass"]
    )
    return df.withColumn("risk_score", C.half_even(C.clip(risk * 100, 0.0, 100.0), 2))


def corridor_load(df: DataFrame) -> DataFrame:
    """Incidents per corridor, and the share of the busiest one, on every row.

    The counts are partial per task and written; they also tell which corridors are hot, and
    the join splits those.
    """
    if "corridor" not in df.columns:
        return df
    loads = df.filter(F.col("corridor").isNotNull()).groupBy("corridor").agg(
        F.count("id").alias("corridor_event_load"))
    busiest = loads.agg(F.max("corridor_event_load")).scalar()
    loads = loads.withColumn(
        "corridor_load_norm", C.half_even(F.try_divide("corridor_event_load", busiest), 4))
    return join_by_key(df, loads, "corridor", "corridor_event_load", F.col("id"))


def cell_repeat_count(df: DataFrame) -> DataFrame:
    """Incidents per 0.001 degree cell on every row."""
    cells = df.groupBy("geo_cell").agg(F.count("id").alias("cell_repeat_count"))
    return join_by_key(df, cells, "geo_cell", "cell_repeat_count", F.col("id"))


def row_features(df: DataFrame) -> DataFrame:
    """The features that need nothing but the row itself."""
    return (
        df.transform(temporal_features).transform(cyclic_features)
        .transform(geo_features).transform(severity_features)
    )


def engineer_features(df: DataFrame) -> DataFrame:
    return (
        df.transform(row_features).transform(duration_norm).transform(risk_score)
        .drop("duration_norm").transform(corridor_load).transform(cell_repeat_count)
    )
