"""Cleaning: raw incidents -> typed, normalised, imputed, deduplicated incidents.

Timestamps are UTC wall clock (``TIMESTAMP_NTZ``), so no step depends on the session time
zone. "Now" is the argument ``as_of``. Optional columns may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from curbsight import settings as S
from curbsight.functions import columns as C
from curbsight.operators.spatial_fill import fill_from_nearest


def drop_dead_columns(df: DataFrame) -> DataFrame:
    """Drop the configured columns and those without any value (one aggregate)."""
    kept = [c for c in df.columns if c not in S.DROP_COLUMNS]
    if not kept:
        return df.select()
    filled = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in kept]).first()
    return df.select(*[c for c in kept if filled[c]])


def coerce_types(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Text to DOUBLE and UTC timestamps; what does not parse becomes null."""
    out = {}
    for name, kind in df.dtypes:
        if name in S.COORDINATE_COLUMNS and kind != "double":
            out[name] = C.to_number(F.col(name)) if kind == "string" else F.col(name).cast("double")
        elif name in S.DATETIME_COLUMNS and kind == "string":
            out[name] = C.to_utc(F.col(name), formats)
        elif name in S.DATETIME_COLUMNS and kind == "timestamp":
            out[name] = C.ntz_from_micros(F.unix_micros(F.col(name)))
    return df.withColumns(out) if out else df


def _clean_pair(lat: str, lon: str) -> dict[str, Column]:
    y = F.when(F.col(lat) != 0, F.col(lat))
    x = F.when(F.col(lon) != 0, F.col(lon))
    box = S.BBOX
    outside = (
        F.coalesce((y < box["lat_min"]) | (y > box["lat_max"]), F.lit(False))
        | F.coalesce((x < box["lon_min"]) | (x > box["lon_max"]), F.lit(False))
    )
    return {lat: F.when(~outside, y), lon: F.when(~outside, x)}


def fix_geo(df: DataFrame) -> DataFrame:
    """Zero and outside coordinates to null; flag incidents that have an end point."""
    out = {}
    for lat, lon in (("latitude", "longitude"), ("endlatitude", "endlongitude")):
        if lat in df.columns and lon in df.columns:
            out.update(_clean_pair(lat, lon))
    df = df.withColumns(out) if out else df
    if "endlatitude" in df.columns and "endlongitude" in df.columns:
        df = df.withColumn(
            "is_segment_event",
            F.col("endlatitude").isNotNull() & F.col("endlongitude").isNotNull())
    return df


def fix_temporal(df: DataFrame, as_of: Column) -> DataFrame:
    """Drop rows without a start; end times before the start or beyond ``as_of`` + 2 days to null."""
    if "start_datetime" not in df.columns:
        return df
    df = df.filter(F.col("start_datetime").isNotNull())
    if "end_datetime" in df.columns:
        end = F.col("end_datetime")
        late = as_of + F.expr(f"INTERVAL {S.END_GRACE_DAYS} DAYS")
        bad = F.coalesce((end < F.col("start_datetime")) | (end > late), F.lit(False))
        df = df.withColumn("end_datetime", F.when(~bad, end))
    return df


def resolution_micros(df: DataFrame) -> Column | None:
    """Microseconds from start to close (else end), null outside 0..720 hours."""
    finish = [F.col(c) for c in ("closed_datetime", "end_datetime") if c in df.columns]
    if not finish or "start_datetime" not in df.columns:
        return None
    span = C.micros_between(F.col("start_datetime"), F.coalesce(*finish))
    return F.when(span.between(0, S.MAX_RESOLUTION_HOURS * 3_600_000_000), span)


def resolution_hours(df: DataFrame) -> DataFrame:
    span = resolution_micros(df)
    if span is None:
        return df
    return df.withColumn("resolution_hours", span / F.lit(3.6e9))


def normalise_categoricals(df: DataFrame) -> DataFrame:
    """Canonical causes, real booleans, trimmed text."""
    out = {}
    if "event_cause" in df.columns:
        cause = F.col("event_cause")
        pairs = [F.lit(v) for item in S.CAUSE_MAP.items() for v in item]
        mapped = F.coalesce(F.try_element_at(F.create_map(*pairs), cause), cause)
        out["event_cause"] = F.lower(C.strip(mapped))
    if "requires_road_closure" in df.columns:
        word = F.upper(C.strip(F.col("requires_road_closure").cast("string")))
        out["requires_road_closure"] = (
            F.when(word.isin("TRUE", "1"), True).when(word.isin("FALSE", "0"), False))
    for name in S.TRIM_COLUMNS:
        if name in df.columns:
            out[name] = C.strip(F.col(name))
    return df.withColumns(out) if out else df


def fill_defaults(df: DataFrame) -> DataFrame:
    """Priority and vehicle type defaults; these come before the spatial fill."""
    fills = {"priority": S.PRIORITY_FILL, "veh_type": S.VEH_TYPE_FILL}
    fills = {c: v for c, v in fills.items() if c in df.columns}
    return df.fillna(fills) if fills else df


def fill_unknown(df: DataFrame) -> DataFrame:
    """What is still missing in a categorical column becomes ``unknown``."""
    names = [c for c in S.CATEGORICAL_COLUMNS if c in df.columns]
    return df.fillna(S.UNKNOWN, subset=names) if names else df


def spatial_impute(df: DataFrame) -> DataFrame:
    """Area names from the nearest incident that has one (exact, haversine)."""
    fields = [c for c in S.SPATIAL_FILL_FIELDS if c in df.columns]
    return fill_from_nearest(df, fields)


def dedupe(df: DataFrame) -> DataFrame:
    """First report in input order per (place, start, cause); nulls count as equal.

    ``row_number() = 1`` puts a group limit below the shuffle, so each map task sends at
    most one row per key however many copies a key has.
    """
    key = [c for c in S.DEDUPE_KEY if c in df.columns]
    first = Window.partitionBy(*key).orderBy("ordinal")
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def prepare(df: DataFrame, as_of: Column, formats: list[str] | None = None) -> DataFrame:
    """All cleaning steps before the spatial fill; one narrow stage, no shuffle."""
    return (
        df.transform(coerce_types, formats)
        .transform(fix_geo)
        .transform(fix_temporal, as_of)
        .transform(resolution_hours)
        .transform(normalise_categoricals)
        .transform(fill_defaults)
    )


def clean(df: DataFrame, as_of: Column, formats: list[str] | None = None) -> DataFrame:
    """The whole cleaning chain, in its fixed order."""
    return (
        df.transform(drop_dead_columns)
        .transform(prepare, as_of, formats)
        .transform(spatial_impute)
        .transform(fill_unknown)
        .transform(dedupe)
    )
