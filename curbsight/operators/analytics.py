"""Filters, key figures, group counts and top lists over the feature table.

Each function is one declarative query; filters and columns reach the Parquet scan, and a
feature table partitioned by date is pruned by the date range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SEGMENTS = ["morning", "afternoon", "evening", "night"]
RECORD_COLUMNS = ["id", "start_datetime", "event_cause", "corridor", "zone", "priority",
                  "status", "risk_score", "veh_type"]
FILTER_COLUMNS = {"corridors": "corridor", "zones": "zone", "causes": "event_cause",
                  "priorities": "priority"}
HEALTH_ORDER = list(S.ROAD_HEALTH_CATEGORIES)


def filtered(df: DataFrame, date_from: str | None = None, date_to: str | None = None,
             **wanted: list[str]) -> DataFrame:
    """Rows that meet all given conditions; an empty list means no condition."""
    if date_from:
        df = df.filter(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.filter(F.col("date") <= F.lit(date_to).cast("date"))
    for name, values in wanted.items():
        if values:
            df = df.filter(F.col(FILTER_COLUMNS[name]).isin(list(values)))
    return df


def filter_options(df: DataFrame) -> DataFrame:
    """(filter, value): what each filter can be set to, from one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("filter"), F.col(c).alias("value"))
                      for k, c in FILTER_COLUMNS.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.*").filter(
        F.col("value").isNotNull()).distinct().orderBy("filter", "value")


def selection_size(df: DataFrame, condition: DataFrame) -> DataFrame:
    """Selected rows out of all rows."""
    return condition.agg(F.count(F.lit(1)).alias("selected")).withColumn(
        "total", df.agg(F.count(F.lit(1))).scalar())


def _kpis() -> list:
    return [
        F.count(F.lit(1)).alias("total_incidents"),
        C.tally(F.col("status") == "active").alias("active"),
        C.tally(F.col("requires_road_closure")).alias("road_closures"),
        C.half_even(C.fixed_mean(F.col("risk_score"), 2), 2).alias("mean_risk_score"),
    ]


def kpi_stats(df: DataFrame) -> DataFrame:
    return df.agg(*_kpis(), F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def kpi_overview(df: DataFrame, zone_health: DataFrame) -> DataFrame:
    mean = zone_health.agg(C.fixed_mean(F.col("health_score"), 1)).scalar()
    return df.agg(*_kpis()).withColumn("city_road_health", C.half_even(mean, 2))


def _counts(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def top_causes(df: DataFrame, k: int = 7) -> DataFrame:
    return _counts(df, "event_cause").orderBy(F.desc("n"), "event_cause").limit(k)


def daily_volume(df: DataFrame, scope: str | None = None) -> DataFrame:
    """Incidents per day as they are, of all areas or of one corridor."""
    if scope is not None and scope != S.CITY_SCOPE:
        df = df.filter(F.col("corridor") == scope)
    return _counts(df, "date").orderBy("date")


def zone_volume(df: DataFrame) -> DataFrame:
    return _counts(df.filter(F.col("zone") != S.UNKNOWN), "zone").orderBy(F.desc("n"), "zone")


def dow_hour_heatmap(df: DataFrame, day_tz: str = "local") -> DataFrame:
    """Weekday by local hour; ``day_tz='utc'`` takes the weekday from the UTC date instead."""
    day = F.weekday("start_datetime") if day_tz == "utc" else F.col("dayofweek")
    counts = df.select("id", "hour", day.cast("int").alias("dow")).groupBy("dow").pivot(
        "hour", list(range(24))).agg(F.count("id"))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return counts.select(
        "dow", F.get(names, F.col("dow")).alias("day"),
        *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in range(24)]).orderBy("dow")


def live_kpis(df: DataFrame) -> DataFrame:
    pct = lambda c: C.half_even(F.avg(c.cast("double")) * 100, 2)
    return df.agg(
        F.count(F.lit(1)).alias("selected"), F.count_distinct("corridor").alias("corridors"),
        pct(F.col("priority") == "High").alias("high_priority_pct"),
        pct(F.col("is_rush_hour")).alias("rush_hour_pct"))


def map_sample(df: DataFrame, size: int = 3000, seed: int = 1) -> DataFrame:
    """Seeded sample that does not depend on the partitioning; a bounded top-n, not a sort."""
    return df.orderBy(C.spread(F.col("id"), seed), "id").limit(size)


def vehicle_mix(df: DataFrame, k: int = 8) -> DataFrame:
    return _counts(df.filter(F.col("veh_type") != S.VEH_TYPE_FILL), "veh_type").orderBy(
        F.desc("n"), "veh_type").limit(k)


def day_segment_counts(df: DataFrame) -> DataFrame:
    """Counts in the order of the day; a segment without incidents has a null count."""
    domain = df.sparkSession.createDataFrame(
        list(enumerate(SEGMENTS)), "position int, day_segment string")
    return domain.join(_counts(df, "day_segment"), "day_segment", "left").select(
        "position", "day_segment", "n").orderBy("position")


def hourly_profile(df: DataFrame) -> DataFrame:
    return _counts(df, "hour").orderBy("hour")


def latest_records(df: DataFrame, k: int = 500) -> DataFrame:
    return df.select(*RECORD_COLUMNS).orderBy(F.desc("start_datetime"), "id").limit(k)


def rhi_category_counts(scores: DataFrame) -> DataFrame:
    """Segments per category in fixed order; a missing category counts 0."""
    domain = scores.sparkSession.createDataFrame(
        list(enumerate(HEALTH_ORDER)), "position int, health_category string")
    return domain.join(_counts(scores, "health_category"), "health_category", "left").select(
        "position", "health_category", F.coalesce("n", F.lit(0)).alias("n")).orderBy("position")


def rhi_worst(scores: DataFrame, k: int = 6) -> DataFrame:
    return scores.orderBy("health_score", "segment").limit(k)


def points_lost_long(scores: DataFrame) -> DataFrame:
    names = [c for c in scores.columns if c.startswith("points_lost_")]
    return scores.select("segment", *names).unpivot(
        "segment", names, "cause", "points_lost").withColumn(
        "cause", F.regexp_replace("cause", "^points_lost_", ""))


def json_records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
