"""Incident view over the ``events`` table.

The view turns the plain event log into a raw incident log with the usual dirt: mixed
case causes, missing zones, zero and outside coordinates, wrong end times and repeated
reports. It spans 150 local days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-04-30 00:00:00"


def as_of_column(as_of: str = AS_OF):
    return F.lit(as_of).cast("timestamp_ntz")


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def incident_view(events: DataFrame) -> DataFrame:
    """Raw incidents, one row per report, with the input order in ``ordinal``."""
    parsed = events.selectExpr(
        "event_id", "user_id", "event_type AS kind", "value",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        "timestampadd(SECOND, 5 * CAST(floor(CAST(CAST(ts - timestamp_ntz'2024-01-01 00:00:00'"
        " AS INTERVAL SECOND) AS DECIMAL(20, 6))) AS BIGINT), timestamp_ntz'2023-11-10 00:00:00')"
        " AS t",
    )
    # The parsed values travel through the generator: a filter on a derived column then
    # stays above it and reads them, instead of repeating the JSON parsing per reference.
    copies = parsed.selectExpr(
        "event_id", "user_id", "kind", "value",
        "inline(transform(IF(event_id % 97 = 0, array(0L, 1L), array(0L)),"
        " d -> named_struct('dup', d, 'k', k, 't', t)))",
    ).withColumn("u", F.expr("IF(k >= 50, user_id % 30, user_id % 150)"))
    return copies.selectExpr(
        "concat('INC', event_id, IF(dup = 1, 'D', '')) AS id",
        "event_id * 2 + dup AS ordinal",
        "IF(kind = 'signup', 'planned', 'unplanned') AS event_type",
        "CASE WHEN k < 50 THEN 'vehicle_breakdown' WHEN k < 58 THEN 'others'"
        " WHEN k < 66 THEN 'pot_holes' WHEN k < 72 THEN ' Water_Logging'"
        " WHEN k < 78 THEN 'construction' WHEN k < 84 THEN 'accident'"
        " WHEN k < 88 THEN 'tree_fall' WHEN k < 92 THEN 'congestion'"
        " WHEN k < 95 THEN 'road_conditions' WHEN k < 97 THEN 'Debris'"
        " WHEN k < 98 THEN 'Fog / Low Visibility' ELSE 'public_event' END AS event_cause",
        "CASE kind WHEN 'error' THEN 'High' WHEN 'purchase' THEN ' High'"
        " WHEN 'view' THEN NULL ELSE 'Low' END AS priority",
        "IF(k % 13 = 0, 'TRUE', 'false') AS requires_road_closure",
        "CASE WHEN event_id % 8 = 0 THEN 'active' WHEN event_id % 8 <= 3 THEN 'resolved'"
        " ELSE 'closed' END AS status",
        "CASE event_id % 7 WHEN 0 THEN 'heavy_vehicle' WHEN 1 THEN 'bmtc_bus'"
        " WHEN 2 THEN 'lcv' WHEN 3 THEN 'private_car' WHEN 4 THEN 'auto'"
        " WHEN 5 THEN 'truck' END AS veh_type",
        "CASE WHEN event_id % 17 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'Non-corridor'"
        " ELSE concat('Corridor ', user_id % 22) END AS corridor",
        "CASE WHEN event_id % 5 < 3 THEN NULL"
        " ELSE concat('Zone ', (u % 15) div 3 + 5 * (u div 75)) END AS zone",
        "CASE WHEN event_id % 101 = 0 THEN 0.0D WHEN event_id % 211 = 0 THEN 10.0D"
        " ELSE (1275000 + (u % 15) * 3000 + ((event_id * 7919) % 97 - 48) * (1 + k % 5) * 5)"
        " / 100000.0D END AS latitude",
        "CASE WHEN event_id % 101 = 0 THEN 0.0D"
        " ELSE (7740000 + (u div 15) * 3500 + ((event_id * 104729) % 89 - 44) * (1 + k % 5) * 5)"
        " / 100000.0D END AS longitude",
        "CASE WHEN event_id % 6 = 0 THEN 12.9D END AS endlatitude",
        "CASE WHEN event_id % 12 = 0 THEN 77.6D WHEN event_id % 6 = 0 THEN 0.0D END"
        " AS endlongitude",
        "t AS start_datetime",
        "CASE WHEN event_id % 9 = 0 THEN"
        " timestampadd(SECOND, CAST(floor((value - 20) * 600) AS BIGINT), t) END AS end_datetime",
        "CASE WHEN event_id % 8 <> 0 AND event_id % 9 <> 0 THEN"
        " timestampadd(SECOND, CAST(floor(value * 600) AS BIGINT), t) END AS closed_datetime",
    )


def load_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident_view(load_events(spark, sf_dir))
