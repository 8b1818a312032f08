"""The same results as plain SQL for DuckDB, from the ``events`` view up.

Every statement is a chain of common table expressions, written independently of the Spark
operators: nearest neighbours by comparing all pairs, clusters by recursive reachability,
smoothing by recursion over the days.
"""

from __future__ import annotations

import math

from curbsight import settings as S
from curbsight.operators.forecasting import SMOOTHING_GRID

AS_OF = "TIMESTAMP '2024-04-30 00:00:00'"
CAUSES = list(S.ROAD_HEALTH_WEIGHTS)
PARTS: dict[str, tuple[str, list[str]]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (sql, list(needs))


def chain(sql: str, *needs: str) -> str:
    """The statement with all the expressions it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][1]:
            add(n)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    body = ",\n".join(f"{n} AS ({PARTS[n][0]})" for n in order)
    return f"WITH RECURSIVE {body}\n{sql}"


def _case(column: str, table: dict, default) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CAST(CASE {column} {whens} ELSE {default} END AS DOUBLE)"


def even(x: str, places: int) -> str:
    return f"round_even({x}, {places})"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2)"
            f" + cos(radians({lat1})) * cos(radians({lat2}))"
            f" * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2))")


def scale(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} - {lo} < 1e-12 THEN 0.0::DOUBLE ELSE ({x} - {lo})::DOUBLE / ({hi} - {lo}) END)"


def exact_mean(x: str, places: int) -> str:
    unit = f"1e{places}::DOUBLE"
    return f"(sum(CAST(round_even({x} * {unit}, 0) AS BIGINT))::DOUBLE / count({x}) / {unit})"


# -- incidents ---------------------------------------------------------------------
part("src", """SELECT event_id, user_id, event_type AS kind, value,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 TIMESTAMP '2023-11-10 00:00:00' + to_seconds(5 * date_sub('second', TIMESTAMP '2024-01-01 00:00:00', ts)) AS t
 FROM events""")
part("copies", """SELECT s.*, d.dup, CASE WHEN k >= 50 THEN user_id % 30 ELSE user_id % 150 END AS u
 FROM src s JOIN (VALUES (0), (1)) d(dup) ON d.dup = 0 OR event_id % 97 = 0""", "src")
part("raw", """SELECT 'INC' || event_id || CASE WHEN dup = 1 THEN 'D' ELSE '' END AS id,
 CAST(event_id * 2 + dup AS BIGINT) AS ordinal,
 CASE WHEN kind = 'signup' THEN 'planned' ELSE 'unplanned' END AS event_type,
 CASE WHEN k < 50 THEN 'vehicle_breakdown' WHEN k < 58 THEN 'others' WHEN k < 66 THEN 'pot_holes'
  WHEN k < 72 THEN ' Water_Logging' WHEN k < 78 THEN 'construction' WHEN k < 84 THEN 'accident'
  WHEN k < 88 THEN 'tree_fall' WHEN k < 92 THEN 'congestion' WHEN k < 95 THEN 'road_conditions'
  WHEN k < 97 THEN 'Debris' WHEN k < 98 THEN 'Fog / Low Visibility' ELSE 'public_event' END AS event_cause,
 CASE kind WHEN 'error' THEN 'High' WHEN 'purchase' THEN ' High' WHEN 'view' THEN NULL ELSE 'Low' END AS priority,
 CASE WHEN k % 13 = 0 THEN 'TRUE' ELSE 'false' END AS requires_road_closure,
 CASE WHEN event_id % 8 = 0 THEN 'active' WHEN event_id % 8 <= 3 THEN 'resolved' ELSE 'closed' END AS status,
 CASE event_id % 7 WHEN 0 THEN 'heavy_vehicle' WHEN 1 THEN 'bmtc_bus' WHEN 2 THEN 'lcv'
  WHEN 3 THEN 'private_car' WHEN 4 THEN 'auto' WHEN 5 THEN 'truck' END AS veh_type,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'Non-corridor'
  ELSE 'Corridor ' || (user_id % 22) END AS corridor,
 CASE WHEN event_id % 5 < 3 THEN NULL ELSE 'Zone ' || ((u % 15) // 3 + 5 * (u // 75)) END AS zone,
 CASE WHEN event_id % 101 = 0 THEN 0.0::DOUBLE WHEN event_id % 211 = 0 THEN 10.0::DOUBLE
  ELSE (1275000 + (u % 15) * 3000 + ((event_id * 7919) % 97 - 48) * (1 + k % 5) * 5) / 100000.0::DOUBLE END AS latitude,
 CASE WHEN event_id % 101 = 0 THEN 0.0::DOUBLE
  ELSE (7740000 + (u // 15) * 3500 + ((event_id * 104729) % 89 - 44) * (1 + k % 5) * 5) / 100000.0::DOUBLE END AS longitude,
 CASE WHEN event_id % 6 = 0 THEN 12.9::DOUBLE END AS endlatitude,
 CASE WHEN event_id % 12 = 0 THEN 77.6::DOUBLE WHEN event_id % 6 = 0 THEN 0.0::DOUBLE END AS endlongitude,
 t AS start_datetime,
 CASE WHEN event_id % 9 = 0 THEN t + to_seconds(CAST(floor((value - 20) * 600) AS BIGINT)) END AS end_datetime,
 CASE WHEN event_id % 8 <> 0 AND event_id % 9 <> 0
  THEN t + to_seconds(CAST(floor(value * 600) AS BIGINT)) END AS closed_datetime
 FROM copies""", "copies")

OUTSIDE = ("(coalesce({y} < 12.6 OR {y} > 13.4, false) OR coalesce({x} < 77.2 OR {x} > 77.9, false))")
part("geo0", """SELECT * REPLACE (nullif(latitude, 0) AS latitude, nullif(longitude, 0) AS longitude,
 nullif(endlatitude, 0) AS endlatitude, nullif(endlongitude, 0) AS endlongitude) FROM raw""", "raw")
_out = OUTSIDE.format(y="latitude", x="longitude")
_end = OUTSIDE.format(y="endlatitude", x="endlongitude")
part("geo1", f"""SELECT * REPLACE (
 CASE WHEN NOT {_out} THEN latitude END AS latitude, CASE WHEN NOT {_out} THEN longitude END AS longitude,
 CASE WHEN NOT {_end} THEN endlatitude END AS endlatitude,
 CASE WHEN NOT {_end} THEN endlongitude END AS endlongitude) FROM geo0""", "geo0")
part("geo", """SELECT *, endlatitude IS NOT NULL AND endlongitude IS NOT NULL AS is_segment_event
 FROM geo1""", "geo1")
END_TIME = (f"CASE WHEN NOT coalesce(end_datetime < start_datetime OR end_datetime > {AS_OF}"
            f" + INTERVAL {S.END_GRACE_DAYS} DAY, false) THEN end_datetime END AS end_datetime")
HOURS = ("date_sub('microsecond', start_datetime, coalesce(closed_datetime, end_datetime)) / 3.6e9::DOUBLE")
CAUSE = ("lower(trim(CASE event_cause WHEN 'Debris' THEN 'debris' WHEN 'Fog / Low Visibility' THEN 'fog'"
         " ELSE event_cause END, ' \t\n\r'))")
FLAG = "CASE upper(trim(requires_road_closure)) WHEN 'TRUE' THEN true WHEN '1' THEN true" \
       " WHEN 'FALSE' THEN false WHEN '0' THEN false END"
part("timed", f"SELECT * REPLACE ({END_TIME}) FROM geo WHERE start_datetime IS NOT NULL", "geo")
part("prep", f"""SELECT * REPLACE ({CAUSE} AS event_cause, {FLAG} AS requires_road_closure,
 coalesce(trim(priority), 'Low') AS priority, coalesce(trim(veh_type), 'not_applicable') AS veh_type),
 CASE WHEN {HOURS} BETWEEN 0 AND 720 THEN {HOURS} END AS resolution_hours FROM timed""", "timed")
for _f in ("zone", "corridor"):
    part(f"near_{_f}", f"""SELECT la, lo, arg_min(label, row(h, ordinal)) AS label FROM (
 SELECT la, lo, ordinal, {_f} AS label, {haversine('la', 'lo', 'latitude', 'longitude')} AS h
 FROM (SELECT DISTINCT latitude AS la, longitude AS lo FROM prep WHERE {_f} IS NULL AND latitude IS NOT NULL
  AND longitude IS NOT NULL) q
 CROSS JOIN (SELECT ordinal, latitude, longitude, {_f} FROM prep WHERE {_f} IS NOT NULL
  AND latitude IS NOT NULL AND longitude IS NOT NULL) p) GROUP BY la, lo""", "prep")
part("imputed", """SELECT p.* REPLACE (coalesce(p.zone, z.label) AS zone, coalesce(p.corridor, c.label) AS corridor)
 FROM prep p LEFT JOIN near_zone z ON p.latitude = z.la AND p.longitude = z.lo
 LEFT JOIN near_corridor c ON p.latitude = c.la AND p.longitude = c.lo""",
     "prep", "near_zone", "near_corridor")
FIRST = ("QUALIFY row_number() OVER (PARTITION BY latitude, longitude, start_datetime, event_cause"
         " ORDER BY ordinal) = 1")
part("clean", f"""SELECT * REPLACE (coalesce(zone, 'unknown') AS zone, coalesce(corridor, 'unknown') AS corridor)
 FROM imputed {FIRST}""", "imputed")

# -- features ------------------------------------------------------------------------
part("loads", """SELECT corridor, count(id) AS corridor_event_load FROM clean GROUP BY corridor""", "clean")
part("durations", """SELECT coalesce(quantile_cont(resolution_hours, 0.95), 1.0) AS cap,
 CASE WHEN count(resolution_hours) = 0 THEN 0.3
 ELSE least(greatest(median(resolution_hours), 0), 1) END AS fill FROM clean""", "clean")
part("local", """SELECT *, start_datetime + INTERVAL 330 MINUTE AS lt FROM clean""", "clean")
CELL = (f"coalesce({even('latitude', 3)}::VARCHAR, 'nan') || '_' || coalesce({even('longitude', 3)}::VARCHAR, 'nan')")
part("rowed", f"""SELECT * EXCLUDE (lt), CAST(hour(lt) AS INTEGER) AS hour, CAST(isodow(lt) - 1 AS INTEGER) AS dayofweek,
 dayname(lt) AS day_name, CAST(month(lt) AS INTEGER) AS month, CAST(day(lt) AS INTEGER) AS day,
 CAST(weekofyear(lt) AS INTEGER) AS week, CAST(lt AS DATE) AS date,
 CAST(isodow(lt) >= 6 AS INTEGER) AS is_weekend,
 CAST(hour(lt) IN (8, 9, 10, 18, 19, 20) AS INTEGER) AS is_rush_hour,
 CASE WHEN hour(lt) <= 5 THEN 'night' WHEN hour(lt) <= 11 THEN 'morning' WHEN hour(lt) <= 16 THEN 'afternoon'
  WHEN hour(lt) <= 21 THEN 'evening' ELSE 'night' END AS day_segment,
 6371.0 * 2 * asin(sqrt({haversine('latitude', 'longitude', '12.9716::DOUBLE', '77.5946::DOUBLE')})) AS dist_centre_km,
 {CELL} AS geo_cell,
 {_case('event_cause', S.CAUSE_SEVERITY, S.CAUSE_SEVERITY_DEFAULT)} AS cause_severity,
 {_case('veh_type', S.VEH_MASS, S.VEH_MASS_DEFAULT)} AS veh_mass,
 CASE WHEN resolution_hours IS NULL OR (SELECT cap FROM durations) = 0 THEN (SELECT fill FROM durations)
  ELSE least(greatest(resolution_hours / (SELECT cap FROM durations), 0), 1) END AS duration_norm
 FROM local""", "local", "durations")
RISK = ("cause_severity * 0.40::DOUBLE + CAST(requires_road_closure AS DOUBLE) * 0.20::DOUBLE"
        " + CAST(coalesce(lower(priority) = 'high', false) AS DOUBLE) * 0.15::DOUBLE"
        " + duration_norm * 0.15::DOUBLE + veh_mass * 0.10::DOUBLE")
part("cells", "SELECT geo_cell, count(id) AS cell_repeat_count FROM rowed GROUP BY geo_cell", "rowed")
part("feats", f"""SELECT r.*, {even(f'least(greatest(({RISK}) * 100, 0), 100)', 2)} AS risk_score,
 l.corridor_event_load,
 {even('l.corridor_event_load / (SELECT max(corridor_event_load) FROM loads)', 4)} AS corridor_load_norm,
 c.cell_repeat_count
 FROM rowed r JOIN loads l USING (corridor) JOIN cells c USING (geo_cell)""", "rowed", "loads", "cells")
_angles = ", ".join(
    even(f"{f}(hour * (2 * pi()) / 24)", 4) + f" AS hour_{f}" for f in ("sin", "cos")) + ", " + ", ".join(
    even(f"{f}(dayofweek * (2 * pi()) / 7)", 4) + f" AS dow_{f}" for f in ("sin", "cos"))

FEATURE_COLUMNS = [
    "id", "ordinal", "event_type", "event_cause", "priority", "requires_road_closure", "status",
    "veh_type", "corridor", "zone", "latitude", "longitude", "endlatitude", "endlongitude",
    "start_datetime", "end_datetime", "closed_datetime", "is_segment_event", "resolution_hours",
    "hour", "dayofweek", "day_name", "month", "day", "week", "date", "is_weekend",
    "is_rush_hour", "day_segment", "dist_centre_km", "geo_cell", "cause_severity", "veh_mass",
    "risk_score", "corridor_event_load", "corridor_load_norm", "cell_repeat_count"]
ANGLE_COLUMNS = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]

# -- quality ----------------------------------------------------------------------------
_domain = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value FROM raw WHERE {c} IS NOT NULL" for c in S.DOMAIN_COLUMNS)
part("domain", f"SELECT \"column\", value, count(*) AS n FROM ({_domain}) GROUP BY ALL", "raw")
part("stats", f"""SELECT count(*) AS n, count(*) - count(DISTINCT id)
  - CASE WHEN count(*) > count(id) THEN 1 ELSE 0 END AS duplicates,
 {', '.join(f'count(*) FILTER ({c} IS NULL) AS null_{c}' for c in S.MAX_MISSING_PCT)},
 count(*) FILTER (coalesce(latitude < 12.6 OR latitude > 13.4, true)
  OR coalesce(longitude < 77.2 OR longitude > 77.9, true)) AS outside,
 count(*) FILTER (start_datetime IS NULL) AS unparsed,
 count(*) FILTER (coalesce(start_datetime > {AS_OF}, false)) AS future FROM raw""", "raw")
_checks = [
    "SELECT 'schema.required_columns' AS name, 'OK' AS severity, 'All required columns present.' AS message",
    "SELECT 'volume.min_rows', CASE WHEN n < 1000 THEN 'ERROR' ELSE 'OK' END, CASE WHEN n < 1000"
    " THEN 'Only ' || n || ' rows (< 1000).' ELSE n || ' rows.' END FROM stats",
    "SELECT 'uniqueness.primary_key', CASE WHEN duplicates > 0 THEN 'ERROR' ELSE 'OK' END,"
    " duplicates || ' duplicate ''id'' values.' FROM stats",
    *[f"SELECT 'missing.{c}', CASE WHEN null_{c} * 100.0::DOUBLE / n > {m} THEN 'ERROR' ELSE 'OK' END,"
      f" '{c}: ' || printf('%.2f', null_{c} * 100.0::DOUBLE / n) || '% missing (max {m}%).' FROM stats"
      for c, m in S.MAX_MISSING_PCT.items()],
    "SELECT 'geo.in_bbox', CASE WHEN outside * 100.0::DOUBLE / n >= 5 THEN 'ERROR' WHEN outside > 0 THEN 'WARN'"
    " ELSE 'OK' END, outside || ' (' || printf('%.2f', outside * 100.0::DOUBLE / n)"
    " || '%) primary coords outside city bbox.' FROM stats",
    "SELECT 'temporal.start_datetime', CASE WHEN unparsed > 0 OR future > 0 THEN 'WARN' ELSE 'OK' END,"
    " unparsed || ' unparseable, ' || future || ' future-dated start times.' FROM stats",
    "SELECT 'domain.' || \"column\" || '.cardinality', 'OK', \"column\" || ' has ' || count(*)"
    " || ' distinct values.' FROM domain GROUP BY \"column\""]
part("checks", " UNION ALL ".join(_checks), "stats", "domain")

# -- road health --------------------------------------------------------------------------
part("present", "SELECT " + ", ".join(
    f"coalesce(bool_or(event_cause = '{c}'), false) AS {c}" for c in CAUSES) + " FROM feats", "feats")
_total = " + ".join(
    f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for c, w in S.ROAD_HEALTH_WEIGHTS.items())
part("weights", "SELECT " + ", ".join(
    f"CASE WHEN {c} THEN {w}::DOUBLE / ({_total}) ELSE 0.0::DOUBLE END AS w_{c}, {c} AS has_{c}"
    for c, w in S.ROAD_HEALTH_WEIGHTS.items()) + " FROM present", "present")
_by_cause = ", ".join(f"count(*) FILTER (event_cause = '{c}') AS n_{c}" for c in CAUSES)
part("segments", " UNION ALL ".join(
    f"SELECT '{lv}' AS level, {lv} AS segment, count(id) AS total_events, {_by_cause} FROM feats"
    f" WHERE {lv} IS NOT NULL AND {lv} <> 'unknown' GROUP BY {lv}" for lv in S.ROAD_HEALTH_LEVELS), "feats")


def _contribution(c: str) -> str:
    share = f"n_{c}::DOUBLE / (total_events + 5)"
    over = "OVER (PARTITION BY level)"
    s = scale(f"({share})", f"min({share}) {over}", f"max({share}) {over}")
    v = scale(f"n_{c}", f"min(n_{c}) {over}", f"max(n_{c}) {over}")
    return f"({s} * 0.5::DOUBLE + {v} * 0.5::DOUBLE) * w_{c} AS c_{c}"


part("contributions", "SELECT *, " + ", ".join(_contribution(c) for c in CAUSES)
     + " FROM segments, weights", "segments", "weights")
part("points", "SELECT *, " + ", ".join(even(f"c_{c} * 100", 2) + f" AS points_lost_{c}" for c in CAUSES)
     + ", " + even("least(greatest(" + " + ".join(f"c_{c}" for c in CAUSES) + ", 0), 1)", 4)
     + " AS degradation_index FROM contributions", "contributions")
part("scored", f"SELECT *, {even('(1.0::DOUBLE - degradation_index) * 100', 1)} AS health_score FROM points", "points")
_most = "greatest(" + ", ".join(f"CASE WHEN has_{c} THEN points_lost_{c} END" for c in CAUSES) + ")"
part("health", "SELECT level, segment, total_events, " + ", ".join(
    f"n_{c}, points_lost_{c}" for c in CAUSES) + """, degradation_index, health_score,
 CASE WHEN health_score <= 20 THEN 'Critical' WHEN health_score <= 40 THEN 'Poor' WHEN health_score <= 60
  THEN 'Moderate' WHEN health_score <= 80 THEN 'Good' ELSE 'Excellent' END AS health_category,
 CASE """ + " ".join(f"WHEN has_{c} AND points_lost_{c} = {_most} THEN '{c}'" for c in CAUSES)
     + " END AS top_factor FROM scored", "scored")
part("zone_health", "SELECT * FROM health WHERE level = 'zone'", "health")
part("cell_flags", "SELECT geo_cell, " + ", ".join(
    f"CAST(coalesce(bool_or(event_cause = '{c}'), false) AS BIGINT) AS f_{c}" for c in CAUSES)
     + " FROM feats GROUP BY geo_cell", "feats")
part("flag_sums", "SELECT count(*)::DOUBLE AS n, " + ", ".join(
    f"sum(f_{c})::DOUBLE AS s_{c}, sum(f_{c} * f_accident)::DOUBLE AS b_{c}" for c in CAUSES)
     + " FROM cell_flags", "cell_flags")


def _learned(c: str) -> str:
    if c == "accident":
        return f"CASE WHEN s_{c} > 0 THEN {S.ROAD_HEALTH_WEIGHTS[c]}::DOUBLE ELSE 0 END"
    r = (f"(n * b_{c} - s_{c} * s_accident) / nullif(sqrt((n * s_{c} - s_{c} * s_{c})"
         f" * (n * s_accident - s_accident * s_accident)), 0)")
    return f"CASE WHEN s_{c} > 0 THEN greatest(0, coalesce({r}, 0)) + 0.05::DOUBLE ELSE 0 END"


part("learned", "SELECT *, " + ", ".join(f"{_learned(c)} AS l_{c}" for c in CAUSES) + " FROM flag_sums", "flag_sums")

# -- clusters -------------------------------------------------------------------------------
EPS_TERM = repr(math.sin(S.EPS_METERS / S.EARTH_RADIUS_M / 2) ** 2)
_listed = ", ".join(f"'{c}'" for c in S.HOTSPOT_CAUSES)
part("pts", f"""SELECT layer, ordinal, latitude AS lat, longitude AS lon,
 CAST(floor(latitude / 0.0025) AS BIGINT) AS cy, CAST(floor(longitude / 0.0025) AS BIGINT) AS cx FROM (
 SELECT 'all' AS layer, * FROM feats UNION ALL
 SELECT event_cause AS layer, * FROM feats WHERE event_cause IN ({_listed}))
 WHERE latitude IS NOT NULL AND longitude IS NOT NULL""", "feats")
part("steps", "SELECT y AS sy, x AS sx FROM range(-1, 2) a(y), range(-1, 2) b(x)")
part("near_pairs", f"""SELECT p.layer, p.ordinal AS a, q.ordinal AS b
 FROM (SELECT *, cy + sy AS ny, cx + sx AS nx FROM pts, steps) p
 JOIN pts q ON p.layer = q.layer AND p.ny = q.cy AND p.nx = q.cx
 WHERE {haversine('p.lat', 'p.lon', 'q.lat', 'q.lon')} <= {EPS_TERM}""", "pts", "steps")
part("core", f"SELECT layer, a AS ordinal FROM near_pairs GROUP BY layer, a HAVING count(*) >= {S.MIN_SAMPLES}", "near_pairs")
part("links", """SELECT n.layer, a, b FROM near_pairs n JOIN core c ON n.layer = c.layer AND n.a = c.ordinal
 JOIN core d ON n.layer = d.layer AND n.b = d.ordinal""", "near_pairs", "core")
part("reach", """SELECT layer, ordinal AS root, ordinal AS node FROM core
 UNION SELECT r.layer, r.root, l.b FROM reach r JOIN links l ON r.layer = l.layer AND r.node = l.a AND l.b > r.root""",
     "core", "links")
part("roots", "SELECT layer, node, min(root) AS root FROM reach GROUP BY layer, node", "reach")
part("numbered", """SELECT layer, node, dense_rank() OVER (PARTITION BY layer ORDER BY root) - 1 AS cluster
 FROM roots""", "roots")
part("labels", """SELECT p.layer, p.ordinal, coalesce(min(k.cluster), -1) AS cluster,
 coalesce(bool_or(k.node = p.ordinal), false) AS is_core FROM pts p
 LEFT JOIN near_pairs n ON n.layer = p.layer AND n.a = p.ordinal
 LEFT JOIN numbered k ON k.layer = p.layer AND k.node = n.b GROUP BY p.layer, p.ordinal""",
     "pts", "near_pairs", "numbered")
part("members", "SELECT l.layer, l.cluster, f.* FROM labels l JOIN feats f USING (ordinal) WHERE cluster >= 0", "labels", "feats")


def _mode(column: str, alias: str) -> str:
    return (f"SELECT layer, cluster, arg_min({column}, row(-n, {column})) AS {alias} FROM (SELECT layer, cluster,"
            f" {column}, count(*) AS n FROM members WHERE {column} IS NOT NULL GROUP BY ALL) GROUP BY layer, cluster")


for _c, _a in (("event_cause", "dominant_cause"), ("corridor", "top_corridor"), ("zone", "top_zone")):
    part(_a + "s", _mode(_c, _a), "members")
part("centres", f"""SELECT layer, cluster, count(*) AS incident_count, {exact_mean('latitude', 7)} AS lat0,
 {exact_mean('longitude', 7)} AS lon0, {even(exact_mean('cause_severity', 2), 3)} AS mean_severity
 FROM members GROUP BY layer, cluster""", "members")
part("radii", """SELECT layer, cluster, quantile_cont(6371000.0 * 2 * asin(sqrt(pow(sin(radians(latitude - lat0) / 2), 2)
 + pow(cos(radians(lat0)), 2) * pow(sin(radians(longitude - lon0) / 2), 2))), 0.9) AS radius
 FROM members JOIN centres USING (layer, cluster) GROUP BY layer, cluster""", "members", "centres")
_lay = "OVER (PARTITION BY layer)"
_spot_risk = (scale("incident_count", f"min(incident_count) {_lay}", f"max(incident_count) {_lay}") + " * 0.6::DOUBLE + "
              + scale("mean_severity", f"min(mean_severity) {_lay}", f"max(mean_severity) {_lay}") + " * 0.4::DOUBLE")
part("spots", f"""SELECT layer || '_cluster_' || cluster AS hotspot_id, layer AS cause_filter, 'cluster' AS method,
 {even('lat0', 6)} AS center_lat, {even('lon0', 6)} AS center_lon, incident_count, dominant_cause, mean_severity,
 {even('radius', 1)} AS radius_m, top_corridor, top_zone, {even(f'({_spot_risk}) * 100', 1)} AS risk_score
 FROM centres JOIN radii USING (layer, cluster) JOIN dominant_causes USING (layer, cluster)
 LEFT JOIN top_corridors USING (layer, cluster) LEFT JOIN top_zones USING (layer, cluster)""",
     "centres", "radii", "dominant_causes", "top_corridors", "top_zones")

# -- forecasts ----------------------------------------------------------------------------
part("scoped_all", """SELECT 'CITY' AS scope, date FROM feats
 UNION ALL SELECT corridor, date FROM feats WHERE corridor <> 'unknown'""", "feats")
part("busiest", """SELECT corridor FROM feats WHERE corridor <> 'unknown' GROUP BY corridor
 ORDER BY count(*) DESC, corridor LIMIT 5""", "feats")


def _series(source: str) -> str:
    return f"""SELECT scope, d.date, count(s.date) AS y FROM (
 SELECT scope, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
 FROM {source} GROUP BY scope) d LEFT JOIN {source} s USING (scope, date) GROUP BY scope, d.date"""


part("series_all", _series("scoped_all"), "scoped_all")
part("series", """SELECT * FROM series_all WHERE scope = 'CITY' OR (scope IN (SELECT corridor FROM busiest)
 AND scope IN (SELECT scope FROM series_all WHERE y > 0 GROUP BY scope HAVING count(*) >= 20))""",
     "series_all", "busiest")
part("split", """SELECT *, CASE WHEN back <= test_days THEN test_days - back + 1 END AS step FROM (
 SELECT *, CAST(least(21, greatest(7, n // 4)) AS INTEGER) AS test_days FROM (
 SELECT *, count(*) OVER (PARTITION BY scope) AS n,
 row_number() OVER (PARTITION BY scope ORDER BY date DESC) AS back FROM series))""", "series")
part("inputs", """SELECT 'full' AS run, scope, date, y, row_number() OVER (PARTITION BY scope ORDER BY date) AS t FROM series
 UNION ALL SELECT 'train', scope, date, y, row_number() OVER (PARTITION BY scope ORDER BY date) FROM split
 WHERE step IS NULL""", "series", "split")
part("ends", "SELECT run, scope, max(date) AS last_date, max(t) AS len FROM inputs GROUP BY run, scope", "inputs")
part("naive", """SELECT e.run, e.scope, 'naive' AS model, CAST(h AS INTEGER) AS step,
 CAST(e.last_date + CAST(h AS INTEGER) AS DATE) AS date, CAST(i.y AS DOUBLE) AS yhat
 FROM ends e CROSS JOIN range(1, 31) r(h) JOIN inputs i ON i.run = e.run AND i.scope = e.scope
 AND i.t = e.len - 7 + (h - 1) % 7 + 1 WHERE e.len >= 7""", "ends", "inputs")
part("grid", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)" for i, (a, b, g) in enumerate(SMOOTHING_GRID))
     + ") v(i, wa, wb, wg)")
part("shifted", "SELECT run, scope, t, greatest(y, 0) + 1e-6::DOUBLE AS y FROM inputs", "inputs")
_week = lambda lo: " + ".join(
    f"max(CASE WHEN t = {lo + j} THEN y END)" for j in range(7))
part("starts", f"""SELECT run, scope, (0.0::DOUBLE + {_week(1)}) / 7 AS l0, (0.0::DOUBLE + {_week(8)}) / 7 AS l1,
 {', '.join(f'max(CASE WHEN t = {j + 1} THEN y END) AS y{j}' for j in range(7))}
 FROM shifted GROUP BY run, scope HAVING max(t) >= 14""", "shifted")
part("smooth", f"""SELECT run, scope, i, wa, wb, wg, CAST(0 AS BIGINT) AS t, l0 AS l, (l1 - l0) / 7 AS b,
 {', '.join(f'y{j} - l0 AS s{j}' for j in range(7))}, 0.0::DOUBLE AS sse FROM starts, grid
 UNION ALL SELECT run, scope, i, wa, wb, wg, t, level, wb * (level - l) + (1.0::DOUBLE - wb) * b,
 {', '.join(f's{j}' for j in range(1, 7))}, wg * (y - level) + (1.0::DOUBLE - wg) * s0, sse + e * e FROM (
 SELECT m.*, x.y, x.t AS nt, x.y - (m.l + m.b + m.s0) AS e,
 m.wa * (x.y - m.s0) + (1.0::DOUBLE - m.wa) * (m.l + m.b) AS level
 FROM smooth m JOIN shifted x ON x.run = m.run AND x.scope = m.scope AND x.t = m.t + 1)""", "starts", "grid", "shifted")
PARTS["smooth"] = (PARTS["smooth"][0].replace("wa, wb, wg, t, level", "wa, wb, wg, nt, level"),
                   PARTS["smooth"][1])
part("fits", """SELECT s.* FROM smooth s JOIN ends e ON e.run = s.run AND e.scope = s.scope AND e.len = s.t
 QUALIFY row_number() OVER (PARTITION BY s.run, s.scope ORDER BY sse, i) = 1""", "smooth", "ends")
part("ets", """SELECT f.run, f.scope, 'ets' AS model, CAST(h AS INTEGER) AS step,
 CAST(e.last_date + CAST(h AS INTEGER) AS DATE) AS date, greatest(0.0::DOUBLE, f.l + f.b * h
 + CASE (h - 1) % 7 WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 WHEN 4 THEN s4 WHEN 5 THEN s5
 ELSE s6 END) AS yhat FROM fits f JOIN ends e USING (run, scope) CROSS JOIN range(1, 31) r(h)""", "fits", "ends")
part("predicted", "SELECT * FROM naive UNION ALL SELECT * FROM ets", "naive", "ets")
part("measures", """SELECT scope, model, avg(abs(s.y - p.yhat)) AS mae, sqrt(avg((s.y - p.yhat) * (s.y - p.yhat))) AS rmse,
 avg(CASE WHEN s.y > 0 THEN abs((s.y - p.yhat) / s.y) END) * 100 AS mape
 FROM split s JOIN predicted p USING (scope, step) WHERE s.step IS NOT NULL AND p.run = 'train'
 GROUP BY scope, model""", "split", "predicted")
part("chosen", """SELECT scope, model, rmse FROM measures QUALIFY row_number() OVER (PARTITION BY scope
 ORDER BY round_even(mae, 6), model) = 1""", "measures")
part("ahead", f"""SELECT scope, date, model, step, {even('yhat', 2)} AS yhat,
 {even('greatest(0.0::DOUBLE, yhat - rmse * 1.96::DOUBLE)', 2)} AS yhat_lower,
 {even('yhat + rmse * 1.96::DOUBLE', 2)} AS yhat_upper
 FROM predicted JOIN chosen USING (scope, model) WHERE run = 'full'""", "predicted", "chosen")
part("ahead_totals", "SELECT scope, model AS best_model, " + ", ".join(
    f"sum(CAST(round_even(CASE WHEN step <= {d} THEN yhat END * 100, 0) AS BIGINT))::DOUBLE / 100 AS {n}"
    for n, d in S.HORIZONS.items()) + " FROM ahead GROUP BY scope, model", "ahead")

# -- fleet --------------------------------------------------------------------------------
part("signals", f"""SELECT f.zone, f.total_events, breakdown, accident, congestion, pot_holes, water_logging, risk,
 coalesce(100.0::DOUBLE - h.health_score, 0) AS road_health, coalesce(s.hotspot, 0) AS hotspot FROM (
 SELECT zone, count(id) AS total_events, count(*) FILTER (event_cause = 'vehicle_breakdown') AS breakdown,
 count(*) FILTER (event_cause = 'accident') AS accident, count(*) FILTER (event_cause = 'congestion') AS congestion,
 count(*) FILTER (event_cause = 'pot_holes') AS pot_holes,
 count(*) FILTER (event_cause = 'water_logging') AS water_logging,
 coalesce({exact_mean('risk_score', 2)}, 0) AS risk FROM feats WHERE zone <> 'unknown' GROUP BY zone) f
 LEFT JOIN zone_health h ON h.segment = f.zone
 LEFT JOIN (SELECT top_zone, sum(CAST(round_even(risk_score * 10, 0) AS BIGINT))::DOUBLE / 10 AS hotspot
 FROM spots WHERE cause_filter = 'all' GROUP BY top_zone) s ON s.top_zone = f.zone""", "feats", "zone_health", "spots")


def _demand(resource: str) -> str:
    terms = [f"{scale(d, f'min({d}) OVER ()', f'max({d}) OVER ()')} * {w}::DOUBLE"
             for d, w in S.FLEET_DRIVERS[resource].items()]
    return "0.0::DOUBLE + " + " + ".join(terms)


part("demand", " UNION ALL ".join(
    f"SELECT zone, '{r}' AS resource, {f} AS fleet, {S.FLEET_FLOORS[r]} AS low, {_demand(r)} AS demand FROM signals"
    for r, f in S.FLEET.items()), "signals")
part("quotas", """SELECT *, greatest(0, fleet - low * n) AS rest,
 CASE WHEN total > 0 THEN demand / total * greatest(0, fleet - low * n) ELSE 0.0::DOUBLE END AS quota FROM (
 SELECT *, count(*) OVER (PARTITION BY resource) AS n, sum(demand) OVER (PARTITION BY resource ORDER BY zone
 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM demand)""", "demand")
part("units", """SELECT zone, resource, demand, CAST(floor(quota) + low + remaining // n
 + CASE WHEN place <= remaining % n THEN 1 ELSE 0 END AS BIGINT) AS units FROM (
 SELECT *, CAST(rest - sum(floor(quota)) OVER (PARTITION BY resource) AS BIGINT) AS remaining,
 row_number() OVER (PARTITION BY resource ORDER BY CASE WHEN total > 0 THEN quota - floor(quota) ELSE demand END DESC,
 zone) AS place FROM quotas)""", "quotas")
_wide = ", ".join(f"max(units) FILTER (resource = '{r}') AS {r}, max(demand) FILTER (resource = '{r}') AS raw_{r}"
                  for r in S.FLEET)
_sum = "0.0::DOUBLE + " + " + ".join(f"raw_{r}" for r in S.FLEET)
part("plan0", f"""SELECT w.*, {even(_sum, 3)} AS total_demand, total_events, breakdown, accident,
 {even('risk', 2)} AS risk, {even('road_health', 2)} AS road_health, {even('hotspot', 2)} AS hotspot
 FROM (SELECT zone, {_wide} FROM units GROUP BY zone) w JOIN signals USING (zone)""", "units", "signals")
part("plan", f"""SELECT zone, {', '.join(even(f'raw_{r}', 3) + f' AS demand_{r}, {r}' for r in S.FLEET)}, total_demand,
 CAST(rank() OVER (ORDER BY total_demand DESC) AS INTEGER) AS priority_rank, total_events, breakdown, accident, risk,
 road_health, hotspot, 'Tow ' || tow_trucks || ', Police ' || traffic_police || ', Maint ' || maintenance_teams
 || ' - driven by ' || coalesce(nullif(concat_ws(', ',
 CASE WHEN breakdown > 0 THEN breakdown || ' breakdowns' END, CASE WHEN accident > 0 THEN accident || ' accidents' END,
 CASE WHEN road_health > 50 THEN 'poor road health' END, CASE WHEN hotspot > 0 THEN 'active hotspots' END), ''),
 'baseline coverage') || '.' AS rationale FROM plan0""", "plan0")
part("plan_long", " UNION ALL ".join(
    f"SELECT zone, '{r}' AS resource, {r} AS units FROM plan" for r in S.FLEET), "plan")

# -- measures -----------------------------------------------------------------------------
part("scores", """SELECT id, CAST(lower(priority) = 'high' AS INTEGER) AS label,
 (300 * CAST(lower(priority) = 'high' AS INTEGER) + ((ordinal // 2) * 7919) % 700) / 1000.0::DOUBLE AS score
 FROM clean""", "clean")
part("actuals", "SELECT id, ordinal, least(resolution_hours, 48.0::DOUBLE) AS actual FROM clean WHERE resolution_hours IS NOT NULL", "clean")
part("fitted", """SELECT id, actual, actual * 0.8::DOUBLE + ((ordinal // 2) % 11 - 5) * 0.3::DOUBLE AS predicted
 FROM actuals""", "actuals")
part("levels", """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS idx,
 sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (
 SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scores GROUP BY score)
 WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "scores")
_prec, _rec = "tp::DOUBLE / (tp + fp)", "tp::DOUBLE / p"
part("f1s", f"SELECT score, ({_prec}) * ({_rec}) * 2 / (({_prec}) + ({_rec}) + 1e-9) AS f1 FROM levels", "levels")
part("confusion", """SELECT label, CAST(score >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM scores
 GROUP BY ALL""", "scores")
part("quad", """SELECT coalesce(sum(n) FILTER (label = 1 AND predicted = 1), 0) AS tp,
 coalesce(sum(n) FILTER (label = 0 AND predicted = 1), 0) AS fp,
 coalesce(sum(n) FILTER (label = 1 AND predicted = 0), 0) AS fn,
 coalesce(sum(n) FILTER (label = 0 AND predicted = 0), 0) AS tn FROM confusion""", "confusion")


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


part("rates", "SELECT *, " + ", ".join([
    _ratio("tp", "tp + fp") + " AS p1", _ratio("tp", "tp + fn") + " AS r1",
    _ratio("tn", "tn + fn") + " AS p0", _ratio("tn", "tn + fp") + " AS r0"]) + " FROM quad", "quad")
part("rates2", "SELECT *, coalesce(p1 * r1 * 2 / nullif(p1 + r1, 0), 0) AS f1, coalesce(p0 * r0 * 2"
     " / nullif(p0 + r0, 0), 0) AS f0, tn + fp AS s0, tp + fn AS s1 FROM rates", "rates")
part("corners", """SELECT *, row_number() OVER (ORDER BY score DESC) AS position FROM (
 SELECT *, lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn FROM levels)
 WHERE idx = 1 OR np IS NULL OR np <> pos OR nn <> neg""", "levels")
part("thin", "SELECT greatest(1, (count(*) + 1) // 100) AS step FROM corners", "corners")

# -- requests -------------------------------------------------------------------------------
part("requests", """SELECT id, CASE WHEN ordinal % 50 <> 0 THEN lower(trim(event_cause)) END AS event_cause,
 coalesce(corridor, 'Non-corridor') AS corridor, coalesce(zone, 'unknown') AS zone,
 coalesce(veh_type, 'not_applicable') AS veh_type, event_type, status,
 CAST(coalesce(CASE WHEN ordinal % 40 = 0 THEN 99 WHEN ordinal % 13 <> 0 THEN ordinal % 24 END, 9) AS INTEGER) AS hour,
 CASE WHEN ordinal % 29 <> 0 THEN latitude ELSE 12.9716::DOUBLE END AS latitude,
 CASE WHEN ordinal % 29 <> 0 THEN longitude ELSE 77.5946::DOUBLE END AS longitude FROM raw""", "raw")
part("judged", """SELECT *, concat_ws('; ', CASE WHEN event_cause IS NULL THEN 'event_cause missing' END,
 CASE WHEN hour NOT BETWEEN 0 AND 23 THEN 'hour out of range' END,
 CASE WHEN latitude NOT BETWEEN 12.6 AND 13.4 THEN 'latitude out of range' END,
 CASE WHEN longitude NOT BETWEEN 77.2 AND 77.9 THEN 'longitude out of range' END) AS reason FROM requests""", "requests")

_kpi = f"""count(*) AS total_incidents, count(*) FILTER (status = 'active') AS active,
 count(*) FILTER (requires_road_closure) AS road_closures, {even(exact_mean('risk_score', 2), 2)} AS mean_risk_score"""


def _top(column: str, k: int, where: str = "") -> str:
    return (f"SELECT {column}, count(*) AS n FROM feats {where} GROUP BY {column}"
            f" ORDER BY n DESC, {column} LIMIT {k}")


def _na_tokens() -> str:
    tokens = ", ".join(f"'{t}'" for t in S.NA_TOKENS)
    return (f"SELECT id, CASE WHEN ordinal % 8 >= 6 THEN ' ' || status END AS word, corridor, zone FROM raw"
            f" WHERE 'x' NOT IN ({tokens})")


def statements() -> dict[str, str]:
    """One statement per query that SQL can express."""
    q: dict[str, str] = {}
    # sources and quality
    q["na_tokens"] = chain(_na_tokens(), "raw")
    q["bad_lines"] = chain(
        "SELECT 'incidents' AS _file, count(*) FILTER (ordinal % 50 = 0) AS skipped,"
        " count(*) AS read FROM raw", "raw")
    q["scan_features"] = chain("SELECT id, start_datetime, date, risk_score FROM feats", "feats")
    q["dq_checks"] = chain("SELECT name, severity, message FROM checks", "checks")
    q["dq_domain_top5"] = chain(
        "SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS INTEGER) AS rank"
        " FROM domain QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) <= 5", "domain")
    q["dq_summary"] = chain(
        "SELECT count(*) FILTER (severity = 'ERROR') = 0 AS passed, count(*) FILTER (severity = 'ERROR') AS n_errors,"
        " count(*) AS n_checks FROM checks", "checks")
    q["dq_severity_counts"] = chain("SELECT severity, count(*) AS n FROM checks GROUP BY severity", "checks")
    shares = " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", {even(f'count({c})::DOUBLE / count(*)', 4)} AS completeness FROM feats"
         for c in FEATURE_COLUMNS] + [
            f"SELECT '{c}', {even('count(start_datetime)::DOUBLE / count(*)', 4)} FROM feats"
            for c in ANGLE_COLUMNS])
    q["completeness"] = chain(
        f"SELECT * FROM ({shares}) ORDER BY completeness DESC, \"column\" DESC LIMIT 25", "feats")
    # cleaning
    q["drop_dead_columns"] = chain("SELECT id, status, zone FROM raw", "raw")
    q["coerce_types"] = chain(
        "SELECT id, CASE WHEN ordinal % 20 IN (0, 1, 2) THEN NULL WHEN ordinal % 20 = 4 THEN 12.5::DOUBLE"
        " ELSE latitude END AS latitude, CASE WHEN ordinal % 25 = 0 THEN NULL WHEN ordinal % 25 = 1"
        " THEN start_datetime - INTERVAL 330 MINUTE ELSE start_datetime END AS start_datetime FROM raw", "raw")
    q["fix_geo"] = chain(
        "SELECT id, latitude, longitude, endlatitude, endlongitude, is_segment_event FROM geo", "geo")
    q["fix_temporal"] = chain(
        f"SELECT id, start_datetime, {END_TIME} FROM raw WHERE start_datetime IS NOT NULL", "raw")
    q["resolution_hours"] = chain(
        f"SELECT id, {even('resolution_hours', 4)} AS resolution_hours FROM prep", "prep")
    q["normalise_categoricals"] = chain(
        f"SELECT id, {CAUSE} AS event_cause, {FLAG} AS requires_road_closure, trim(priority) AS priority,"
        " status, zone FROM raw", "raw")
    q["impute_fills"] = chain(
        "SELECT id, coalesce(trim(priority), 'Low') AS priority, coalesce(veh_type, 'not_applicable') AS veh_type,"
        " coalesce(zone, 'unknown') AS zone, coalesce(corridor, 'unknown') AS corridor, event_type FROM raw", "raw")
    q["spatial_impute"] = chain("SELECT id, zone, corridor FROM imputed", "imputed")
    q["dedupe"] = chain(
        f"SELECT id, event_cause, start_datetime FROM (SELECT * REPLACE ({CAUSE} AS event_cause) FROM geo) {FIRST}",
        "geo")
    q["clean"] = chain(
        f"SELECT * EXCLUDE (ordinal) REPLACE ({even('resolution_hours', 4)} AS resolution_hours) FROM clean", "clean")
    # features
    q["temporal_features"] = chain(
        "SELECT id, hour, dayofweek, day_name, month, day, week, date, is_weekend, is_rush_hour, day_segment"
        " FROM rowed", "rowed")
    q["cyclic_features"] = chain(f"SELECT id, {_angles} FROM rowed", "rowed")
    q["dist_centre"] = chain(
        f"SELECT id, {even('dist_centre_km', 4)} AS dist_centre_km FROM rowed", "rowed")
    q["geo_cell"] = chain("SELECT id, geo_cell FROM rowed", "rowed")
    q["severity_lookup"] = chain("SELECT id, cause_severity, veh_mass FROM rowed", "rowed")
    q["duration_norm"] = chain(f"SELECT id, {even('duration_norm', 4)} AS duration_norm FROM rowed", "rowed")
    q["risk_score"] = chain("SELECT id, risk_score FROM feats", "feats")
    q["corridor_load"] = chain(
        "SELECT id, corridor, corridor_event_load, corridor_load_norm FROM feats", "feats")
    q["cell_repeat_count"] = chain("SELECT id, geo_cell, cell_repeat_count FROM feats", "feats")
    q["features"] = chain(
        f"SELECT * EXCLUDE (ordinal, duration_norm) REPLACE ({even('resolution_hours', 4)} AS resolution_hours,"
        f" {even('dist_centre_km', 4)} AS dist_centre_km), {_angles} FROM feats", "feats")
    # road health
    q["rhi_counts"] = chain("SELECT * FROM segments", "segments")
    q["rhi_weights_config"] = chain(" UNION ALL ".join(
        f"SELECT '{c}' AS cause, {even(f'w_{c}', 4)} AS weight FROM weights" for c in CAUSES), "weights")
    total = " + ".join(f"l_{c}" for c in CAUSES)
    q["rhi_weights_data"] = chain(" UNION ALL ".join(
        f"SELECT '{c}' AS cause, {even(f'l_{c} / ({total})', 4)} AS weight FROM learned" for c in CAUSES), "learned")
    q["rhi_zone"] = chain("SELECT * FROM zone_health ORDER BY health_score, segment", "zone_health")
    q["rhi_corridor"] = chain(
        "SELECT * FROM health WHERE level = 'corridor' ORDER BY health_score, segment", "health")
    q["rhi_all_levels"] = chain("SELECT * FROM health", "health")
    q["rhi_summary"] = chain(
        f"SELECT level, count(*) AS segments, {even(exact_mean('health_score', 1), 4)} AS mean_score,"
        " count(*) FILTER (health_category = 'Critical') AS n_critical FROM health GROUP BY level", "health")
    # hotspots
    q["dbscan_labels"] = chain("SELECT id, layer, cluster FROM labels JOIN feats USING (ordinal)", "labels", "feats")
    q["dbscan_core_points"] = chain(
        "SELECT layer, count(*) AS points, count(*) FILTER (is_core) AS core, count(*) FILTER (cluster = -1) AS noise,"
        " count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters FROM labels GROUP BY layer", "labels")
    q["hotspots_all"] = chain(
        "SELECT * FROM spots WHERE cause_filter = 'all' ORDER BY risk_score DESC, hotspot_id", "spots")
    q["hotspots_by_cause"] = chain("SELECT * FROM spots", "spots")
    q["hotspots_top"] = chain(
        "SELECT * FROM spots WHERE cause_filter = 'vehicle_breakdown' ORDER BY risk_score DESC, hotspot_id LIMIT 20",
        "spots")
    q["hotspot_kpis"] = chain(
        "SELECT cause_filter, count(*) AS hotspots, CAST(sum(incident_count) AS BIGINT) AS incidents,"
        " max(risk_score) AS top_risk, max(incident_count) AS largest FROM spots GROUP BY cause_filter", "spots")
    # forecasts
    q["daily_series"] = chain("SELECT * FROM series_all", "series_all")
    q["forecast_scopes"] = chain(
        "SELECT scope, count(*) AS days, CAST(sum(y) AS BIGINT) AS incidents FROM series GROUP BY scope", "series")
    lags = ", ".join(f"lag(y::DOUBLE, {n}) OVER w AS lag_{n}" for n in S.LAGS)
    q["supervised_frame"] = chain(
        f"SELECT * REPLACE ({even('roll7', 4)} AS roll7) FROM (SELECT scope, date, y,"
        " CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(day(date) AS INTEGER) AS day,"
        " CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,"
        f" CAST(weekofyear(date) AS INTEGER) AS weekofyear, {lags},"
        " avg(y) OVER (PARTITION BY scope ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll7"
        " FROM series WINDOW w AS (PARTITION BY scope ORDER BY date)) WHERE lag_14 IS NOT NULL", "series")
    q["backtest_split"] = chain(
        "SELECT scope, date, y, n, test_days, CAST(step AS INTEGER) AS step FROM split", "split")
    for model in ("naive", "ets"):
        q[f"forecast_{model}"] = chain(
            f"SELECT scope, model, step, date, {even('yhat', 2)} AS yhat FROM {model} WHERE run = 'full'", model)
    q["forecast_metrics"] = chain(
        f"SELECT scope, model, {even('mae', 2)} AS mae, {even('rmse', 2)} AS rmse, {even('mape', 2)} AS mape"
        " FROM measures", "measures")
    q["forecasts"] = chain("SELECT * FROM ahead", "ahead")
    q["forecast_summary"] = chain("SELECT * FROM ahead_totals", "ahead_totals")
    q["forecast_by_scope"] = chain(
        "SELECT scope, date, yhat, yhat_lower, yhat_upper, best_model, day, week, month FROM ahead"
        " JOIN ahead_totals USING (scope) WHERE scope = 'CITY'", "ahead", "ahead_totals")
    # fleet
    q["zone_signals"] = chain(
        f"SELECT * REPLACE ({even('risk', 4)} AS risk, {even('road_health', 4)} AS road_health,"
        f" {even('hotspot', 4)} AS hotspot) FROM signals", "signals")
    q["zone_demand"] = chain(f"SELECT zone, resource, {even('demand', 4)} AS demand FROM demand", "demand")
    q["resource_allocation"] = chain("SELECT * FROM plan ORDER BY priority_rank, zone", "plan")
    q["allocation_long"] = chain("SELECT * FROM plan_long", "plan_long")
    fleet = " ".join(f"WHEN '{r}' THEN {n}" for r, n in S.FLEET.items())
    q["allocation_totals"] = chain(
        "SELECT resource, CAST(sum(units) AS BIGINT) AS allocated, count(*) AS zones,"
        f" CAST(CASE resource {fleet} END AS BIGINT) AS fleet FROM plan_long GROUP BY resource", "plan_long")
    # models
    q["ml_label_table"] = chain(
        f"SELECT id, {even('least(greatest(resolution_hours, 0), 48)', 4)} AS label, event_type, zone,"
        " CAST(hour AS DOUBLE) AS hour, CAST(is_segment_event AS DOUBLE) AS is_segment_event, corridor_load_norm,"
        " CAST(cell_repeat_count AS DOUBLE) AS cell_repeat_count FROM feats WHERE resolution_hours IS NOT NULL", "feats")
    q["optimal_threshold"] = chain(
        f"SELECT {even('score', 4)} AS threshold, {even('f1', 4)} AS f1 FROM f1s ORDER BY f1s.f1 DESC, score LIMIT 1",
        "f1s")
    q["clf_metrics"] = chain(
        f"SELECT {even('(tp + tn)::DOUBLE / (tp + fp + fn + tn)', 4)} AS accuracy, {even('p1', 4)} AS precision,"
        f" {even('r1', 4)} AS recall, {even('f1', 4)} AS f1,"
        f" {even('(SELECT sum(neg * (tp - pos / 2.0::DOUBLE)) / max(p * n)::DOUBLE FROM levels)', 4)} AS roc_auc,"
        f" {even(f'(SELECT sum(pos * ({_prec})) / max(p)::DOUBLE FROM levels)', 4)} AS pr_auc,"
        " 0.5::DOUBLE AS threshold FROM rates2", "rates2", "levels")
    q["reg_metrics"] = chain(
        f"SELECT {even('1.0::DOUBLE - avg((actual - predicted) * (actual - predicted)) / var_pop(actual)', 4)} AS r2,"
        f" {even('avg(abs(actual - predicted))', 4)} AS mae,"
        f" {even('sqrt(avg((actual - predicted) * (actual - predicted)))', 4)} AS rmse FROM fitted", "fitted")
    q["confusion_matrix"] = chain("SELECT * FROM confusion", "confusion")
    rows = [("0", "p0", "r0", "f0", "s0"), ("1", "p1", "r1", "f1", "s1"),
            ("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "s0 + s1")]
    rows.append(("weighted avg", *[f"({m}0 * s0 + {m}1 * s1) / (s0 + s1)" for m in "prf"], "s0 + s1"))
    q["class_report"] = chain(" UNION ALL ".join(
        f"SELECT '{n}' AS class, {even(p, 4)} AS precision, {even(r, 4)} AS recall, {even(f, 4)} AS f1,"
        f" CAST({s} AS BIGINT) AS support FROM rates2" for n, p, r, f, s in rows), "rates2")
    q["roc_curve"] = chain(
        f"SELECT position, {even('fpr', 4)} AS fpr, {even('tpr', 4)} AS tpr FROM (SELECT CAST(0 AS BIGINT) AS position,"
        " 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT position, fp::DOUBLE / n, tp::DOUBLE / p"
        " FROM corners) WHERE position % (SELECT step FROM thin) = 0", "corners", "thin")
    q["pr_curve"] = chain(
        f"SELECT position, {even('precision', 4)} AS precision, {even('recall', 4)} AS recall FROM ("
        f" SELECT (SELECT count(*) FROM levels) - idx AS position, {_prec} AS precision, {_rec} AS recall FROM levels"
        " UNION ALL SELECT count(*), 1.0::DOUBLE, 0.0::DOUBLE FROM levels)"
        " WHERE position % (SELECT step FROM thin) = 0", "levels", "thin")
    q["residual_stats"] = chain(
        f"SELECT {even('avg(actual - predicted)', 4)} AS mean, {even('stddev_pop(actual - predicted)', 4)} AS std,"
        " count(*) AS n FROM fitted", "fitted")
    q["validate_requests"] = chain("SELECT *, reason = '' AS accepted FROM judged", "judged")
    q["enrich_requests"] = chain(
        "SELECT id, hour, CAST(hour IN (8, 9, 10, 18, 19, 20) AS INTEGER) AS is_rush_hour,"
        " CASE WHEN hour <= 5 THEN 'night' WHEN hour <= 11 THEN 'morning' WHEN hour <= 16 THEN 'afternoon'"
        " WHEN hour <= 21 THEN 'evening' ELSE 'night' END AS day_segment, geo_cell,"
        f" {_case('event_cause', S.CAUSE_SEVERITY, S.CAUSE_SEVERITY_DEFAULT)} AS cause_severity,"
        f" {_case('veh_type', S.VEH_MASS, S.VEH_MASS_DEFAULT)} AS veh_mass,"
        " coalesce(l.corridor_load_norm, 0.3::DOUBLE) AS corridor_load_norm,"
        " coalesce(c.cell_repeat_count, 1) AS cell_repeat_count,"
        f" {even('sin(hour * (2 * pi()) / 24)', 4)} AS hour_sin, {even('cos(hour * (2 * pi()) / 24)', 4)} AS hour_cos,"
        f" {even('6371.0 * 2 * asin(sqrt(' + haversine('latitude', 'longitude', '12.9716::DOUBLE', '77.5946::DOUBLE') + '))', 4)}"
        f" AS dist_centre_km FROM (SELECT *, {CELL} AS geo_cell FROM judged WHERE reason = '') r"
        " LEFT JOIN (SELECT corridor, max(corridor_load_norm) AS corridor_load_norm FROM feats GROUP BY corridor) l"
        " USING (corridor) LEFT JOIN cells c USING (geo_cell)", "judged", "feats", "cells")
    # analytics
    q["filtered_events"] = chain(
        "SELECT id, event_cause, zone, corridor, risk_score, date FROM feats WHERE date BETWEEN DATE '2023-12-01'"
        " AND DATE '2024-02-29' AND event_cause IN ('accident', 'pot_holes') AND priority = 'High'", "feats")
    q["selection_size"] = chain(
        "SELECT count(*) FILTER (date >= DATE '2023-12-01' AND corridor = 'Corridor 1') AS selected,"
        " count(*) AS total FROM feats", "feats")
    options = {"corridors": "corridor", "zones": "zone", "causes": "event_cause", "priorities": "priority"}
    q["filter_options"] = chain(" UNION ".join(
        f"SELECT '{k}' AS filter, {c} AS value FROM feats" for k, c in options.items()), "feats")
    q["kpi_stats"] = chain(f"SELECT {_kpi}, min(date) AS date_min, max(date) AS date_max FROM feats", "feats")
    q["kpi_overview"] = chain(
        f"SELECT {_kpi}, (SELECT {even(exact_mean('health_score', 1), 2)} FROM zone_health) AS city_road_health"
        " FROM feats", "feats", "zone_health")
    q["top_causes"] = chain(_top("event_cause", 7), "feats")
    q["daily_volume"] = chain("SELECT date, count(*) AS n FROM feats GROUP BY date", "feats")
    q["zone_volume"] = chain(
        "SELECT zone, count(*) AS n FROM feats WHERE zone <> 'unknown' GROUP BY zone", "feats")
    hours = ", ".join(f"count(*) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))
    q["dow_hour_heatmap"] = chain(
        f"SELECT dayofweek AS dow, day_name AS day, {hours} FROM feats GROUP BY dayofweek, day_name", "feats")
    q["live_kpis"] = chain(
        f"SELECT count(*) AS selected, count(DISTINCT corridor) AS corridors,"
        f" {even('avg(CAST(priority = $$High$$ AS DOUBLE)) * 100', 2)} AS high_priority_pct,"
        f" {even('avg(is_rush_hour::DOUBLE) * 100', 2)} AS rush_hour_pct FROM feats", "feats")
    q["vehicle_mix"] = chain(_top("veh_type", 8, "WHERE veh_type <> 'not_applicable'"), "feats")
    q["day_segment_counts"] = chain(
        "SELECT position, d.day_segment, n FROM (VALUES (0, 'morning'), (1, 'afternoon'), (2, 'evening'), (3, 'night'))"
        " d(position, day_segment) LEFT JOIN (SELECT day_segment, count(*) AS n FROM feats GROUP BY day_segment) c"
        " ON c.day_segment = d.day_segment", "feats")
    q["hourly_profile"] = chain("SELECT hour, count(*) AS n FROM feats GROUP BY hour", "feats")
    q["latest_records"] = chain(
        "SELECT id, start_datetime, event_cause, corridor, zone, priority, status, risk_score, veh_type FROM feats"
        " ORDER BY start_datetime DESC, id LIMIT 500", "feats")
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(S.ROAD_HEALTH_CATEGORIES))
    q["rhi_category_counts"] = chain(
        f"SELECT position, v.health_category, coalesce(n, 0) AS n FROM (VALUES {names}) v(position, health_category)"
        " LEFT JOIN (SELECT health_category, count(*) AS n FROM zone_health GROUP BY health_category) c"
        " ON c.health_category = v.health_category", "zone_health")
    q["rhi_worst"] = chain(
        "SELECT segment, health_score, health_category, top_factor FROM zone_health ORDER BY health_score, segment"
        " LIMIT 6", "zone_health")
    q["points_lost_long"] = chain(" UNION ALL ".join(
        f"SELECT segment, '{c}' AS cause, points_lost_{c} AS points_lost FROM zone_health" for c in CAUSES), "zone_health")
    # streams
    q["stream_dedupe"] = chain(
        "SELECT latitude, longitude, start_datetime, event_cause, min_by(id, ordinal) AS id FROM prep GROUP BY ALL", "prep")
    q["stream_daily_counts"] = chain(
        "SELECT CAST(start_datetime + INTERVAL 330 MINUTE AS DATE) AS date, event_cause, count(*) AS n FROM prep GROUP BY ALL", "prep")
    q["stream_quarantine"] = chain("SELECT id, reason FROM judged WHERE reason <> ''", "judged")
    # files
    q["ingest_manifest"] = chain(
        "SELECT count(*) AS n_rows, CAST(16 AS BIGINT) AS n_cols, 'id,event_type,event_cause,priority,"
        "requires_road_closure,status,veh_type,corridor,zone,latitude,longitude,endlatitude,endlongitude,"
        "start_datetime,end_datetime,closed_datetime' AS columns FROM raw", "raw")
    word = ", ".join(
        f"sum(CAST('0x' || substr(h, {1 + i * 15}, 15) AS BIGINT)) AS w{i}" for i in range(4))
    q["file_fingerprint"] = f"""
WITH t AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, translate(text, chr(10) || chr(13), '  ') AS line FROM documents),
h AS (SELECT sha256(i || ':' || line) AS h, octet_length(encode(line)) + 1 AS n FROM t),
s AS (SELECT count(*) AS lines, CAST(sum(n) AS BIGINT) AS n_bytes, {word} FROM h)
SELECT sha256(lines || '|' || n_bytes || '|' || w0 || ',' || w1 || ',' || w2 || ',' || w3) AS sha256, n_bytes FROM s"""
    # model tables
    label = "CAST(lower(CAST(requires_road_closure AS VARCHAR)) = 'true' AS DOUBLE)"
    q["ml_split_counts"] = chain(
        "SELECT label, rank <= ceil(n * 0.2::DOUBLE) AS is_test, count(*) AS n FROM (SELECT label, count(*) OVER (PARTITION BY"
        " label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rank FROM ("
        f"SELECT id, {label} AS label FROM feats WHERE requires_road_closure IS NOT NULL)) GROUP BY ALL", "feats")
    q["ml_folds"] = chain(
        "SELECT label, (rank - 1) % 5 AS fold, count(*) AS n, min(id) AS first_id FROM (SELECT id, label,"
        " row_number() OVER (PARTITION BY label ORDER BY md5('43:' || id), id) AS rank FROM ("
        f"SELECT id, {label} AS label FROM feats WHERE requires_road_closure IS NOT NULL)) GROUP BY ALL", "feats")
    return q


__all__ = ["statements", "chain", "PARTS"]
