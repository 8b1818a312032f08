"""Fixed values of the incident model.

Every weight, threshold, mapping and column list below is a fixed value: results
are only right when they equal these numbers, so they are stated plainly here and
nowhere else.
"""

SEED = 42
CITY_CENTRE = (12.9716, 77.5946)
LOCAL_ZONE = "Asia/Kolkata"
EARTH_RADIUS_M = 6_371_000.0
BBOX = {"lat_min": 12.6, "lat_max": 13.4, "lon_min": 77.2, "lon_max": 77.9}

# -- sources ---------------------------------------------------------------
NA_TOKENS = ["NULL", "null", "NaN", "nan", "None", ""]
DATETIME_COLUMNS = [
    "start_datetime", "end_datetime", "created_date", "modified_datetime", "closed_datetime",
]
COORDINATE_COLUMNS = ["latitude", "longitude", "endlatitude", "endlongitude"]
DROP_COLUMNS = [
    "map_file", "comment", "meta_data", "direction", "route_path", "cargo_material",
    "reason_breakdown", "age_of_truck", "assigned_to_police_id", "citizen_accident_id",
    "resolved_at_address", "resolved_at_latitude", "resolved_at_longitude",
    "resolved_by_id", "resolved_datetime", "kgid", "veh_no", "end_address",
]

# -- quality gates -----------------------------------------------------------
MIN_ROWS = 1000
REQUIRED_COLUMNS = [
    "id", "event_cause", "latitude", "longitude", "start_datetime", "priority",
    "requires_road_closure",
]
MAX_MISSING_PCT = {
    "latitude": 0.0, "longitude": 0.0, "event_cause": 0.0, "start_datetime": 5.0,
}
UNIQUE_KEY = "id"
DOMAIN_COLUMNS = ["priority", "status", "event_type"]

# -- cleaning ----------------------------------------------------------------
CAUSE_MAP = {
    "Debris": "debris", "debris": "debris", "Fog / Low Visibility": "fog",
    "pot_holes": "pot_holes", "water_logging": "water_logging",
}
DEDUPE_KEY = ["latitude", "longitude", "start_datetime", "event_cause"]
TRIM_COLUMNS = [
    "priority", "status", "event_type", "corridor", "zone", "gba_identifier", "veh_type",
    "police_station",
]
PRIORITY_FILL = "Low"
VEH_TYPE_FILL = "not_applicable"
SPATIAL_FILL_FIELDS = ["zone", "gba_identifier", "corridor"]
CATEGORICAL_COLUMNS = [
    "event_type", "event_cause", "status", "veh_type", "corridor", "zone", "gba_identifier",
    "authenticated",
]
UNKNOWN = "unknown"
MAX_RESOLUTION_HOURS = 24 * 30
END_GRACE_DAYS = 2

# -- features ----------------------------------------------------------------
RUSH_HOURS = [8, 9, 10, 18, 19, 20]
CAUSE_SEVERITY = {
    "accident": 1.00, "water_logging": 0.80, "tree_fall": 0.75, "fog": 0.70,
    "pot_holes": 0.60, "construction": 0.55, "road_conditions": 0.55, "congestion": 0.50,
    "vehicle_breakdown": 0.45, "protest": 0.45, "debris": 0.40, "vip_movement": 0.40,
    "public_event": 0.35, "procession": 0.35, "others": 0.30, "test_demo": 0.10,
}
CAUSE_SEVERITY_DEFAULT = 0.3
VEH_MASS = {
    "heavy_vehicle": 1.0, "truck": 1.0, "bmtc_bus": 0.9, "ksrtc_bus": 0.9,
    "private_bus": 0.85, "lcv": 0.6, "private_car": 0.4, "taxi": 0.4, "auto": 0.3,
    "others": 0.3, "not_applicable": 0.2,
}
VEH_MASS_DEFAULT = 0.2
RISK_WEIGHTS = {
    "severity": 0.40, "closure": 0.20, "priority_high": 0.15, "duration": 0.15,
    "veh_mass": 0.10,
}
DURATION_DEFAULT = 0.3
DURATION_CAP_QUANTILE = 0.95

# -- road health ---------------------------------------------------------------
ROAD_HEALTH_WEIGHTS = {
    "pot_holes": 0.30, "water_logging": 0.20, "road_conditions": 0.20,
    "construction": 0.10, "vehicle_breakdown": 0.10, "accident": 0.10,
}
ROAD_HEALTH_SMOOTHING = 5
ROAD_HEALTH_CATEGORIES = {
    "Critical": 20, "Poor": 40, "Moderate": 60, "Good": 80, "Excellent": 100,
}
ROAD_HEALTH_LEVELS = ["corridor", "zone"]
FLAT_RANGE = 1e-12

# -- hotspots ------------------------------------------------------------------
HOTSPOT_CAUSES = ["accident", "vehicle_breakdown", "water_logging", "pot_holes"]
EPS_METERS = 250.0
MIN_SAMPLES = 8
KMEANS_DEFAULT_K = 12
KMEANS_K_RANGE = (6, 20)
KMEANS_MIN_ROWS = 50
KMEANS_RESTARTS = 10
HOTSPOT_WEIGHTS = {"count": 0.6, "severity": 0.4}

# -- forecasting -----------------------------------------------------------------
SEASON = 7
LAGS = [1, 2, 3, 7, 14]
HORIZONS = {"day": 1, "week": 7, "month": 30}
TEST_DAYS = 21
TOP_SCOPES = 5
MIN_ACTIVE_DAYS = 20
MIN_TRAIN_ROWS = 20
INTERVAL_Z = 1.96
CITY_SCOPE = "CITY"

# -- fleet -------------------------------------------------------------------------
FLEET = {"tow_trucks": 40, "traffic_police": 60, "maintenance_teams": 25}
FLEET_DRIVERS = {
    "tow_trucks": {"breakdown": 0.6, "accident": 0.3, "risk": 0.1},
    "traffic_police": {"accident": 0.35, "congestion": 0.25, "risk": 0.25, "hotspot": 0.15},
    "maintenance_teams": {"road_health": 0.5, "pot_holes": 0.3, "water_logging": 0.2},
}
FLEET_FLOORS = {"tow_trucks": 0, "traffic_police": 1, "maintenance_teams": 0}

# -- models --------------------------------------------------------------------------
NUMERIC_FEATURES = [
    "hour", "dayofweek", "month", "is_weekend", "is_rush_hour", "hour_sin", "hour_cos",
    "dow_sin", "dow_cos", "dist_centre_km", "cause_severity", "veh_mass",
    "corridor_load_norm", "cell_repeat_count", "is_segment_event",
]
CATEGORICAL_FEATURES = [
    "event_type", "event_cause", "status", "veh_type", "corridor", "zone",
    "gba_identifier", "day_segment",
]
TASKS = {
    "priority": {
        "kind": "classification", "target": "priority", "positive": "High",
        "balanced": False,
        "leakage": ["corridor", "zone", "gba_identifier", "corridor_load_norm",
                    "cause_severity"],
    },
    "closure": {
        "kind": "classification", "target": "requires_road_closure", "positive": "true",
        "balanced": True, "leakage": ["is_segment_event", "cause_severity"],
    },
    "resolution": {
        "kind": "regression", "target": "resolution_hours", "clip": (0.0, 48.0),
        "balanced": False, "leakage": ["status"],
    },
}
TEST_FRACTION = 0.2
CV_FOLDS = 5
THRESHOLD_FOLDS = 3
SEARCH_DRAWS = 25
TOP_FEATURES = 25
RARE_LEVEL_ROWS = 10
SELECTOR_TREES = 200
FAST_FOREST = {"numTrees": 120, "maxDepth": 16}
# The deepest tree Spark grows stands for "no limit"; a depth of 5 for 31 leaves.
NO_LIMIT, LEAVES_31 = 30, 5
SELECTOR_DEPTH = NO_LIMIT
COMPARED_FAMILIES = {
    "random_forest": {"numTrees": 100, "maxDepth": NO_LIMIT},
    "boosting": {"maxIter": 100, "maxDepth": LEAVES_31},
}
# Search space: trees, depth, rows per leaf and feature share of forests; rounds, rate and depth
# of boosting.
SEARCH_SPACE = {
    ("random_forest", "classification"): {
        "numTrees": [200, 400, 600], "maxDepth": [NO_LIMIT, 8, 16, 24],
        "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2", "0.5"]},
    ("random_forest", "regression"): {
        "numTrees": [200, 400, 600], "maxDepth": [NO_LIMIT, 10, 20],
        "minInstancesPerNode": [1, 2, 4]},
    ("boosting", "classification"): {
        "maxIter": [200, 400], "stepSize": [0.03, 0.06, 0.1], "maxDepth": [LEAVES_31, 6, 10]},
    ("boosting", "regression"): {"maxIter": [200, 400], "stepSize": [0.03, 0.06, 0.1]},
}
# What a stored model depends on besides its rows and options.
TRAINING_SETTINGS = ("TEST_FRACTION", "CV_FOLDS", "THRESHOLD_FOLDS", "SEARCH_DRAWS", "TOP_FEATURES",
                     "RARE_LEVEL_ROWS", "SELECTOR_TREES", "SELECTOR_DEPTH", "FAST_FOREST", "SEED")

# -- scoring requests ------------------------------------------------------------------
REQUEST_DEFAULTS = {
    "corridor": "Non-corridor", "zone": "unknown", "veh_type": "not_applicable",
    "event_type": "unplanned", "status": "active", "hour": 9,
    "latitude": 12.9716, "longitude": 77.5946,
}
