"""Named queries over a test-data folder, one per operator.

Operators up to the feature table run on the incident view itself. Analytics read the stage
tables of one ``IncidentJob`` per session and folder, the way the batch job runs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C
from curbsight.functions.lineage import cut, new_table_path
from curbsight.learning import metrics as M, prepare, scoring, train
from curbsight.learning.registry import ModelRegistry
from curbsight.learning.store import ModelStore
from curbsight.operators import (analytics as A, cleaning as K, features as FE, fleet,
                                 forecasting as FC, hotspots as H, quality as Q,
                                 road_health as R)
from curbsight.plans.job import IncidentJob, rounded
from curbsight.sources import files
from curbsight.sources.incidents import as_of_column, load_incidents
from curbsight.streaming import incidents as ST

_jobs: dict[tuple[str, str], IncidentJob] = {}
_runs: dict[tuple[str, str], dict] = {}
# Cross-validation compares smaller models than the job's search.
SEARCHED_FOREST = {"numTrees": 20, "maxDepth": 6}
COMPARED_FAMILIES = {"random_forest": SEARCHED_FOREST, "boosting": {"maxIter": 8, "maxDepth": 4}}
SCENARIOS = [
    {"event_cause": "accident", "hour": 18},
    {"event_cause": "pot_holes", "veh_type": "auto", "hour": 9},
    {"corridor": "Corridor 1", "hour": 3},
]
RISK_COLUMNS = ["id", "event_cause", "zone", "corridor", "risk_score"]


def job_for(spark: SparkSession, sf_dir: str) -> IncidentJob:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _jobs:
        _jobs[key] = IncidentJob(
            spark, new_table_path(spark, "job"), lambda: load_incidents(spark, sf_dir),
            as_of_column(), models=["ets", "naive"])
    return _jobs[key]


def features_of(spark, sf) -> DataFrame:
    return job_for(spark, sf).table("features")


def raw_of(spark, sf) -> DataFrame:
    return job_for(spark, sf).table("raw")


def fast_runs(spark, sf, task_names=tuple(S.TASKS)) -> dict[str, dict]:
    """Fast models of the folder's features, trained once per state of the features."""
    runs = _runs.setdefault((spark.sparkContext.applicationId, sf), {})
    missing = [t for t in task_names if t not in runs]
    if missing:
        runs |= ModelStore(spark).runs(features_of(spark, sf), missing)
    return {t: runs[t] for t in task_names}


# -- sources -------------------------------------------------------------------

def _csv_copy(spark, sf) -> str:
    path = new_table_path(spark, "csv")
    files.write_csv(raw_of(spark, sf).drop("ordinal"), path)
    return path


def ingest_raw(spark, sf):
    return files.ingest(spark, _csv_copy(spark, sf))


def na_tokens(spark, sf):
    kind = F.col("ordinal") % 8
    words = F.when(kind < 6, F.element_at(
        F.array(*[F.lit(t) for t in S.NA_TOKENS]), (kind + 1).cast("int"))).otherwise(
        F.concat(F.lit(" "), F.col("status")))
    return files.na_tokens(load_incidents(spark, sf).select(
        "id", words.alias("word"), "corridor", "zone"))


def bad_lines(spark, sf):
    """Incidents as CSV text where every 50th row has surplus fields and every 30th is short."""
    raw = raw_of(spark, sf)
    line = F.concat_ws(
        ",", "id", "status", F.when(F.col("ordinal") % 30 != 0, F.col("event_type")),
        F.when(F.col("ordinal") % 50 == 0, F.lit("surplus,more")))
    path = new_table_path(spark, "lines")
    raw.select(line.alias("value")).write.option("header", False).text(path)
    schema = "id string, status string, event_type string, _extra string"
    read = spark.read.schema(schema).option("header", False).csv(path).withColumn(
        "_file", F.lit("incidents"))
    return files.bad_lines(read)


def ingest_manifest(spark, sf):
    """Totals of the manifest over the incident log as text files; file names differ from run to run."""
    found = files.ingest_manifest(spark, _csv_copy(spark, sf))
    return found.agg(F.sum("n_rows").alias("n_rows"), F.max("n_cols").cast("long").alias("n_cols"),
                     F.max(F.array_join("column_names", ",")).alias("columns"))


def file_fingerprint(spark, sf):
    """Fingerprint of the document texts written to one file, a line per text."""
    path = new_table_path(spark, "lines")
    words = F.translate("text", "\n\r", "  ")
    spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", words.alias("line")).coalesce(
        1).sortWithinPartitions("doc_id").select("line").write.option("lineSep", "\n").text(path)
    return files.file_fingerprints(spark, path).select("sha256", "n_bytes")


def scan_features(spark, sf):
    return features_of(spark, sf).select("id", "start_datetime", "date", "risk_score")


def json_records(spark, sf):
    return A.json_records(features_of(spark, sf))


def hotspot_geojson(spark, sf):
    return H.geojson_features(job_for(spark, sf).table("hotspots"))


# -- quality ---------------------------------------------------------------------

def _report(spark, sf):
    return Q.checks(load_incidents(spark, sf), as_of_column())


def dq_checks(spark, sf):
    return _report(spark, sf).select("name", "severity", "message")


def dq_domain_top5(spark, sf):
    return Q.domain_top5(load_incidents(spark, sf))


def dq_summary(spark, sf):
    return Q.summary(_report(spark, sf))


def dq_severity_counts(spark, sf):
    return Q.severity_counts(_report(spark, sf))


def completeness(spark, sf):
    return Q.completeness(features_of(spark, sf))


# -- cleaning ----------------------------------------------------------------------

def drop_dead_columns(spark, sf):
    raw = load_incidents(spark, sf).withColumns({
        "comment": F.lit("x"), "gba_identifier": F.lit(None).cast("string")})
    return K.drop_dead_columns(raw.select("id", "status", "zone", "comment", "gba_identifier"))


def coerce_types(spark, sf):
    """Text versions of the coordinates and times, some of them unreadable."""
    raw = load_incidents(spark, sf)
    n = F.col("ordinal")
    lat = F.when(n % 20 == 0, "n/a").when(n % 20 == 1, "1.0d").when(n % 20 == 2, "Infinity").when(
        n % 20 == 3, F.concat(F.lit("  "), F.col("latitude").cast("string"))).when(
        n % 20 == 4, "1.25e1").otherwise(F.col("latitude").cast("string"))
    start = F.when(n % 25 == 0, "yesterday").when(
        n % 25 == 1, F.concat(F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")),
    ).otherwise(F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss"))
    return K.coerce_types(raw.select(
        "id", lat.alias("latitude"), start.alias("start_datetime")))


def fix_geo(spark, sf):
    return K.fix_geo(load_incidents(spark, sf)).select(
        "id", *S.COORDINATE_COLUMNS, "is_segment_event")


def fix_temporal(spark, sf):
    return K.fix_temporal(load_incidents(spark, sf), as_of_column()).select(
        "id", "start_datetime", "end_datetime")


def resolution_hours(spark, sf):
    raw = load_incidents(spark, sf).transform(K.fix_temporal, as_of_column())
    return rounded(K.resolution_hours(raw).select("id", "resolution_hours"),
                   {"resolution_hours": 4})


def normalise_categoricals(spark, sf):
    return K.normalise_categoricals(load_incidents(spark, sf)).select(
        "id", "event_cause", "requires_road_closure", "priority", "status", "zone")


def impute_fills(spark, sf):
    raw = load_incidents(spark, sf).transform(K.normalise_categoricals)
    return raw.transform(K.fill_defaults).transform(K.fill_unknown).select(
        "id", "priority", "veh_type", "zone", "corridor", "event_type")


def spatial_impute(spark, sf):
    prepared = K.prepare(raw_of(spark, sf), as_of_column())
    return K.spatial_impute(prepared).select("id", "zone", "corridor")


def dedupe(spark, sf):
    rows = load_incidents(spark, sf).transform(K.fix_geo).transform(K.normalise_categoricals)
    return K.dedupe(rows).select("id", "event_cause", "start_datetime")


def clean(spark, sf):
    out = K.clean(raw_of(spark, sf), as_of_column()).drop("ordinal")
    return rounded(out, {"resolution_hours": 4})


# -- features ------------------------------------------------------------------------

def _clean_of(spark, sf):
    return job_for(spark, sf).table("clean")


def temporal_features(spark, sf):
    return FE.temporal_features(_clean_of(spark, sf)).select(
        "id", "hour", "dayofweek", "day_name", "month", "day", "week", "date", "is_weekend",
        "is_rush_hour", "day_segment")


def cyclic_features(spark, sf):
    out = FE.cyclic_features(FE.temporal_features(_clean_of(spark, sf)))
    names = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
    return rounded(out.select("id", *names), {c: 4 for c in names})


def dist_centre(spark, sf):
    return rounded(FE.geo_features(_clean_of(spark, sf)).select("id", "dist_centre_km"),
                   {"dist_centre_km": 4})


def geo_cell(spark, sf):
    return FE.geo_features(_clean_of(spark, sf)).select("id", "geo_cell")


def severity_lookup(spark, sf):
    return FE.severity_features(_clean_of(spark, sf)).select("id", "cause_severity", "veh_mass")


def duration_norm(spark, sf):
    return rounded(FE.duration_norm(_clean_of(spark, sf)).select("id", "duration_norm"),
                   {"duration_norm": 4})


def risk_score(spark, sf):
    rows = FE.duration_norm(FE.severity_features(_clean_of(spark, sf)))
    return FE.risk_score(rows).select("id", "risk_score")


def corridor_load(spark, sf):
    return FE.corridor_load(_clean_of(spark, sf)).select(
        "id", "corridor", "corridor_event_load", "corridor_load_norm")


def cell_repeat_count(spark, sf):
    return FE.cell_repeat_count(FE.geo_features(_clean_of(spark, sf))).select(
        "id", "geo_cell", "cell_repeat_count")


def features(spark, sf):
    out = FE.engineer_features(_clean_of(spark, sf)).drop("ordinal")
    return rounded(out, {c: 4 for c in (
        "resolution_hours", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "dist_centre_km")})


# -- road health ---------------------------------------------------------------------

def _health(spark, sf):
    return job_for(spark, sf).table("road_health")


def rhi_counts(spark, sf):
    return R.segment_counts(features_of(spark, sf))


def _weights(table):
    return rounded(table.select("cause", "weight"), {"weight": 4})


def rhi_weights_config(spark, sf):
    return _weights(R.present_weights(features_of(spark, sf)))


def rhi_weights_data(spark, sf):
    return _weights(R.data_weights(features_of(spark, sf)))


def rhi_zone(spark, sf):
    return R.ranked(R.road_health(features_of(spark, sf), ["zone"]))


def rhi_corridor(spark, sf):
    return R.ranked(R.road_health(features_of(spark, sf), ["corridor"]))


def rhi_all_levels(spark, sf):
    return R.road_health(features_of(spark, sf))


def rhi_summary(spark, sf):
    return R.summary(_health(spark, sf))


def _zone_health(spark, sf):
    return _health(spark, sf).filter("level = 'zone'")


# -- hotspots -----------------------------------------------------------------------

def _located(spark, sf):
    return features_of(spark, sf)


def dbscan_labels(spark, sf):
    return H.dbscan(_located(spark, sf)).select("id", "layer", "cluster")


def dbscan_core_points(spark, sf):
    labelled = job_for(spark, sf).table("labelled")
    return labelled.groupBy("layer").agg(
        F.count(F.lit(1)).alias("points"), C.tally(F.col("is_core")).alias("core"),
        C.tally(F.col("cluster") == -1).alias("noise"),
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"))


def hotspots_all(spark, sf):
    return H.ranked(H.detect_hotspots(_located(spark, sf), []))


def hotspots_by_cause(spark, sf):
    return H.summarise(job_for(spark, sf).table("labelled"))


def hotspots_top(spark, sf):
    return H.top_hotspots(job_for(spark, sf).table("hotspots"), "vehicle_breakdown", 20)


def hotspot_kpis(spark, sf):
    return H.hotspot_kpis(job_for(spark, sf).table("hotspots"))


def kmeans_zones(spark, sf):
    return H.kmeans_hotspots(_located(spark, sf))


# -- forecasts -----------------------------------------------------------------------

def _series(spark, sf):
    return job_for(spark, sf).table("series")


def daily_series(spark, sf):
    return FC.daily_series(FC.city_events(features_of(spark, sf), top_scopes=None))


def forecast_scopes(spark, sf):
    return FC.forecast_series(features_of(spark, sf)).groupBy("scope").agg(
        F.count(F.lit(1)).alias("days"), F.sum("y").alias("incidents"))


def supervised_frame(spark, sf):
    return rounded(FC.supervised_frame(_series(spark, sf)), {"roll7": 4})


def backtest_split(spark, sf):
    return FC.backtest_split(_series(spark, sf))


def _two_places(df):
    return rounded(df, {"yhat": 2})


def forecast_naive(spark, sf):
    return _two_places(FC.forecast_naive(_series(spark, sf)))


def forecast_ets(spark, sf):
    return _two_places(FC.forecast_ets(_series(spark, sf)))


def forecast_gbt(spark, sf):
    return _two_places(FC.forecast_gbt(_series(spark, sf)))


def forecast_metrics(spark, sf):
    tested = FC.backtest(_series(spark, sf), ["ets", "naive"])
    return rounded(FC.forecast_metrics(tested), {"mae": 2, "rmse": 2, "mape": 2})


def forecasts(spark, sf):
    job = job_for(spark, sf)
    return FC.forecasts(job.table("series"), job.table("forecast_metrics"), ["ets", "naive"])


def forecast_summary(spark, sf):
    return FC.forecast_summary(job_for(spark, sf).table("forecasts"))


def forecast_by_scope(spark, sf):
    ahead = job_for(spark, sf).table("forecasts")
    return FC.forecast_of(ahead, FC.forecast_summary(ahead), S.CITY_SCOPE)


# -- fleet ---------------------------------------------------------------------------

def _signals(spark, sf):
    spots = job_for(spark, sf).table("hotspots").filter(F.col("cause_filter") == H.ALL)
    return fleet.zone_signals(features_of(spark, sf), _zone_health(spark, sf), spots)


def zone_signals(spark, sf):
    return rounded(_signals(spark, sf), {"risk": 4, "road_health": 4, "hotspot": 4})


def zone_demand(spark, sf):
    return rounded(fleet.zone_demand(_signals(spark, sf)), {"demand": 4})


def resource_allocation(spark, sf):
    return fleet.ranked(fleet.allocate(_signals(spark, sf)))


def allocation_long(spark, sf):
    return fleet.allocation_long(job_for(spark, sf).table("allocation"))


def allocation_totals(spark, sf):
    return fleet.allocation_totals(job_for(spark, sf).table("allocation"))


# -- models --------------------------------------------------------------------------

def _score_table(spark, sf):
    """Deterministic scores of the clean incidents, to check the measures on."""
    n = F.expr("ordinal div 2")
    label = (F.lower("priority") == "high").cast("int")
    return _clean_of(spark, sf).select(
        "id", label.alias("label"),
        ((label * 300 + (n * 7919) % 700) / F.lit(1000.0)).alias("score"))


def _pair_table(spark, sf):
    n = F.expr("ordinal div 2")
    actual = F.least("resolution_hours", F.lit(48.0))
    return _clean_of(spark, sf).filter("resolution_hours IS NOT NULL").select(
        "id", actual.alias("actual"),
        (actual * 0.8 + ((n % 11) - 5) * F.lit(0.3)).alias("predicted"))


def ml_label_table(spark, sf):
    out = prepare.label_table(features_of(spark, sf), "resolution")
    return rounded(out.select("id", "label", "event_type", "zone", "hour", "is_segment_event",
                              "corridor_load_norm", "cell_repeat_count"), {"label": 4})


def ml_split_counts(spark, sf):
    table = prepare.split(prepare.label_table(features_of(spark, sf), "closure"), "closure")
    return table.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


def ml_folds(spark, sf):
    table = prepare.folds(prepare.label_table(features_of(spark, sf), "closure"), S.CV_FOLDS, task="closure")
    return table.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def ml_cv_scores(spark, sf):
    table = train.training_table(features_of(spark, sf), "closure")
    scores = train.cv_scores(
        table.filter(~F.col("is_test")).drop("is_test"), "closure", COMPARED_FAMILIES,
        selector=SEARCHED_FOREST, k=3)
    return spark.createDataFrame(list(scores.items()), "family string, roc_auc double")


def ml_fast_train(spark, sf):
    rows = [(t, r["best_model"], r["n_train"], r["n_test"], k, float(v))
            for t, r in fast_runs(spark, sf).items() for k, v in r["metrics"].items()]
    return spark.createDataFrame(
        rows, "task string, model string, n_train long, n_test long, measure string, value double")


def optimal_threshold(spark, sf):
    return rounded(M.optimal_threshold(_score_table(spark, sf)), {"threshold": 4, "f1": 4})


def clf_metrics(spark, sf):
    return M.clf_metrics(_score_table(spark, sf), 0.5)


def reg_metrics(spark, sf):
    return M.reg_metrics(_pair_table(spark, sf))


def confusion_matrix(spark, sf):
    return M.confusion_matrix(_score_table(spark, sf), F.lit(0.5))


def class_report(spark, sf):
    return M.class_report(confusion_matrix(spark, sf))


def roc_curve(spark, sf):
    return M.roc_curve(_score_table(spark, sf))


def pr_curve(spark, sf):
    return M.pr_curve(_score_table(spark, sf))


def residual_stats(spark, sf):
    return M.residual_stats(_pair_table(spark, sf))


def feature_importance(spark, sf):
    return train.importances(fast_runs(spark, sf, ("closure",))["closure"]["model"], spark)


def model_runs_latest(spark, sf):
    registry = ModelRegistry(spark, new_table_path(spark, "registry"))
    for run in fast_runs(spark, sf).values():
        registry.log_run(run)
    return registry.latest().select(
        "task", "best_model", "n_features", "n_train", "n_test", "threshold",
        F.size("importances").alias("n_importances"),
        F.col("importances")[0]["feature"].alias("top_feature"))


def _requests(spark, sf):
    """Scoring requests made from the incidents, with gaps and values out of range."""
    n = F.col("ordinal")
    return load_incidents(spark, sf).select(
        "id", F.when(n % 50 != 0, F.lower(C.strip(F.col("event_cause")))).alias("event_cause"),
        "corridor", "zone", "veh_type", "event_type", "status",
        F.when(n % 40 == 0, 99).when(n % 13 != 0, (n % 24).cast("int")).alias("hour"),
        F.when(n % 29 != 0, F.col("latitude")).alias("latitude"),
        F.when(n % 29 != 0, F.col("longitude")).alias("longitude"))


def validate_requests(spark, sf):
    return scoring.validate_requests(_requests(spark, sf))


def _enriched(spark, sf):
    known = features_of(spark, sf)
    accepted = scoring.validate_requests(_requests(spark, sf)).filter("accepted")
    return scoring.enrich_requests(
        accepted, scoring.corridor_loads(known), scoring.cell_counts(known))


def enrich_requests(spark, sf):
    names = ["hour_sin", "hour_cos", "dist_centre_km"]
    out = _enriched(spark, sf).select(
        "id", "hour", "is_rush_hour", "day_segment", "geo_cell", "cause_severity", "veh_mass",
        "corridor_load_norm", "cell_repeat_count", *names)
    return rounded(out, {c: 4 for c in names})


def score_incidents(spark, sf):
    runs = fast_runs(spark, sf)
    return scoring.score(_enriched(spark, sf), runs).select(
        "id", "priority_label", "priority_proba", "closure_label", "closure_proba",
        "resolution_pred")


def score_responses(spark, sf):
    runs = fast_runs(spark, sf)
    return scoring.respond(scoring.score(_enriched(spark, sf), runs), runs).select(
        "id", F.to_json("response").alias("response"))


def what_if_scenarios(spark, sf):
    runs = fast_runs(spark, sf, ("closure",))
    return scoring.score(scoring.what_if(features_of(spark, sf), SCENARIOS), runs).select(
        "id", "scenario", "event_cause", "hour", "is_rush_hour", "closure_proba", "closure_label")


# -- analytics -------------------------------------------------------------------------

def filtered_events(spark, sf):
    return A.filtered(
        features_of(spark, sf), "2023-12-01", "2024-02-29", causes=["accident", "pot_holes"],
        priorities=["High"], zones=[]).select(*RISK_COLUMNS, "date")


def selection_size(spark, sf):
    every = features_of(spark, sf)
    return A.selection_size(every, A.filtered(every, "2023-12-01", None, corridors=["Corridor 1"]))


def _over_features(query, **options):
    return lambda spark, sf: query(features_of(spark, sf), **options)


def kpi_overview(spark, sf):
    return A.kpi_overview(features_of(spark, sf), _zone_health(spark, sf))


def rhi_category_counts(spark, sf):
    return A.rhi_category_counts(_zone_health(spark, sf))


def rhi_worst(spark, sf):
    return A.rhi_worst(_zone_health(spark, sf)).select(
        "segment", "health_score", "health_category", "top_factor")


def points_lost_long(spark, sf):
    return A.points_lost_long(_zone_health(spark, sf))


def map_sample(spark, sf):
    return A.map_sample(features_of(spark, sf)).select("id", "latitude", "longitude", "event_cause")


# -- streams -----------------------------------------------------------------------------

def _slices(spark, sf) -> tuple[str, object]:
    """The raw incidents as a folder of files, one set per local week."""
    raw = raw_of(spark, sf)
    path = new_table_path(spark, "slices")
    raw.repartitionByRange(4, "start_datetime").sortWithinPartitions(
        "start_datetime").write.parquet(path)
    return path, raw.schema


def stream_dedupe(spark, sf):
    path, schema = _slices(spark, sf)
    cleaned = ST.clean_stream(ST.read_slices(spark, path, schema), as_of_column())
    unique = ST.dedupe_stream(cleaned).select(*S.DEDUPE_KEY, "id")
    return ST.run_to_end(unique, new_table_path(spark, "out"), new_table_path(spark, "state"), S.DEDUPE_KEY)


def stream_daily_counts(spark, sf):
    path, schema = _slices(spark, sf)
    cleaned = ST.clean_stream(ST.read_slices(spark, path, schema), as_of_column())
    return ST.run_to_end(ST.daily_counts_stream(cleaned, "event_cause"), new_table_path(spark, "out"),
                         new_table_path(spark, "state"), ["date", "event_cause"])


def _streamed_requests(spark, sf, runs) -> tuple[DataFrame, DataFrame]:
    """Scored and quarantined requests of a stream of all requests."""
    path, known = new_table_path(spark, "requests"), features_of(spark, sf)
    requests = _requests(spark, sf)
    requests.repartition(4).write.parquet(path)
    scored, quarantine = new_table_path(spark, "scored"), new_table_path(spark, "quarantine")
    ST.score_requests(
        ST.read_slices(spark, path, requests.schema, files_per_batch=2),
        lambda: (scoring.corridor_loads(known), scoring.cell_counts(known)), runs, scored, quarantine,
        new_table_path(spark, "state")).awaitTermination()
    return spark.read.parquet(scored), spark.read.parquet(quarantine)


def stream_quarantine(spark, sf):
    return _streamed_requests(spark, sf, {})[1].select("id", "reason")


def stream_score(spark, sf):
    return _streamed_requests(spark, sf, fast_runs(spark, sf))[0].select(
        "id", "priority_label", "priority_proba", "closure_label", "closure_proba", "resolution_pred")


QUERIES = {f.__name__: f for f in (
    ingest_raw, na_tokens, bad_lines, ingest_manifest, file_fingerprint, scan_features, json_records,
    hotspot_geojson, dq_checks, dq_domain_top5, dq_summary, dq_severity_counts, completeness,
    drop_dead_columns, coerce_types, fix_geo, fix_temporal, resolution_hours,
    normalise_categoricals, impute_fills, spatial_impute, dedupe, clean, temporal_features,
    cyclic_features, dist_centre, geo_cell, severity_lookup, duration_norm, risk_score,
    corridor_load, cell_repeat_count, features, rhi_counts, rhi_weights_config,
    rhi_weights_data, rhi_zone, rhi_corridor, rhi_all_levels, rhi_summary, dbscan_labels,
    dbscan_core_points, hotspots_all, hotspots_by_cause, hotspots_top, hotspot_kpis,
    kmeans_zones, daily_series, forecast_scopes, supervised_frame, backtest_split,
    forecast_naive, forecast_ets, forecast_gbt, forecast_metrics, forecasts, forecast_summary,
    forecast_by_scope, zone_signals, zone_demand, resource_allocation, allocation_long,
    allocation_totals, ml_label_table, ml_split_counts, ml_folds, ml_cv_scores, ml_fast_train,
    optimal_threshold, clf_metrics, reg_metrics, confusion_matrix, class_report, roc_curve,
    pr_curve, residual_stats, feature_importance, model_runs_latest, validate_requests,
    enrich_requests, score_incidents, score_responses, what_if_scenarios, filtered_events,
    selection_size, kpi_overview, rhi_category_counts, rhi_worst, points_lost_long, map_sample,
    stream_dedupe, stream_daily_counts, stream_quarantine, stream_score)}
QUERIES.update({
    "filter_options": _over_features(A.filter_options),
    "kpi_stats": _over_features(A.kpi_stats),
    "top_causes": _over_features(A.top_causes),
    "daily_volume": _over_features(A.daily_volume),
    "zone_volume": _over_features(A.zone_volume),
    "dow_hour_heatmap": _over_features(A.dow_hour_heatmap),
    "live_kpis": _over_features(A.live_kpis),
    "vehicle_mix": _over_features(A.vehicle_mix),
    "day_segment_counts": _over_features(A.day_segment_counts),
    "hourly_profile": _over_features(A.hourly_profile),
    "latest_records": _over_features(A.latest_records),
})
