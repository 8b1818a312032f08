"""Hotspots: summaries of dense incident clusters, per cause layer, with GeoJSON export."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C
from curbsight.functions.lineage import cut
from curbsight.functions.ordered import quantiles, value_counts
from curbsight.operators.density import density_clusters

ALL = "all"
# Coordinates are summed in units of 1e-7 degree (1 cm), which keeps means exact.
COORDINATE_PLACES = 7
RADIUS_BUCKET_M = 1.0


def layers_of(causes: list[str] | None = None) -> Column:
    """The layers an incident belongs to: ``all``, and its cause if that has a layer."""
    causes = S.HOTSPOT_CAUSES if causes is None else causes
    cause = F.col("event_cause")
    return F.when(cause.isin(causes), F.array(F.lit(ALL), cause)).otherwise(F.array(F.lit(ALL)))


def dbscan(df: DataFrame, causes: list[str] | None = None, eps: float = S.EPS_METERS,
           min_samples: int = S.MIN_SAMPLES) -> DataFrame:
    """Incidents with layer and cluster (-1: noise); all layers in one run."""
    layers = layers_of(causes)
    return density_clusters(df, layers, eps, min_samples).label(df, layers)


def _mode(name: str) -> Column:
    return F.mode(F.col(name), True)


def summarise(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """One row per (layer, cluster): centre, size, severity, radius, risk; noise left out.

    Centre and severity are exact sums, the radius is an exact P90 from counts of equal
    coordinates, so the result does not depend on the partitioning.
    """
    keys = ["layer", label]
    valid = labelled.filter(F.col(label) != -1)
    cells = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("incident_count"),
        C.fixed_mean(F.col("latitude"), COORDINATE_PLACES).alias("lat0"),
        C.fixed_mean(F.col("longitude"), COORDINATE_PLACES).alias("lon0"),
        C.half_even(C.fixed_mean(F.col("cause_severity"), 2), 3).alias("mean_severity"),
        _mode("event_cause").alias("dominant_cause"),
        (_mode("corridor") if "corridor" in labelled.columns else F.lit(None).cast("string"))
        .alias("top_corridor"),
        (_mode("zone") if "zone" in labelled.columns else F.lit(None).cast("string"))
        .alias("top_zone"),
    )
    # Distances only once per distinct coordinate of a cluster.
    places = valid.groupBy(*keys, "latitude", "longitude").agg(F.count(F.lit(1)).alias("m"))
    sin2 = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    term = sin2(F.col("latitude") - F.col("lat0")) + F.pow(
        F.cos(F.radians(F.col("lat0"))), 2) * sin2(F.col("longitude") - F.col("lon0"))
    far = places.join(cells.select(*keys, "lat0", "lon0"), keys).withColumn(
        "metres", F.lit(S.EARTH_RADIUS_M) * 2 * F.asin(F.sqrt(term)))
    radius = quantiles(
        value_counts(far, keys, "metres", "m"), keys, "metres", {"radius": 0.9}, RADIUS_BUCKET_M)
    ranges = cells.groupBy("layer").agg(
        F.min("incident_count").alias("c_lo"), F.max("incident_count").alias("c_hi"),
        F.min("mean_severity").alias("s_lo"), F.max("mean_severity").alias("s_hi"))
    w = S.HOTSPOT_WEIGHTS
    risk = (
        C.min_max(F.col("incident_count").cast("double"), F.col("c_lo").cast("double"),
                  F.col("c_hi").cast("double")) * w["count"]
        + C.min_max(F.col("mean_severity"), F.col("s_lo"), F.col("s_hi")) * w["severity"])
    return cells.join(radius, keys).join(ranges, "layer").select(
        F.concat(F.col("layer"), F.lit(f"_{label}_"), F.col(label).cast("string"))
        .alias("hotspot_id"),
        F.col("layer").alias("cause_filter"), F.lit(label).alias("method"),
        C.half_even(F.col("lat0"), 6).alias("center_lat"),
        C.half_even(F.col("lon0"), 6).alias("center_lon"),
        "incident_count", "dominant_cause", "mean_severity",
        C.half_even(F.col("radius"), 1).alias("radius_m"), "top_corridor", "top_zone",
        C.half_even(risk * 100, 1).alias("risk_score"),
    )


def ranked(hotspots: DataFrame) -> DataFrame:
    return hotspots.orderBy(F.desc("risk_score"), "hotspot_id")


def detect_hotspots(df: DataFrame, causes: list[str] | None = None) -> DataFrame:
    """Hotspots of the ``all`` layer and of each cause layer, in one table."""
    return summarise(cut(dbscan(df, causes)))


def kmeans_zones(df: DataFrame, k_range: tuple[int, int] = S.KMEANS_K_RANGE,
                 restarts: int = S.KMEANS_RESTARTS, iterations: int = 20) -> DataFrame:
    """Incidents with ``kmeans_zone``; the k with the best silhouette (12 for small tables).

    Works on distinct coordinates weighted by their number of incidents, which gives the same
    centres from a smaller table. Candidate fits are independent jobs and run side by side.
    """
    located = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    places = located.groupBy("latitude", "longitude").agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    vectors = cut(VectorAssembler(
        inputCols=["latitude", "longitude"], outputCol="features").transform(places))
    rows = vectors.agg(F.sum("weight")).first()[0] or 0
    if rows <= S.KMEANS_MIN_ROWS:
        return located.limit(0).withColumn("kmeans_zone", F.lit(0))
    vectors = vectors.cache()

    def fit(k: int, seed: int):
        return KMeans(k=k, seed=seed, maxIter=iterations, weightCol="weight",
                      predictionCol="kmeans_zone").fit(vectors)

    def score(k: int) -> tuple[float, int]:
        out = fit(k, S.SEED).transform(vectors)
        return ClusteringEvaluator(
            predictionCol="kmeans_zone", weightCol="weight").evaluate(out), k

    with ThreadPoolExecutor(4) as pool:
        run = lambda f, args: list(pool.map(inheritable_thread_target(f), args))
        low, high = k_range
        scores = run(score, range(low, min(high, int(rows) - 1) + 1))
        best_k = max(scores, key=lambda s: (s[0], -s[1]))[1] if scores else S.KMEANS_DEFAULT_K
        models = run(lambda i: fit(best_k, S.SEED + i), range(restarts))
    model = min(models, key=lambda m: m.summary.trainingCost)
    zones = cut(model.transform(vectors).select("latitude", "longitude", "kmeans_zone"))
    vectors.unpersist()
    return located.join(zones, ["latitude", "longitude"])


def kmeans_hotspots(df: DataFrame, **options) -> DataFrame:
    return summarise(kmeans_zones(df, **options).withColumn("layer", F.lit(ALL)), "kmeans_zone")


def geojson_features(hotspots: DataFrame) -> DataFrame:
    """(cause_filter, hotspot_id, feature): one GeoJSON Feature as text per hotspot."""
    properties = [c for c in hotspots.columns if c not in ("center_lat", "center_lon")]
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array("center_lon", "center_lat").alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})
    return hotspots.select("cause_filter", "hotspot_id", feature.alias("feature"))


def geojson_combined(hotspots: DataFrame) -> DataFrame:
    """All features of the ``all`` layer and of each cause; an incident may count twice."""
    return geojson_features(hotspots)


def write_geojson(hotspots: DataFrame, path: str) -> None:
    """Newline-delimited features, one folder per cause; files can be split and merged."""
    geojson_features(hotspots).select("cause_filter", F.col("feature").alias("value")).write.mode(
        "overwrite").partitionBy("cause_filter").text(path)


def top_hotspots(hotspots: DataFrame, cause: str = ALL, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return ranked(hotspots.filter(F.col("cause_filter") == cause)).limit(limit)


def hotspot_kpis(hotspots: DataFrame) -> DataFrame:
    """Number of hotspots, incidents in them, highest risk and largest cluster per layer."""
    return hotspots.groupBy("cause_filter").agg(
        F.count(F.lit(1)).alias("hotspots"), F.sum("incident_count").alias("incidents"),
        F.max("risk_score").alias("top_risk"), F.max("incident_count").alias("largest"))
