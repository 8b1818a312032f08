"""The batch job: versioned stage tables, built on demand and written as Parquet.

A stage table lives in a folder per version; a small file names the current version and the versions
it was built from. That file is replaced in one step after the table is complete, so a failed build
leaves the old table, and a table whose sources have changed since is built anew before it is read.
Stage tables cut the lineage: all analytics read the written feature table, with column pruning and
filter push-down. Tables that a build writes on its way are deleted at its end, also after an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from curbsight import settings as S
from curbsight.functions import storage
from curbsight.functions.columns import half_even
from curbsight.functions.lineage import scratch
from curbsight.learning import train
from curbsight.learning.registry import ModelRegistry
from curbsight.learning.store import ModelStore
from curbsight.operators import cleaning, features, fleet, forecasting, hotspots, quality, road_health
from curbsight.sources import files

STAGES = ["manifest", "raw", "quality", "clean", "features", "road_health", "hotspots", "kmeans_zones",
          "allocation", "forecasts", "models"]
# Tables between a stage and the stages before it; a run builds them anew with their stage.
INNER = {"hotspots": ["labelled"], "forecasts": ["series", "tested", "forecast_metrics"]}
# The tables each one is built from.
SOURCES = {
    "quality": ["raw"], "clean": ["raw"], "features": ["clean"], "road_health": ["features"],
    "labelled": ["features"], "hotspots": ["labelled"], "kmeans_zones": ["features"],
    "allocation": ["features", "road_health", "hotspots"], "series": ["features"], "tested": ["series"],
    "forecast_metrics": ["tested"], "forecasts": ["series", "forecast_metrics"], "models": ["features"],
}


class IncidentJob:
    """Stage tables under ``root`` from a raw incident table.

    ``raw`` builds the raw table (with ``ordinal``), for instance ``files.ingest`` of a CSV
    path. ``as_of`` is the moment that counts as now, a timestamp column. ``manifest`` builds the
    table of input files; ``source_version`` names the state of the input
    (``files.listing_version``), without it the raw table is current until it is built again.
    """

    def __init__(self, spark: SparkSession, root: str, raw: Callable[[], DataFrame], as_of,
                 models: list[str] | None = None, top_scopes: int | None = S.TOP_SCOPES,
                 forecast_options: dict | None = None, training: dict | None = None,
                 manifest: Callable[[], DataFrame] | None = None,
                 source_version: Callable[[], str] | None = None):
        self.spark, self.root, self._raw, self.as_of = spark, root, raw, as_of
        self.forecast_models = models or list(forecasting.MODELS)
        self.top_scopes, self.forecast_options = top_scopes, forecast_options
        self.training = {"fast": False} if training is None else training
        self._manifest, self._source_version = manifest, source_version

    @classmethod
    def of_files(cls, spark: SparkSession, root: str, path: str, as_of, **options) -> "IncidentJob":
        """A job over CSV files; new, changed or removed files make its tables out of date."""
        return cls(spark, root, lambda: files.ingest(spark, path), as_of,
                   manifest=lambda: files.ingest_manifest(spark, path),
                   source_version=lambda: files.listing_version(spark, path), **options)

    def _entry_path(self, name: str) -> str:
        return f"{self.root}/_versions/{name.replace('/', '.')}.json"

    def _entry(self, name: str) -> dict | None:
        text = storage.read_text(self.spark, self._entry_path(name))
        return json.loads(text) if text else None

    def version(self, name: str) -> str | None:
        entry = self._entry(name)
        return entry["version"] if entry else None

    def path(self, table: str) -> str:
        """The folder of the current version."""
        return f"{self.root}/{table}/{self.version(table)}"

    def exists(self, table: str) -> bool:
        return self._entry(table) is not None

    def _sources(self, name: str) -> dict[str, str | None]:
        found = {s: self.version(s) for s in SOURCES.get(name, [])}
        if name in ("raw", "manifest") and self._source_version:
            found["input"] = self._source_version()
        return found

    def current(self, name: str) -> bool:
        """Whether the table is there and built from what its sources are now."""
        entry = self._entry(name)
        if entry is None:
            return False
        if entry["sources"] is None:  # given, not built
            return True
        return all(self.current(s) for s in SOURCES.get(name, [])) and entry["sources"] == self._sources(name)

    def table(self, name: str) -> DataFrame:
        """The stage table ``name``, built first if it is missing or out of date."""
        if not self.current(name):
            self.build(name)
        return self.spark.read.parquet(self.path(name))

    def _write(self, df: DataFrame | None, name: str, sources: dict | None = None) -> None:
        """Make ``df`` the current version. The one before stays for readers that have begun."""
        before = self._entry(name)
        version = uuid.uuid4().hex
        target = f"{self.root}/{name}/{version}"
        if df is not None:
            try:
                df.write.parquet(target)
            except BaseException:
                storage.remove(self.spark, target)
                raise
        storage.write_text(self.spark, self._entry_path(name), json.dumps({
            "version": version, "sources": sources, "before": before["version"] if before else None}))
        if before and before["before"]:
            storage.remove(self.spark, f"{self.root}/{name}/{before['before']}")

    def build(self, name: str) -> None:
        for source in SOURCES.get(name, []):
            self.table(source)
        sources = self._sources(name)
        with scratch(self.spark):
            self._write(getattr(self, f"_build_{name}")(), name, sources)

    def _build_manifest(self) -> DataFrame:
        if self._manifest is None:
            raise LookupError("the job has no input files to list")
        return self._manifest()

    def _build_raw(self) -> DataFrame:
        return self._raw()

    def _build_quality(self) -> DataFrame:
        return quality.checks(self.table("raw"), self.as_of)

    def _build_clean(self) -> DataFrame:
        return cleaning.clean(self.table("raw"), self.as_of)

    def _build_features(self) -> DataFrame:
        """In files of even size by date, so that readers of some days skip the others."""
        return features.engineer_features(self.table("clean")).hint(
            "rebalance", F.col("date")).sortWithinPartitions("date")

    def _build_road_health(self) -> DataFrame:
        return road_health.road_health(self.table("features"))

    def _build_labelled(self) -> DataFrame:
        return hotspots.dbscan(self.table("features"))

    def _build_hotspots(self) -> DataFrame:
        return hotspots.summarise(self.table("labelled"))

    def _build_kmeans_zones(self) -> DataFrame:
        return hotspots.kmeans_hotspots(self.table("features"))

    def _build_allocation(self) -> DataFrame:
        health = self.table("road_health").filter("level = 'zone'")
        spots = self.table("hotspots").filter(F.col("cause_filter") == hotspots.ALL)
        return fleet.allocate(fleet.zone_signals(self.table("features"), health, spots))

    def _build_series(self) -> DataFrame:
        return forecasting.forecast_series(self.table("features"), top_scopes=self.top_scopes)

    def _build_tested(self) -> DataFrame:
        return forecasting.backtest(self.table("series"), self.forecast_models, self.forecast_options)

    def _build_forecast_metrics(self) -> DataFrame:
        return forecasting.forecast_metrics(self.table("tested"))

    def _build_forecasts(self) -> DataFrame:
        return forecasting.forecasts(self.table("series"), self.table("forecast_metrics"),
                                     self.forecast_models, self.forecast_options)

    def _build_models(self) -> DataFrame:
        """The latest runs; models are in the registry, their reports under ``evaluation/<task>``."""
        registry = ModelRegistry(self.spark, f"{self.root}/registry")
        runs = ModelStore(self.spark, f"{self.root}/trained").runs(self.table("features"), **self.training)
        for task, run in runs.items():
            registry.log_run(run)
            for report, table in train.evaluate_task(run).items():
                self._write(table, f"evaluation/{task}/{report}")
        return registry.latest()

    def run(self, only: list[str] | None = None, skip: list[str] | None = None,
            fail_on_error: bool = False) -> list[str]:
        """Build the chosen stages in order, each with its inner tables; returns their names."""
        chosen = [s for s in STAGES if (not only or s in only) and s not in (skip or [])
                  and (s != "manifest" or self._manifest)]
        for stage in chosen:
            for inner in INNER.get(stage, []):
                self.build(inner)
            self.build(stage)
            if stage == "quality" and fail_on_error:
                quality.require_passed(self.table("quality"))
        return chosen

    def export(self, out: str) -> None:
        """CSV, JSON and GeoJSON copies of the result tables that exist."""
        flat = {"hotspots": "hotspots", "allocation": "resource_allocation",
                "forecasts": "forecasts", "forecast_metrics": "forecast_metrics",
                "kmeans_zones": "hotspots_kmeans_zones", "road_health": "road_health"}
        for name, target in flat.items():
            if self.exists(name):
                files.write_csv(self.table(name), f"{out}/{target}")
        if self.exists("hotspots"):
            hotspots.write_geojson(self.table("hotspots"), f"{out}/hotspots_geojson")
        if self.exists("forecasts"):
            files.write_csv(forecasting.forecast_summary(self.table("forecasts")),
                            f"{out}/forecast_summary")
        if self.exists("quality"):
            files.write_json(self.table("quality"), f"{out}/validation_report")


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), p) for c, p in places.items()})
