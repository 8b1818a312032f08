"""Model registry: fitted pipelines and an append-only table of runs."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

RUN_SCHEMA = (
    "task string, created_at timestamp_ntz, path string, best_model string, params string, "
    "metrics map<string,double>, features array<string>, n_features int, threshold double, "
    "cv_scores map<string,double>, n_train long, n_test long, "
    "importances array<struct<feature:string,importance:double>>")


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.runs_path = spark, root, f"{root}/model_runs"

    def log_run(self, run: dict) -> str:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        path = f"{self.root}/{run['task']}/{now:%Y%m%dT%H%M%S%f}"
        run["model"].write().overwrite().save(path)
        metrics = {k: float(v) for k, v in run["metrics"].items() if v is not None}
        row = (run["task"], now, path, run["best_model"], json.dumps(run["params"]), metrics,
               run["features"], len(run["features"]), float(run["threshold"]),
               run["cv_scores"], run["n_train"], run["n_test"],
               [tuple(i) for i in run["importances"]])
        self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(
            self.runs_path)
        return path

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(self.runs_path)

    def latest(self) -> DataFrame:
        """The newest run of each task."""
        columns = [c for c in self.runs().columns if c != "task"]
        return self.runs().groupBy("task").agg(
            F.max_by(F.struct(*columns), F.struct("created_at", "path")).alias("r")).select(
            "task", "r.*")

    def metadata(self, task: str) -> dict:
        row = self.latest().filter(F.col("task") == task).first()
        if row is None:
            raise FileNotFoundError(f"no registered model for task '{task}'")
        return row.asDict()

    def load(self, task: str) -> PipelineModel:
        return PipelineModel.load(self.metadata(task)["path"])
