"""Trained runs in the shared folder, found again by what they were trained on and how.

A run's folder is named by a hash of its training rows, its task, its options and the training code,
and gets that name in one step when it is complete. Whoever asks for the same run again, in another query, session
or job, loads it; two jobs that train it at the same time end with one folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from curbsight import settings as S
from curbsight.functions import storage
from curbsight.functions.lineage import scratch, shared_folder
from curbsight.learning import forest, prepare, train
from curbsight.learning.prepare import label_table



def code_version() -> str:
    """A hash of the training code: models of other code are never taken for those of this one."""
    h = hashlib.sha256()
    for module in (prepare, train, forest):
        h.update(module.__loader__.get_data(module.__file__))
    return h.hexdigest()


def fingerprint(table: DataFrame) -> str:
    """A hash of the rows of ``table`` in any order and any partitioning."""
    h = F.xxhash64(*[F.col(c) for c in table.columns])
    row = table.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("s"),
                    F.bit_xor(F.xxhash64(h)).alias("x")).first()
    return hashlib.sha256(json.dumps([table.dtypes, row["n"], row["s"], row["x"]]).encode()).hexdigest()


class ModelStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/curbsight/trained"

    def key(self, df: DataFrame, task: str, options: dict) -> str:
        about = {"rows": fingerprint(label_table(df, task)), "task": task, "options": options,
                 "settings": {k: v for k, v in vars(S).items() if k in S.TRAINING_SETTINGS},
                 "spec": S.TASKS[task], "spark": self.spark.version, "code": code_version()}
        return hashlib.sha256(json.dumps(about, sort_keys=True, default=str).encode()).hexdigest()

    def run(self, df: DataFrame, task: str, **options) -> dict:
        """The run of ``train.train_task(df, task, **options)``, trained unless it is stored."""
        path = f"{self.root}/{task}-{self.key(df, task, options)}"
        if not storage.exists(self.spark, path):
            with scratch(self.spark):
                self._save(train.train_task(df, task, **options), path)
        return self.load(path)

    def runs(self, df: DataFrame, tasks=tuple(S.TASKS), **options) -> dict[str, dict]:
        """The runs of several tasks; those that are not stored are trained side by side."""
        return dict(zip(tasks, train.side_by_side(
            [lambda t=t: self.run(df, t, **options) for t in tasks], df.count())))

    def _save(self, run: dict, path: str) -> None:
        draft = f"{self.root}/draft-{uuid.uuid4().hex}"
        try:
            run["model"].write().save(f"{draft}/model")
            run["held_out"].write.parquet(f"{draft}/held_out")
            record = {k: v for k, v in run.items() if k not in ("model", "held_out")}
            storage.write_text(self.spark, f"{draft}/record.json", json.dumps(record))
            storage.publish(self.spark, draft, path)
        finally:
            storage.remove(self.spark, draft)

    def load(self, path: str) -> dict:
        record = json.loads(storage.read_text(self.spark, f"{path}/record.json"))
        model = PipelineModel.load(f"{path}/model")
        last = len(model.stages) - 1
        nodes = f"{path}/model/stages/{last:0{len(str(last + 1))}d}_{model.stages[last].uid}/data"
        if hasattr(model.stages[last], "totalNumNodes") and storage.exists(self.spark, nodes):
            model.stages[last].nodes_at = nodes
        return {**record, "model": model, "held_out": self.spark.read.parquet(f"{path}/held_out")}
