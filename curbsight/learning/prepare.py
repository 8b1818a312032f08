"""Label tables, stable splits and the preprocessing stages of the models."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (Imputer, OneHotEncoder, SQLTransformer, StandardScaler,
                                StringIndexer, VectorAssembler, VectorSlicer)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C

# Digits of the hash that name a bucket: 65,536 of them.
RANK_DIGITS = 4
RARE = "(rare)"


def feature_names(task: str, columns: list[str]) -> tuple[list[str], list[str]]:
    """Categorical and numeric features of a task; leakage columns never take part."""
    banned = set(S.TASKS[task]["leakage"])
    pick = lambda names: [c for c in names if c in columns and c not in banned]
    return pick(S.CATEGORICAL_FEATURES), pick(S.NUMERIC_FEATURES)


def label_table(df: DataFrame, task: str) -> DataFrame:
    """id, label and the features of a task; rows without a target drop out."""
    spec = S.TASKS[task]
    target = spec["target"]
    if target not in df.columns:
        raise KeyError(f"no target column '{target}'")
    if spec["kind"] == "classification":
        label = (F.lower(F.col(target).cast("string")) == spec["positive"].lower()).cast("double")
    else:
        label = C.clip(F.col(target).cast("double"), *spec["clip"])
    text, numbers = feature_names(task, df.columns)
    return df.filter(F.col(target).isNotNull()).select(
        "id", label.alias("label"), *text,
        *[F.col(c).cast("double").alias(c) for c in numbers])


def _order(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")))


def class_ranks(table: DataFrame, stratum: Column, seed: int) -> DataFrame:
    """``table`` with ``_rank`` (from 1) and ``_n``: the place of a row in its class, by a hash of its id.

    Exact, without a task that ranks a whole class: the first digits of the hash are a bucket,
    rows rank within their bucket, and buckets get the number of rows before them.
    """
    hashed = table.withColumns({"_class": stratum, "_order": _order(seed)}).withColumn(
        "_bucket", F.substring("_order", 1, RANK_DIGITS))
    held = hashed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_held"))
    whole = Window.partitionBy("_class")
    held = held.withColumns({
        "_before": F.sum("_held").over(whole.orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, -1)),
        "_n": F.sum("_held").over(whole)})
    inside = Window.partitionBy("_class", "_bucket").orderBy("_order", "id")
    return hashed.withColumn("_place", F.row_number().over(inside)).join(
        held, ["_class", "_bucket"]).withColumn(
        "_rank", F.coalesce("_before", F.lit(0)) + F.col("_place")).drop(
        "_class", "_bucket", "_order", "_held", "_before", "_place")


def _stratum(table: DataFrame, task: str) -> Column:
    return F.col("label") if S.TASKS[task]["kind"] == "classification" else F.lit(0.0)


def split(table: DataFrame, task: str, fraction: float = S.TEST_FRACTION,
          seed: int = S.SEED) -> DataFrame:
    """Adds ``is_test``: of each class the first ``fraction`` of rows (rounded up) by a hash of the id.

    A row stays on its side however the table is partitioned.
    """
    return class_ranks(table, _stratum(table, task), seed).withColumn(
        "is_test", F.col("_rank") <= F.ceil(F.col("_n") * F.lit(fraction))).drop("_rank", "_n")


def folds(table: DataFrame, k: int, seed: int = S.SEED, task: str | None = None) -> DataFrame:
    """Adds ``fold``; with a classification ``task``, every fold holds each class within one row."""
    stratum = _stratum(table, task) if task else F.lit(0.0)
    return class_ranks(table, stratum, seed + 1).withColumn(
        "fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def balanced_weights(table: DataFrame) -> DataFrame:
    """Adds ``weight``: rows / (2 * rows of the class)."""
    counts = table.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))).scalar()
    own = F.when(F.col("label") == 1, counts["pos"]).otherwise(counts["n"] - counts["pos"])
    return table.withColumn("weight", F.coalesce(F.try_divide(counts["n"], own * 2), F.lit(1.0)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class LevelPooler(Estimator):
    """Fill missing levels with the most frequent one and pool levels with few rows.

    A level that training did not see becomes null, which later stages encode as all zeros.
    The fitted stage is a plain SQL transformer.
    """

    inputCols = Param(Params._dummy(), "inputCols", "text columns", TypeConverters.toListString)
    minRows = Param(Params._dummy(), "minRows", "rows a level needs", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, minRows=S.RARE_LEVEL_ROWS):
        super().__init__()
        self._setDefault(minRows=S.RARE_LEVEL_ROWS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        names = self.getOrDefault(self.inputCols)
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in names])
        # One row per level of a text column: thousands, not the rows of the table.
        counts = dataset.select(F.explode(pairs).alias("p")).select("p.*").filter(
            "v IS NOT NULL").groupBy("c", "v").count().collect()
        levels = {c: {} for c in names}
        for row in counts:
            levels[row["c"]][row["v"]] = row["count"]
        minimum = self.getOrDefault(self.minRows)
        parts = []
        for c in names:
            seen = levels[c]
            if not seen:
                parts.append(f"CAST(NULL AS STRING) AS `{c}_level`")
                continue
            mode = min(seen, key=lambda v: (-seen[v], v))
            often = sorted(v for v, n in seen.items() if n >= minimum)
            rare = sorted(v for v, n in seen.items() if n < minimum)
            filled = f"coalesce(`{c}`, {_quoted(mode)})"
            cases = ""
            if often:
                cases += f" WHEN {filled} IN ({', '.join(map(_quoted, often))}) THEN {filled}"
            if rare:
                cases += f" WHEN {filled} IN ({', '.join(map(_quoted, rare))}) THEN '{RARE}'"
            parts.append(f"CASE{cases} END AS `{c}_level`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


class ImportanceSelector(Estimator):
    """Keep the vector slots a forest finds most important; the fitted stage slices them."""

    topK = Param(Params._dummy(), "topK", "slots to keep", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "trees of the forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the forest", TypeConverters.toInt)
    kind = Param(Params._dummy(), "kind", "classification or regression", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, kind="classification", topK=S.TOP_FEATURES,
                 numTrees=S.SELECTOR_TREES, maxDepth=S.SELECTOR_DEPTH):
        super().__init__()
        self._setDefault(kind="classification", topK=S.TOP_FEATURES,
                         numTrees=S.SELECTOR_TREES, maxDepth=S.SELECTOR_DEPTH)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        get = self.getOrDefault
        cls = RandomForestClassifier if get(self.kind) == "classification" else RandomForestRegressor
        forest = cls(featuresCol="prepared", labelCol="label", seed=S.SEED, maxMemoryInMB=1024,
                     numTrees=get(self.numTrees), maxDepth=get(self.maxDepth)).fit(dataset)
        weights = forest.featureImportances.toArray()
        order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
        return VectorSlicer(inputCol="prepared", outputCol="features",
                            indices=sorted(order[:get(self.topK)]))


def preprocessing(task: str, columns: list[str], output: str = "features") -> list:
    """Stages from feature columns to one vector: pooled one-hot text, scaled numbers."""
    text, numbers = feature_names(task, columns)
    stages, inputs = [], []
    if text:
        levels, indexes = [f"{c}_level" for c in text], [f"{c}_index" for c in text]
        stages += [
            LevelPooler(inputCols=text),
            StringIndexer(inputCols=levels, outputCols=indexes, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            # dropLast drops the slot of unseen levels, which leaves them all zeros.
            OneHotEncoder(inputCols=indexes, outputCols=[f"{c}_hot" for c in text],
                          dropLast=True),
        ]
        inputs += [f"{c}_hot" for c in text]
    filled = [f"{c}_filled" for c in numbers]
    stages += [
        Imputer(strategy="median", inputCols=numbers, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numbers", handleInvalid="keep"),
        StandardScaler(inputCol="numbers", outputCol="numbers_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=[*inputs, "numbers_scaled"], outputCol=output,
                        handleInvalid="keep"),
    ]
    return stages
