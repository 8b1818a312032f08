"""Forests of large tables: whole trees grown in tasks, read back as Spark ML models.

Spark grows all trees of a forest together, one job per level, and each job sends the statistics of all open
nodes once per partition. Here the rows are written once as a table of bins (a byte per number, a bit per
one-hot slot, in the order of a hash); a task reads it and grows a few whole trees over all of its rows,
so that nothing is sent between levels. Rules are those of Spark's trainer: Poisson counts of rows per tree, a
draw of features per node, the best cut by Gini impurity or variance, leaves that agree are joined. Random numbers
belong to the tree and the node, so models do not change with the partitioning. The nodes are written the way
Spark stores a model, and Spark loads them: what comes out is a Spark model like any other.
"""

from __future__ import annotations

import dataclasses
import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from curbsight.functions import storage
from curbsight.functions.lineage import new_table_path

PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Tables of fewer rows cost little in Spark's own trainer. A worker holds some 40 bytes a row, so that larger
# tables stay with Spark's, which keeps its rows apart.
ROWS_OF_TASK = (40_000, 12_000_000)
TREES_OF_TASK = 5
# Rows of a node that is split on its own, and rows of smaller nodes that are split together.
LARGE_NODE, SMALL_ROWS = 8_192, 16_384
MOST_BINS = 128
# A forest of that many nodes is scored tree by tree, so many rows at a time.
NODES_OF_LARGE_FOREST, SCORED_ROWS = 50_000, 4_096
FEATURES = "_features"
# A number with more values than that gets cuts at quantiles.
LISTED_VALUES = 64
NO_GAIN = 1e-12
# What the trainer here knows; any other setting is Spark's case.
KNOWN = {"impurity": ("gini", "variance"), "minInfoGain": (0.0,), "minWeightFractionPerNode": (0.0,),
         "minInstancesPerNode": (1,), "subsamplingRate": (1.0,), "bootstrap": (True,), "featureSubsetStrategy": ("auto",)}
NODE_FIELDS = (
    "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, "
    "gain double, leftChild int, rightChild int, featureIndex int, cut array<double>, numCategories int")


def suits(estimator, rows: int) -> bool:
    """Whether ``fit`` takes this estimator and table."""
    return (
        isinstance(estimator, (RandomForestClassifier, RandomForestRegressor))
        and ROWS_OF_TASK[0] <= rows <= ROWS_OF_TASK[1]
        and all(estimator.getOrDefault(k) in known for k, known in KNOWN.items()))


def in_tasks(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose workers can import this package from where the driver has it."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_HOME])
    return df.mapInArrow(fn, schema)


# -- bins ------------------------------------------------------------------------------

@dataclasses.dataclass
class Bins:
    """How a feature vector becomes bytes: a byte per number, then seven one-hot slots per byte; the top bit is free."""

    cuts: dict[int, np.ndarray]  # slot of a number -> its cuts, ascending; left of a cut is what is not above it
    binary: list[int]            # slots of two values, 0 and 1

    @property
    def slots(self) -> int:
        return len(self.cuts) + len(self.binary)

    @property
    def width(self) -> int:
        return len(self.cuts) + (len(self.binary) + 6) // 7

    def codes(self, values: np.ndarray) -> np.ndarray:
        """The bytes (rows x width) of feature vectors (rows x slots)."""
        out = np.zeros((len(values), self.width), np.uint8)
        for i, (slot, cuts) in enumerate(self.cuts.items()):
            out[:, i] = np.searchsorted(cuts, values[:, slot])
        for i, slot in enumerate(self.binary):
            out[:, len(self.cuts) + i // 7] |= (values[:, slot] != 0).astype(np.uint8) << (i % 7)
        return out

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per slot its byte, its bit there (-1 for a number) and its number of bins."""
        column, bit, n_bins = np.zeros(self.slots, np.int64), np.full(self.slots, -1), np.full(self.slots, 2)
        for i, (slot, cuts) in enumerate(self.cuts.items()):
            column[slot], n_bins[slot] = i, len(cuts) + 1
        for i, slot in enumerate(self.binary):
            column[slot], bit[slot] = len(self.cuts) + i // 7, i % 7
        return column, bit, n_bins


def bins_of(prepared: DataFrame, estimator) -> tuple[Bins, tuple[float, float]]:
    """Cuts of every number from all rows of ``prepared``, and the weight of either class.

    Cuts lie between all values of a number if they are few, else at its quantiles.
    """
    features, most = estimator.getFeaturesCol(), min(estimator.getMaxBins(), MOST_BINS)
    attrs = prepared.schema[features].metadata["ml_attr"]
    binary = sorted(a["idx"] for a in attrs["attrs"].get("binary", []))
    held = set(binary)
    numbers = [i for i in range(attrs["num_attrs"]) if i not in held]
    column = vector_to_array(features)
    # Missing and infinite values give no cut.
    weighted = estimator.hasParam("weightCol") and estimator.isSet("weightCol")
    weight = F.col(estimator.getWeightCol()) if weighted else F.lit(1.0)
    values = prepared.select(*[
        F.when(F.abs(column[i]) < math.inf, column[i]).alias(f"n{i}") for i in numbers],
        *[F.when((F.col(estimator.getLabelCol()) > 0.5) == c, weight).alias(f"w{c:d}") for c in (False, True)])
    w0, w1, v0, v1, *counts = values.agg(
        F.min("w0"), F.min("w1"), F.max("w0"), F.max("w1"),
        *[F.approx_count_distinct(f"n{i}") for i in numbers]).first()
    if (w0, w1) != (v0, v1):
        raise ValueError("rows of one class have different weights")
    few = {i for i, n in zip(numbers, counts) if n <= LISTED_VALUES}
    shares = [q / most for q in range(1, most)]
    row = values.agg(F.count(F.lit(1)), *[
        F.array_sort(F.collect_set(f"n{i}")) if i in few else F.percentile_approx(f"n{i}", F.lit(shares))
        for i in numbers]).first()[1:]
    cuts = {}
    for i, found in zip(numbers, row):
        at = np.unique(np.array(found or [], float))
        if i in few and len(at) <= most:
            at = (at[1:] + at[:-1]) / 2
        elif i in few:
            at = at[np.unique(np.arange(1, most) * len(at) // most)]
        cuts[i] = at
    return Bins(cuts, binary), tuple(1.0 if w is None else float(w) for w in (w0, w1))


def write_bins(prepared: DataFrame, bins: Bins, estimator, path: str) -> None:
    """Write (codes, label) of all rows to ``path``, in the order of a hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = bins.codes(batch.column(2).flatten().to_numpy().reshape(-1, bins.slots))
            data = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(bins.width), len(codes), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), data.cast(pa.binary()), batch.column(1)], ["id", "codes", "label"])

    rows = in_tasks(prepared.select(
        F.xxhash64(F.col("id").cast("string")).alias("id"), F.col(estimator.getLabelCol()).cast("double").alias("label"),
        vector_to_array(estimator.getFeaturesCol()).alias("x")), run, "id long, codes binary, label double")
    # Rows that are equal in all of this are interchangeable.
    order = ["at", "id", "codes", "label"]
    rows.withColumn("at", F.xxhash64(*order[1:])).orderBy(*order).select("codes", "label").write.parquet(path)


def read_bins(path: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    store, folder = pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet"))
    codes, labels = [], []
    for name in files:
        table = pq.read_table(store.open_input_file(name))
        for batch in table.to_batches():
            data = batch.column(0).cast(pa.binary(width))
            codes.append(np.frombuffer(data.buffers()[1], np.uint8).reshape(-1, width)[data.offset:data.offset + len(data)])
            labels.append(batch.column(1).to_numpy())
    return np.concatenate(codes), np.concatenate(labels)


# -- trees -----------------------------------------------------------------------------

@dataclasses.dataclass
class Growth:
    """What a tree needs to know besides its rows."""

    bins: Bins
    class_weights: tuple[float, float] | None  # None in a regression
    depth: int
    draw: int                                  # features looked at per node
    seed: int


class Rows:
    """The rows of a forest in a worker: a byte array per column, and the labels."""

    def __init__(self, codes: np.ndarray, labels: np.ndarray, growth: Growth):
        self.bins, self.classes = growth.bins, growth.class_weights is not None
        self.factors = np.array(growth.class_weights or (1.0, 1.0))
        self.columns = np.ascontiguousarray(codes.T)
        self.y = labels
        if self.classes:
            # The free bit of every byte tells the class, so that one count per byte splits by class.
            self.y = (labels > 0.5).astype(np.uint8)
            self.columns |= self.y << 7
        self.column, self.bit, self.n_bins = growth.bins.places()
        self.has_bit = ((np.arange(128) >> np.arange(7)[:, None]) & 1).astype(float)

    def __len__(self) -> int:
        return len(self.y)

    def values(self, slot: int, rows: np.ndarray) -> np.ndarray:
        """The bins of one slot."""
        held = self.columns[self.column[slot]].take(rows)
        return held & 127 if self.bit[slot] < 0 else (held >> self.bit[slot]) & 1

    def statistics(self, rows, count, node, k: int) -> np.ndarray:
        """Per node the rows of both classes, or rows, sum and sum of squares of the labels."""
        own = self.y[rows]
        if self.classes:
            return np.bincount(node * 2 + own, count, 2 * k).reshape(k, 2)
        return np.stack([np.bincount(node, count, k), np.bincount(node, count * own, k),
                         np.bincount(node, count * own * own, k)], 1)

    def purity(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prediction and impurity of nodes."""
        if self.classes:
            stats = stats * self.factors
            share = stats / stats.sum(1, keepdims=True)
            return (share[:, 1] > share[:, 0]).astype(float), 1 - (share ** 2).sum(1)
        mean = stats[:, 1] / stats[:, 0]
        return mean, np.maximum(stats[:, 2] / stats[:, 0] - mean ** 2, 0)

    def best_cuts(self, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, totals: np.ndarray):
        """Per node the gain, the drawn feature and the bin of its best cut; the first of equal ones.

        ``one`` and ``two`` hold for every bin of every drawn feature (nodes x features x bins, ``sizes`` bins each)
        the rows of both classes, or the rows and the sum of their labels.
        """
        k, drawn = sizes.shape
        each = sizes.reshape(-1)
        begin = np.cumsum(each) - each
        left = []
        for held in (one, two):
            run = np.cumsum(held)
            left.append(run - np.repeat(run[begin] - held[begin], each))
        per_node = sizes.sum(1)
        node = np.repeat(np.arange(k), per_node)
        right = [totals[:, i].take(node) - left[i] for i in (0, 1)]
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.classes:
                a, b = self.factors
                empty = (left[0] + left[1] == 0) | (right[0] + right[1] == 0)
                score = sum(((x * a) ** 2 + (z * b) ** 2) / (x * a + z * b) for x, z in (left, right))
                weights = totals[:, 0] * a + totals[:, 1] * b
                own = ((totals[:, 0] * a) ** 2 + (totals[:, 1] * b) ** 2) / weights
            else:
                empty = (left[0] == 0) | (right[0] == 0)
                score = left[1] ** 2 / left[0] + right[1] ** 2 / right[0]
                weights, own = totals[:, 0], totals[:, 1] ** 2 / totals[:, 0]
        score[empty] = -np.inf
        best = np.maximum.reduceat(score, np.cumsum(per_node) - per_node)
        hits = np.flatnonzero(score == best.take(node))
        at = hits[np.unique(node[hits], return_index=True)[1]]
        feature = np.repeat(np.arange(k * drawn), each)[at]
        return (best - own) / weights, feature % drawn, at - begin[feature]


class Tree:
    """One tree. Large nodes are split one by one from counts per byte; small ones many at a time."""

    def __init__(self, rows: Rows, growth: Growth, number: int):
        self.rows, self.growth = rows, growth
        self.rng = np.random.default_rng([growth.seed, number])
        self.stats, self.splits, self.made = [], [], 0

    def _drawn(self, k: int) -> np.ndarray:
        draws = self.rng.random((k, self.growth.bins.slots))
        return np.argsort(draws, axis=1)[:, :self.growth.draw]

    def _add(self, stats: np.ndarray) -> np.ndarray:
        ids = np.arange(self.made, self.made + len(stats))
        self.made += len(stats)
        self.stats.append(stats)
        return ids

    def _split(self, ids, feature, cut, gain, stats) -> tuple[np.ndarray, np.ndarray]:
        """Note splits of nodes whose children have ``stats``; the ids of the children and whether they may split."""
        children = self._add(stats)
        self.splits.append((ids, feature, cut, gain, children[::2], children[1::2]))
        return children, self.rows.purity(stats)[1] > NO_GAIN

    def grown(self) -> dict[str, np.ndarray]:
        n, rng = len(self.rows), self.rng
        counts = np.concatenate([rng.poisson(1.0, min(1 << 20, n - s)).astype(np.uint8) for s in range(0, n, 1 << 20)])
        rows = np.flatnonzero(counts).astype(np.int32)
        count = counts[rows]
        if not len(rows):  # a tree without rows predicts from all of them
            rows, count = np.arange(n, dtype=np.int32), np.ones(n, np.uint8)
        root = self.rows.statistics(rows, count, np.zeros(len(rows), np.int64), 1)
        stack, small, waiting = [(self._add(root)[0], rows, count, 0, root[0])], [], 0
        if self.rows.purity(root)[1][0] <= NO_GAIN:
            stack = []
        while stack:
            node = stack.pop()
            if len(node[1]) >= LARGE_NODE:
                stack += self._large(*node)
            else:
                small.append(node)
                waiting += len(node[1])
            if small and (waiting >= SMALL_ROWS or not stack):
                self._small(small)
                small, waiting = [], 0
        return self._nodes()

    def _large(self, node: int, rows, count, depth: int, total) -> list[tuple]:
        held = self.rows
        weight = count.astype(float)
        moments = None if held.classes else weight * held.y[rows]
        drawn = self._drawn(1)[0]
        per_byte = {}
        for c in set(held.column[drawn].tolist()):
            code = held.columns[c].take(rows)
            if held.classes:
                found = np.bincount(code, weight, 256)
                per_byte[c] = found[:128], found[128:]
            else:
                per_byte[c] = np.bincount(code, weight, 128), np.bincount(code, moments, 128)
        one, two = [], []
        for slot in drawn.tolist():
            for out, found, whole in zip((one, two), per_byte[int(held.column[slot])], total):
                if held.bit[slot] < 0:
                    out.append(found[:held.n_bins[slot]])
                else:
                    ones = float(held.has_bit[held.bit[slot]] @ found)
                    out.append(np.array([whole - ones, ones]))
        gain, which, cut = held.best_cuts(
            np.concatenate(one), np.concatenate(two), held.n_bins[drawn][None], total[None, :2])
        if gain[0] <= NO_GAIN:
            return []
        right = held.values(drawn[which[0]], rows) > cut[0]
        sides = [(rows[m], count[m]) for m in (~right, right)]
        stats = np.concatenate([held.statistics(r, c, np.zeros(len(r), np.int64), 1) for r, c in sides])
        children, is_open = self._split(np.array([node]), drawn[which], cut, gain, stats)
        return [(i, r, c, depth + 1, s) for i, (r, c), s, o in zip(children, sides, stats, is_open)
                if o and depth + 1 < self.growth.depth]

    def _small(self, nodes: list[tuple]) -> None:
        held, slots = self.rows, self.growth.bins.slots
        rows = np.concatenate([n[1] for n in nodes])
        values = np.empty((len(rows), slots), np.uint8)
        for slot in range(slots):
            values[:, slot] = held.values(slot, rows)
        values = values.reshape(-1)
        weight = np.concatenate([n[2] for n in nodes]).astype(float)
        node = np.repeat(np.arange(len(nodes)), [len(n[1]) for n in nodes])
        ids, depth = np.array([n[0] for n in nodes]), np.array([n[3] for n in nodes])
        totals, y = np.array([n[4] for n in nodes]), held.y[rows]
        at = np.arange(len(rows))
        while len(ids):
            k = len(ids)
            drawn = self._drawn(k)
            sizes = held.n_bins[drawn]
            each = sizes.reshape(-1)
            begin, length = (np.cumsum(each) - each).reshape(k, -1), int(each.sum())
            key = begin.take(node, axis=0)
            key += values.take(drawn.take(node, axis=0) + (at * slots)[:, None])
            if held.classes:
                key += (y[at].astype(np.int64) * length)[:, None]
                found = np.bincount(key.reshape(-1), np.repeat(weight, key.shape[1]), 2 * length)
                one, two = found[:length], found[length:]
            else:
                key = key.reshape(-1)
                one = np.bincount(key, np.repeat(weight, drawn.shape[1]), length)
                two = np.bincount(key, np.repeat(weight * y[at], drawn.shape[1]), length)
            gain, which, cut = held.best_cuts(one, two, sizes, totals[:, :2])
            split = gain > NO_GAIN
            if not split.any():
                return
            feature = drawn[np.arange(k), which]
            inside = split[node]
            at, weight, node = at[inside], weight[inside], node[inside]
            right = values.take(at * slots + feature.take(node)) > cut.take(node)
            child = (np.cumsum(split) - 1).take(node) * 2 + right
            stats = held.statistics(rows[at], weight, child, 2 * int(split.sum()))
            children, is_open = self._split(ids[split], feature[split], cut[split], gain[split], stats)
            depth = np.repeat(depth[split], 2) + 1
            is_open &= depth < self.growth.depth
            inside = is_open[child]
            at, weight, node = at[inside], weight[inside], (np.cumsum(is_open) - 1)[child[inside]]
            ids, depth, totals = children[is_open], depth[is_open], stats[is_open]

    def _nodes(self) -> dict[str, np.ndarray]:
        """The nodes with parents before children, root first."""
        stats = np.concatenate(self.stats)
        raw = stats.sum(1) if self.rows.classes else stats[:, 0]
        nodes = {"raw": raw.astype(np.int64), "gain": np.full(self.made, -1.0)}
        nodes |= {name: np.full(self.made, -1, np.int64) for name in ("left", "right", "feature", "cut")}
        for ids, *columns in self.splits:
            for name, values in zip(("feature", "cut", "gain", "left", "right"), columns):
                nodes[name][ids] = values
        nodes["prediction"], nodes["impurity"] = self.rows.purity(stats)
        nodes["stats"] = stats * self.rows.factors if self.rows.classes else stats
        return pruned(nodes)


def pruned(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Join leaves of one parent that predict the same, from the bottom up, and number the nodes that stay."""
    left, right, said = nodes["left"].tolist(), nodes["right"].tolist(), nodes["prediction"].tolist()
    for i in range(len(left) - 1, -1, -1):
        a, b = left[i], right[i]
        if a >= 0 and left[a] < 0 and left[b] < 0 and said[a] == said[b]:
            left[i] = right[i] = -1
    stays = [False] * len(left)
    stays[0] = True
    for i, a in enumerate(left):
        if a >= 0 and stays[i]:
            stays[a] = stays[right[i]] = True
    kept = np.array(stays)
    number = np.cumsum(kept) - 1
    out = {name: values[kept] for name, values in nodes.items()}
    leaf = np.array(left)[kept] < 0
    for name in ("left", "right"):
        out[name] = np.where(leaf, -1, number[out[name]])
    out["gain"][leaf], out["feature"][leaf] = -1.0, -1
    return out


def _node_batch(tree: int, nodes: dict[str, np.ndarray], bins: Bins) -> pa.RecordBatch:
    n = len(nodes["left"])
    binary = set(bins.binary)
    cuts = [[] if f < 0 else [0.0] if f in binary else [float(bins.cuts[f][c])]
            for f, c in zip(nodes["feature"].tolist(), nodes["cut"].tolist())]
    kinds = [2 if f in binary else -1 for f in nodes["feature"].tolist()]
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, tree, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(nodes["prediction"]),
        pa.array(nodes["impurity"]), pa.array(nodes["stats"].tolist(), pa.list_(pa.float64())), pa.array(nodes["raw"]),
        pa.array(nodes["gain"]), pa.array(nodes["left"].astype(np.int32)), pa.array(nodes["right"].astype(np.int32)),
        pa.array(nodes["feature"].astype(np.int32)), pa.array(cuts, pa.list_(pa.float64())),
        pa.array(kinds, pa.int32())], [f.split()[0] for f in NODE_FIELDS.split(", ")])


# -- model -----------------------------------------------------------------------------

def fit(estimator, prepared: DataFrame):
    """The model of a forest ``estimator`` over ``prepared`` (id, label, features and perhaps a weight)."""
    spark = prepared.sparkSession
    rows_at, path = new_table_path(spark, "bins"), new_table_path(spark, "forest")
    bins, weights = bins_of(prepared, estimator)
    write_bins(prepared, bins, estimator, rows_at)
    classes = isinstance(estimator, RandomForestClassifier)
    trees = estimator.getNumTrees()
    share = math.ceil(math.sqrt(bins.slots)) if classes else math.ceil(bins.slots / 3)
    growth = Growth(bins, weights if classes else None, estimator.getMaxDepth(),
                    share if trees > 1 else bins.slots, estimator.getSeed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                held = held or Rows(*read_bins(rows_at, bins.width), growth)
                yield _node_batch(tree, Tree(held, growth, tree).grown(), bins)

    nodes = in_tasks(spark.range(0, trees, 1, math.ceil(trees / TREES_OF_TASK)), run, NODE_FIELDS)
    nodes.select("treeID", F.struct(
        "id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild",
        F.struct("featureIndex", F.col("cut").alias("leftCategoriesOrThreshold"), "numCategories").alias("split")
    ).alias("nodeData")).write.parquet(f"{path}/data")
    model = RandomForestClassificationModel if classes else RandomForestRegressionModel
    _write_description(spark, estimator, bins.slots, path, model)
    loaded = model.load(path)
    loaded.nodes_at = f"{path}/data"
    return loaded


def _write_description(spark: SparkSession, estimator, slots: int, path: str, model) -> None:
    """The parts of a stored forest besides its nodes."""
    package = "classification" if model is RandomForestClassificationModel else "regression"
    kind = package.capitalize()

    def described(name: str, uid: str, dropped: tuple[str, ...], **more) -> str:
        values = {p.name: v for p, v in estimator._paramMap.items() if p.name not in dropped}
        defaults = {p.name: v for p, v in estimator._defaultParamMap.items() if p.name not in dropped}
        return json.dumps({"class": f"org.apache.spark.ml.{package}.{name}", "timestamp": int(time.time() * 1000),
                           "sparkVersion": spark.version, "uid": uid, "paramMap": values,
                           "defaultParamMap": defaults, **more})

    trees = estimator.getNumTrees()
    classes = {"numClasses": 2} if package == "classification" else {}
    alone = ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")
    spark.createDataFrame(
        [(i, described(f"DecisionTree{kind}Model", f"tree_{uuid.uuid4().hex[:12]}", alone), 1.0) for i in range(trees)],
        "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    storage.write_text(spark, f"{path}/metadata/part-00000", described(
        f"RandomForest{kind}Model", estimator.uid, (), numFeatures=slots, **classes, numTrees=trees) + "\n")


# -- scores ----------------------------------------------------------------------------

@dataclasses.dataclass
class Nodes:
    """The nodes of all trees one after another; a leaf is its own child."""

    roots: np.ndarray
    depths: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray          # left and right child of node i at 2 i and 2 i + 1
    values: list[np.ndarray]   # share of both classes, or the predicted number

    def sums(self, x: np.ndarray) -> list[np.ndarray]:
        """The sums of ``values`` over the trees for each row of ``x``, added up in the order of the trees."""
        out = [np.zeros(len(x)) for _ in self.values]
        start, x = np.arange(len(x)) * x.shape[1], x.reshape(-1)
        for root, depth in zip(self.roots.tolist(), self.depths.tolist()):
            at = np.full(len(start), root)
            for _ in range(depth):
                # What is not a number goes right, as in Spark.
                right = ~(x.take(start + self.feature.take(at)) <= self.threshold.take(at))
                at = self.child.take(at * 2 + right)
            for total, values in zip(out, self.values):
                total += values.take(at)
        return out


def nodes_of(spark: SparkSession, model) -> Nodes | None:
    """The nodes of a forest; None if a split has more than two categories."""
    if getattr(model, "nodes_at", None) is None:
        path = new_table_path(spark, "forest")
        model.write().save(path)
        model.nodes_at = f"{path}/data"
    table = spark.read.parquet(model.nodes_at).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
        F.col("nodeData.split.numCategories").alias("categories"),
        F.get("nodeData.impurityStats", F.lit(0)).alias("one"),
        F.get("nodeData.impurityStats", F.lit(1)).alias("two")).toArrow()
    held = {name: table[name].to_numpy() for name in table.column_names}
    order = np.lexsort((held["id"], held["treeID"]))
    held = {name: values[order] for name, values in held.items()}
    if (held["categories"] > 2).any():
        return None
    roots = np.flatnonzero(held["id"] == 0)
    first = np.repeat(roots, np.diff(np.append(roots, len(order))))
    inner, own = held["leftChild"] >= 0, np.arange(len(order))
    sides = [np.where(inner, held[side] + first, own) for side in ("leftChild", "rightChild")]
    # Of two categories, the one that goes left is 0 or 1.
    swapped = (held["categories"] == 2) & (held["cut"] == 1)
    child = np.stack([np.where(swapped, sides[1], sides[0]), np.where(swapped, sides[0], sides[1])], 1)
    depths, at, trees = np.zeros(len(roots), np.int64), roots, np.arange(len(roots))
    while len(at):
        at, trees = at[inner[at]], trees[inner[at]]
        depths[np.unique(trees)] += 1
        at, trees = child[at].reshape(-1), np.repeat(trees, 2)
    if isinstance(model, RandomForestClassificationModel):
        total = held["one"] + held["two"]
        values = [held["one"] / total, held["two"] / total]
    else:
        values = [held["prediction"]]
    threshold = np.where(held["categories"] == 2, 0.5, np.nan_to_num(held["cut"].astype(float)))
    return Nodes(roots, depths, np.maximum(held["featureIndex"], 0).astype(np.int64), threshold,
                 child.reshape(-1), values)


def with_score(model: PipelineModel, df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``columns`` of ``df`` and ``name``: the probability of the second class, or the predicted number.

    A large forest is no longer found in a processor's cache row by row; rows go through it tree by tree then.
    The numbers are Spark's to the last bit.
    """
    last, spark = model.stages[-1], df.sparkSession
    nodes = None
    if isinstance(last, (RandomForestClassificationModel, RandomForestRegressionModel)):
        if last.totalNumNodes >= NODES_OF_LARGE_FOREST and set(last.treeWeights) == {1.0}:
            nodes = nodes_of(spark, last)
    if nodes is None:
        out = model.transform(df)
        score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        return out.select(*columns, score.alias(name))
    prepared = PipelineModel(model.stages[:-1]).transform(df).select(
        *columns, vector_to_array(last.getFeaturesCol()).alias(FEATURES))
    shared, slots, trees = spark.sparkContext.broadcast(nodes), last.numFeatures, len(nodes.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(s, SCORED_ROWS)
                sums = forest.sums(part.column(part.num_columns - 1).flatten().to_numpy().reshape(-1, slots))
                score = sums[1] / (sums[0] + sums[1]) if len(sums) == 2 else sums[0] / trees
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], [*columns, name])

    schema = T.StructType([*prepared.drop(FEATURES).schema.fields, T.StructField(name, T.DoubleType())])
    return in_tasks(prepared, run, schema)
