"""Document quality by attention over passages.

A document is a bag of passages. Each passage is described by shares of character classes, of
their transitions and of repeated words, and encoded by a small network. Gated attention, learned
from document labels alone, weighs the passages; the document's score comes from the weighted
sum of the encodings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from curbsight.llm.common import fold_of, in_tasks, packed, portions, record_batch, unpacked

PASSAGE = 600
# Texts are described in portions of so many bytes: each needs some hundred bytes per character.
PORTION = 1 << 19
HELD_OUT_FOLDS, HELD_OUT = 3, 1
# The model is fitted on at most so many labelled documents of each class, and on at most so
# many passages of each, evenly spread. Scoring uses every passage of every document.
TRAIN_DOCS_PER_CLASS = 3000
TRAIN_PASSAGES = 48
HIDDEN, GATE, EPOCHS, BATCH, RATE = 32, 16, 40, 64, 0.01

UPPER, LOWER, OTHER_LETTER, DIGIT, SPACE, STOP, SYMBOL, NEWLINE = range(8)
CLASSES = 8
SENTENCE_MARKS = ".,;:'\"?()-"
WORD_FEATURES = 9
FEATURES = CLASSES * CLASSES + 12 + WORD_FEATURES

_tables: dict[str, np.ndarray] = {}


def _class_of(c: str) -> int:
    if c == "\n":
        return NEWLINE
    if c.isspace():
        return SPACE
    if c.isalpha():
        return UPPER if c.isupper() else LOWER if c.islower() else OTHER_LETTER
    if c.isnumeric():
        return DIGIT
    return STOP if c in SENTENCE_MARKS else SYMBOL


def char_classes(points: np.ndarray) -> np.ndarray:
    if "classes" not in _tables:
        _tables["classes"] = np.fromiter(
            (_class_of(chr(i)) for i in range(1 << 16)), dtype=np.uint8, count=1 << 16)
    return _tables["classes"][np.minimum(points, (1 << 16) - 1)]


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``texts`` and, per text, the index of its first passage.

    Passages are runs of ``PASSAGE`` characters; an empty text is one empty passage.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = int(first[-1])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    in_text = np.arange(len(points)) - np.repeat(starts, lengths)
    passage = np.repeat(first[:-1], lengths) + in_text // PASSAGE
    cls = char_classes(points).astype(np.int64)
    size = np.bincount(passage, minlength=total).astype(np.float64)
    per = np.maximum(size, 1)

    out = np.zeros((total, FEATURES), dtype=np.float32)
    if len(points):
        same = passage[1:] == passage[:-1]
        pairs = (passage[:-1] * CLASSES + cls[:-1]) * CLASSES + cls[1:]
        out[:, :CLASSES * CLASSES] = np.bincount(
            pairs[same], minlength=total * CLASSES * CLASSES).reshape(total, -1) / per[:, None]
        at = CLASSES * CLASSES
        out[:, at:at + CLASSES] = np.bincount(
            passage * CLASSES + cls, minlength=total * CLASSES).reshape(total, -1) / per[:, None]
        doubled = same & (points[1:] == points[:-1])
        out[:, at + 8] = np.bincount(passage[1:][doubled], minlength=total) / per
        out[:, at + 9] = np.bincount(passage[points > 127], minlength=total) / per
        out[:, at + 10] = np.bincount(passage[points == ord("!")], minlength=total) / per
        out[:, at + 11] = np.log1p(size)
        out[:, at + 12:] = _word_features(points, cls, passage, total)
    return out, first


def _word_features(points, cls, passage, total) -> np.ndarray:
    inside = (cls != SPACE) & (cls != NEWLINE)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (passage[1:] != passage[:-1])
    where = np.flatnonzero(begins)
    out = np.zeros((total, WORD_FEATURES), dtype=np.float32)
    if not len(where):
        return out
    at = np.flatnonzero(inside)
    word = np.cumsum(begins)[at] - 1
    length = np.bincount(word, minlength=len(where))
    place = at - where[word]
    spread = (points[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread = (spread ^ (spread >> np.uint64(29))) * (2 * place.astype(np.uint64) + np.uint64(1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(spread)])
    ends = np.concatenate([[0], np.cumsum(length)])
    code = sums[ends[1:]] - sums[ends[:-1]]
    p = passage[where]
    n = np.bincount(p, minlength=total)
    per = np.maximum(n, 1)
    order = np.lexsort((code, p))
    new = np.ones(len(p), dtype=bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (p[order][1:] != p[order][:-1])
    again = np.zeros(len(p), dtype=bool)
    again[1:] = (code[1:] == code[:-1]) & (p[1:] == p[:-1])
    last = cls[where + length - 1]
    out[:, 0] = np.bincount(p[order][new], minlength=total) / per
    out[:, 1] = np.bincount(p[again], minlength=total) / per
    out[:, 2] = np.bincount(p, weights=length, minlength=total) / per / 10
    out[:, 3] = np.bincount(p[length > 14], minlength=total) / per
    out[:, 4] = np.bincount(p[length == 1], minlength=total) / per
    out[:, 5] = np.bincount(p[cls[where] == UPPER], minlength=total) / per
    out[:, 6] = np.bincount(p[last == SYMBOL], minlength=total) / per
    out[:, 7] = np.bincount(p[(last == UPPER) & (length > 1)], minlength=total) / per
    out[:, 8] = n / 100
    return out


@dataclass
class Model:
    """Encoder, gated attention and scorer over passage features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        return _forward(self.weights, x, first)["score"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict:
    bounds, sizes = first[:-1], np.diff(first)
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (v * u) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, bounds), sizes))
    attention = e / np.repeat(np.add.reduceat(e, bounds), sizes)
    z = np.add.reduceat(h * attention[:, None], bounds, axis=0)
    logit = np.clip(z @ w["c"] + w["d"], -30, 30)
    return {"h": h, "v": v, "u": u, "attention": attention, "z": z,
            "score": 1 / (1 + np.exp(-logit))}


def _gradients(w, x, first, y) -> dict[str, np.ndarray]:
    sizes = np.diff(first)
    f = _forward(w, x, first)
    off = (f["score"] - y) / len(y)
    dz = np.repeat(off, sizes)[:, None] * w["c"]
    da = (dz * f["h"]).sum(1)
    inner = np.repeat(np.add.reduceat(f["attention"] * da, first[:-1]), sizes)
    de = f["attention"] * (da - inner)
    dv = de[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2)
    du = de[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
    dh = dz * f["attention"][:, None] + dv @ w["V"].T + du @ w["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
            "a": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ off, "d": np.array(off.sum())}


def fit(features: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS,
        seed: int = 7) -> Model:
    """Adam on the log loss; both classes weigh the same through the balanced sample."""
    rng = np.random.default_rng(seed)
    stacked = np.concatenate(features).astype(np.float64)
    mean, scale = stacked.mean(0), np.maximum(stacked.std(0), 1e-3)
    bags = [np.clip((f - mean) / scale, -6, 6) for f in features]
    w = {"W": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
         "U": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
         "a": rng.normal(0, 0.1, GATE), "c": rng.normal(0, 0.1, HIDDEN), "d": np.zeros(())}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for begin in range(0, len(bags), BATCH):
            chosen = order[begin:begin + BATCH]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            grad = _gradients(w, np.concatenate([bags[i] for i in chosen]), first,
                              labels[chosen])
            step += 1
            for k in w:
                g = grad[k] + (1e-4 * w[k] if w[k].ndim else 0)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w)


_SAMPLE = pa.schema([("label", pa.float64()), ("features", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS_PER_CLASS) -> Model | None:
    """A model from at most ``per_class`` labelled documents of each class, by lowest hash of id.

    Held-out documents and null labels are left out; a document with several labels counts by
    their mean. None if either class has no document.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .filter(fold_of(F.col("doc_id"), HELD_OUT_FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label")))
    order = F.xxhash64("doc_id")
    chosen = usable.filter("label = 0").orderBy(order, "doc_id").limit(per_class).unionByName(
        usable.filter("label = 1").orderBy(order, "doc_id").limit(per_class))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        chosen, "doc_id")

    def run(batches):
        for part in portions(batches, "text", PORTION):
            features, first = passage_features(part["text"])
            blobs = []
            for a, b in zip(first[:-1], first[1:]):
                spread = np.unique(np.linspace(a, b - 1, min(b - a, TRAIN_PASSAGES)).round())
                blobs.append(features[spread.astype(np.int64)].tobytes())
            yield record_batch(_SAMPLE, {"label": part["label"], "features": blobs})

    rows = in_tasks(sample, run, "label double, features binary").limit(2 * per_class).collect()
    got = np.array([r["label"] for r in rows])
    if not len(got) or got.min() == got.max():
        return None
    rows = sorted(rows, key=lambda r: (r["label"], bytes(r["features"])))
    return fit([np.frombuffer(r["features"], dtype=np.float32).reshape(-1, FEATURES)
                for r in rows], np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ()) -> DataFrame:
    """``score`` (0 to 1) of every row of ``docs``, beside ``columns``; 0.5 without a model.

    Null and empty texts are scored as one empty passage. Whole texts are read.
    """
    carried = ["doc_id", *columns]
    frame = docs.select(*carried, F.coalesce("text", F.lit("")).alias("text")
                        ) if "text" not in columns else docs.select(*carried)
    fields = frame.select(*carried).schema

    def run(batches):
        for batch in batches:
            scores = []
            for part in portions([batch.select(["text"])], "text", PORTION):
                if model is None:
                    scores += [0.5] * len(part["text"])
                else:
                    scores += model.scores(*passage_features(
                        [t or "" for t in part["text"]])).tolist()
            out = batch.select(carried)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(scores, pa.float64())], [*carried, "_score"])

    return in_tasks(frame, run, T.StructType(
        [*fields, T.StructField("_score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, train(docs, labels)).select(
        "doc_id", (fold_of(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    frame = packed(docs, "doc_id", "text")
    return score(frame, train(docs, labels), tuple(frame.columns[1:])).filter(
        "_score >= 0.5").select(*unpacked(docs.columns, "doc_id", "text"))
