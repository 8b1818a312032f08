"""Languages of a document as a mixture.

Every language is a distribution over hashed letter trigrams, counted over all training
documents. A document is a mixture of languages: expectation-maximisation finds the proportions
under which its trigrams are most likely. More languages always fit better, so a set of languages
is charged for its size, and the set with the best penalised likelihood is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from curbsight.llm.common import fold_of, in_tasks, portions, record_batch

HELD_OUT_FOLDS, HELD_OUT = 4, 2
BUCKET_BITS = 14
SMOOTHING = 0.5
# Expectation-maximisation ends when no proportion moves by more; so many rounds are an error.
STILL, MOST_ROUNDS = 1e-4, 100_000
# Charge per language, in units of half the logarithm of the number of trigrams.
CHARGE = 2.0
UNKNOWN = "und"

_COUNTED = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
_NAMED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                    ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
_letters: dict[str, np.ndarray] = {}


def is_letter(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter; the table of all of them is made once per process."""
    if "table" not in _letters:
        _letters["table"] = np.fromiter(
            (chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters["table"][points]


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of lower-cased words; other characters are word bounds."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = is_letter(points)
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    plain = np.where(letter, points, 32).astype(np.uint64)
    middle = letter[1:-1]
    code = (plain[:-2] * np.uint64(0x9E3779B97F4A7C15)
            + plain[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
            + plain[2:] * np.uint64(0x165667B19E3779F9))[middle]
    code ^= code >> np.uint64(31)
    return ((code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Languages:
    """Trigram probabilities per language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTHING
        self.p = smooth / smooth.sum(0)

    def shares(self, buckets: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Chosen languages, most likely first, and their proportions."""
        seen, n = np.unique(buckets, return_counts=True)
        p = self.p[seen]
        mix, likelihood = _mixture(p, n)
        order = np.argsort(-mix, kind="stable")
        single = n @ np.log(p)
        order = np.concatenate([[single.argmax()], order[order != single.argmax()]])
        charge = CHARGE * 0.5 * np.log(max(2, n.sum()))
        best = [int(order[0])], np.ones(1)
        value = single[order[0]] - charge
        for k in range(2, len(order) + 1):
            chosen = order[:k]
            mix, likelihood = _mixture(p[:, chosen], n)
            if likelihood - k * charge <= value:
                break
            value, best = likelihood - k * charge, (chosen.tolist(), mix)
        at = np.argsort(-best[1], kind="stable")
        return [best[0][i] for i in at], best[1][at]


def _mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log likelihood they reach."""
    mix = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(MOST_ROUNDS):
        joint = p * mix
        before, mix = mix, (n / joint.sum(1)) @ joint / total
        if np.abs(mix - before).max() < STILL:
            return mix, float(n @ np.log((p * mix).sum(1) + 1e-300))
    raise RuntimeError("the language mixture of a document does not settle")


def train(docs: DataFrame) -> Languages | None:
    """Counts over all training documents; the driver gets one row per language and bucket."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & (fold_of(F.col("doc_id"), HELD_OUT_FOLDS) != HELD_OUT))

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for part in portions(batches, "text"):
            for lang, text in zip(part["lang"], part["text"]):
                b = trigrams(text)
                if lang not in held:
                    held[lang] = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
                held[lang] += np.bincount(b, minlength=1 << BUCKET_BITS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield record_batch(_COUNTED, {"lang": [lang] * len(at), "bucket": at, "n": n[at]})

    counted = in_tasks(known.select("lang", "text"), run, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.collect_list(F.struct("bucket", "n")).alias("held")).orderBy("lang").collect()
    if not rows:
        return None
    counts = np.zeros((1 << BUCKET_BITS, len(rows)))
    for i, r in enumerate(rows):
        for bucket, n in r["held"]:
            counts[bucket, i] = n
    return Languages([r["lang"] for r in rows], counts)


def predict(docs: DataFrame, model: Languages | None) -> DataFrame:
    """doc_id, lang_pred, score, langs, shares of every document.

    ``langs`` is the chosen set, largest share first; ``score`` is the share of the first. A null
    text, one without a letter, or no training data gives ``und`` with score 0 and an empty set.
    """
    def run(batches):
        for part in portions(batches, "text"):
            out = {f.name: [] for f in _NAMED}
            for doc_id, text in zip(part["doc_id"], part["text"]):
                buckets = trigrams(text or "") if model else ()
                names, shares = [], []
                if len(buckets):
                    chosen, mix = model.shares(buckets)
                    names, shares = [model.names[i] for i in chosen], mix.tolist()
                for name, value in zip(out, (
                        doc_id, names[0] if names else UNKNOWN,
                        min(1.0, shares[0]) if names else 0.0, names, shares)):
                    out[name].append(value)
            yield record_batch(_NAMED, out)

    return in_tasks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, lang_pred string, score double, langs array<string>, "
                    "shares array<double>")


def languages(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs)).select(
        "doc_id", (fold_of(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"),
        "lang_pred", "score", "langs", "shares")
