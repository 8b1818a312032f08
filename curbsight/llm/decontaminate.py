"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-cased words. A document and an item become a
candidate pair when hashes of ``SEED`` consecutive words meet. Greedy string tiling then marks the
longest match that is not yet covered on either side, again and again, until none of ``SEED`` words
is left; a Karp-Rabin hash that grows by doubling finds the longest match. The share of the item's
words that tiles cover decides, in whatever order the document has them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from curbsight.llm.common import (in_tasks, kept, mixed, packed, portions, record_batch, row_key,
                                  unpacked)

SEED = 4
COVERAGE = 0.5
# Items are compared in blocks of at most so many bytes of text, so what a task holds is bounded.
BLOCK_BYTES = 16 << 20

_WORDS = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOUND = pa.schema([("_id", pa.int64()), ("_txt", pa.int64()), ("item_id", pa.int64()),
                    ("covered", pa.int64()), ("item_words", pa.int64())])


def words(text: str | None) -> np.ndarray:
    """One 64-bit code per word; equal words have equal codes within one process."""
    found = _WORDS.findall((text or "").lower())
    return mixed(np.fromiter(map(hash, found), dtype=np.int64, count=len(found)))


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = codes[:n].copy()
    for i in range(1, size):
        out = out * _STEP + codes[i:n + i]
    return mixed(out)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(document start, item start, length) of the greedy tiling.

    Longest first; ties go to the earliest place in the document, then in the item.
    """
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out = []
    while True:
        best = _longest(doc, item, free_doc, free_item, least)
        if best is None:
            return out
        length, matches = best
        for i, j in matches:
            if free_doc[i:i + length].all() and free_item[j:j + length].all():
                free_doc[i:i + length] = False
                free_item[j:j + length] = False
                out.append((i, j, length))


def _starts(codes, free, size):
    """Hashes and places of the windows that lie in free words only."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    where = np.flatnonzero(taken[size:] == taken[:n])
    return windows(codes, size)[where], where


def _common(doc, item, free_doc, free_item, size):
    hi, pi = _starts(item, free_item, size)
    hd, pd = _starts(doc, free_doc, size)
    hit = np.isin(hd, hi)
    return hd[hit], pd[hit], hi, pi


def _longest(doc, item, free_doc, free_item, least):
    """The greatest length at which free windows meet, and all places where they do."""
    low, high = 0, least
    while high <= len(item) and len(_common(doc, item, free_doc, free_item, high)[0]):
        low, high = high, high * 2
    if not low:
        return None
    high = min(high, len(item) + 1)
    while high - low > 1:
        middle = (low + high) // 2
        if len(_common(doc, item, free_doc, free_item, middle)[0]):
            low = middle
        else:
            high = middle
    hd, pd, hi, pi = _common(doc, item, free_doc, free_item, low)
    at: dict[int, list[int]] = {}
    for h, j in zip(hi.tolist(), pi.tolist()):
        at.setdefault(h, []).append(j)
    return low, ((i, j) for h, i in zip(hd.tolist(), pd.tolist()) for j in at[h])


class Items:
    """Benchmark items with their seeds, sorted for lookup."""

    def __init__(self, rows: list[tuple[int, str]], seed: int):
        self.seed = seed
        self.ids = [r[0] for r in rows]
        self.codes = [words(r[1]) for r in rows]
        # An item shorter than a seed is sought as a whole.
        self.least = [min(seed, len(c)) for c in self.codes]
        self.tables = {}
        for size in sorted({n for n in self.least if n}):
            hashes, owner, place = [], [], []
            for k, c in enumerate(self.codes):
                if self.least[k] == size:
                    w = windows(c, size)
                    hashes.append(w)
                    owner.append(np.full(len(w), k))
                    place.append(np.arange(len(w)))
            hashes, owner, place = map(np.concatenate, (hashes, owner, place))
            order = np.argsort(hashes, kind="stable")
            self.tables[size] = hashes[order], owner[order], place[order]

    def candidates(self, doc: np.ndarray, share: float):
        """Items of which seeds found in ``doc`` reach ``share``: no tiling can cover more."""
        for size, (hashes, owner, place) in self.tables.items():
            here = windows(doc, size)
            here = here[hashes[np.minimum(np.searchsorted(hashes, here), len(hashes) - 1)] == here]
            if not len(here):
                continue
            hit = np.isin(hashes, here)
            for k in np.unique(owner[hit]).tolist():
                reached = np.zeros(len(self.codes[k]) + 1, dtype=np.int64)
                spots = place[hit & (owner == k)]
                np.add.at(reached, spots, 1)
                np.add.at(reached, spots + size, -1)
                if (np.cumsum(reached) > 0).sum() >= share * len(self.codes[k]):
                    yield k

    def covered(self, doc: np.ndarray, share: float):
        for k in self.candidates(doc, share):
            marked = sum(t[2] for t in tiles(doc, self.codes[k], self.least[k]))
            if marked >= share * len(self.codes[k]):
                yield self.ids[k], marked, len(self.codes[k])


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, share: float = COVERAGE,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_id, _txt, item_id, covered, item_words): items of which a document holds ``share``.

    Null or wordless texts and items match nothing. Items are dealt into blocks by a hash of
    their id and text so that a block stays near ``block_bytes``; every document meets every
    block. Items are read with one bounded collect per block.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    keyed = docs.select(*row_key(), "text")
    found = None
    for block in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]

        def run(batches, rows=rows):
            held = Items(rows, seed)
            for part in portions(batches, "text"):
                out = {f.name: [] for f in _FOUND}
                for key, text_key, text in zip(part["_id"], part["_txt"], part["text"]):
                    for item, marked, size in held.covered(words(text), share):
                        for name, value in zip(out, (key, text_key, item, marked, size)):
                            out[name].append(value)
                yield record_batch(_FOUND, out)

        part = in_tasks(keyed, run, "_id long, _txt long, item_id long, covered long, "
                                    "item_words long")
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = SEED,
                  share: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with _items (sorted distinct ids of the leaked items) and _coverage (greatest).

    Columns of these two names are replaced. A clean document has an empty list and coverage 0. Rows with the same id and text get the
    same result. An item without an id counts under id null: its coverage shows, its id cannot.
    """
    found = kept(leaks(docs, benchmark, seed, share, block_bytes), "leaks")
    per_doc = found.groupBy("_id", "_txt").agg(
        F.sort_array(F.collect_set("item_id")).alias("_items"),
        F.max(F.col("covered") / F.col("item_words")).alias("_coverage"))
    key, text_key = row_key()
    return packed(docs, "doc_id", "text").withColumns({"_id": key, "_txt": text_key}).join(
        per_doc, ["_id", "_txt"], "left").select(
        *unpacked([c for c in docs.columns if c not in ("_items", "_coverage")],
                  "doc_id", "text"), F.coalesce("_items", F.array().cast("array<bigint>")).alias("_items"),
        F.coalesce("_coverage", F.lit(0.0)).alias("_coverage"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    return contamination(packed(docs, "doc_id", "text"), benchmark).filter(
        "_coverage = 0").select(*unpacked(docs.columns, "doc_id", "text"))
