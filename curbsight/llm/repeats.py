"""Byte strings that repeat across or within texts, by refining buckets.

Bucket-pointer refinement sorts suffixes by a short prefix first and refines a bucket by the
buckets at later offsets, using what earlier steps have settled. Here the strings to be judged are
all windows of ``SIZE`` bytes, and the first bucket of a window is its anchor: the place in it whose
``GRAM`` bytes hash lowest, leftmost among equals. Equal windows have equal anchors at equal
offsets, so a bucket holds windows by (anchor gram, offset), and refining a bucket compares what
lies around the anchor:

1. all windows of one anchor at once: anchors whose whole surroundings are equal settle each
   other, which leaves only anchors near the ends of a repeat;
2. for those, nodes of ``NODE`` neighbouring offsets: a node is dropped if the bytes its windows have
   in common occur once, and settled if all bytes its windows span occur twice;
3. for the nodes still open, single windows.

Each step groups by hashes with minima and maxima, so a gram that a third of all texts share is
counted by many tasks; only distinct surroundings of it go on to the next step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from curbsight.llm.common import Rolling, in_tasks, kept, mixed, portions, record_batch

SIZE, GRAM, NODE = 400, 32, 32
SEGMENT = 1 << 20
POSITION_BITS = 21

_rolling: dict[str, Rolling] = {}

_ANCHORS = pa.schema([("tk", pa.binary()), ("gram", pa.int64()), ("span", pa.int64()),
                      ("many", pa.bool_()), ("x", pa.int32()), ("runs", pa.binary())])
_CONTEXT = pa.schema([("o", pa.int64()), ("tk", pa.binary()), ("gram", pa.int64()),
                      ("open", pa.bool_()), ("x", pa.int32()), ("at", pa.int32()),
                      ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary())])
_NODES = pa.schema([("o", pa.int64()), ("i", pa.int32()), ("gram", pa.int64()),
                    ("core", pa.int64()), ("span", pa.int64()), ("open", pa.bool_())])
_WINDOWS = pa.schema([("tk", pa.binary()), ("p", pa.int32()), ("gram", pa.int64()),
                      ("w", pa.int64()), ("o", pa.int64()), ("open", pa.bool_())])
_DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                   ("n_spans", pa.int64()), ("kept", pa.binary())])


def _hasher() -> Rolling:
    if "bytes" not in _rolling:
        _rolling["bytes"] = Rolling(31)
    return _rolling["bytes"]


def _lowest_in_windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` codes, from minima of blocks read both ways."""
    n = len(codes)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = codes
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray):
    """(gram, span, x, low, high) per anchor: it serves the windows that start at low ... high.

    ``span`` is a hash of all bytes of these windows and of the place of the anchor in them. Texts
    are read in segments; a segment's end only cuts an anchor's run in two.
    """
    roll, out = _hasher(), []
    width = SIZE - GRAM + 1
    for base in range(0, len(data) - SIZE + 1, SEGMENT):
        part = data[base:base + SEGMENT + SIZE - 1]
        sums = roll.sums(part)
        places = np.arange(len(part) - GRAM + 1)
        grams = mixed(roll.ranges(sums, places, places + GRAM))
        order = (grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | places.astype(
            np.uint64)
        x = (_lowest_in_windows(order, width) & np.uint64((1 << POSITION_BITS) - 1)).astype(
            np.int64)
        low = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
        high = np.concatenate([low[1:], [len(x)]]) - 1
        x = x[low]
        shape = ((x - low) * 1024 + (high - low)).astype(np.uint64)
        span = mixed(mixed(roll.ranges(sums, low, high + SIZE)) + shape)
        out.append((grams[x], span, x + base, low + base, high + base))
    return [np.concatenate([o[i] for o in out]) for i in range(5)] if out else None


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("tk")


def anchor_rows(texts: DataFrame) -> DataFrame:
    """One row per text and (gram, span); ``runs`` has the window starts as pairs low, high.

    A task reads a text once, however many copies it sees. Repeats of an anchor within a text
    are one row with ``many``; neighbouring runs are joined.
    """
    def run(batches):
        seen = set()
        for part in portions(batches, "text", 1 << 20):
            out = {f.name: [] for f in _ANCHORS}
            for tk, text in zip(part["tk"], part["text"]):
                if tk in seen:
                    continue
                seen.add(tk)
                found = anchors(np.frombuffer(text, dtype=np.uint8))
                if found is None:
                    continue
                gram, span, x, low, high = found
                order = np.lexsort((x, span, gram))
                gram, span, x, low, high = (c[order] for c in found)
                new = np.ones(len(x), dtype=bool)
                new[1:] = (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.concatenate([first, [len(x)]]))
                joint = np.ones(len(x), dtype=bool)
                joint[1:] = new[1:] | (low[1:] != high[:-1] + 1)
                begin = np.flatnonzero(joint)
                last = np.concatenate([begin[1:], [len(x)]]) - 1
                pairs = np.stack([low[begin], high[last]], axis=1).astype("<i4")
                at = np.searchsorted(begin, np.concatenate([first, [len(x)]]))
                out["tk"] += [tk] * len(first)
                out["gram"] += gram[first].view(np.int64).tolist()
                out["span"] += span[first].view(np.int64).tolist()
                out["many"] += (count > 1).tolist()
                out["x"] += x[first].tolist()
                out["runs"] += [pairs[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield record_batch(_ANCHORS, out)

    return in_tasks(texts, run, "tk binary, gram long, span long, many boolean, x int, runs binary")


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around the anchors of ``wanted`` (tk, gram, x, open, runs), by text."""
    per_text = kept(wanted.groupBy("tk").agg(
        F.collect_set(F.struct("gram", "x", "open", "runs")).alias("places")), "places")

    def run(batches):
        seen = set()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["tk"] in seen:
                    continue
                seen.add(row["tk"])
                out = {f.name: [] for f in _CONTEXT}
                text, tk = row["text"], row["tk"]
                for place in row["places"]:
                    x = place["x"]
                    runs = np.frombuffer(place["runs"], "<i4")
                    low, high = x - int(runs[1]), x - int(runs[0])  # offsets of the anchor
                    begin = max(0, x - high // NODE * NODE - NODE + 1)
                    end = min(len(text), x - low // NODE * NODE + SIZE)
                    o = int.from_bytes(tk[:8], "little", signed=True) ^ (x * 0x9E3779B97F4A7C1)
                    for name, value in zip(out, (
                            (o + (1 << 63)) % (1 << 64) - (1 << 63), tk, place["gram"],
                            place["open"], x, x - begin, low, high, text[begin:end])):
                        out[name].append(value)
                yield record_batch(_CONTEXT, out)

    joined = texts.join(per_text, "tk").select("tk", "text", "places")
    rows = in_tasks(joined, run, "o long, tk binary, gram long, open boolean, x int, at int, "
                                 "low int, high int, bytes binary")
    return kept(rows.dropDuplicates(["tk", "x", "gram", "open"]), "contexts")


def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint64).view(np.int64)


def _node_rows(contexts: DataFrame) -> DataFrame:
    def run(batches):
        roll = _hasher()
        for part in portions(batches, "bytes", 1 << 20):
            out = {f.name: [] for f in _NODES}
            for o, gram, open_, at, low, high, raw in zip(*(part[c] for c in (
                    "o", "gram", "open", "at", "low", "high", "bytes"))):
                sums = roll.sums(np.frombuffer(raw, dtype=np.uint8))
                i = np.arange(low // NODE, high // NODE + 1)
                begin = at - i * NODE
                core = mixed(mixed(roll.ranges(sums, begin, begin + SIZE - NODE + 1))
                             + i.astype(np.uint64))
                whole = (begin >= NODE - 1) & (begin + SIZE <= len(raw))
                a, b = np.maximum(begin - NODE + 1, 0), np.minimum(begin + SIZE, len(raw))
                span = mixed(mixed(roll.ranges(sums, a, b)) + i.astype(np.uint64))
                # A node that the text's end cuts cannot be settled as a whole: a code of its own.
                own = mixed(np.uint64(o % (1 << 64)) + i.astype(np.uint64) * np.uint64(3))
                out["o"] += [o] * len(i)
                out["i"] += i.tolist()
                out["gram"] += [gram] * len(i)
                out["core"] += _signed(core).tolist()
                out["span"] += _signed(np.where(whole, span, own)).tolist()
                out["open"] += [open_] * len(i)
            yield record_batch(_NODES, out)

    return in_tasks(contexts, run,
                    "o long, i int, gram long, core long, span long, open boolean")


def _window_rows(contexts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Single windows of the nodes in ``wanted`` (o, i, open)."""
    per_context = wanted.groupBy("o").agg(F.collect_set(F.struct("i", "open")).alias("nodes"))

    def run(batches):
        roll = _hasher()
        for part in portions(batches, "bytes", 1 << 20):
            out = {f.name: [] for f in _WINDOWS}
            for tk, gram, x, at, low, high, nodes, raw in zip(*(part[c] for c in (
                    "tk", "gram", "x", "at", "low", "high", "nodes", "bytes"))):
                sums = roll.sums(np.frombuffer(raw, dtype=np.uint8))
                for node in nodes:
                    offset = np.arange(node["i"] * NODE, node["i"] * NODE + NODE)
                    begin = at - offset
                    fits = (begin >= 0) & (begin + SIZE <= len(raw))
                    offset, begin = offset[fits], begin[fits]
                    w = mixed(mixed(roll.ranges(sums, begin, begin + SIZE))
                              + offset.astype(np.uint64))
                    p = x - offset
                    o = mixed(p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                              ^ np.uint64(int.from_bytes(tk[:8], "little")))
                    out["tk"] += [tk] * len(p)
                    out["p"] += p.tolist()
                    out["gram"] += [gram] * len(p)
                    out["w"] += _signed(w).tolist()
                    out["o"] += _signed(o).tolist()
                    out["open"] += (node["open"] & (offset >= low) & (offset <= high)).tolist()
            yield record_batch(_WINDOWS, out)

    joined = contexts.join(per_context, "o").select(
        "tk", "gram", "x", "at", "low", "high", "nodes", "bytes")
    return in_tasks(joined, run,
                    "tk binary, p int, gram long, w long, o long, open boolean")


def _pair(low: str, high: str) -> Column:
    return F.struct(F.col(low).cast("int").alias("low"), F.col(high).cast("int").alias("high"))


def repeated_starts(texts: DataFrame) -> DataFrame:
    """(tk, starts): binary pairs low, high of window starts that occur elsewhere, by text.

    ``texts`` has tk (a key of the text) and text (binary). Copies of a text are not looked at.
    """
    rows = kept(anchor_rows(texts), "anchors")
    hashed = rows.withColumn("th", F.xxhash64("tk"))
    classes = kept(hashed.groupBy("gram", "span").agg(
        F.min("th").alias("first"), (F.max("many") | (F.min("th") != F.max("th"))).alias("dup")),
        "anchor-classes")
    open_grams = classes.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.max(~F.col("dup")).alias("any_open")).filter(
        "n > 1 AND any_open").select("gram", F.lit(True).alias("open_gram"))
    relevant = classes.join(open_grams, "gram", "left").withColumn(
        "open_gram", F.coalesce("open_gram", F.lit(False))).filter("dup OR open_gram")
    judged = kept(hashed.join(relevant, ["gram", "span"]).select(
        "tk", "gram", "x", "runs", "dup",
        (F.col("open_gram") & (~F.col("dup") | (F.col("th") == F.col("first")))).alias("look")),
        "judged")
    settled = judged.filter("dup").select("tk", "runs")

    contexts = _contexts(texts, judged.filter("look").select(
        "tk", "gram", "x", "runs", (~F.col("dup")).alias("open")))
    nodes = kept(_node_rows(contexts), "nodes")
    spans = nodes.groupBy("gram", "core", "span").agg(
        F.min("o").alias("first"), F.max("o").alias("last"), F.max("open").alias("any_open"))
    spans = kept(spans.withColumn("dup", F.col("first") != F.col("last")), "node-spans")
    cores = spans.groupBy("gram", "core").agg(
        F.min("first").alias("c_first"), F.max("last").alias("c_last"),
        F.max(F.col("any_open") & ~F.col("dup")).alias("c_open")).filter("c_first <> c_last")
    met = kept(nodes.join(spans.drop("any_open", "last").join(
        cores.select("gram", "core", "c_open"), ["gram", "core"]), ["gram", "core", "span"]).select(
        "o", "i", "open", "dup", (F.col("c_open") & ((F.col("open") & ~F.col("dup")) | (
            F.col("o") == F.col("first")))).alias("look")), "met-nodes")
    places = contexts.select("o", "tk", "x", "low", "high", F.col("open").alias("c_is_open"))
    whole_nodes = met.filter("open AND dup").select("o", "i").join(
        places.filter("c_is_open"), "o").select("tk", _pair_of_node())
    windows = kept(_window_rows(contexts, met.filter("look").select(
        "o", "i", (F.col("open") & ~F.col("dup")).alias("open"))), "windows")
    twice = windows.groupBy("gram", "w").agg(
        F.min("o").alias("a"), F.max("o").alias("b")).filter("a <> b").select("gram", "w")
    single = windows.filter("open").join(twice, ["gram", "w"], "left_semi").select(
        "tk", _pair("p", "p").alias("run"))
    runs = settled.groupBy("tk").agg(F.collect_set("runs").alias("runs"))
    ends = whole_nodes.unionByName(single).groupBy("tk").agg(F.collect_set("run").alias("ends"))
    return runs.join(ends, "tk", "full_outer")


def _pair_of_node() -> Column:
    """Window starts of the part of a node that its anchor serves."""
    first = F.greatest(F.col("low"), F.col("i") * NODE)
    last = F.least(F.col("high"), F.col("i") * NODE + NODE - 1)
    return F.struct((F.col("x") - last).cast("int").alias("low"),
                    (F.col("x") - first).cast("int").alias("high")).alias("run")


def covered(size: int, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Which bytes the windows that start in low ... high cover."""
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, lows, 1)
    np.add.at(edge, np.minimum(highs + SIZE, size), -1)
    return np.cumsum(edge[:size]) > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every document.

    ``docs`` has doc_id and text. Every byte that a string of ``SIZE`` bytes covers which also
    starts anywhere else, in the same text or another, is removed; strings are judged on the
    input, and never cross documents. A text with copies goes entirely if it has ``SIZE`` bytes. A
    null text is empty; shorter texts keep all bytes. ``n_spans`` counts maximal removed runs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = docs.filter(F.length("text") >= SIZE).select("tk", "text")
    copied = texts.groupBy("tk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "tk", F.lit(True).alias("copied"))
    marks = kept(repeated_starts(texts).join(copied, "tk", "full_outer"), "marks")
    joined = docs.join(marks, "tk", "left")

    def run(batches):
        for part in portions(batches, "text", 1 << 20):
            out = {f.name: [] for f in _DONE}
            for doc_id, text, runs, ends, copied_ in zip(
                    part["doc_id"], part["text"], part["runs"], part["ends"], part["copied"]):
                left, removed, spans = text, 0, 0
                if copied_:
                    left, removed, spans = b"", len(text), 1
                elif runs or ends:
                    pairs = np.frombuffer(b"".join(runs or ()), "<i4").reshape(-1, 2)
                    more = np.array([(e["low"], e["high"]) for e in ends or ()],
                                    dtype=np.int64).reshape(-1, 2)
                    pairs = np.concatenate([pairs.astype(np.int64), more])
                    gone = covered(len(text), pairs[:, 0], pairs[:, 1])
                    left = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                    removed = int(gone.sum())
                    spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                for name, value in zip(out, (doc_id, len(text), removed, spans, left)):
                    out[name].append(value)
            yield record_batch(_DONE, out)

    return in_tasks(joined.select("doc_id", "text", "runs", "ends", "copied"), run,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans",
                       F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"))
