"""Exact Jaccard join of word-shingle sets, with skips between related sets.

Shingles that many documents have come last in a global order, all others in hash order; two sets
that reach the similarity share a shingle among the first of either (its prefix). The inverted
lists of these prefixes are cut by a skip rule on sizes: only blocks of sizes within reach meet,
and a position bounds what two sets can still have in common.

Sets take answers over from sets like them. Every list first compares its members with one leader:
the member with the fewest rare tokens before it, which of near copies is the least edited.
Sets that are found to be linked form classes, and afterwards only members of different classes
are compared: the links of a class answer for all its members. A group of thousands of near copies
costs one comparison per member and list, not one per pair. Rows are links or classes, never
copies squared.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from curbsight.functions.lineage import cut
from curbsight.llm.common import (LOWEST, Rolling, in_tasks, kept, mixed, packed, portions,
                                  record_batch, unpacked)
from curbsight.operators.components import components

WORDS = 5
# Similarity as a ratio of whole numbers, so that no link is lost to rounding.
SHARED, OF = 75, 100
# Shingles are counted by so many leading bits; counts only decide the order of the prefixes.
KEY_BITS = 36
HEAVY_FROM = 64
# At most so many of the most frequent shingles go last; 8 bytes each go to every task.
HEAVY_KEYS = 200_000
# Texts whose shingles a task makes at a time; the words and hashes of a text take many times its size.
TEXT_BYTES = 1 << 20
COUNT_FLUSH = 4_000_000
# Ids of sets to verify are broadcast up to this number, and joined by a shuffle beyond.
BROADCAST_IDS = 500_000
SMALLEST_MAP, LARGEST_MAP = 64, 1 << 16
# Words of the short parity map that goes with the members of a list.
BRIEF = 8

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_rolling: dict[str, Rolling] = {}

_SETS = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("check", pa.int64()), ("size", pa.int32()),
                   ("bits", pa.binary()), ("brief", pa.list_(pa.int64()))])
_COUNTS = pa.schema([("part", pa.int32()), ("keys", pa.binary())])
# A posting on its way: position and size in one word, inverted for frequent tokens.
_POSTS = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("place", pa.int64())])
_MEMBERS = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; empty without words."""
    if "word" not in _rolling:
        _rolling["word"] = Rolling(11)
    roll = _rolling["word"]
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    codes = mixed(roll.ranges(roll.sums(data), begin, end) + (end - begin).astype(np.uint64))
    bounds = np.concatenate([[0], np.searchsorted(begin, ends)])
    step = np.uint64(0x9E3779B97F4A7C15)
    rows = codes[:max(0, len(codes) - words + 1)].copy()
    for i in range(1, words):
        rows = rows * step + codes[i:len(rows) + i]
    rows = mixed(rows)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rows[a:b - words + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                whole = whole * step + codes[i:i + 1]
            out.append(mixed(whole))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def set_id(tokens: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """The id of a set and a second word; sets that agree in both are the same."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=salt.to_bytes(4, "little")).digest()
    return tuple(np.frombuffer(digest, "<i8").tolist())


def parity_map(tokens: np.ndarray) -> bytes:
    """One bit per token, flipped by each token that falls on it; sized to the set."""
    m = min(LARGEST_MAP, max(SMALLEST_MAP, 1 << (len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def brief_map(tokens: np.ndarray) -> list[int]:
    """A parity map of ``BRIEF`` 64-bit words, the same size for every set."""
    odd = np.bincount((tokens >> np.uint64(20) & np.uint64(64 * BRIEF - 1)).astype(np.int64),
                      minlength=64 * BRIEF) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def most_shared(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """Upper bound of the intersection: every differing bit is a token of one set only."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return (size_a + size_b - int(np.bitwise_count(x ^ y).sum())) // 2


def needed(size_a, size_b):
    """Least intersection of a link: 100 * i >= 75 * (a + b - i), in whole numbers."""
    return -(-SHARED * (size_a + size_b) // (SHARED + OF))


def prefix_length(size: int) -> int:
    return size - -(-SHARED * size // OF) + 1


def described(docs: DataFrame, words: int, salt: int = 0) -> DataFrame:
    """One row per document: id, set id with its second word, size and parity maps."""
    def run(batches):
        for part in portions(batches, "text", TEXT_BYTES):
            sets = shingle_sets([t or "" for t in part["text"]], words)
            ids = [set_id(s, salt) for s in sets]
            yield record_batch(_SETS, {
                "doc_id": part["doc_id"], "sid": [i for i, _ in ids], "check": [c for _, c in ids],
                "size": [len(s) for s in sets],
                "bits": [parity_map(s) if len(s) else b"" for s in sets],
                "brief": [brief_map(s) for s in sets]})

    return in_tasks(docs, run,
                    "doc_id long, sid long, check long, size int, bits binary, brief array<bigint>")


def distinct_sets(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, int]:
    """The described documents, their distinct sets that are not empty, and the salt of their ids.

    Ids are 8 bytes, for they go with every shingle. No two sets share one: if any do, all sets get
    ids of another salt.
    """
    for salt in itertools.count():
        rows = kept(described(docs, words, salt), "sets")
        sets = kept(rows.filter("size > 0").groupBy("sid").agg(
            F.min("doc_id").alias("doc_id"), F.first("size").alias("size"),
            F.first("bits").alias("bits"), F.first("brief").alias("brief"),
            (F.min("check") == F.max("check")).alias("alone")), "distinct-sets")
        if sets.filter("not alone").isEmpty():
            return rows.drop("check"), sets.drop("alone"), salt


def heavy_keys(docs: DataFrame, words: int, keys: int, least: int) -> np.ndarray:
    """Leading bits of the shingles that most documents have, at most ``keys`` of them.

    All shingles of all documents are counted. A task sends sorted keys in compressed blocks, one
    per key range; a range is counted where its blocks meet.
    """
    spark = docs.sparkSession
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shift = np.uint64(64 - KEY_BITS)
    bounds = np.array([(i << KEY_BITS) // parts for i in range(1, parts)], dtype=np.uint64)

    def packed(held):
        values = np.sort(np.concatenate(held) >> shift)
        squeeze = zstandard.ZstdCompressor(level=1)
        cuts = [0, *np.searchsorted(values, bounds).tolist(), len(values)]
        blobs = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            steps = np.diff(values[a:b], prepend=np.uint64(0)).astype("<u8")
            # Equal bytes of all steps side by side: the high ones are mostly zero.
            blobs.append(squeeze.compress(
                steps.view(np.uint8).reshape(-1, 8).T.tobytes() if b > a else b""))
        return record_batch(_COUNTS, {"part": list(range(parts)), "keys": blobs})

    def emit(batches):
        held, n = [], 0
        for part in portions(batches, "text", TEXT_BYTES):
            for s in shingle_sets([t or "" for t in part["text"]], words):
                held.append(s)
                n += len(s)
            if n >= COUNT_FLUSH:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def count(batches):
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = open_.decompress(blob)
                steps = np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
                values, n = np.unique(np.cumsum(steps, dtype=np.uint64), return_counts=True)
                if part in ranges:
                    values = np.concatenate([ranges[part][0], values])
                    n = np.concatenate([ranges[part][1], n])
                    values, at = np.unique(values, return_inverse=True)
                    n = np.bincount(at, weights=n, minlength=len(values)).astype(np.int64)
                ranges[part] = values, n
        for values, n in ranges.values():
            often = n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[often].astype(np.int64)), pa.array(n[often].astype(np.int64))],
                ["key", "n"])

    blocks = in_tasks(docs.select("text"), emit, "part int, keys binary")
    counted = in_tasks(blocks.repartition(parts, "part"), count, "key long, n long")
    rows = counted.orderBy(F.desc("n"), "key").limit(keys).collect()
    return np.sort(np.array([r["key"] for r in rows], dtype=np.uint64))


def postings(docs: DataFrame, words: int, heavy: np.ndarray, salt: int = 0) -> DataFrame:
    """(token, sid, size, pos) of prefix tokens that two or more different sets have.

    A task sends a set once, however many copies it sees. Frequent tokens are known to be shared,
    so their rows are dealt by set too; all other lists are shorter than the bound that ``heavy`` keeps.
    """
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shift = np.uint64(64 - KEY_BITS)

    def emit(batches):
        seen = set()
        for part in portions(batches, "text", TEXT_BYTES):
            tokens, sids, places = [], [], []
            for s in shingle_sets([t or "" for t in part["text"]], words):
                sid = set_id(s, salt)[0] if len(s) else None
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                n = prefix_length(len(s))
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s >> shift), len(heavy) - 1)
                    often = heavy[at] == (s >> shift)
                    chosen = np.concatenate([s[~often], s[often]])[:n]
                    rare = min(n, int((~often).sum()))
                else:
                    chosen, rare = s[:n], n
                place = np.arange(n, dtype=np.int64) << 32 | len(s)
                place[rare:] = ~place[rare:]
                tokens.append(chosen)
                sids.append(np.full(n, sid, dtype=np.int64))
                places.append(place)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sids)),
                     pa.array(np.concatenate(places))], schema=_POSTS)

    def shared(batches):
        """Rows come sorted by token and set; holds back one row."""
        before = None  # (token, sid, row, whether it has been sent)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if before is None else pa.Table.from_batches(
                [before[2], batch]).combine_chunks().to_batches()[0]
            token, sid, place = (rows.column(i).to_numpy() for i in range(3))
            often = place < 0
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
            own = np.flatnonzero(fresh)
            t = token[own]
            meets = often[own]
            meets[1:] |= t[1:] == t[:-1]
            meets[:-1] |= t[1:] == t[:-1]
            send = meets.copy()
            if before is not None:
                meets[0] |= before[3]
                send[0] &= not before[3]
            out = own[send]
            whole = np.where(often[out], ~place[out], place[out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[out]), pa.array(sid[out]),
                 pa.array((whole & 0xFFFFFFFF).astype(np.int32)), pa.array((whole >> 32).astype(np.int32))],
                schema=_MEMBERS)
            before = (None, None, rows.slice(int(own[-1]), 1), bool(meets[-1]))

    rows = in_tasks(docs.select("text"), emit, "token long, sid long, place long")
    dealt = rows.repartition(parts, "token", F.when(F.col("place") < 0, F.pmod("sid", F.lit(64)))) \
        .sortWithinPartitions("token", "sid")
    return in_tasks(dealt, shared, "token long, sid long, size int, pos int")


def _within_reach(size_a: Column, size_b: Column, pos_a: Column, pos_b: Column) -> Column:
    """Sizes allow the similarity, and so do the tokens from the two positions on."""
    least = F.ceil((size_a + size_b) * SHARED / F.lit(float(SHARED + OF)) - 1e-9)
    return (F.least(size_a, size_b) * OF >= F.greatest(size_a, size_b) * SHARED) & (
        F.least(size_a - pos_a, size_b - pos_b) + F.least(pos_a, pos_b) >= least)


def linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, salt: int = 0) -> DataFrame:
    """The pairs (x, y) of set ids that reach the similarity, verified on the sets themselves."""
    maps = [sets.select(F.col("sid").alias(c), F.col("size").alias(f"size_{c}"),
                        F.col("bits").alias(f"bits_{c}")) for c in ("x", "y")]

    def close(batches):
        for batch in batches:
            p = batch.to_pydict()
            good = [most_shared(a, b, n, m) >= needed(n, m) for a, b, n, m in zip(
                p["bits_x"], p["bits_y"], p["size_x"], p["size_y"])]
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    near = kept(in_tasks(pairs.join(maps[0], "x").join(maps[1], "y").select(
        "x", "y", "size_x", "size_y", "bits_x", "bits_y"), close, "x long, y long"), "near")
    ids = near.select(F.explode(F.array("x", "y")).alias("sid")).distinct().join(
        sets.select("sid", "doc_id"), "sid").select(F.coalesce(
            "doc_id", F.lit(LOWEST)).alias("_id")).distinct()
    ids = cut(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def whole(batches):
        for part in portions(batches, "text", TEXT_BYTES):
            held = {set_id(s, salt)[0]: s.tobytes() for s in shingle_sets(part["text"], words) if len(s)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.binary())],
                ["sid", "tokens"])

    texts = docs.filter("text is not null").select(
        F.coalesce("doc_id", F.lit(LOWEST)).alias("_id"), "text").join(ids, "_id", "left_semi")
    held = kept(in_tasks(texts.select("text"), whole, "sid long, tokens binary").groupBy(
        "sid").agg(F.first("tokens").alias("tokens")), "sets")

    def similar(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(OF * both >= SHARED * (len(a) + len(b) - both))
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    x = held.select(F.col("sid").alias("x"), F.col("tokens").alias("tokens_x"))
    y = held.select(F.col("sid").alias("y"), F.col("tokens").alias("tokens_y"))
    return kept(in_tasks(near.join(x, "x").join(y, "y").select(
        "x", "y", "tokens_x", "tokens_y"), similar, "x long, y long"), "links")


def _classes(links: DataFrame) -> DataFrame:
    """(sid, class) of the sets that have a link."""
    ends = links.select(F.explode(F.array("x", "y")).alias("v")).distinct()
    return cut(components(ends, links.select(F.col("x").alias("a"), F.col("y").alias("b")), [])
               .select(F.col("v").alias("sid"), F.col("root").alias("class")))


def _across_classes(lists: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a list whose members are of different classes and within reach of each other.

    The members of a list's largest class meet only its other members. Every differing bit of two
    brief maps is a token of one set only; pairs that differ in too many are not written.
    """
    own = lists.join(classes, "sid", "left").withColumn("class", F.coalesce("class", "sid"))
    own = kept(own, "class-lists")
    held = own.groupBy("token", "class").agg(F.count(F.lit(1)).alias("n"))
    main = kept(held.groupBy("token").agg(
        F.max_by("class", F.struct("n", "class")).alias("main"), F.count(F.lit(1)).alias("k"))
        .filter("k > 1").drop("k"), "main-classes")
    open_ = own.join(main, "token").withColumn("rest", F.col("class") != F.col("main"))
    block = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(OF / SHARED)) + 1e-9)
    open_ = kept(open_.select("token", "sid", "class", "size", "pos", "rest",
                              block.cast("int").alias("block")).join(
        sets.select("sid", "brief"), "sid"), "open-lists")
    left = open_.filter("rest").select(
        "token", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1))
        .alias("block"), F.col("sid").alias("sid_l"), F.col("class").alias("class_l"),
        F.col("size").alias("size_l"), F.col("pos").alias("pos_l"),
        F.col("brief").alias("brief_l"))
    differ = sum((F.bit_count(F.col("brief_l")[i].bitwiseXOR(F.col("brief")[i]))
                  for i in range(BRIEF)), F.lit(0))
    both = F.col("size_l") + F.col("size")
    met = left.join(open_, ["token", "block"]).filter(
        (F.col("class_l") != F.col("class")) & (~F.col("rest") | (F.col("sid_l") < F.col("sid")))
        & _within_reach(F.col("size_l"), F.col("size"), F.col("pos_l"), F.col("pos"))
        # At most (both - differ) / 2 tokens are shared; a link has SHARED * both / (SHARED + OF).
        & ((both - differ) * (SHARED + OF) >= both * (2 * SHARED)))
    return met.select(F.least("sid_l", "sid").alias("x"),
                      F.greatest("sid_l", "sid").alias("y")).distinct()


def similar_groups(docs: DataFrame, words: int = WORDS, heavy_from: int = HEAVY_FROM,
                   heavy: int = HEAVY_KEYS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    ``docs`` has doc_id and text. The set of a document is its distinct shingles of ``words`` words,
    or its whole word sequence if it has fewer; a null or wordless text has an empty set, links
    with nothing and is its own component. Documents with equal sets are one vertex.
    ``component_id`` is the smallest doc_id of the component, null ids aside; a component of null
    ids alone has id null. Repeated rows come out as often as they came in.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, sets, salt = distinct_sets(docs, words)
    lists = kept(postings(docs, words, heavy_keys(docs, words, heavy, heavy_from), salt), "postings")

    leaders = lists.groupBy("token").agg(F.min_by(
        F.struct("sid", "size", "pos"),
        F.struct(F.col("pos") / F.col("size"), F.xxhash64("sid"), "sid")).alias("lead"))
    stars = lists.join(leaders, "token").filter(
        (F.col("sid") != F.col("lead.sid")) & _within_reach(
            F.col("size"), F.col("lead.size"), F.col("pos"), F.col("lead.pos"))).select(
        F.least("sid", "lead.sid").alias("x"), F.greatest("sid", "lead.sid").alias("y"))
    first = linked(stars.distinct(), sets, docs, words, salt)
    rest = linked(_across_classes(lists, _classes(first), sets), sets, docs, words, salt)
    classes = _classes(first.unionByName(rest))

    grouped = rows.select("doc_id", "sid", "size").join(classes, "sid", "left").withColumn(
        "class", F.coalesce("class", "sid"))
    lowest = grouped.filter("size > 0").groupBy("class").agg(F.min("doc_id").alias("lowest"))
    return grouped.join(lowest, "class", "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias(
            "component_id"))


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the lowest id of each component.

    Rows that repeat an id and text stay once. Rows without an id cannot be referred to; they
    stay, once per text. Documents without words stay.
    """
    groups = kept(similar_groups(docs, **options), "groups")
    keep = groups.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))) \
        .select(F.coalesce("doc_id", F.lit(LOWEST)).alias("_id")).distinct()
    repeated = groups.groupBy("doc_id").count().filter("count > 1")
    chosen = packed(docs, "doc_id", "text").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))) \
        .join(keep, "_id", "left_semi")
    if not repeated.isEmpty():
        chosen = chosen.dropDuplicates(["_id", "text"])
    return chosen.select(*unpacked(docs.columns, "doc_id", "text"))
