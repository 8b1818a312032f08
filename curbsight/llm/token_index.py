"""Token ids in raw binary shards, with a minimal perfect hash from document key to place.

Shard file (little endian): the ids of its documents end to end, each ``width`` bytes; then the
token offsets of the documents (unsigned 64-bit, one more than documents); then a trailer of
magic, width, number of documents and number of tokens. Documents are in ascending key order
within a shard and across shards.

Index file: keys are dealt to index parts by a hash. A part is a minimal perfect hash in levels of
bit arrays: a key takes the first level at which its bit is its own, and the number of bits set
before it is its slot. Slots hold a 32-bit fingerprint of the key, the number of the key's first
record, and how many records it has. A key that was never stored is turned away by the
fingerprint but for one case in 2^32. Looking a key up takes a constant number of steps.
"""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from curbsight.llm.common import LOWEST, in_tasks, kept, mixed, portions, record_batch
from curbsight.llm.tokens import END_ID, encoder, vocabulary

SHARD_MAGIC, INDEX_MAGIC = b"CSTOKEN1", b"CSMPHF01"
TRAILER = "<8sIIQQ"
KEYS_PER_PART = 50_000
SLACK = 1.6
LEVELS = 64
READ_BYTES = 4 << 20
# Texts that are encoded together: each word they share is looked up once.
TEXT_BYTES = 8 << 20

_STORED = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("ordinal", pa.int64()),
                     ("n", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                   ("ids", pa.binary())])


def _store(folder: str):
    store, path = pafs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def _publish(folder: str, name: str, chunks) -> None:
    """Write a file under a name of its own and move it into place, so a retried task is harmless."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(draft, f"{path}/{name}")


def _load(folder: str, name: str) -> bytes:
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def write_shards(docs: DataFrame, folder: str, path: str, shards: int) -> DataFrame:
    """One file per shard; a row (key, shard, ordinal, n) per document. A null id is the lowest key."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"),
                        "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(shards, "key", "tie").sortWithinPartitions(
        "key", "tie").select("key", "text")

    def run(batches):
        encode = encoder("word", path).encode
        shard = TaskContext.get().partitionId()
        width = 2 if encoder("word", path).slow.get_vocab_size() <= 1 << 16 else 4
        store, where = _store(folder)
        store.create_dir(where, recursive=True)
        draft = f"{where}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        ends, tokens = [0], 0
        with store.open_output_stream(draft) as out:
            for part in portions(batches, "text", TEXT_BYTES):
                sizes, chunk = [], []
                for ids in encode([t or "" for t in part["text"]]):
                    chunk.append(ids.astype(f"<u{width}").tobytes())
                    chunk.append(END_ID.to_bytes(width, "little"))
                    tokens += len(ids) + 1
                    sizes.append(len(ids) + 1)
                    ends.append(tokens)
                out.write(b"".join(chunk))
                first = len(ends) - 1 - len(sizes)
                yield record_batch(_STORED, {
                    "key": part["key"], "shard": [shard] * len(sizes),
                    "ordinal": list(range(first, first + len(sizes))), "n": sizes})
            out.write(np.array(ends, dtype="<u8").tobytes())
            out.write(struct.pack(TRAILER, SHARD_MAGIC, width, 0, len(ends) - 1, tokens))
        store.move(draft, f"{where}/shard-{shard:06d}")

    return in_tasks(ordered, run, "key long, shard int, ordinal long, n long")


def _level_bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return (mixed(keys ^ salt) % np.uint64(size)).astype(np.int64)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys + np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; also answers for keys it has not seen."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            counts = np.cumsum(np.bitwise_count(bits.view("<u8"))).astype(np.int64)
            self.before.append(total + np.concatenate([[0], counts]))
            total += int(counts[-1]) if len(counts) else 0

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, -(-int(len(left) * SLACK) // 64) * 64)
            spot = _level_bits(left, len(levels), size)
            alone = np.bincount(spot, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[spot]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot per key; -1 for some keys that were not stored."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            spot = _level_bits(keys[open_], level, len(bits) * 8)
            hit = (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
            at = spot[hit]
            words = bits.view("<u8")[at >> 6]
            below = words & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            out[open_[hit]] = self.before[level][at >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out


class IndexPart:
    """A perfect hash with the fingerprint, first record and number of records per slot."""

    def __init__(self, table: PerfectHash, prints, records, copies):
        self.table, self.prints, self.records, self.copies = table, prints, records, copies

    @classmethod
    def of(cls, keys: np.ndarray, records: np.ndarray, copies: np.ndarray) -> "IndexPart":
        keys = keys.astype(np.int64).view(np.uint64)
        table = PerfectHash.of(keys)
        at = np.argsort(table.slots(keys))
        return cls(table, _fingerprints(keys)[at], records[at].astype("<u8"),
                   copies[at].astype("<u8"))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        out.write(struct.pack("<8sQQ", INDEX_MAGIC, len(self.prints), len(self.table.levels)))
        out.write(np.array([len(b) for b in self.table.levels], dtype="<u8").tobytes())
        for block in (*self.table.levels, self.prints, self.records, self.copies):
            out.write(block.tobytes())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "IndexPart":
        magic, n, levels = struct.unpack_from("<8sQQ", raw)
        if magic != INDEX_MAGIC:
            raise ValueError("not an index file")
        at = 24
        sizes = np.frombuffer(raw, "<u8", levels, at).tolist()
        at += 8 * levels
        bits = []
        for size in sizes:
            bits.append(np.frombuffer(raw, np.uint8, size, at))
            at += size
        prints = np.frombuffer(raw, "<u4", n, at)
        records = np.frombuffer(raw, "<u8", n, at + 4 * n)
        return cls(PerfectHash(bits), prints, records, np.frombuffer(raw, "<u8", n, at + 12 * n))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record (-1 if the key is not stored) and number of records per key."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot = self.table.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == _fingerprints(keys[known])
        first, copies = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[known] = self.records[slot[known]]
        copies[known] = self.copies[slot[known]]
        return first, copies


def _part_of(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_index(stored: DataFrame, folder: str, keys_per_part: int = KEYS_PER_PART) -> None:
    """Index files and the manifest of shards for rows (key, shard, ordinal, n).

    Records are numbered across shards, so the records of one key follow each other even where a
    shard ends between them.
    """
    spark = stored.sparkSession
    shards = stored.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"),
                                         F.sum("n").alias("tokens")).orderBy("shard").collect()
    docs = np.concatenate([[0], np.cumsum([r["docs"] for r in shards])]).astype("<i8")
    tokens = np.concatenate([[0], np.cumsum([r["tokens"] for r in shards])]).astype("<i8")
    numbers = np.array([r["shard"] for r in shards], dtype="<i8")
    bases = spark.createDataFrame(
        [(r["shard"], int(b)) for r, b in zip(shards, docs)], "shard int, base long")
    keys = kept(stored.join(bases, "shard").groupBy("key").agg(
        F.min(F.col("base") + F.col("ordinal")).alias("record"),
        F.count(F.lit(1)).alias("copies")), "keys")
    parts = max(1, -(-keys.count() // keys_per_part))

    def build(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        made = IndexPart.of(*(table.column(c).to_numpy() for c in ("key", "record", "copies")))
        _publish(folder, f"index-{part:06d}", [made.to_bytes()])
        return pa.table({"part": pa.array([part], pa.int32()),
                         "n": pa.array([table.num_rows], pa.int64())})

    in_tasks(keys, lambda b: b, "key long, record long, copies long")  # makes the package known
    keys.select(_part_of("key", parts).alias("part"), "key", "record", "copies").groupBy(
        "part").applyInArrow(build, "part int, n long").agg(F.sum("n")).collect()
    _publish(folder, "manifest", [np.array([parts, len(shards)], dtype="<i8").tobytes(),
                                  numbers.tobytes(), docs.tobytes(), tokens.tobytes()])


class Manifest:
    """Shard numbers and where their documents and tokens begin."""

    def __init__(self, folder: str):
        raw = np.frombuffer(_load(folder, "manifest"), dtype="<i8")
        self.parts, n = int(raw[0]), int(raw[1])
        self.shards, self.docs, self.tokens = raw[2:2 + n], raw[2 + n:3 + 2 * n], raw[3 + 2 * n:]


def build(docs: DataFrame, folder: str, path: str | None = None,
          shards: int | None = None) -> None:
    """Write shards, index and manifest of all documents (doc_id, text) into ``folder``.

    A null or empty text is the end id alone. Rows that share an id are stored one after another,
    and so are rows without an id. The folder must be one that all executors reach.
    """
    spark = docs.sparkSession
    path = path or vocabulary("word_bpe_49k.json")
    shards = shards or max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write_index(kept(write_shards(docs, folder, path, shards), "stored"), folder)


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of the documents of ``keys``.

    ``keys`` has doc_id; each distinct one is looked up in its index part, and its records are
    read from the shards by place. Keys that are not stored give no row.
    """
    spark = keys.sparkSession
    manifest = Manifest(folder)
    fan = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def locate(batches):
        held: tuple[int, IndexPart] | None = None
        for batch in batches:
            part, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for p in np.unique(part).tolist():
                if held is None or held[0] != p:
                    held = p, IndexPart.from_bytes(_load(folder, f"index-{p:06d}"))
                own = key[part == p]
                first, copies = held[1].find(own)
                copies = np.where(first >= 0, copies, 0)
                step = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                out.append((np.repeat(own, copies), np.repeat(first, copies) + step))
            found, record = (np.concatenate([o[i] for o in out]) for i in (0, 1))
            at = np.searchsorted(manifest.docs, record, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(at.astype(np.int32)),
                 pa.array(record - manifest.docs[at])], ["key", "at", "ordinal"])

    def fetch(batches):
        shard = None
        for batch in batches:
            key, at, ordinal = (batch.column(i).to_numpy() for i in range(3))
            begin = 0
            while begin < len(key):
                if shard is None or shard.at != at[begin]:
                    if shard:
                        shard.close()
                    shard = Shard(folder, int(manifest.shards[at[begin]]), int(at[begin]))
                end = begin + int(np.searchsorted(at[begin:], at[begin], side="right"))
                for a, b in shard.spans(ordinal[begin:end]):
                    a, b = begin + a, begin + b
                    starts, sizes, ids = shard.read(ordinal[a:b])
                    yield record_batch(_READ, {
                        "doc_id": [None if k == LOWEST else k for k in key[a:b].tolist()],
                        "start": (starts + manifest.tokens[at[a]]).tolist(),
                        "n_tokens": sizes.tolist(), "ids": ids})
                begin = end
        if shard:
            shard.close()

    wanted = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias(
        "key")).distinct().withColumn("part", _part_of("key", manifest.parts))
    places = in_tasks(
        wanted.select("part", "key").repartition(fan, "part", F.pmod(F.xxhash64("key", F.lit(1)),
                                                                     F.lit(16)))
        .sortWithinPartitions("part", "key"), locate, "key long, at int, ordinal long")
    return in_tasks(places.repartitionByRange(fan, "at", "ordinal").sortWithinPartitions(
        "at", "ordinal"), fetch, "doc_id long, start long, n_tokens long, ids binary")


class Shard:
    """An open shard file."""

    def __init__(self, folder: str, number: int, at: int):
        store, path = _store(folder)
        self.at = at
        self.file = store.open_input_file(f"{path}/shard-{number:06d}")
        size = self.file.size()
        tail = struct.calcsize(TRAILER)
        magic, self.width, _, docs, tokens = struct.unpack(
            TRAILER, self.file.read_at(tail, size - tail))
        if magic != SHARD_MAGIC:
            raise ValueError("not a shard file")
        self.ends = np.frombuffer(self.file.read_at(8 * (docs + 1), tokens * self.width),
                                  dtype="<u8").astype(np.int64)

    def close(self) -> None:
        self.file.close()

    def spans(self, ordinals: np.ndarray):
        """Runs of neighbouring documents that are read in one go."""
        begin = 0
        for i in range(1, len(ordinals) + 1):
            if i == len(ordinals) or ordinals[i] != ordinals[i - 1] + 1 or (
                    self.ends[ordinals[i] + 1] - self.ends[ordinals[begin]]
                    ) * self.width > READ_BYTES:
                yield begin, i
                begin = i

    def read(self, ordinals: np.ndarray):
        first, last = self.ends[ordinals[0]], self.ends[ordinals[-1] + 1]
        raw = np.frombuffer(self.file.read_at(int(last - first) * self.width,
                                              int(first) * self.width), dtype=f"<u{self.width}")
        wide = raw.astype("<u4")
        starts, ends = self.ends[ordinals], self.ends[ordinals + 1]
        return starts, ends - starts, [
            wide[a:b].tobytes() for a, b in zip(starts - first, ends - first)]


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def stored_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Build the index of ``docs`` in ``folder`` and read every document back through it."""
    build(docs, folder)
    return lookup(docs.select("doc_id"), folder)
