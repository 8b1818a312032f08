"""The trie of conversations, from fingerprints that are put together instead of texts.

A sequence of turns has a fingerprint in a monoid: its length and, per lane, the sum of its turns'
hashes times powers of an odd base, modulo 2^64. Products are formed from parts,
``(m, x) (n, y) = (m + n, x + base^m y)``, and since bases can be inverted, the part of a
conversation after its first h turns follows from two of its running products. So the prefixes of
a rebuilt conversation, the head of one and the rest of another, are computed from the stored
turns' running products; no rebuilt text and no rebuilt list of turns exists.

Prefixes of equal depth and fingerprint are a node. Each keeps a reference to its last turn, and a
node counts as one only if all its prefixes agree on parent and reference, and a reference stands
for one role and text only; otherwise everything is done again with other bases.

Running products are made in sorted order: tasks multiply what they hold, and the few
conversations that continue from one task to the next get the product of the tasks before. No
conversation, however long, is held by one task. Sums over a subtree are sums over its members:
every node's share is put down to its smallest member.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from curbsight.llm.common import in_tasks, kept

FAMILY, HEADS = 5, 9
MASK = (1 << 64) - 1
TRIES = 4
# Ids of one node whose high bits agree are joined to text before they are sent.
CHUNK_BITS = 12
NODE = ("depth", "f1", "f2")


def lanes(attempt: int) -> dict[str, int]:
    """An odd base per lane."""
    rng = np.random.default_rng([61, attempt])
    return {c: int(rng.integers(1 << 61, 1 << 62)) * 4 + 3 for c in ("p1", "p2")}


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent, modulo 2^64; negative exponents need an odd base."""
    out = np.ones(len(exponents), dtype=np.uint64)
    for sign in (1, -1):
        left = np.where(exponents * sign > 0, exponents * sign, 0)
        step = base if sign > 0 else pow(base, -1, 1 << 64)
        while left.any():
            out[(left & 1) == 1] *= np.uint64(step)
            left, step = left >> 1, step * step & MASK
    return out


def _words(column) -> np.ndarray:
    return np.asarray(column, dtype=np.int64).view(np.uint64)


def _longs(words: np.ndarray) -> pa.Array:
    return pa.array(words.view(np.int64))


def running_products(df: DataFrame, key: str, order: list[Column], bases: dict[str, int]) -> DataFrame:
    """``df`` with ``pos``, and the columns of ``bases`` replaced by the products up to each row.

    Rows follow ``order`` within a ``key``, and count from 0. Base 1 gives plain running sums.
    """
    spark = df.sparkSession
    fan = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = df.columns
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def scan(batches):
        task, last, held, before = TaskContext.get().partitionId(), None, 0, dict.fromkeys(bases, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(key))
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            pos = np.arange(len(keys)) - starts[number]
            goes_on = keys[0] == last
            if goes_on:
                pos[number == 0] += held
            columns = {c: batch.column(c) for c in names}
            for c, base in bases.items():
                total = np.cumsum(_words(batch.column(c)) * _power(base, pos), dtype=np.uint64)
                skipped = np.concatenate([np.zeros(1, np.uint64), total])[starts]
                total -= skipped[number]
                if goes_on:
                    total[number == 0] += np.uint64(before[c])
                before[c] = int(total[-1])
                columns[c] = _longs(total)
            last, held = keys[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(pos), pa.array(np.full(len(keys), task, np.int32))],
                [*names, "pos", "task"])

    dealt = df.repartitionByRange(fan, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    local = kept(in_tasks(dealt, scan, f"{ddl}, pos long, task int"), "local-products")
    # One row per task, and one per task and key that lies across tasks.
    ends = sorted(map(tuple, local.groupBy("task").agg(F.min(key), F.max(key)).collect()))
    across = {hi for (_, _, hi), (_, lo, _) in zip(ends, ends[1:]) if hi == lo}
    offsets: dict[int, tuple] = {}
    if across:
        wanted = spark.createDataFrame([(k,) for k in across], f"{key} long")
        parts = local.join(wanted, key, "left_semi").groupBy(key, "task").agg(
            F.max("pos"), *[F.max_by(c, "pos") for c in bases]).collect()
        done, product = None, ()
        for k, task, most, *values in sorted(map(tuple, parts)):
            if k != done:
                done, product = k, (0, *(0 for _ in bases))
            else:
                offsets[task] = (k, *product)
            product = (product[0] + most + 1, *(
                (p + pow(b, product[0], 1 << 64) * (v & MASK)) & MASK
                for p, v, b in zip(product[1:], values, bases.values())))

    def shift(batches):
        for batch in batches:
            keys, task = np.asarray(batch.column(key)), np.asarray(batch.column("task"))
            pos = np.array(batch.column("pos"))
            values = {c: _words(batch.column(c)).copy() for c in bases}
            for t in np.unique(task).tolist():
                if t in offsets:
                    k, count, *products = offsets[t]
                    at = (task == t) & (keys == k)
                    pos[at] += count
                    for (c, base), p in zip(bases.items(), products):
                        values[c][at] = np.uint64(p) + np.uint64(pow(base, count, 1 << 64)) * values[c][at]
            yield pa.RecordBatch.from_arrays(
                [*(_longs(values[c]) if c in bases else batch.column(c) for c in names), pa.array(pos)],
                [*names, "pos"])

    return in_tasks(local, shift, f"{ddl}, pos long") if offsets else local.drop("task")


def _contents(conversations: DataFrame, attempt: int) -> DataFrame:
    """(conv, turn, r1, r2, bytes, role, text); r1 and r2 refer to role and text."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("*", F.xxhash64(F.lit(attempt), "role", "text").alias("r1"),
                       F.xxhash64(F.lit(~attempt), "text", "role").alias("r2"),
                       F.octet_length("text").cast("long").alias("bytes"))


def prefixes(conversations: DataFrame, attempt: int = 0) -> DataFrame:
    """(conv, depth, f1, f2, g1, g2, r1, r2, bytes, last) of every prefix of every rebuilt conversation.

    f is the prefix's fingerprint, g its parent's, r refers to its last turn.
    """
    bases = lanes(attempt)
    turns = kept(running_products(
        _contents(conversations, attempt).select(
            "conv", "turn", "r1", "r2", "bytes", F.col("r1").alias("p1"), F.col("r2").alias("p2")),
        "conv", [F.asc_nulls_first("turn"), F.col("r1"), F.col("r2")], bases).drop("turn"), "turns")
    step = F.struct("pos", "p1", "p2", "r1", "r2", "bytes")
    firsts = kept(turns.groupBy("conv").agg(
        (F.max("pos") + 1).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("pos") < HEADS - 1, step))).alias("steps")), "first-turns")

    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    own = firsts.select("conv", "n", "steps", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    heads = own.join(firsts.select(F.col("conv").alias("base"), F.col("steps").alias("lead")), "base", "left")
    heads = heads.withColumn("lead", F.slice(F.coalesce("lead", F.array().cast(
        firsts.schema["steps"].dataType)), F.lit(1), F.col("h")))

    def product(steps: str, count: Column, lane: str) -> Column:
        return F.coalesce(F.get(steps, count - 1)[lane], F.lit(0).cast("long"))

    facts = heads.select(
        "conv", "n", "h", "lead", F.size("lead").alias("m"),
        *[product("lead", F.size("lead"), p).alias(f"a{p}") for p in bases],
        *[product("steps", F.col("h"), p).alias(f"b{p}") for p in bases])
    facts = kept(facts, "heads")
    zero = F.lit(0).cast("long")
    lead = facts.select("conv", "n", "h", "m", F.explode("lead").alias("s")).select(
        "conv", *[F.col(f"s.{c}").alias(c) for c in ("pos", "p1", "p2", "r1", "r2", "bytes")],
        F.lit(0).alias("h"), F.lit(0).alias("m"), *[zero.alias(x + p) for p in bases for x in "ab"],
        ((F.col("s.pos") == F.col("m") - 1) & (F.col("n") <= F.col("h"))).alias("last"))
    rest = turns.join(facts.drop("lead"), "conv").filter("pos >= h").select(
        *[c for c in lead.columns if c != "last"], (F.col("pos") == F.col("n") - 1).alias("last"))

    def compose(batches):
        for batch in batches:
            pos, head, skip = (np.asarray(batch.column(c), dtype=np.int64) for c in ("pos", "m", "h"))
            depth = head + pos - skip + 1
            out = []
            for lane, (p, base) in enumerate(bases.items(), 1):
                a, b, own = (_words(batch.column(c)) for c in ("a" + p, "b" + p, p))
                whole = a + _power(base, head - skip) * (own - b)
                out.append((whole, whole - _power(base, depth - 1) * _words(batch.column(f"r{lane}"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(depth), *(_longs(f) for f, _ in out), *(
                    _longs(g) for _, g in out), *(batch.column(c) for c in ("r1", "r2", "bytes", "last"))],
                ["conv", *NODE, "g1", "g2", "r1", "r2", "bytes", "last"])

    deep = in_tasks(lead.unionByName(rest), compose, "conv long, depth long, f1 long, f2 long, g1 long, "
                    "g2 long, r1 long, r2 long, bytes long, last boolean")
    roots = facts.select("conv", *[zero.alias(c) for c in (*NODE, "g1", "g2", "r1", "r2", "bytes")], (
        (F.col("m") == 0) & (F.col("n") <= F.col("h"))).alias("last"))
    return kept(deep.unionByName(roots), "prefixes")


def _nodes(paths: DataFrame) -> DataFrame:
    """One row per depth and fingerprint; ``same`` tells whether its prefixes agree on what they keep."""
    seen = ("g1", "g2", "r1", "r2")
    same = F.lit(True)
    for c in seen:
        same = same & (F.min(c) == F.max(c))
    return kept(paths.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        F.min("g1").alias("g1"), F.min("g2").alias("g2"), same.alias("same")), "nodes")


def _references_hold(conversations: DataFrame, attempt: int) -> bool:
    """Whether a reference stands for one role and text only."""
    used = _contents(conversations, attempt).select("r1", "r2", "role", "text").distinct()
    return used.groupBy("r1", "r2").count().filter("count > 1").isEmpty()


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the ids of conversations that end at a node, in order."""
    chunks = paths.filter("last").groupBy(*NODE, F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))
    fan = max(12, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = chunks.repartition(fan, *NODE).sortWithinPartitions(*NODE, "chunk")

    def digest(batches):
        last, state, done = None, None, []

        def out():
            keys = list(zip(*[k for k, _ in done]))
            return pa.RecordBatch.from_arrays(
                [*(pa.array(k, pa.int64()) for k in keys), pa.array([h for _, h in done], pa.string())],
                [*NODE, "ends_sha256"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*NODE, "ids")]
            for *key, ids in zip(*columns):
                if key != last:
                    if state:
                        done.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield out()
                done = []
        if state:
            done.append((last, state.hexdigest()))
            yield out()

    return in_tasks(dealt, digest, "depth long, f1 long, f2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text. Turns follow ``turn``, null first; turns of
    equal number follow a hash of role and text. A null role or text is empty, equal turns of a
    conversation all stay. Rows without conv_id take no part. ``c % 5`` has the sign of c. An empty
    table has no nodes, not even a root.
    """
    for attempt in range(TRIES):
        paths = prefixes(conversations, attempt)
        nodes = _nodes(paths)
        if nodes.filter(~F.col("same")).isEmpty() and _references_hold(conversations, attempt):
            break
    else:
        raise RuntimeError("fingerprints of different conversations stayed equal")

    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = kept(nodes.drop("same").join(children, list(NODE), "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
        "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "counted-nodes")
    # What a conversation brings to every node it is a member of.
    brought = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    below = paths.select("conv", *NODE).join(brought, "conv").groupBy(*NODE).agg(
        F.sum("saved").alias("below"), F.sum("leaf").alias("n_leaves"))
    # A smallest member's shares above the node are not part of the subtree.
    above = running_products(nodes.select("conv_id", *NODE, "saved", F.col("saved").alias("upto")),
                             "conv_id", [F.col("depth")], {"upto": 1}).select(
        *NODE, (F.col("upto") - F.col("saved")).alias("above"))

    whole = nodes.join(below, list(NODE)).join(above, list(NODE)).join(_ends(paths), list(NODE), "left")
    up = nodes.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("g1"), F.col(
        "f2").alias("g2"), F.col("conv_id").alias("parent_conv_id"))
    root = nodes.filter("depth = 0").agg(F.max("conv_id")).scalar()
    top = whole.filter("depth < 2").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, root))
    deep = whole.filter("depth >= 2").join(up, ["depth", "g1", "g2"])
    return top.unionByName(deep).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


_CRC = """xor(4294967295, list_reduce(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1),
    lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT)),
    lambda crc, x: list_reduce(range(0, 8), lambda a, k: xor(a >> 1, (a & 1) * 3988292384), xor(crc, x)),
    4294967295))"""

SQL = f"""
WITH t AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, s, CAST({_CRC} % {HEADS} AS BIGINT) AS h FROM t),
b AS (
  SELECT h.c, list_concat(coalesce(list_slice(o.s, 1, h.h), []), list_slice(h.s, h.h + 1, len(h.s))) AS s
  FROM h LEFT JOIN t o ON o.c = h.c - h.c % {FAMILY}),
p AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM b),
m AS (SELECT c, n, d, list_slice(s, 1, d) AS k FROM p),
v AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(k[d].t)) END AS bytes,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM m GROUP BY d, k),
x AS (SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(x.n_children, 0) AS n_children FROM v LEFT JOIN x ON x.d = v.d AND x.k = v.k),
a AS (SELECT w.d AS at, w.n_children, (w.n_convs - 1) * w.bytes AS saved, k, unnest(range(0, w.d + 1)) AS d FROM w),
u AS (
  SELECT d, list_slice(k, 1, d) AS k, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM a GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, y.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves,
       CAST(u.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN u ON u.d = w.d AND u.k = w.k LEFT JOIN v y ON y.d = w.d - 1 AND y.k = list_slice(w.k, 1, w.d - 1)
"""
