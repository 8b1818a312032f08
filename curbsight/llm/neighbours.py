"""Near-duplicate embeddings by NN-descent over balls of close vectors.

Vectors within ``HALF`` of a leader are a ball: half the angle of a link, so any two of them are
linked by the triangle inequality, and a group of thousands of near copies is a few balls. A
neighbour graph over the leaders starts from random-hyperplane buckets and is refined by
NN-descent: neighbours of a leader are compared with each other, and each keeps its best. A list
whose entries are all within reach may hide more; it is enlarged and refined again. The recall is
audited against brute force for a fixed number of leaders, or, where these have too few neighbours to
tell, by pairs planted at the angle of a link. While it is low, the tables are doubled; where they would cost as much as comparing all leaders in blocks, that is done instead.

Edges between balls are settled by bounds where the angles allow it, and by comparing their
members in blocks where not. Counts are added up per vector; pairs of vectors are never written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curbsight.llm.common import in_tasks, kept
from curbsight.operators.components import components

LINK = 0.9
REACH = math.acos(LINK)
SAFE = 1e-7
HALF = REACH / 2 - SAFE
BALL_ROUNDS, TABLES = 4, 6
NEIGHBOURS = 10
CHUNK = 256
ROUNDS = 4
# The loop ends when fewer than this share of the list entries are new.
STILL = 0.002
AUDIT, ENOUGH = 512, 0.99
# With fewer true neighbours a sample of leaders measures nothing.
SEEN = 200
BLOCK = 1024


def _matrix(column, kind: str = "<f8") -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=kind).reshape(len(column), -1)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _groups(batches, key: str):
    """Runs of equal ``key`` in sorted batches, as tables; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def unit_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, raw) and distinct usable vectors (node, raw, rows, v), v of length 1.

    ``raw`` is null for a vector that is null, zero, empty, or holds a null or non-finite
    component. Vectors of different lengths are different spaces; a link needs equal length.
    """
    def run(batches):
        for batch in batches:
            raw, unit = [], []
            for x in batch.column(1).to_pylist():
                v = np.array([np.nan if c is None else c for c in x or ()], dtype="<f8")
                size = float(np.abs(v).max()) if len(v) and np.isfinite(v).all() else 0.0
                if size > 0:
                    scaled = v / size
                    raw.append((v + 0.0).tobytes())
                    unit.append((scaled / math.sqrt(float(scaled @ scaled))).tobytes())
                else:
                    raw.append(None)
                    unit.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array(unit, pa.binary())],
                ["vec_id", "raw", "v"])

    rows = kept(in_tasks(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(
        "embedding").cast("array<double>").alias("embedding")), run,
        "vec_id long, raw binary, v binary"), "vectors")
    nodes = kept(rows.filter("raw is not null").groupBy("raw").agg(
        F.count(F.lit(1)).alias("rows"), F.first("v").alias("v")).withColumn(
        "node", F.monotonically_increasing_id()), "nodes")
    return rows, nodes


def hashed(nodes: DataFrame, id_column: str, tables: int, bits: int, seed: int) -> DataFrame:
    """``nodes`` with ``keys``: per table the signs of random projections, and one projection."""
    names = nodes.columns

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = [len(x) // 8 for x in batch.column("v").to_pylist()]
            keys, places = [None] * batch.num_rows, [None] * batch.num_rows
            for size in set(sizes):
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).normal(
                        size=(size, tables * (bits + 1)))
                own = [i for i, s in enumerate(sizes) if s == size]
                x = _matrix(batch.column("v").take(pa.array(own))) @ planes[size]
                sign = (x[:, :tables * bits] > 0).reshape(len(own), tables, bits)
                code = sign @ (1 << np.arange(bits, dtype=np.int64)) + (size << 40)
                for i, c, p in zip(own, code.tolist(), x[:, tables * bits:].tolist()):
                    keys[i], places[i] = c, p
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.list_(pa.int64())),
                 pa.array(places, pa.list_(pa.float64()))], [*names, "keys", "places"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return in_tasks(nodes, run, f"{ddl}, keys array<bigint>, places array<double>")


def _cosine_rows(df: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``cosine`` of the vectors in columns ``a`` and ``b``."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = batch.column(a).to_pylist(), batch.column(b).to_pylist()
                sims = [float(np.frombuffer(p) @ np.frombuffer(q)) for p, q in zip(x, y)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(sims, pa.float64())],
                    [*keep, "cosine"])

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    return in_tasks(df.select(*keep, a, b), run, ", ".join(
        [*[f"{c} {fields[c]}" for c in keep], "cosine double"]))


def balls(nodes: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(node, ball, angle) of all nodes, and (ball, radius, members, rows, v) of all balls.

    Every round takes one leader per bucket of free nodes and gives it those within ``HALF``.
    What stays free is a ball of its own.
    """
    bits = max(2, math.ceil(math.log2(max(2, count / 64))))
    free = kept(hashed(nodes.select("node", "v"), "node", BALL_ROUNDS, bits, 5).drop("places"),
                "hashed")
    placed = None
    for r in range(BALL_ROUNDS):
        keyed = free.withColumn("key", F.get("keys", F.lit(r)))
        leaders = keyed.groupBy("key").agg(
            F.min_by(F.struct("node", "v"), F.struct(F.xxhash64("node", F.lit(r)), "node"))
            .alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        leaders = kept(leaders.select("key", F.col("lead.node").alias("ball"),
                                      F.col("lead.v").alias("lead_v")), "leaders")
        near = _cosine_rows(keyed.select("key", "node", "v").join(leaders, "key"),
                            "v", "lead_v", ["node", "ball"]).withColumn(
            "angle", F.acos(F.least("cosine", F.lit(1.0)))).filter(F.col("angle") <= HALF)
        near = kept(near.withColumn("angle", F.when(F.col("node") == F.col("ball"), 0.0).otherwise(
            F.col("angle"))).select("node", "ball", "angle"), "near-leader")
        own = near.join(near.filter("node <> ball").select("ball").distinct(), "ball",
                        "left_semi").select("node", "ball", "angle")
        free = kept(free.join(own.select("node"), "node", "left_anti"), "free")
        placed = own if placed is None else placed.unionByName(own)
    placed = kept(placed.unionByName(free.select("node", F.col("node").alias("ball"),
                                                 F.lit(0.0).alias("angle"))), "in-balls")
    sizes = placed.join(nodes.select("node", "rows"), "node").groupBy("ball").agg(
        F.max("angle").alias("radius"), F.count(F.lit(1)).alias("members"),
        F.sum("rows").alias("rows"))
    return placed, kept(sizes.join(nodes.select(F.col("node").alias("ball"), "v"), "ball"),
                        "balls")


def _best(lists: DataFrame, limits: DataFrame | None, k: int) -> DataFrame:
    """The best entries per list, at most ``k`` or as many as ``limits`` (u, k) says."""
    ranked = Window.partitionBy("u").orderBy(F.desc("cosine"), "w")
    merged = lists.groupBy("u", "w").agg(F.max("cosine").alias("cosine"),
                                         F.min("fresh").alias("fresh"))
    if limits is None:
        return merged.withColumn("rank", F.row_number().over(ranked)).filter(
            F.col("rank") <= k).drop("rank")
    return merged.join(limits, "u", "left").withColumn(
        "rank", F.row_number().over(ranked)).filter(
        F.col("rank") <= F.coalesce("k", F.lit(k))).drop("rank", "k")


def first_lists(leaders: DataFrame, count: int, seed: int, k: int, fan: int) -> DataFrame:
    """(u, w, cosine, fresh): the best of the neighbours that share a bucket chunk."""
    bits = max(2, math.ceil(math.log2(max(2, count / 128))))
    keyed = kept(hashed(leaders.select("ball", "v"), "ball", TABLES, bits, seed), "keyed-leaders")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held, batch])
            at = 0
            while table.num_rows - at >= 2 * CHUNK:
                yield from chunk(table.slice(at, CHUNK))
                at += CHUNK
            held = table.slice(at).to_batches()
        if held:
            yield from chunk(pa.Table.from_batches(held))

    def chunk(table):
        ids = table.column("ball").to_numpy()
        sizes = np.array([len(x) for x in table.column("v").to_pylist()])
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            if len(own) < 2:
                continue
            x = _matrix(table.column("v").take(pa.array(own)).combine_chunks())
            s = x @ x.T
            np.fill_diagonal(s, -2)
            n = min(k, len(own) - 1)
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            u = np.repeat(ids[own], n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u), pa.array(ids[own][top].ravel()),
                 pa.array(np.take_along_axis(s, top, 1).ravel()),
                 pa.array(np.ones(len(u), dtype=bool))], ["u", "w", "cosine", "fresh"])

    out = None
    for t in range(TABLES):
        dealt = keyed.select("ball", "v", F.get("keys", F.lit(t)).alias("key"),
                             F.get("places", F.lit(t)).alias("place")).repartitionByRange(
            fan, "key", "place").sortWithinPartitions("key", "place").select("ball", "v")
        part = in_tasks(dealt, run, "u long, w long, cosine double, fresh boolean")
        out = part if out is None else out.unionByName(part)
    return out


def refined(lists: DataFrame, leaders: DataFrame, limits: DataFrame | None, k: int,
            fan: int) -> DataFrame:
    """One round: neighbours of a leader, in either direction, are compared with each other.

    Only pairs with a fresh entry are compared, and only pairs that would enter a list are sent.
    """
    both = lists.select(F.col("u").alias("at"), F.col("w").alias("x"), "cosine", "fresh").unionByName(
        lists.select(F.col("w").alias("at"), F.col("u").alias("x"), "cosine", "fresh"))
    ranked = Window.partitionBy("at").orderBy(F.desc("cosine"), "x")
    room = F.lit(2 * k) if limits is None else 2 * F.coalesce("k", F.lit(k))
    near = both.groupBy("at", "x").agg(F.max("cosine").alias("cosine"),
                                       F.max("fresh").alias("fresh"))
    if limits is not None:
        near = near.join(limits.withColumnRenamed("u", "at"), "at", "left")
    near = near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= room)
    held = lists.groupBy("u").agg(F.min("cosine").alias("worst"), F.count(F.lit(1)).alias("n"))
    if limits is None:
        full = held.withColumn("k", F.lit(k))
    else:
        full = held.join(limits, "u", "left").withColumn("k", F.coalesce("k", F.lit(k)))
    short = full.select(F.col("u").alias("x"), F.when(F.col("n") >= F.col("k"), F.col(
        "worst")).otherwise(-2.0).alias("worst"))
    members = near.select("at", "x", "fresh").join(
        leaders.select(F.col("ball").alias("x"), "v"), "x").join(short, "x", "left").select(
        "at", "x", "fresh", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "v")
    dealt = members.repartition(fan, "at").sortWithinPartitions("at")

    def run(batches):
        u, w, c = [], [], []
        for table in _groups(batches, "at"):
            ids, fresh = table.column("x").to_numpy(), np.asarray(table.column("fresh"))
            worst = table.column("worst").to_numpy()
            sizes = [len(b) for b in table.column("v").to_pylist()]
            if len(ids) < 2 or len(set(sizes)) > 1:
                continue
            x = _matrix(table.column("v").combine_chunks())
            s = x @ x.T
            good = (s > worst[:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            u.append(ids[i])
            w.append(ids[j])
            c.append(s[i, j])
            if sum(map(len, u)) > 50_000:
                yield packed(u, w, c)
                u, w, c = [], [], []
        if u:
            yield packed(u, w, c)

    def packed(u, w, c):
        u = np.concatenate(u)
        return pa.RecordBatch.from_arrays(
            [pa.array(u), pa.array(np.concatenate(w)), pa.array(np.concatenate(c)),
             pa.array(np.ones(len(u), dtype=bool))], ["u", "w", "cosine", "fresh"])

    found = in_tasks(dealt, run, "u long, w long, cosine double, fresh boolean")
    return kept(_best(lists.withColumn("fresh", F.lit(False)).unionByName(found), limits, k),
                "lists")


def audit(lists: DataFrame, leaders: DataFrame, queries: int) -> float | None:
    """Share of the neighbours within reach that the lists have, for a fixed number of leaders.

    The queries, at most ``queries`` vectors, are held by every task; all leaders meet them. None
    if these are a sample that has too few neighbours to tell.
    """
    chosen = leaders.select("ball", "v", "radius").orderBy(
        F.xxhash64("ball", F.lit(17)), "ball").limit(queries).collect()
    if not chosen:
        return 1.0
    ids = np.array([r["ball"] for r in chosen])
    vectors = [np.frombuffer(r["v"]) for r in chosen]
    radii = np.array([r["radius"] for r in chosen])

    def run(batches):
        for batch in batches:
            own, rad = batch.column("ball").to_numpy(), batch.column("radius").to_numpy()
            v = batch.column("v").to_pylist()
            u, w = [], []
            for size in {len(x) // 8 for x in v}:
                at = np.array([i for i, x in enumerate(v) if len(x) == 8 * size])
                q = np.array([i for i, x in enumerate(vectors) if len(x) == size])
                if not len(q):
                    continue
                s = _angles(np.stack([vectors[i] for i in q])
                            @ np.stack([np.frombuffer(v[i]) for i in at]).T)
                i, j = np.nonzero(s <= REACH + radii[q][:, None] + rad[at][None, :])
                u.append(ids[q[i]])
                w.append(own[at[j]])
            if u:
                u, w = np.concatenate(u), np.concatenate(w)
                other = u != w
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u[other]), pa.array(w[other])], ["u", "w"])

    truth = kept(in_tasks(leaders.select("ball", "v", "radius"), run, "u long, w long"), "truth")
    known = lists.select("u", "w").unionByName(
        lists.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct()
    total = truth.count()
    if total < SEEN and len(chosen) == queries:
        return None
    return truth.join(known, ["u", "w"], "left_semi").count() / total if total else 1.0


def planted_recall(leaders: DataFrame, count: int, seeds: list[int], k: int, fan: int,
                   pairs: int) -> float:
    """Share of planted pairs that the tables of ``seeds`` bring together.

    A vector at the angle of a link, the widest a pair can have, is planted beside each of at most
    ``pairs`` leaders. Refinement can only add to what the tables find.
    """
    chosen = leaders.select("ball", "v").orderBy(F.xxhash64("ball", F.lit(19)), "ball").limit(pairs).collect()
    top = leaders.agg(F.max("ball")).first()[0]
    rows, rng = [], np.random.default_rng(31)
    for i, r in enumerate(chosen, 1):
        v = np.frombuffer(r["v"])
        if len(v) < 2:
            continue
        side = rng.normal(size=len(v))
        side -= (side @ v) * v
        w = LINK * v + math.sin(REACH) * side / np.linalg.norm(side)
        rows.append((top + i, r["ball"], bytearray(w.tobytes())))
    if not rows:
        return 1.0
    planted = leaders.sparkSession.createDataFrame(rows, "planted long, ball long, v binary")
    both = kept(leaders.select("ball", "v").unionByName(planted.select(F.col("planted").alias("ball"), "v")),
                "planted-leaders")
    wanted = planted.select(F.col("ball").alias("u"), F.col("planted").alias("w"))
    wanted = wanted.unionByName(wanted.select(F.col("w").alias("u"), F.col("u").alias("w")))
    met = None
    for seed in seeds:
        part = first_lists(both, count, seed, k, fan).select("u", "w").join(wanted, ["u", "w"], "left_semi")
        met = part if met is None else met.unionByName(part)
    return met.select(F.greatest("u", "w")).distinct().count() / len(rows)


def neighbour_graph(leaders: DataFrame, count: int, k: int = NEIGHBOURS) -> DataFrame:
    """(u, w, cosine, fresh): lists that hold what is within reach, as far as the audit can tell."""
    fan = max(12, int(leaders.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists, limits = kept(_best(first_lists(leaders, count, 23, k, fan), None, k), "lists"), None
    seeds, seed = [23], 101
    while True:
        lists, limits = _settled(lists, leaders, limits, k, fan)
        recall = audit(lists, leaders, AUDIT)
        if recall is None:
            recall = planted_recall(leaders, count, seeds, k, fan, AUDIT)
        if recall >= ENOUGH:
            return lists
        if len(seeds) * TABLES * BLOCK >= count:
            return compared(leaders, count)
        for _ in range(len(seeds)):
            lists = kept(_best(lists.unionByName(
                first_lists(leaders, count, seed, k, fan)), limits, k), "lists")
            seeds.append(seed)
            seed += 1


def _settled(lists: DataFrame, leaders: DataFrame, limits: DataFrame | None, k: int,
             fan: int) -> tuple[DataFrame, DataFrame | None]:
    """Lists and limits after refinement, and again after every widening of full lists."""
    widened = None
    while True:
        for _ in range(ROUNDS):
            lists = refined(lists, leaders, limits, k, fan)
            # A few widened lists are not judged by all the others, which have settled.
            looked = lists if widened is None else lists.join(widened, "u", "left_semi")
            if (looked.agg(F.avg(F.col("fresh").cast("double"))).first()[0] or 0) < STILL:
                break
        wider = _saturated(lists, leaders, limits, k)
        if wider is None:
            return lists, limits
        limits, widened = wider, wider.select("u")
        lists = kept(lists.join(widened.withColumn("again", F.lit(True)), "u", "left").withColumn(
            "fresh", F.coalesce("again", "fresh")).drop("again"), "lists")


def compared(leaders: DataFrame, count: int) -> DataFrame:
    """(u, w, cosine, fresh): all pairs within reach, u < w, by comparing blocks of leaders."""
    blocks = math.ceil(count / BLOCK)
    own = F.pmod(F.xxhash64("ball", F.lit(29)), F.lit(blocks)).cast("int")
    both = leaders.select("ball", "v", "radius", own.alias("own")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns(
        {"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def compare(table: pa.Table) -> pa.Table:
        ids, radii = table.column("ball").to_numpy(), table.column("radius").to_numpy()
        left = table.column("own").to_numpy() == table.column("i").to_numpy()
        right = table.column("own").to_numpy() == table.column("j").to_numpy()
        sizes = np.array([len(v) for v in table.column("v").to_pylist()])
        found = []
        for size in np.unique(sizes):
            a, b = np.flatnonzero(left & (sizes == size)), np.flatnonzero(right & (sizes == size))
            if not len(a) or not len(b):
                continue
            x, y = (_matrix(table.column("v").take(pa.array(at)).combine_chunks())
                    for at in (a, b))
            s = x @ y.T
            near = _angles(s) <= REACH + radii[a][:, None] + radii[b][None, :] + SAFE
            i, j = np.nonzero(near & (ids[a][:, None] != ids[b][None, :]))
            u, w = ids[a[i]], ids[b[j]]
            found.append((np.minimum(u, w), np.maximum(u, w), s[i, j]))
        u, w, c = (np.concatenate(x) for x in zip(*found)) if found else (
            np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
        return pa.table({"u": u, "w": w, "cosine": c, "fresh": np.zeros(len(u), dtype=bool)})

    pairs = both.groupBy("i", "j").applyInArrow(
        compare, "u long, w long, cosine double, fresh boolean")
    # A pair inside one block is found from both ends.
    return kept(pairs.groupBy("u", "w").agg(
        F.max("cosine").alias("cosine"), F.min("fresh").alias("fresh")), "compared")


def _saturated(lists, leaders, limits, k) -> DataFrame | None:
    """Limits with those doubled whose full lists have only entries within reach; None if none."""
    state = lists.groupBy("u").agg(F.min("cosine").alias("worst"), F.count(F.lit(1)).alias("n"))
    if limits is not None:
        state = state.join(limits, "u", "left")
    else:
        state = state.withColumn("k", F.lit(None).cast("int"))
    state = state.withColumn("k", F.coalesce("k", F.lit(k))).join(
        leaders.select(F.col("ball").alias("u"), "radius"), "u")
    full = (F.col("n") >= F.col("k")) & (
        F.col("worst") >= F.cos(F.lit(REACH + HALF) + F.col("radius")))
    wide = kept(state.select("u", full.alias("full"), F.when(full, 2 * F.col("k")).otherwise(
        F.col("k")).cast("int").alias("k")), "limits")
    if wide.filter("full").isEmpty():
        return None
    return wide.filter(F.col("k") > k).select("u", "k")


def _between(pairs: DataFrame, placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, a, b, links): links of members to the other ball, for pairs that need a look."""
    members = placed.join(nodes, "node").select("ball", "node", "rows", "v")
    wide = pairs.withColumns({
        "blocks_a": F.ceil(F.col("members_a") / BLOCK).cast("int"),
        "blocks_b": F.ceil(F.col("members_b") / BLOCK).cast("int")})

    def side(own: str, other: str, i: str, j: str) -> DataFrame:
        rows = wide.join(members.withColumnRenamed("ball", own), own)
        return rows.select(
            "a", "b", F.lit(own).alias("side"),
            F.pmod(F.xxhash64("node"), F.col(f"blocks_{own}")).cast("int").alias(i),
            F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1)).alias(j),
            "node", "rows", "v")

    both = side("a", "b", "i", "j").unionByName(side("b", "a", "j", "i"))

    def compare(table: pa.Table) -> pa.Table:
        left = np.array(table.column("side").to_pylist()) == "a"
        x = _matrix(table.column("v").combine_chunks())
        node, rows = table.column("node").to_numpy(), table.column("rows").to_numpy()
        hit = x[left] @ x[~left].T >= LINK
        n = table.num_rows
        links = np.zeros(n, dtype=np.int64)
        links[left], links[~left] = hit @ rows[~left], hit.T @ rows[left]
        return pa.table({"node": node, "a": table.column("a"), "b": table.column("b"),
                         "links": links})

    return both.groupBy("a", "b", "i", "j").applyInArrow(
        compare, "node long, a long, b long, links long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    ``vectors`` has vec_id and embedding. A link is a cosine of at least ``LINK`` in double
    precision; rows with equal vectors are linked. Vectors that are null, zero, or hold a null or
    non-finite component link with nothing, and are components of their own. ``component_id`` is
    the smallest vec_id of the component, null ids aside. An empty table gives no rows.
    """
    rows, nodes = unit_vectors(vectors)
    count = nodes.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    placed, all_balls = balls(nodes, count)
    lists = neighbour_graph(all_balls, all_balls.count())
    ends = [all_balls.select(F.col("ball").alias(c), F.col("radius").alias(f"radius_{c}"),
                             F.col("members").alias(f"members_{c}"),
                             F.col("rows").alias(f"rows_{c}"), F.col("v").alias(f"v_{c}"))
            for c in ("a", "b")]
    pairs = lists.filter(F.col("cosine") >= math.cos(REACH + 2 * HALF) - SAFE).select(
        F.least("u", "w").alias("a"), F.greatest("u", "w").alias("b")).distinct()
    facts = [f"{f}_{c}" for f in ("radius", "members", "rows") for c in "ab"]
    measured = kept(_cosine_rows(pairs.join(ends[0], "a").join(ends[1], "b"), "v_a", "v_b",
                                 ["a", "b", *facts]), "ball-pairs")
    angle, spread = F.acos(F.greatest(F.lit(-1.0), F.least("cosine", F.lit(1.0)))), F.col(
        "radius_a") + F.col("radius_b")
    single = (F.col("members_a") == 1) & (F.col("members_b") == 1)
    sure = F.when(single, F.col("cosine") >= LINK).otherwise(angle + spread <= REACH - SAFE)
    measured = measured.withColumn("sure", sure)
    all_linked = measured.filter("sure")
    open_ = measured.filter(~F.col("sure") & ~single & (angle - spread <= REACH + SAFE))
    part = kept(_between(open_, placed, nodes), "between")

    edges = all_linked.select("a", "b").unionByName(
        part.filter("links > 0").select("a", "b").distinct())
    roots = components(all_balls.select(F.col("ball").alias("v")), edges, []).select(
        F.col("v").alias("ball"), "root")
    outside = all_linked.select(F.col("a").alias("ball"), F.col("rows_b").alias("n")).unionByName(
        all_linked.select(F.col("b").alias("ball"), F.col("rows_a").alias("n"))).groupBy(
        "ball").agg(F.sum("n").alias("outside"))
    looked = part.groupBy("node").agg(F.sum("links").alias("looked"))
    counted = placed.join(all_balls.select("ball", "rows"), "ball").join(
        outside, "ball", "left").join(roots, "ball").join(looked, "node", "left").select(
        "node", "root", (F.col("rows") - 1 + F.coalesce("outside", F.lit(0))
                         + F.coalesce("looked", F.lit(0))).alias("n_links"))
    known = kept(rows.join(nodes.select("raw", "node"), "raw", "left").join(
        counted, "node", "left").select("vec_id", "root", "n_links"), "linked-rows")
    lowest = known.filter("root is not null").groupBy("root").agg(
        F.min("vec_id").alias("lowest"))
    named = known.join(lowest, "root", "left").withColumn(
        "component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(
            F.col("lowest")))
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                        "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"),
                                                   F.lit(False)).alias("kept"))
