"""Exact top-k inner products by a Voronoi join.

Queries and data are grouped by their nearest pivots. One coordinate, ``sqrt(M - |x|^2)`` with the
largest squared length M, is added to every data vector and 0 to every query; then
``|q - x|^2 = |q|^2 + M - 2 q.x``, so the highest scores are the nearest vectors, and distances to
pivots bound them.

A summary counts the vectors of each cell by their distance to its pivot. From it every query gets
a distance within which its answers must lie, and every group of queries the interval of distances
to the pivot in which a cell can hold answers for it. Only vectors in these intervals are sent to
the group. Cells are packed into blocks of at most ``BLOCK`` vectors, crowded cells are split, and
the same holds for groups of queries; a task compares one group with one block and passes on the
best of each query. Bounds only leave out what cannot be an answer, so any pivots give the same
result.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from curbsight.llm.common import in_tasks, kept

K = 20
SCALE = 64
QUERY_STEP = 20
PIVOTS = 1024
GROUP = BLOCK = 8192
BUCKETS = 256
CHUNK = 512
# Relative room for rounding in distances; a bound that is too wide only sends more.
ROOM = 1e-6

ANSWER = "query_id long, rank int, vec_id long, score long"


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): vectors with an id whose components are all present and finite, as doubles."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _largest(x: str):
    return F.coalesce(F.array_max(F.transform(x, lambda c: F.abs(F.floor(c * SCALE).cast("double")))), F.lit(0.0))


def _whole(column, dim: int) -> np.ndarray:
    """The scaled and floored components of a list column, one row per vector, 0 where it is short."""
    flat = np.floor(SCALE * np.asarray(column.flatten(), dtype="<f8"))
    sizes = np.diff(np.asarray(column.offsets, dtype=np.int64))
    out = np.zeros((len(sizes), dim))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


class Space:
    """Pivots, and distances in the space with the added coordinate."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.p, self.longest = pivots, longest
        self.extra = np.sqrt(np.maximum(longest - (pivots ** 2).sum(1), 0))
        self.slack = ROOM * (1 + math.sqrt(longest))

    @cached_property
    def between(self) -> np.ndarray:
        return self.of_data(self.p)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "between"}

    def of_data(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.longest - (x ** 2).sum(1), 0))
        # With the added coordinate every data vector, pivots too, has the squared length ``longest``.
        return np.sqrt(np.maximum(2 * self.longest - 2 * (
            x @ self.p.T + extra[:, None] * self.extra[None, :]), 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q ** 2).sum(1)[:, None] + self.longest - 2 * (q @ self.p.T), 0))


def _chain(between: np.ndarray) -> list[int]:
    """Pivots in an order in which neighbours are close."""
    left = np.ones(len(between), dtype=bool)
    order, at = [0], 0
    left[0] = False
    while left.any():
        at = int(np.argmin(np.where(left, between[at], np.inf)))
        left[at] = False
        order.append(at)
    return order


def _dealt(order: list[int], counts: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(cell, first, parts): small neighbouring cells share a part, large ones are split over several."""
    out, number, held = [], 0, 0
    for cell in order:
        n = int(counts[cell])
        if held and held + n > size:
            number, held = number + 1, 0
        parts = max(1, -(-n // size))
        out.append((cell, number, parts))
        if parts > 1:
            number, held = number + parts, 0
        else:
            held += n
    return out


def _bounds(space: Space, within: np.ndarray, probes: np.ndarray, probe_ids: np.ndarray, k: int):
    """For queries: distance that holds their answers, and distances to the pivots."""
    def of(q: np.ndarray, ids: np.ndarray):
        far = space.of_queries(q)
        reach = (far + within[None, :]).min(1)
        if len(probes) > k:
            # Sampled rows are answers themselves unless better ones exist.
            scores = np.where(ids[:, None] == probe_ids[None, :], -np.inf, q @ probes.T)
            least = np.partition(scores, -k, axis=1)[:, -k]
            known = np.isfinite(least)
            own = (q ** 2).sum(1) + space.longest
            found = np.sqrt(np.maximum(own - 2 * np.where(known, least, 0), 0))
            reach = np.where(known, np.minimum(reach, found), reach)
        return reach + space.slack, far
    return of


def _best(q: np.ndarray, x: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    """(query, data, score) of the k best per query; data rows are in order of their ids.

    ``own`` is the place of each query among the data rows, or -1; scores below ``floor`` are left out.
    """
    n = len(x)
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 1 << 53:
        score = (q.astype("<f8") @ x.astype("<f8").T).astype(np.int64)
    else:
        score = q.astype(np.int64) @ x.astype(np.int64).T
    rows = np.arange(len(q))
    open_ = np.ones(score.shape, dtype=bool)
    open_[rows[own >= 0], own[own >= 0]] = False
    if bound < (1 << 61) // max(1, n):
        # Equal scores rank by place: the key holds both.
        key = np.where(open_, score * n + np.arange(n - 1, -1, -1), np.iinfo(np.int64).min)
        take = min(k, n)
        top = np.argpartition(key, n - take, axis=1)[:, n - take:]
    else:
        value = np.where(open_, score, np.iinfo(np.int64).min)
        top = np.argsort(-value.astype(object), axis=1, kind="stable")[:, :k]
    i, j = np.repeat(rows, top.shape[1]), top.ravel()
    good = open_[i, j] & (score[i, j] >= floor[i])
    return i[good], j[good], score[i, j][good]


def _solved(table: pa.Table, dim: int, kind: str, k: int) -> pa.Table:
    """The best of one block of data for one group of queries."""
    asks = np.asarray(table.column("floor").is_valid())
    data = table.filter(pa.array(~asks)).sort_by([("vec_id", "ascending"), ("row", "ascending")])
    ask = table.filter(pa.array(asks))

    def matrix(t):
        return np.frombuffer(b"".join(t.column("v").to_pylist()), dtype=kind).reshape(t.num_rows, dim)

    x, row = matrix(data), data.column("row").to_numpy()
    q, q_row = matrix(ask), ask.column("row").to_numpy()
    floor, q_id, x_id = (t.column(c).to_numpy() for t, c in (
        (ask, "floor"), (ask, "vec_id"), (data, "vec_id")))
    by_row = np.argsort(row)
    spot = np.searchsorted(row[by_row], q_row)
    inside = np.minimum(spot, max(0, len(row) - 1))
    own = np.where(row[by_row][inside] == q_row, by_row[inside], -1) if len(row) else np.full(len(q), -1)
    parts = [[], [], [], [], []]
    for at in range(0, len(q) if len(row) else 0, CHUNK):
        i, j, score = _best(q[at:at + CHUNK], x, own[at:at + CHUNK], floor[at:at + CHUNK], k)
        for held, new in zip(parts, (q_row[at + i], q_id[at + i], x_id[j], row[j], score)):
            held.append(new)
    names = ("q_row", "query_id", "vec_id", "row", "score")
    return pa.table({n: np.concatenate(p) if p else np.zeros(0, np.int64) for n, p in zip(names, parts)})


def top_scores(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, pivots: int = PIVOTS,
               group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products per query.

    ``vectors`` has vec_id and embedding; components x count as floor(64 x). Queries are the rows
    whose vec_id is divisible by ``step``, candidates all rows but the query's own. Ties go to the
    smaller vec_id. Vectors that are null or hold a null or non-finite component take no part, and
    neither do rows without vec_id and vectors with a component so large that scores could leave 64
    bits. A shorter vector counts as if zeros followed. Rows that share a vec_id are rows of their
    own: candidates for each other, and each answered if they are queries. An empty table gives no
    rows. At most ``pivots`` vectors are sampled as pivots, which has no influence on the result.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors)
    dim = max(1, rows.agg(F.max(F.size("x"))).first()[0] or 0)
    limit = float(math.isqrt(((1 << 63) - 1) // dim))
    rows = rows.filter(_largest("x") <= limit)
    floored = F.transform("x", lambda c: F.floor(c * SCALE).cast("double"))
    count, top, longest = rows.agg(
        F.count(F.lit(1)), F.max(_largest("x")),
        F.max(F.aggregate(floored, F.lit(0.0), lambda s, c: s + c * c))).first()
    if not count:
        return spark.createDataFrame([], ANSWER)
    kind = "<i2" if top < 1 << 15 else "<i8"

    sample = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(
        min(pivots, math.isqrt(count) + 1)).collect()
    probes = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        probes[i, :len(r["x"])] = np.floor(SCALE * np.array(r["x"], dtype="<f8"))
    probe_ids = np.array([r["vec_id"] for r in sample], dtype=np.int64)
    space = Space(np.unique(probes, axis=0), longest)

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _whole(part.column("x"), dim)
                far = space.of_data(x)
                cell = far.argmin(1)
                raw = x.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(cell.astype(np.int32)),
                     pa.array((x @ space.p.T).argmax(1).astype(np.int32)),
                     pa.array(far[np.arange(len(x)), cell]),
                     pa.array([r.tobytes() for r in raw], pa.binary())],
                    ["vec_id", "cell", "asks_at", "far", "v"])

    placed = kept(in_tasks(rows, place, "vec_id long, cell int, asks_at int, far double, v binary")
                  .withColumn("row", F.monotonically_increasing_id()), "voronoi-cells")
    asked = placed.filter(F.col("vec_id") % step == 0)

    # At most pivots x (BUCKETS + 1) counts.
    width = max(1e-9, 2 * math.sqrt(longest) / BUCKETS)
    summary = placed.groupBy("cell", F.floor(F.col("far") / width).cast("int").alias("ring")).count().collect()
    cells = len(space.p)
    counts, within = np.zeros(cells, np.int64), np.full(cells, np.inf)
    near, far_out = np.full(cells, np.inf), np.full(cells, -np.inf)
    for cell, ring, n in sorted(map(tuple, summary)):
        counts[cell] += n
        near[cell] = min(near[cell], ring * width)
        far_out[cell] = (ring + 1) * width
        # One more than k: the query's own row may be among them.
        if counts[cell] > k and np.isinf(within[cell]):
            within[cell] = (ring + 1) * width
    asks = np.zeros(cells, np.int64)
    for cell, n in asked.groupBy("asks_at").count().collect():
        asks[cell] = n
    order = _chain(space.between)
    blocks = spark.createDataFrame(_dealt(order, counts, block), "cell int, first int, parts int")
    groups = {c: (first, parts) for c, first, parts in _dealt(order, asks, group)}
    first = np.array([groups[c][0] for c in range(cells)])
    parts = np.array([groups[c][1] for c in range(cells)])
    bounds = _bounds(space, within, probes, probe_ids, k)

    def queries(batches):
        """Every query with its group and the lowest score that can be an answer."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                q, ids, group_of = asked_rows(part)
                reach, _ = bounds(q, ids)
                lowest = np.floor(((q ** 2).sum(1) + space.longest - np.minimum(reach, 1e150) ** 2) / 2) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group_of), part.column("row"), part.column("vec_id"), part.column("v"),
                     pa.array(np.clip(lowest, -(2.0 ** 63), 2.0 ** 62).astype(np.int64))],
                    ["group", "row", "vec_id", "v", "floor"])

    def asked_rows(part):
        q = np.frombuffer(b"".join(part.column("v").to_pylist()), dtype=kind).reshape(
            part.num_rows, dim).astype("<f8")
        cell, row = part.column("asks_at").to_numpy(), part.column("row").to_numpy()
        return q, part.column("vec_id").to_numpy(), (first[cell] + row % parts[cell]).astype(np.int32)

    def needs(batches):
        """Per group and cell: distances to the pivot at which it can hold an answer."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                q, ids, group_of = asked_rows(batch.slice(at, 1024))
                reach, far = bounds(q, ids)
                own = far.argmin(1)
                apart = 2 * space.between[own]
                # A vector of another cell lies beyond the plane between the two pivots.
                plane = (far ** 2 - far[np.arange(len(q)), own][:, None] ** 2) / np.maximum(apart, 1e-300)
                low, high = far - reach[:, None] - space.slack, far + reach[:, None] + space.slack
                may = (low <= far_out) & (high >= near) & (
                    (apart <= 0) | (plane <= reach[:, None] + space.slack))
                low, high = np.where(may, low, np.inf), np.where(may, high, -np.inf)
                by = np.argsort(group_of, kind="stable")
                names, starts = np.unique(group_of[by], return_index=True)
                low = np.minimum.reduceat(low[by], starts, axis=0)
                high = np.maximum.reduceat(high[by], starts, axis=0)
                i, j = np.nonzero(low < np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[i].astype(np.int32)), pa.array(j.astype(np.int32)),
                     pa.array(low[i, j]), pa.array(high[i, j])], ["group", "cell", "low", "high"])

    needed = kept(in_tasks(asked, needs, "group int, cell int, low double, high double").groupBy(
        "group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).join(
        blocks, "cell").select("group", "cell", "low", "high", F.explode(F.sequence(
            "first", F.col("first") + F.col("parts") - 1)).alias("block")), "voronoi-needs")
    sent = placed.join(blocks, "cell").withColumn(
        "block", (F.col("first") + F.col("row") % F.col("parts")).cast("int")).join(
        needed, ["cell", "block"]).filter("far BETWEEN low AND high").select(
        "group", "block", "row", "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    asking = in_tasks(asked, queries, "group int, row long, vec_id long, v binary, floor long").join(
        needed.select("group", "block").distinct(), "group").select(*sent.columns)
    found = sent.unionByName(asking).groupBy("group", "block").applyInArrow(
        lambda table: _solved(table, dim, kind, k),
        "q_row long, query_id long, vec_id long, row long, score long")
    ranked = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


SQL = f"""
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM w q JOIN w d ON d.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= {K}
"""
