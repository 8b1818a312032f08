"""Mixture-controlled packing by deficit round-robin, without a sequential pass.

Every source is a queue of tokens, cut into packets of ``quantum`` tokens. In each round a queue
with share ``p`` earns ``p * window`` tokens of credit, sends as many whole packets as its credit
covers, and carries the rest (its deficit) into the next round. All packets but a queue's last
have one size, so the packets sent by the end of round ``r`` are ``floor(r * p * window / quantum)``
in closed form, up to the queue's end. Any task can therefore say where any packet goes, from one
row of totals per queue: deficits carry across windows and partitions without being passed on.
With many queues the same rounds are laid out as a table of packets, whose running total over
ranges of rounds says the same places.

The rounds are laid end to end and cut into windows, so only the very last one needs padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from curbsight.llm.common import in_tasks, kept, portions, record_batch
from curbsight.llm.tokens import END_ID, encoder, vocabulary

WINDOW = 2048
QUANTUM = 256
QUEUES = 256
SCALE = 1 << 40
NO_SOURCE = "\u0000none"

_ENCODED = pa.schema([("task", pa.int64()), ("queue", pa.string()), ("doc_id", pa.int64()),
                      ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("start", pa.int64()),
                     ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_PACKETS = pa.schema([("queue", pa.string()), ("packet", pa.int64()),
                      ("round", pa.decimal128(38, 0)), ("length", pa.int64())])
PORTION = 50_000


def encoded(docs: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """Ids per document, with the tokens of its queue that this task has seen before it."""
    def run(batches):
        encode = encoder("byte", *paths).encode
        task, seen = TaskContext.get().partitionId(), {}
        for part in portions(batches, "text"):
            out = {f.name: [] for f in _ENCODED}
            for doc_id, queue, ids in zip(
                    part["doc_id"], part["queue"], encode([t or "" for t in part["text"]])):
                before = seen.get(queue, 0)
                seen[queue] = before + len(ids) + 1
                out["task"].append(task)
                out["queue"].append(queue)
                out["doc_id"].append(doc_id)
                out["before"].append(before)
                out["n"].append(len(ids) + 1)
                wide = np.asarray([*ids, END_ID], dtype="<u4")
                out["ids"].append(
                    (wide.astype("<u2") if wide.max() < 1 << 16 else wide).tobytes())
            yield record_batch(_ENCODED, out)

    return in_tasks(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce("source", F.lit(NO_SOURCE)).alias("queue"), "text"), run,
        "task long, queue string, doc_id long, before long, n long, ids binary")


class Rounds:
    """Where each token of each queue goes; ``sizes`` and ``weights`` are whole numbers."""

    def __init__(self, sizes: list[int], weights: list[int], window: int, quantum: int):
        self.sizes, self.weights, self.quantum = sizes, weights, quantum
        self.credit = [window * w for w in weights]
        self.price = sum(weights) * quantum
        self.at = (-1, [], 0)

    def sent(self, r: int) -> list[int]:
        """Tokens each queue has sent by the end of round ``r``."""
        return [min(r * c // self.price * self.quantum, s)
                for c, s in zip(self.credit, self.sizes)]

    def place(self, queue: int, packet: int) -> int:
        """Position of the first token of a packet in the whole output."""
        r = -(-(packet + 1) * self.price // self.credit[queue])
        if self.at[0] != r:
            before, after = self.sent(r - 1), self.sent(r)
            ahead, total = [], sum(before)
            for a, b in zip(before, after):
                ahead.append(total - a)
                total += b - a
            self.at = (r, ahead, total)
        return self.at[1][queue] + packet * self.quantum


def pieces_of(first: int, n: int, place, quantum: int, window: int):
    """(start, length, position) of a document whose tokens are ``first`` ... in its queue."""
    held = None
    done = 0
    while done < n:
        packet, inside = divmod(first + done, quantum)
        length, at = min(quantum - inside, n - done), place(packet) + inside
        while length:
            take = min(length, window - at % window)
            if held and held[2] + held[1] == at and at % window:
                held = (held[0], held[1] + take, held[2])
            else:
                if held:
                    yield held
                held = (done, take, at)
            done, at, length = done + take, at + take, length - take
    if held:
        yield held


def weighted(totals: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """(queue, tokens, weight): ``mixture`` of a table of queues."""
    if not targets:
        return totals.withColumn("weight", F.col("tokens"))
    named = F.col("queue").isin(list(targets))
    met = {r["queue"] for r in totals.filter(named).select("queue").collect()}
    left = unnamed_share(met, targets)
    free = totals.filter(~named).agg(F.sum("tokens")).first()[0] or 0

    def run(batches):
        for batch in batches:
            weights = [weight(n, s, targets, left, free) for n, s in zip(
                batch.column("queue").to_pylist(), batch.column("tokens").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(weights, pa.int64())], ["queue", "tokens", "weight"])

    return in_tasks(totals.select("queue", "tokens"), run,
                    "queue string, tokens long, weight long")


def packet_places(bases: DataFrame, totals: DataFrame, targets: dict[str, float] | None,
                  window: int, quantum: int) -> DataFrame:
    """(queue, packet, at): what ``Rounds.place`` says, for any number of queues.

    Packets are sorted by round, queue and number over range partitions. Each task adds up its
    own packets; only one total per partition comes to the driver.
    """
    queues = kept(weighted(totals, targets), "queue-weights")
    price = int(queues.agg(F.sum(F.col("weight").cast("decimal(38,0)"))).first()[0]) * quantum

    def cut(batches):
        for batch in batches:
            out = {f.name: [] for f in _PACKETS}
            rows = batch.to_pydict()
            for queue, base, held, tokens, w in zip(*(rows[c] for c in (
                    "queue", "base", "held", "tokens", "weight"))):
                for packet in range(-(-base // quantum), -(-(base + held) // quantum)):
                    out["queue"].append(queue)
                    out["packet"].append(packet)
                    out["round"].append(-(-(packet + 1) * price // (window * w)))
                    out["length"].append(min(quantum, tokens - packet * quantum))
                    if len(out["queue"]) >= PORTION:
                        yield record_batch(_PACKETS, out)
                        out = {f.name: [] for f in _PACKETS}
            yield record_batch(_PACKETS, out)

    packets = in_tasks(
        bases.join(queues, "queue").select("queue", "base", "held", "tokens", "weight"), cut,
        "queue string, packet long, round decimal(38,0), length long")
    order = ["round", "queue", "packet"]
    fan = max(12, int(bases.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def added(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ends = at + np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("queue"), batch.column("packet"),
                 pa.array(np.full(len(ends), part), pa.int32()),
                 pa.array(ends - lengths), pa.array(lengths)],
                ["queue", "packet", "part", "inside", "length"])
            at = int(ends[-1]) if len(ends) else at

    # Written once, so that a packet has the same partition in the totals and in the places.
    laid = kept(in_tasks(
        kept(packets, "packets").repartitionByRange(fan, *order).sortWithinPartitions(*order),
        added, "queue string, packet long, part int, inside long, length long"), "laid-packets")
    sums = {r["part"]: r["n"] for r in laid.groupBy("part").agg(
        F.sum("length").alias("n")).collect()}
    starts, at = [], 0
    for part in range(max(sums, default=0) + 1):
        starts.append(at)
        at += sums.get(part, 0)
    ahead = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("part"))
    return laid.select("queue", "packet", (ahead + F.col("inside")).alias("at"))


def pack(docs: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW,
         quantum: int = QUANTUM, queues: int = QUEUES,
         paths: tuple[str, ...] | None = None) -> DataFrame:
    """Pieces of all documents, packed into windows of ``window`` tokens.

    ``docs`` has doc_id, source, text. A document is its ids and the end id; a null or empty text
    is the end id alone; a null source is a queue of its own; repeated rows are packed each.
    ``targets`` gives sources a weight; all others keep weights in proportion to their tokens,
    scaled so that unnamed sources fill what the named shares leave (without ``targets``, the
    proportions of the corpus: then all queues end together). A queue that ends drops out and
    the others go on, so every token is placed. Every source is a queue of its own; up to
    ``queues`` of them are one list that each task holds, more are a table, with the same result.
    An empty table gives no pieces. ``ids`` holds little-endian unsigned 32-bit ids.
    """
    paths = paths or (vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    table = kept(encoded(docs, paths), "packed-ids")

    per_task = table.groupBy("queue", "task").agg(F.sum("n").alias("tokens"))
    earlier = Window.partitionBy("queue").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = per_task.select(
        "queue", "task", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"),
        F.col("tokens").alias("held"))
    totals = per_task.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    listed = totals.orderBy("queue").limit(queues + 1).collect()
    placed = table.join(bases, ["queue", "task"]).select(
        "doc_id", "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    many = len(listed) > queues
    if many:
        first, last = (F.floor(F.col("first") / quantum),
                       F.floor((F.col("first") + F.col("n") - 1) / quantum))
        places = packet_places(bases, totals, targets, window, quantum)
        found = placed.select("queue", "first", F.explode(F.sequence(first, last)).alias(
            "packet")).join(places, ["queue", "packet"]).groupBy("queue", "first").agg(F.transform(
                F.sort_array(F.collect_list(F.struct("packet", "at"))),
                lambda x: x["at"]).alias("at"))
        placed = placed.join(found, ["queue", "first"])
    else:
        names = [r["queue"] for r in listed]
        sizes = [r["tokens"] for r in listed]
        weights = mixture(names, sizes, targets)
        number = {name: i for i, name in enumerate(names)}

    def run(batches):
        rounds = None if many else Rounds(sizes, weights, window, quantum)
        for part in portions(batches, "ids"):
            out = {f.name: [] for f in _PIECES}
            for i, (doc_id, queue, first, n, raw) in enumerate(zip(
                    part["doc_id"], part["queue"], part["first"], part["n"], part["ids"])):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")
                ids = ids.astype("<u4")
                if many:
                    own, begin = part["at"][i], first // quantum
                    place = lambda p: own[p - begin]
                else:
                    q = number[queue]
                    place = lambda p: rounds.place(q, p)
                for start, length, at in pieces_of(first, n, place, quantum, window):
                    for name, value in zip(out, (
                            doc_id, queue, start, length, n, at // window, at % window,
                            ids[start:start + length].tobytes())):
                        out[name].append(value)
            yield record_batch(_PIECES, out)

    return in_tasks(placed, run, "doc_id long, queue string, start long, length long, "
                    "doc_tokens long, sequence_id long, offset long, ids binary")


def mixture(names: list[str], sizes: list[int], targets: dict[str, float] | None) -> list[int]:
    """Whole weights of the queues."""
    if not targets:
        return list(sizes)
    left = unnamed_share(names, targets)
    free = sum(s for n, s in zip(names, sizes) if n not in targets)
    return [weight(n, s, targets, left, free) for n, s in zip(names, sizes)]


def unnamed_share(names, targets: dict[str, float]) -> float:
    if any(t <= 0 for t in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are shares above 0 that add up to at most 1")
    return max(0.0, 1 - sum(t for n, t in targets.items() if n in names))


def weight(name: str, size: int, targets: dict[str, float], left: float, free: int) -> int:
    return max(1, round(SCALE * (targets[name] if name in targets
                                 else left * size / max(free, 1))))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset", "queue")
