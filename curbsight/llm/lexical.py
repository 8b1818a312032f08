"""Ranked lexical search without a document index: one automaton of all item terms reads the texts.

Terms of the items become patterns between two boundary marks, and in a text every character that is
not part of a term becomes a mark. An Aho-Corasick automaton over the UTF-8 bytes then reports
exactly the whole terms, in one pass over the text; the outputs it counts are the term frequencies.
Document frequencies and lengths are added up from these counts, and each output maps to the items
that hold the term, so a document is scored for all items at once. A task keeps the best of each
item and passes on only those.

Only the automaton and the item lists are broadcast. Item terms are dealt to automata of at most
``TERM_BYTES`` bytes of text, and items to lists of at most ``POSTINGS`` entries; more of either
means more passes, with the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from curbsight.llm.common import LOWEST, in_tasks, kept, portions, record_batch, row_key

K = 20
TERM_BYTES = 2 << 20
POSTINGS = 2_000_000
# Fixed by the ranking: term characters, scale of weights and counts, length share and saturation.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH_SHARE, SATURATION, UNIT = 25, 12, 1_000_000_000

# Byte by byte: separators become a blank, capitals small letters, everything else stays.
_TABLE = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20
    for b in range(256))

_SCANNED = pa.schema([("doc_id", pa.int64()), ("_id", pa.int64()), ("_txt", pa.int64()),
                      ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, reps): the distinct terms of every item and how often it holds them."""
    numbered = items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    found = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER),
                                 F.lit(f"[^{SEPARATORS}]+"), F.lit(0))
    return numbered.select("item", "item_id", F.explode(found).alias("term")).groupBy(
        "item", "item_id", "term").agg(F.count(F.lit(1)).alias("reps"))


def _automaton(terms: list[tuple[int, str]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for number, term in terms:
        made.add_word(f" {term} ".encode().decode("latin-1"), number)
    made.make_automaton()
    return made


def scanned(docs: DataFrame, terms: DataFrame, parts: int) -> DataFrame:
    """(doc_id, copies, n, terms, tfs) of every document; ``terms`` has (part, no, term)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")
    passes = None
    for part in range(parts):
        words = [(r["no"], r["term"]) for r in terms.filter(F.col("part") == part).collect()]
        shared = spark.sparkContext.broadcast(_automaton(words) if words else None)

        def scan(batches, shared=shared):
            automaton = shared.value
            for rows in portions(batches, "text"):
                sizes, numbers, counts = [], [], []
                for text in rows["text"]:
                    plain = (text or "").encode(errors="surrogatepass").translate(_TABLE)
                    sizes.append(len(plain.split()))
                    found = automaton.iter(f" {plain.decode('latin-1')} ") if automaton and sizes[-1] else ()
                    no, tf = np.unique(np.fromiter((no for _, no in found), np.int32), return_counts=True)
                    numbers.append(no)
                    counts.append(tf.astype(np.int32))
                yield record_batch(_SCANNED, {
                    **{c: rows[c] for c in ("doc_id", "_id", "_txt")}, "n": sizes,
                    "terms": numbers, "tfs": counts})

        found = in_tasks(keyed, scan, "doc_id long, _id long, _txt long, n long, "
                                      "terms array<int>, tfs array<int>")
        if parts == 1:
            return kept(found.select("doc_id", F.lit(1).cast("long").alias("copies"), "n", "terms", "tfs"),
                        "scanned")
        # Equal rows have equal hits: one of them is kept per automaton, with their number.
        once = found.groupBy("_id", "_txt").agg(
            F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("n"), F.first(F.struct("terms", "tfs")).alias("hits"))
        once = kept(once, "scanned-part")
        passes = once if passes is None else passes.unionByName(once)
    merged = passes.groupBy("_id", "_txt").agg(
        F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), F.first("n").alias("n"),
        F.collect_list("hits").alias("hits"))
    return kept(merged.select("doc_id", "copies", "n", F.flatten("hits.terms").alias("terms"),
                              F.flatten("hits.tfs").alias("tfs")), "scanned")


def _ranked(lists, documents: int, length: int, k: int):
    """Tasks' function: the best ``k`` documents per item of ``lists`` among a task's documents."""
    def run(batches):
        items, starts, entries, gains = lists.value
        best = [(np.zeros(0, np.int64),) * 3]
        held, floor = 0, np.zeros(len(items), np.int64)
        most = np.bincount(entries, weights=gains).max(initial=0)
        exact = UNIT // 1000 * int(most) < 1 << 53
        for batch in batches:
            doc = np.asarray(batch.column("doc_id").fill_null(LOWEST), dtype=np.int64)
            copies, n = (np.asarray(batch.column(c), dtype=np.int64) for c in ("copies", "n"))
            no, tf = (np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in ("terms", "tfs"))
            ends = np.asarray(batch.column("terms").offsets, dtype=np.int64)
            ends = ends - ends[0]
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(1, length)
            part = (UNIT * tf) // (1000 * tf + SATURATION * np.repeat(m, np.diff(ends)))
            for i in range(len(doc)):
                own = no[ends[i]:ends[i + 1]]
                a, size = starts[own], starts[own + 1] - starts[own]
                if not size.sum():
                    continue
                at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                add = gains[at] * np.repeat(part[ends[i]:ends[i + 1]], size)
                if exact:
                    score = np.bincount(entries[at], weights=add, minlength=len(items)).astype(np.int64)
                else:
                    score = np.zeros(len(items), np.int64)
                    np.add.at(score, entries[at], add)
                hit = np.flatnonzero((score > 0) & (score >= floor))
                for _ in range(min(k, int(copies[i]))):
                    best.append((hit, np.full(len(hit), doc[i]), score[hit]))
                    held += len(hit)
                if held > 2 * k * len(items) + 100_000:
                    best, held = [_top(best, k)], 0
                    full = np.bincount(best[0][0], minlength=len(items)) >= k
                    least = np.full(len(items), np.iinfo(np.int64).max)
                    np.minimum.at(least, best[0][0], best[0][2])
                    floor = np.where(full, least, 0)
        item, doc, score = _top(best, k)
        yield record_batch(_FOUND, {"item": items[item], "doc_id": pa.array(
            doc, mask=doc == LOWEST), "score": score})
    return run


def _top(parts: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` highest scores per item, equal ones by document."""
    item, doc, score = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((doc, -score, item))
    item, doc, score = item[by], doc[by], score[by]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return item[place < k], doc[place < k], score[place < k]


def search(docs: DataFrame, items: DataFrame, k: int = K, term_bytes: int = TERM_BYTES,
           postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 per item.

    ``docs`` has doc_id and text, ``items`` has item_id and text. A null or empty text has no terms:
    such a document is found by nothing and does not count in N, such an item finds nothing. Every
    row of ``items`` is an item of its own, also where ids repeat or are null. Rows that share a
    doc_id are documents of their own. Equal scores rank by doc_id, rows without one first. Empty
    tables give no rows.
    """
    spark = docs.sparkSession
    held = kept(item_terms(items), "item-terms")
    sizes = held.select("term").distinct().agg(
        F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    parts = max(1, math.ceil((sizes[1] or 0) / term_bytes))
    # Numbers follow each other within a part and across parts.
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")
    placed = held.select("term").distinct().select(part, "term").withColumn(
        "place", F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1)
    counts = dict(map(tuple, placed.groupBy("part").count().collect()))
    before = [sum(counts.get(p, 0) for p in range(i)) for i in range(parts)]
    starts = F.array(*[F.lit(b) for b in before])
    terms = kept(placed.select("part", (F.get(starts, F.col("part")) + F.col("place")).cast(
        "int").alias("no"), "term"), "numbered-terms")

    read = scanned(docs, terms, parts)
    documents, length = read.agg(
        F.sum(F.when(F.col("n") > 0, F.col("copies"))), F.sum(F.col("n") * F.col("copies"))).first()
    documents, length = documents or 0, length or 0
    spread = read.select("copies", F.explode("terms").alias("no")).groupBy("no").agg(
        F.sum("copies").alias("df"))
    weights = terms.join(spread, "no").select("term", "no", F.floor(1000 * F.log(
        F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("weight"))
    weighted = kept(held.join(weights, "term").select(
        "item", "no", (F.col("reps") * F.col("weight")).alias("gain")), "postings")

    # Items are dealt to lists so that no list has many more than ``postings`` entries.
    lists = max(1, math.ceil(weighted.count() / postings))
    known = sizes[0] or 0
    found = None
    for number in range(lists):
        rows = weighted.filter(F.pmod(F.xxhash64("item"), F.lit(lists)) == number).toArrow()
        names, entries = np.unique(np.asarray(rows.column("item")), return_inverse=True)
        no = np.asarray(rows.column("no"), dtype=np.int64)
        by = np.argsort(no, kind="stable")
        shared = spark.sparkContext.broadcast((
            names, np.searchsorted(no[by], np.arange(known + 1)), entries[by],
            np.asarray(rows.column("gain"), dtype=np.int64)[by]))
        best = in_tasks(read, _ranked(shared, documents, length, k), "item long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    top = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return top.join(held.select("item", "item_id").distinct(), "item").select(
        "item_id", "rank", "doc_id", "score")


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^{SEPARATORS}]+') AS terms
  FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms)) AS total FROM d WHERE len(terms) > 0),
t AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (
  SELECT row_number() OVER () AS item, item_id,
         unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^{SEPARATORS}]+')) AS term
  FROM benchmark),
scored AS (
  SELECT i.item, i.item_id, tf.row, tf.doc_id,
         sum(CAST(floor(1000 * ln(CAST(2 * s.docs + 2 AS DOUBLE) / CAST(2 * df.df + 1 AS DOUBLE))) AS BIGINT)
             * (({UNIT} * tf.tf) // (1000 * tf.tf + {SATURATION} * (100 - {LENGTH_SHARE}
                + ({LENGTH_SHARE} * tf.n * s.docs) // s.total)))) AS score
  FROM i JOIN tf USING (term) JOIN df USING (term) CROSS JOIN s
  GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS n
  FROM scored WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE n <= {K}
"""
