"""Top-k scores, ranked search and the conversation trie against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from curbsight.llm import lexical, prefix_trie, voronoi

VECTORS = "vec_id long, embedding array<float>"
WIDE = "vec_id long, embedding array<double>"


def brute_scores(rows, k=20, step=20):
    usable = []
    for i, (vec_id, x) in enumerate(rows):
        if vec_id is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            usable.append((i, vec_id, [math.floor(64 * float(c)) for c in x]))
    found = Counter()
    for i, q_id, q in usable:
        if q_id % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), v) for j, v, x in usable if j != i)
            found.update((q_id, n, v, -s) for n, (s, v) in enumerate(scored[:k], 1))
    return found


def test_top_scores_equal_brute_force(spark, sf):
    base = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()][:160]
    width = len(base[0][1])
    odd = [(1000, None), (1020, [None] * width), (1040, [float("nan")] * width), (1060, [float("inf")] * width),
           (None, [1.0] * width), (1080, [0.0] * width), (1100, []), (1120, [1.0, -1.0]), (20, base[3][1])]
    copies = [(2000 + i, base[7][1]) for i in range(60)]
    rows = base + odd + copies
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'own' AS cell", "'own' AS v", "1 AS row")
    expected = brute_scores(rows)
    for options in ({}, {"pivots": 4, "group": 3, "block": 16}, {"pivots": 1}, {"pivots": 60, "block": 7}):
        found = voronoi.top_scores(table, **options).collect()
        assert Counter(map(tuple, found)) == expected, options
    few = voronoi.top_scores(table.filter("vec_id < 5"), step=1, k=3).collect()
    assert Counter(map(tuple, few)) == brute_scores([r for r in rows if r[0] is not None and r[0] < 5], 3, 1)


def test_top_scores_of_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-9_000_000, 9_000_000, 6) * 1.0).tolist()) for i in range(70)]
    rows += [(500, [1e300] * 6)]  # its scores would not fit a long
    found = voronoi.top_scores(spark.createDataFrame(rows, WIDE), block=16, pivots=3).collect()
    assert Counter(map(tuple, found)) == brute_scores(rows[:-1])


def test_distances_are_those_of_the_space_with_the_added_coordinate():
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(50, 8)) * rng.uniform(1, 300, size=(50, 1)))
    longest = float((x ** 2).sum(1).max())
    space = voronoi.Space(x[:7], longest)
    wide = np.hstack([x, np.sqrt(longest - (x ** 2).sum(1))[:, None]])
    asked = np.hstack([x, np.zeros((50, 1))])
    apart = lambda a, b: np.linalg.norm(a[:, None] - b[None], axis=2)
    assert np.allclose(space.of_data(x), apart(wide, wide[:7]), atol=1e-4)
    assert np.allclose(space.of_queries(x), apart(asked, wide[:7]), atol=1e-4)


def test_top_scores_of_vectors_of_any_length_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.01, 5)).tolist()) for i in range(400)]
    rows += [(1000 + i, (np.ones(8) * 3 + rng.normal(scale=0.01, size=8)).tolist()) for i in range(100)]
    expected = brute_scores(rows)
    for options in ({}, {"pivots": 8, "block": 40, "group": 5}, {"pivots": 60, "block": 25}):
        found = voronoi.top_scores(spark.createDataFrame(rows, WIDE), **options).collect()
        assert Counter(map(tuple, found)) == expected, options


def test_bounds_leave_out_far_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    x = np.concatenate([c + rng.normal(scale=0.01, size=(60, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = np.floor(64 * x)
    longest = float((q ** 2).sum(1).max())
    space = voronoi.Space(q[::60], longest)
    far = space.of_data(q)
    within = np.full(8, np.inf)
    for c in range(8):
        within[c] = np.sort(far[far.argmin(1) == c, c])[20]
    reach, dist = voronoi._bounds(space, within, q[::60], np.arange(8), 20)(q, np.arange(len(q)) + 100)
    can = dist - reach[:, None] <= np.array([far[far.argmin(1) == c, c].max() for c in range(8)])
    assert can.sum() < 0.5 * can.size
    scores = q @ q.T
    np.fill_diagonal(scores, -np.inf)
    least = np.sort(scores, axis=1)[:, -20]
    exact = np.sqrt(np.maximum((q ** 2).sum(1) + longest - 2 * least, 0))
    assert (exact <= reach).all()


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_search(docs, items, k=20):
    read = [(d, Counter(terms_of(t))) for d, t in docs]
    read = [(d, c) for d, c in read if c]
    n_docs, length = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    found = Counter()
    for item, text in items:
        scored = []
        for d, c in read:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        found.update((item, n, d if known else None, -s)
                     for n, (s, known, d) in enumerate(sorted(scored)[:k], 1))
    return found


def test_search_equals_brute_force(spark, docs, rows, sf):
    base = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    items = [tuple(r) for r in base.collect()] + [
        (900, None), (901, ""), (902, " \x00!?"), (903, "One, two-THREE zzz"), (903, "É ß 中文"), (None, "word end word"),
        (904, "İstanbul ſtraße"), (905, "absent9 absent9")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(r.doc_id, r.text) for r in rows] + [(20_000 + i, "Same words\x00here ſtraße") for i in range(30)]
    more = docs.unionByName(spark.createDataFrame(texts[len(rows):], "doc_id long, text string"),
                            allowMissingColumns=True)
    expected = brute_search(texts, items)
    for options in ({}, {"term_bytes": 900}, {"postings": 70}):
        found = lexical.search(more, bench, **options).collect()
        assert Counter(map(tuple, found)) == expected, options


def test_search_of_empty_tables(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert lexical.search(docs.limit(0), bench).count() == 0
    assert lexical.search(docs, bench.limit(0)).count() == 0


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    found = Counter()
    for node, held in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaf = [n for n in below if not any(len(x) == len(n) + 1 and x[:len(n)] == n for x in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        text = ",".join(map(str, sorted(ends[node]))).encode()
        found[min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children),
              len(leaf), saved, hashlib.sha256(text).hexdigest()] += 1
    return found


CONVERSATIONS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                              T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="module")
def talks(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    rng = np.random.default_rng(8)
    rows += [(500 + i, t, "user", f"turn {t} é{rng.integers(0, 2)}") for i in range(40) for t in range(12)]
    rows += [(700, None, None, None), (700, 0, "", "x"), (None, 1, "user", "lost"), (-7, 1, "user", "below zero"),
             (-5, 0, "user", "base"), (701, 1, "user", "alone"), (702, 5, "a", "b" * 100_000)]
    rows += [(900, t, "user", "again and again") for t in range(300)]
    return rows


def test_trie_equals_brute_force(spark, talks):
    table = spark.createDataFrame(talks, CONVERSATIONS).selectExpr("*", "'own' AS depth", "1 AS conv", "2 AS p1")
    expected = brute_trie(talks)
    assert Counter(map(tuple, prefix_trie.trie(table.repartition(7)).collect())) == expected


def test_trie_is_built_again_when_fingerprints_collide(spark, talks, monkeypatch):
    """With base 1 and equal hashes, the order of turns is lost; the checks notice and try again."""
    rows = [(10, 0, "u", "a"), (10, 1, "u", "b"), (15, 0, "u", "b"), (15, 1, "u", "a"), (20, 0, "u", "a")]
    real, used = prefix_trie.lanes, []

    def weak(attempt):
        used.append(attempt)
        return {"p1": 1, "p2": 1} if attempt == 0 else real(attempt)

    monkeypatch.setattr(prefix_trie, "lanes", weak)
    table = spark.createDataFrame(rows, CONVERSATIONS)
    assert Counter(map(tuple, prefix_trie.trie(table).collect())) == brute_trie(rows)
    assert used == [0, 1]


def test_running_products_continue_across_tasks(spark):
    rows = [(k, i, (k * 31 + i * 7) % 1000 - 500) for k, n in ((1, 5), (2, 5000), (3, 40), (9, 1)) for i in range(n)]
    base = prefix_trie.lanes(0)["p1"]
    table = spark.createDataFrame(rows, "k long, i long, x long").selectExpr("*", "x AS p", "x AS s").repartition(5)
    got = prefix_trie.running_products(table, "k", [table["i"]], {"p": base, "s": 1}).collect()
    expected, state = {}, {}
    for k, i, x in sorted(rows):
        p, s = state.get(k, (0, 0))
        state[k] = p, s = (p + pow(base, i, 1 << 64) * x) % (1 << 64), s + x
        expected[k, i] = (i, p, s)
    assert {(r.k, r.i): (r.pos, r.p % (1 << 64), r.s) for r in got} == expected


def test_empty_tables_give_no_rows(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert voronoi.top_scores(spark.createDataFrame([], VECTORS)).count() == 0
    assert voronoi.top_scores(spark.createDataFrame([(20, None)], VECTORS)).count() == 0
