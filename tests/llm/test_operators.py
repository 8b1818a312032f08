"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbsight.llm import (decontaminate, jaccard, language, line_dedup, neighbours, packing,
                           quality, repeats, secrets, token_index, tokens)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slow_ids(name):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokens.vocabulary(name))
    return lambda text: [*encoder.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_packing_places_every_id_once(docs, rows):
    encode = slow_ids("byte_bpe_50k.json")
    found = packing.digests(packing.pack(docs)).collect()
    expected = Counter()
    texts = {}
    for r in rows:
        texts[r.doc_id] = encode(r.text)
        expected[r.doc_id] += len(texts[r.doc_id])
    got = Counter()
    for p in found:
        got[p.doc_id] += p.length
        assert p.doc_tokens == len(texts[p.doc_id])
        assert p.ids_crc32 == crc(texts[p.doc_id][p.start:p.start + p.length])
    assert got == expected
    sequences = defaultdict(list)
    for p in found:
        sequences[p.sequence_id].append((p.offset, p.length))
    for number, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or number == max(sequences)


def test_packing_meets_target_shares(spark):
    docs = spark.createDataFrame(
        [(i, "many words in a row " * 300, "a" if i % 4 else "b") for i in range(80)],
        "doc_id long, text string, source string")
    pieces = packing.pack(docs, targets={"b": 0.5}).collect()
    first = [p for p in pieces if p.sequence_id < 8]
    share = sum(p.length for p in first if p.queue == "b") / sum(p.length for p in first)
    assert abs(share - 0.5) < 0.05


def test_packing_of_many_sources_keeps_every_queue(spark, docs):
    key = ("doc_id", "queue", "start", "length", "sequence_id", "offset", "ids_crc32")

    def places(**options):
        return Counter(packing.digests(packing.pack(docs, **options)).select(*key).collect())

    assert places(queues=2) == places()
    shares = {"src9": 0.4, "none such": 0.1}
    assert places(queues=2, targets=shares) == places(targets=shares)


def test_packing_gives_a_small_source_its_share(spark):
    rows = [(i, "many words in a row " * 40, f"s{i % 300}") for i in range(1200)]
    rows += [(5000, "other words here " * 900, "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, targets={"tail": 0.5}).collect()
    assert len({p.queue for p in pieces}) == 301
    first = [p for p in pieces if p.sequence_id < 2]
    share = sum(p.length for p in first if p.queue == "tail") / sum(p.length for p in first)
    assert share > 0.4


def plain_spans(text):
    kinds = [
        (0, "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        (1, "access", r"AKIA[A-Z0-9]+", 0, 20), (2, "hex", r"[0-9a-f]+", 0, 24)]
    found = []
    for rank, kind, pattern, group, least in kinds:
        flags = re.I | re.A if kind == "assign" else 0
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text, flags)
                  if len(m.group(group)) >= least]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def test_secrets_equal_plain_search(docs, rows):
    expected = Counter()
    for r in rows:
        spans = plain_spans(r.text or "")
        kinds = Counter(s.split(":")[0] for s in spans)
        expected[r.doc_id, kinds["assign"], kinds["access"], kinds["hex"],
                 sha(",".join(spans).encode())] += 1
    found = secrets.digests(secrets.find(docs))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)
                   for r in found.collect()) == expected
    assert {"assign:0:23", "access:29:49"} <= set(
        found.filter("doc_id = 10008").first().spans.split(","))


def test_random_strings_are_told_from_words(spark):
    rng = np.random.default_rng(1)
    letters = np.array(list(secrets.ENCODINGS["base62"]))
    texts = [f"see {''.join(rng.choice(letters, 40))} here" for _ in range(60)]
    texts += ["see AzzzzzzzzzzzzzzzzzzzzzzzzAzzzzzzzzzzzzz1 here" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.find(docs).collect()}
    assert sum(found[i] == "random:4:44" for i in range(60)) >= 54
    assert not any(found[i] for i in range(60, 120))


def test_error_function_of_arrays():
    z = np.linspace(-6, 20, 2001)
    exact = np.array([math.erfc(x) for x in z])
    assert (np.abs(secrets._erfc(z) - exact) <= 2e-7 * exact).all()


def test_battery_is_even_on_random_strings_and_low_on_prose():
    rng = np.random.default_rng(3)
    for n, size in ((40, 16), (32, 62), (64, 64)):
        p = np.exp(-secrets.battery(rng.integers(0, size, (4000, n)), size))
        assert 0.02 < (p < 0.05).mean() < 0.09 and 0.4 < (p < 0.5).mean() < 0.6
    words = np.array([[ord(c) - 97 for c in ("themereisnothinglikethesea" * 3)[i:i + 40]] for i in range(26)])
    assert (np.exp(-secrets.battery(words, 26)) < 0.05).mean() > 0.9


def test_planted_keys_are_found_and_false_reports_are_few(spark):
    """Keys of six encodings among prose, compound words, paths, camel case and repeated digits."""
    rng = np.random.default_rng(5)
    syllables = ["the", "ing", "ver", "tion", "ment", "ber", "lo", "sa", "ne", "ri", "co", "und"]
    word = lambda k: "".join(rng.choice(syllables, k))
    draw = lambda name, n: "".join(rng.choice(list(secrets.ENCODINGS[name]), n))
    keys = {}
    texts = []
    for i in range(300):
        plain = " ".join([*(word(int(rng.integers(1, 6))) for _ in range(120)), word(4).title(), "SS" + word(4),
                          f"{word(3)}-{word(4)}/{word(3)}", word(2) + word(3).title() + word(2).title(),
                          "0" * 20 + "1", "2024-01-01-2024-01-01"])
        key = ""
        if i % 3 == 0:
            key = draw(["base62", "HEX", "base36", "base32", "base64url"][i // 3 % 5], 48)
        elif i % 3 == 1:
            h = draw("HEX", 32)
            key = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
        keys[i] = (len(plain) + 1, len(plain) + 1 + len(key)) if key else None
        texts.append((i, f"{plain} {key} {word(3)}"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    hit = false = 0
    for r in secrets.find(docs).collect():
        at = keys[r.doc_id]
        spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")]
        true = [s for s in spans if at and s[0] >= at[0] and s[1] <= at[1]]
        hit += bool(true)
        false += len(spans) - len(true)
    assert hit >= 0.8 * sum(k is not None for k in keys.values())
    assert false <= 0.1 * (hit + false)


def test_values_of_known_shapes_are_judged(spark):
    rng = np.random.default_rng(6)
    prose = "a long walk along the river and back over the old bridge before night fell on the town "
    rows = [(i, prose + "hash " + "".join(rng.choice(list("0123456789abcdef"), 40))) for i in range(40)]
    rows += [(100 + i, prose + "hash " + "ab" * 20) for i in range(20)]
    rows += [(200, prose + "password=secret1"), (201, None), (None, "")]
    found = {r.doc_id: r for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(found[i].judged) == 1 and found[i].judged[0]["class"] == "hex/10" for i in range(40))
    assert sum(found[i].judged[0].random for i in range(40)) >= 34
    assert not any(found[100 + i].judged[0].random for i in range(20))
    assert tuple(found[200].judged[0]) == (None, None, None)
    assert found[201].judged == [] and found[None].judged == []
    digests = {r.doc_id: r.judged for r in secrets.digests(secrets.find(
        spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert digests[200] == "" and digests[0].startswith("hex/10:0.")


def test_lines_equal_brute_force(docs, rows):
    sites, first = defaultdict(set), {}
    for r in rows:
        key = -(1 << 63) if r.doc_id is None else r.doc_id
        for line in (r.text or "").split("\n"):
            line = line.strip(" ")
            sites[line].add(r.source)
            first[line] = min(first.get(line, key), key)
    spread = {s for s, at in sites.items() if s and len(at - {None}) >= 3}
    expected = Counter()
    for r in rows:
        key = -(1 << 63) if r.doc_id is None else r.doc_id
        lines = [] if r.text is None else r.text.split("\n")
        trimmed = [x.strip(" ") for x in lines]
        hit = [x in spread and first[x] != key for x in trimmed]
        kept = "\n".join(x for x, h in zip(lines, hit) if not h)
        expected[r.doc_id, len(lines), sum(hit), sha(kept.encode())] += 1
    cleaned = line_dedup.clean_lines(docs, min_sites=3)
    assert Counter(tuple(r) for r in line_dedup.digests(cleaned).collect()) == expected
    assert sum(k[2] * n for k, n in expected.items()) > 0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    judged = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = np.mean([r.predicted == r.quality for r in judged])
    assert len(judged) > 20 and good >= 0.9


def test_quality_defined_for_edges(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.quality(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    none = quality.quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_repeats_equal_brute_force(docs, rows):
    size, seen, texts = 400, Counter(), [(r.text or "").encode() for r in rows]
    for t in texts:
        seen.update(hash(t[i:i + size]) for i in range(len(t) - size + 1))
    expected = Counter()
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - size + 1):
            if seen[hash(t[i:i + size])] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone[:len(t)]) > 0
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        expected[r.doc_id, len(t), int(gone.sum()), spans, sha(left), spans > 0] += 1
    found = repeats.digests(repeats.without_repeats(docs)).collect()
    assert Counter(tuple(r) for r in found) == expected


def test_language_held_out_and_mixture(spark, docs, rows):
    found = {r.doc_id: r for r in language.languages(docs).collect()}
    judged = [found[r.doc_id].lang_pred == r.lang for r in rows
              if r.lang is not None and found[r.doc_id].held_out]
    assert len(judged) > 20 and np.mean(judged) >= 0.9
    for i in (10_001, 10_002, 10_003):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    halves = {}
    for r in rows:
        if r.lang in ("en", "fr") and len(halves.get(r.lang, "")) < 2000:
            halves[r.lang] = halves.get(r.lang, "") + " " + r.text
    mixed = spark.createDataFrame([(1, " ".join(halves.values()))], "doc_id long, text string")
    assert set(language.predict(mixed, language.train(docs)).first().langs) == set(halves)


def test_letters_of_all_planes():
    for text in ("\U0001E900\U0001E901\U0001E902", "\U00010400\U00010401", "abc", "\u00e9\u00df"):
        assert len(language.trigrams(text))
    assert not len(language.trigrams("\U000E0100 12 \U0001F600"))


def naive_cover(doc, item, least):
    free_d, free_i = [True] * len(doc), [True] * len(item)
    while True:
        best, matches = least - 1, []
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while (i + k < len(doc) and j + k < len(item) and free_d[i + k]
                       and free_i[j + k] and doc[i + k] == item[j + k]):
                    k += 1
                if k > best:
                    best, matches = k, []
                if k == best and k >= least:
                    matches.append((i, j))
        if not matches:
            return free_i.count(False)
        for i, j in matches:
            if all(free_d[i:i + best]) and all(free_i[j:j + best]):
                free_d[i:i + best] = free_i[j:j + best] = [False] * best


def test_tiling_equals_naive_tiling(spark):
    rng = np.random.default_rng(3)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 12, n)) for n in (3, 9, 14, 20)]
    texts = [None, "", "w1"] + [" ".join(f"w{x}" for x in rng.integers(0, 12, 40)) for _ in range(20)]
    for item in items:
        words = item.split()
        half = len(words) // 2
        texts += [" ".join(words[half:] + ["other"] * 3 + words[:half]), f"x {item} y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")],
                                  "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    small = {r.doc_id: r._items for r in decontaminate.contamination(
        docs, bench, block_bytes=32).collect()}
    for i, text in enumerate(texts):
        doc, hit = (text or "").split(), []
        for k, item in enumerate(items):
            words = item.split()
            if naive_cover(doc, words, min(4, len(words))) >= 0.5 * len(words):
                hit.append(k)
        assert found[i]._items == hit == small[i], text
    assert decontaminate.clean(docs, bench).count() == sum(not r._items for r in found.values())


def components_of(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard_equals_all_pairs(docs, rows):
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(
            "[A-Z]", lambda m: m.group().lower(), r.text or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    group = components_of(range(len(rows)), links)
    lowest = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            lowest[group[i]] = min(lowest.get(group[i], r.doc_id), r.doc_id)
    expected = Counter((r.doc_id, len(sets[i]), lowest.get(group[i])) for i, r in enumerate(rows))
    found = jaccard.similar_groups(docs).collect()
    assert Counter(tuple(r) for r in found) == expected
    assert len(links) > 10
    kept = jaccard.one_per_group(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter({*lowest.values(), None})
    assert {r._id for r in kept} == {"own"}


def test_jaccard_sets_of_one_id_get_others(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [words, words[:57], ["x"] + words[1:], words[30:] + words[:30], words[:20], ["y"] * 9, ["y"] * 8, [], None]
    table = spark.createDataFrame([(i, t if t is None else " ".join(t)) for i, t in enumerate(texts)],
                                  "doc_id long, text string")
    expected = sorted(jaccard.similar_groups(table).collect())
    assert [r.component_id for r in expected] == [0, 0, 0, 0, 4, 5, 5, 7, 8]
    assert dict(jaccard.postings(table, 5, np.empty(0, np.uint64)).dtypes)["sid"] == "bigint"
    plain, salts = jaccard.described, []

    def crowded(docs, words, salt=0):
        salts.append(salt)
        return plain(docs, words, salt).withColumn("sid", F.col("sid") % 3 if salt < 2 else F.col("sid"))

    monkeypatch.setattr(jaccard, "described", crowded)
    assert sorted(jaccard.similar_groups(table).collect()) == expected and salts == [0, 1, 2]


def test_vectors_equal_all_pairs(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    width = len(table.first().embedding)
    odd = [(-1, None), (-2, [0.0] * width), (-3, [float("nan")] * width), (-4, [None] * width),
           (-5, [float("inf")] * width), (-6, [1.0] * width), (-7, [2.0] * width)]
    table = table.unionByName(spark.createDataFrame(odd, table.schema))
    rows = table.collect()
    good = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows
            if r.embedding and None not in r.embedding}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()
            if np.isfinite(v).all() and v.any()}
    ids = sorted(good)
    matrix = np.stack([good[i] for i in ids])
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(matrix @ matrix.T >= 0.9)) if a < b]
    root = components_of([r.vec_id for r in rows], links)
    degree = Counter(i for pair in links for i in pair)
    found = {r.vec_id: r for r in neighbours.near_duplicates(table).collect()}
    assert len(found) == len(rows) and links
    assert sum(r.n_links for r in found.values()) >= 0.9 * 2 * len(links)
    assert all(r.n_links <= degree[i] for i, r in found.items())
    assert np.mean([found[i].component_id == root[i] for i in found]) >= 0.9
    assert all(r.kept == (r.component_id == i) for i, r in found.items())


def test_lists_that_fail_the_audit_are_finished_exactly(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(90, 8))
    x = np.concatenate([x, x[:40] + np.random.default_rng(4).normal(scale=0.05, size=(40, 8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    leaders = spark.createDataFrame(
        [(i, bytearray(v.tobytes()), 0.01) for i, v in enumerate(x)],
        "ball long, v binary, radius double")
    tables = neighbours.first_lists
    monkeypatch.setattr(neighbours, "first_lists", lambda *a: tables(*a).limit(0))
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    lists = neighbours.neighbour_graph(leaders, len(x))
    expected = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= np.cos(neighbours.REACH + 0.02)))
                if a < b}
    assert expected and {(r.u, r.w) for r in lists.collect()} == expected
    assert neighbours.audit(lists, leaders, 512) == 1.0


def test_audit_that_sees_nothing_is_not_passed(spark, monkeypatch):
    """A few links among many vectors: a sample sees none of them, and empty lists must not pass."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x[:8] = x[8:16] + rng.normal(scale=0.2, size=(8, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    leaders = spark.createDataFrame(
        [(i, bytearray(v.tobytes()), 0.0) for i, v in enumerate(x)], "ball long, v binary, radius double")
    empty = spark.createDataFrame([], "u long, w long, cosine double, fresh boolean")
    assert neighbours.audit(empty, leaders, 64) is None
    assert neighbours.audit(empty, leaders, 4000) == 0.0
    one, many = (neighbours.planted_recall(leaders, 3000, seeds, 10, 12, 64) for seeds in ([23], [23, 101, 102]))
    assert 0 < one <= many <= 1
    monkeypatch.setattr(neighbours, "AUDIT", 64)
    graph = {(min(r.u, r.w), max(r.u, r.w)) for r in neighbours.neighbour_graph(leaders, 3000).collect()}
    assert {(i, i + 8) for i in range(8)} <= graph


def test_token_index_round_trip(spark, docs, rows, tmp_path):
    encode = slow_ids("word_bpe_49k.json")
    some = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r.doc_id: encode(r.text) for r in rows if r.doc_id is not None}
    found = token_index.digests(token_index.stored_documents(
        spark, some, str(tmp_path / "index"))).collect()
    at = 0
    assert len(found) == len(ids)
    for r in sorted(found):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        at += r.n_tokens


def test_word_ids_equal_the_tokenizer():
    encode = slow_ids("word_bpe_49k.json")
    texts = ["a\x1cb\x85c\u00a0d\u2003e\u3000f", " \t\r\n ", "It's don't 'tis they'll", "x1y22 --a--b c,d;e", "end<|x|>end",
             "\u00c9t\u00e9 \u0130 \u00df STRASSE \u017f", "\v\f a\x0bb", "a" * 3000, "word " * 300_000, None, ""]
    got = tokens.encoder("word", tokens.vocabulary("word_bpe_49k.json")).encode([t or "" for t in texts])
    assert [[*g.tolist(), 1] for g in got] == [encode(t) for t in texts]


def test_word_ids_of_any_usual_text_and_words_taken_apart_once(monkeypatch):
    import random

    path = tokens.vocabulary("word_bpe_49k.json")
    slow, draw = slow_ids("word_bpe_49k.json"), random.Random(7)
    signs = [chr(c) for c in range(0x20, 0x180)] + list("\t\n\r ''''srtvemdl") * 8
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 60))) for _ in range(2_000)]
    texts += ["", " ", "İ ŉ ªº²½", "日本 text", "<|endoftext|> a"]
    enc, seen = tokens.WordEncoder(path), []
    assert [[*ids.tolist(), 1] for ids in enc.encode(texts)] == [slow(t) for t in texts]
    assert enc.encode([]) == [] and [len(x) for x in enc.encode(["", "\n"])] == [0, 0]
    taken = tokens.WordEncoder._words
    monkeypatch.setattr(tokens.WordEncoder, "_words", lambda self, w: (seen.extend(w), taken(self, w))[1])
    enc.encode(["a b a", "b c c"])
    assert sorted(seen) == ["a", "b", "c"]


def test_tasks_take_few_texts_at_a_time_and_give_arrow_memory_back(spark, monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    from curbsight.llm import common

    given = []
    caught = SimpleNamespace(sparkSession=spark, mapInArrow=lambda fn, schema: fn)
    pool = SimpleNamespace(release_unused=lambda: given.append(True))
    texts = pa.record_batch({"doc_id": list(range(8)), "text": ["a b c d e f g " * 40_000] * 8})
    run = common.in_tasks(caught, lambda batches: batches, "x long")
    with monkeypatch.context() as m:
        m.setattr(common.pa, "default_memory_pool", lambda: pool)
        assert list(run(iter([texts]))) == [texts] and given == [True]
    monkeypatch.setattr(jaccard, "in_tasks", lambda df, fn, schema: fn)
    made = list(jaccard.described(None, 5)(iter([texts])))
    assert sum(b.num_rows for b in made) == 8 and max(b.num_rows for b in made) <= 1 + jaccard.TEXT_BYTES // 560_000


def test_token_index_with_null_and_repeated_ids(spark, docs, rows, tmp_path):
    found = token_index.digests(token_index.stored_documents(
        spark, docs, str(tmp_path / "index"))).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in rows)


@pytest.mark.parametrize("run", [
    lambda s, d, b, l, v, p: packing.digests(packing.pack(d)),
    lambda s, d, b, l, v, p: secrets.digests(secrets.find(d)),
    lambda s, d, b, l, v, p: line_dedup.digests(line_dedup.clean_lines(d)),
    lambda s, d, b, l, v, p: quality.quality(d, l),
    lambda s, d, b, l, v, p: repeats.digests(repeats.without_repeats(d)),
    lambda s, d, b, l, v, p: language.languages(d),
    lambda s, d, b, l, v, p: decontaminate.contamination(d, b),
    lambda s, d, b, l, v, p: jaccard.similar_groups(d),
    lambda s, d, b, l, v, p: neighbours.near_duplicates(v),
    lambda s, d, b, l, v, p: token_index.digests(token_index.stored_documents(s, d, p))])
def test_empty_tables(spark, sf, docs, tmp_path, run):
    bench, labels, vectors = (spark.read.parquet(f"{sf}/{n}.parquet").limit(0)
                              for n in ("benchmark", "labels", "embeddings"))
    assert run(spark, docs.limit(0), bench, labels, vectors, str(tmp_path / "x")).count() == 0
