"""Secrets in texts: known shapes, and strings that pass a battery of randomness tests.

Runs of key-like characters, the parts between their separators, the run without separators and
the values of known shapes are read in the narrowest encoding that has all their characters.
Three tests ask whether the characters could be uniform draws from its alphabet: chi-squared of
their counts, the number of runs above and below the alphabet's middle, and the serial
correlation of neighbours. Fisher's method combines the three into one p-value.

A string is reported if text of its shape hardly ever looks as random. Every tested string gets
``DECOYS`` decoys: prose of its own document, of the same length and encoding, with as many capitals,
small letters and digits, arranged as in words. Decoys and strings are counted per
encoding and length class; the step-up rule on the share of decoys with as large a p-value keeps
the expected share of text among the reported strings of every class below ``RATE``. Classes of
short strings, where the tests cannot tell text from keys, so report little or nothing. The decoys
grow with the corpus, and so does their resolution.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from curbsight.llm.common import in_tasks, kept, mixed, portions, record_batch

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_-]{8,}")
SIGNS = re.compile(r"[+/_.=-]+")
# A string that carries less than this, drawn evenly from its alphabet, is no key.
BITS = 48
RATE = 0.05
DECOYS = 20
HUMP = 3
# p-values are counted on a grid of tenths of their natural logarithm.
GRID, BINS = 10, 400
# Characters in one step of the tests, but for a longer string.
STEP = 1 << 18

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
# Narrowest first.
ENCODINGS = {"digits": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF",
             "lower": _LOWER, "UPPER": _UPPER,
             "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
             "letters": _UPPER + _LOWER, "base62": _UPPER + _LOWER + _DIGITS,
             "base64": _UPPER + _LOWER + _DIGITS + "+/",
             "base64url": _UPPER + _LOWER + _DIGITS + "-_"}
_SETS = {name: frozenset(a) for name, a in ENCODINGS.items()}
_LEAST = {name: math.ceil(BITS / math.log2(len(a))) for name, a in ENCODINGS.items()}


def _by_byte(values: dict[str, int]) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for c, v in values.items():
        table[ord(c)] = v
    return table


_PLACES = {name: _by_byte({c: i for i, c in enumerate(a)}) for name, a in ENCODINGS.items()}
# Capitals, small letters, digits, signs; and per encoding the first place and number of each.
_FAMILIES = (_UPPER, _LOWER, _DIGITS)
_FAMILY = _by_byte({chr(b): 3 for b in range(256)}
                   | {c: i for i, f in enumerate(_FAMILIES) for c in f})
_PIECES = {name: ([min((a.index(c) for c in f if c in a), default=0) for f in _FAMILIES] + [0],
                  [max(1, sum(c in a for c in f)) for f in _FAMILIES] + [1])
           for name, a in ENCODINGS.items()}

_TEST = pa.struct([("class", pa.string()), ("bin", pa.int32())])
_SCANNED = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
    ("n_hex", pa.int64()), ("base", pa.string()),
    ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                  ("end", pa.int64()), ("tests", pa.list_(_TEST)),
                                  ("outer", pa.list_(_TEST))]))),
    ("decoys", pa.list_(pa.struct([("class", pa.string()), ("bin", pa.int32()),
                                   ("n", pa.int64())])))])
SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base string, "
          "spans array<struct<kind:string,start:bigint,end:bigint,"
          "tests:array<struct<class:string,bin:int>>,outer:array<struct<class:string,bin:int>>>>, "
          "decoys array<struct<class:string,bin:int,n:bigint>>")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind. Leftmost matches that do not overlap, per kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text)
             if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in _hex_runs(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % HEX_LEAST)


def _hex_runs(text: str):
    # A run is maximal, so asking for its length at once gives the same matches.
    return _LONG_HEX.finditer(text)


def infer_encoding(run: str) -> str | None:
    """The narrowest encoding, or None for a string of no encoding or with too few bits."""
    chars = frozenset(run)
    name = next((name for name, s in _SETS.items() if chars <= s), None)
    return name if name and len(run) >= _LEAST[name] else None


def as_tested(run: str) -> str:
    """A word with a capital in front is judged as the word."""
    return run.lower() if run[1:].islower() and run.isalpha() else run


def _erfc(z: np.ndarray) -> np.ndarray:
    """Complementary error function, to 1.2e-7 of its value everywhere (a Chebyshev fit)."""
    # Fixed values of the published fit.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
           0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1 / (1 + np.abs(z) / 2)
    upper = t * np.exp(-z * z + np.polynomial.polynomial.polyval(t, fit))
    return np.where(z >= 0, upper, 2 - upper)


def battery(values: np.ndarray, size: int) -> np.ndarray:
    """-ln of the combined p-value, per row, that the row is uniform over ``size`` places."""
    m, n = values.shape
    held = np.bincount((values + np.arange(m)[:, None] * size).ravel(),
                       minlength=m * size).reshape(m, size).astype(np.float64)
    chi = np.maximum(1e-9, size / n * (held ** 2).sum(1) - n)
    # Wilson-Hilferty: the cube root of chi-squared is nearly normal.
    k = size - 1
    tail = _erfc(((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)) / math.sqrt(2)) / 2
    lost = 2.0 ** max(1 - n, -1000)  # p of a row that is all of one kind
    high = values >= size / 2
    a = high.sum(1).astype(np.float64)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    mean = 1 + 2 * a * (n - a) / n
    spread = np.sqrt(np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    turns = np.where((a > 0) & (a < n), _erfc(np.abs(runs - mean) / spread / math.sqrt(2)), lost)
    d = values - values.mean(1, keepdims=True)
    power = (d * d).sum(1)
    along = (d[:, 1:] * d[:, :-1]).sum(1) / np.where(power > 0, power, 1)
    serial = np.where(power > 0, _erfc(np.abs(along + 1 / n) * math.sqrt(n / 2)), lost)
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (tail, turns, serial))
    return half - np.log1p(half + half * half / 2)


def cells(values: np.ndarray, size: int) -> np.ndarray:
    return np.minimum(BINS - 1, (np.maximum(battery(values, size), 0) * GRID).astype(np.int64))


def length_class(n: int) -> int:
    """Half octaves: strings of like length, whose tests have like power, are judged together."""
    return int(2 * math.log2(n))


def decoys(data: np.ndarray, encoding: str, prose: np.ndarray, begin: np.ndarray,
           length: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Per row of bytes one row of places: prose from the row's document in the shape of the row.

    Signs stay where they are. A row that changes between capitals, small letters and digits at
    most every ``HUMP`` characters, as words and joined words do, keeps its kinds in place; others
    get as many of each kind in one piece. ``prose`` holds the letters of all documents as 0 to
    25, those of a row's document from ``begin``.
    """
    n = data.shape[1]
    family = _FAMILY[data]
    sign = family == 3
    grouped = np.take_along_axis(np.sort(family, 1), np.maximum(np.cumsum(~sign, 1) - 1, 0), 1)
    calm = (family[:, 1:] != family[:, :-1]).sum(1) * HUMP <= n
    grouped = np.where(calm[:, None], family, grouped)
    first, many = (np.array(x) for x in _PIECES[encoding])
    start = (seeds % length.astype(np.uint64)).astype(np.int64)
    letters = prose[begin[:, None] + (start[:, None] + np.arange(n)) % length[:, None]]
    return np.where(sign, _PLACES[encoding][data], first[grouped] + letters % many[grouped])


class _Tests:
    """Strings of one portion, judged together per encoding and length."""

    def __init__(self):
        self.asked: dict[tuple[str, int], list] = {}
        self.decoys: Counter = Counter()

    def ask(self, run: str, doc: int) -> dict | None:
        """A test whose cell is filled in by ``answer``; None for a string that is not tested."""
        run = as_tested(run)
        encoding = infer_encoding(run)
        if not encoding:
            return None
        test = {"class": f"{encoding}/{length_class(len(run))}", "bin": 0}
        self.asked.setdefault((encoding, len(run)), []).append((run, doc, test))
        return test

    def answer(self, prose: dict[int, np.ndarray]) -> None:
        letters = np.concatenate([np.zeros(0, dtype=np.int8), *prose.values()])
        length = np.zeros(max(prose, default=0) + 1, dtype=np.int64)
        length[list(prose)] = [len(p) for p in prose.values()]
        begin = np.cumsum(length) - length
        for (encoding, n), asked in self.asked.items():
            size = len(ENCODINGS[encoding])
            rows = max(1, STEP // max(n, size))
            for at in range(0, len(asked), rows):
                part = asked[at:at + rows]
                data = np.frombuffer("".join(r for r, _, _ in part).encode("ascii"),
                                     dtype=np.uint8).reshape(len(part), n)
                for (_, _, test), cell in zip(part, cells(_PLACES[encoding][data], size).tolist()):
                    test["bin"] = cell
                own_doc = np.array([doc for _, doc, _ in part])
                able = np.flatnonzero(length[own_doc])
                if not len(able):
                    continue
                data, own_doc = data[able], own_doc[able]
                # Places follow from the string and its rank in the document, not from the portion.
                own = np.array([zlib.crc32(part[i][0].encode("ascii")) for i in able], dtype=np.uint64)
                for j in range(DECOYS):
                    found = cells(decoys(data, encoding, letters, begin[own_doc], length[own_doc],
                                         mixed(own * np.uint64(DECOYS) + np.uint64(j))), size)
                    held = np.bincount(found)
                    for cell in np.flatnonzero(held).tolist():
                        self.decoys[part[0][2]["class"], cell] += int(held[cell])


def _tested(tests: _Tests, run: str, doc: int) -> list[dict]:
    """Tests of a run as it stands and without its signs."""
    bare = SIGNS.sub("", run)
    asked = [tests.ask(run, doc)] + ([tests.ask(bare, doc)] if bare != run else [])
    return [t for t in asked if t]


def _key_of(kind: str, found: str) -> str:
    return ASSIGN.match(found).group(2) if kind == "assign" else found[4:] if kind == "access" else found


def tested_spans(text: str, base: list[tuple[str, int, int]], doc: int, tests: _Tests):
    """The spans of one text with their tests, and where its strings are no words."""
    spans = [{"kind": k, "start": s, "end": e, "tests": _tested(tests, _key_of(k, text[s:e]), doc),
              "outer": []} for k, s, e in base]
    taken = [(s, e) for _, s, e in base]
    reach, i, odd = 0, 0, list(taken)
    for m in RUN.finditer(text):
        start, end = m.span()
        while i < len(taken) and taken[i][0] < end:
            reach = max(reach, taken[i][1])
            i += 1
        if reach > start:
            continue
        run = m.group()
        word = as_tested(run)
        if len(word) < _LEAST["lower"] and word.isalpha() and word.islower():
            continue
        if not run.isalpha():
            odd.append((start, end))
        outer = _tested(tests, run, doc)
        if outer:
            spans.append({"kind": "random", "start": start, "end": end, "tests": outer, "outer": []})
        parts = list(_PART.finditer(run))
        if len(parts) > 1:
            for part in parts:
                own = tests.ask(part.group(), doc)
                if own:
                    spans.append({"kind": "random", "start": start + part.start(),
                                  "end": start + part.end(), "tests": [own], "outer": outer})
    return sorted(spans, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"])), odd


_PART = re.compile(r"[A-Za-z0-9]+")


def prose_letters(text: str, odd: list[tuple[int, int]]) -> np.ndarray:
    """Letters a-z of the text as 0 to 25, in either case, without the spans ``odd``."""
    if odd:
        at, left = 0, []
        for start, end in sorted(odd):
            left.append(text[at:max(at, start)])
            at = max(at, end)
        text = "".join([*left, text[at:]])
    data = np.frombuffer(text.encode("ascii", "ignore").lower(), dtype=np.uint8)
    return (data[(data >= 97) & (data <= 122)] - 97).astype(np.int8)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: base spans, their counts, and all tested strings with class and grid cell.

    The decoys of a task's portion are counted on the portion's first row.
    """
    def run(batches):
        for part in portions(batches, "text"):
            out = {f.name: [] for f in _SCANNED}
            tests, prose = _Tests(), {}
            for at, (doc_id, text) in enumerate(zip(part["doc_id"], part["text"])):
                text = text or ""
                base = base_spans(text)
                spans, odd = tested_spans(text, base, at, tests)
                if spans:
                    prose[at] = prose_letters(text, odd)
                kinds = [k for k, _, _ in base]
                for name, value in zip(out, (
                        doc_id, kinds.count("assign"), kinds.count("access"),
                        kinds.count("hex"), ",".join(f"{k}:{s}:{e}" for k, s, e in base),
                        spans, [])):
                    out[name].append(value)
            tests.answer(prose)
            out["decoys"][0] = [{"class": c, "bin": b, "n": n}
                                for (c, b), n in sorted(tests.decoys.items())]
            yield record_batch(_SCANNED, out)

    return in_tasks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def reported_up_to(strings: dict[int, int], decoys: dict[int, int], rate: float) -> int:
    """The highest grid cell whose strings are reported, by the step-up rule; -1 for none.

    The share of decoys that look at least as random is a string's own p-value under "text".
    """
    total, text = sum(strings.values()), sum(decoys.values())
    level, seen, passed = -1, 0, 0
    if not text:
        return level
    for cell in range(BINS):
        seen += strings.get(cell, 0)
        passed += decoys.get(cell, 0)
        if strings.get(cell) and (1 + passed) / (1 + text) <= rate * seen / total:
            level = cell
    return level


def levels(scanned: DataFrame, rate: float) -> dict[str, int]:
    """Per class the highest reported cell. At most classes x cells rows reach the driver."""
    strings = scanned.select(F.explode("spans").alias("s")).select(
        F.explode("s.tests").alias("t")).groupBy("t.class", "t.bin").agg(
        F.count(F.lit(1)).alias("n"), F.lit(False).alias("decoy"))
    text = scanned.select(F.explode("decoys").alias("t")).groupBy("t.class", "t.bin").agg(
        F.sum("t.n").alias("n"), F.lit(True).alias("decoy"))
    counts: dict[str, tuple[dict, dict]] = {}
    for r in strings.unionByName(text).collect():
        counts.setdefault(r["class"], ({}, {}))[r["decoy"]][r["bin"]] = r["n"]
    return {c: reported_up_to(*both, rate) for c, both in counts.items()}


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (text) and judged of every document.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind. A null text
    counts as empty. A run that overlaps a base span is left to it; parts of a reported run are
    not reported again. ``judged`` has per base span, in the order of ``base``, the class of its
    value, the p-value of the battery (the lower end of its grid cell) and whether the value
    passes as random; these are null where the value has too few bits or no encoding. Rows with
    equal or null ids stay rows of their own; a corpus without any prose reports base spans only.
    """
    scanned = kept(scan(docs), "scanned")
    found = {"": -1, **levels(scanned, rate)}
    table = F.create_map(*[F.lit(x) for pair in sorted(found.items()) for x in pair])
    passes = lambda t: t["bin"] <= F.coalesce(table[t["class"]], F.lit(-1))
    reported = F.filter("spans", lambda s: (s["kind"] != "random") | (
        F.exists(s["tests"], passes) & ~F.exists(s["outer"], passes)))
    # Of the tests of one value, the one nearest to random.
    best = lambda s: F.sort_array(F.transform(s["tests"], lambda t: F.struct(
        t["bin"].alias("bin"), t["class"].alias("class"), passes(t).alias("passes"))))
    judged = F.transform(
        F.transform(F.filter("spans", lambda s: s["kind"] != "random"), lambda s: F.get(best(s), F.lit(0))),
        lambda t: F.struct(t["class"].alias("class"),
                           F.exp(-(t["bin"] + 1) / GRID).alias("p_value"), t["passes"].alias("random")))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base",
                          F.array_join(F.transform(reported, _written), ",").alias("spans"),
                          judged.alias("judged"))


def _written(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["start"].cast("string"),
                       span["end"].cast("string"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
                        F.array_join(F.transform("judged", lambda j: F.when(j["class"].isNull(), "").otherwise(
                            F.concat_ws(":", j["class"], F.format_number(j["p_value"], 4),
                                        F.when(j["random"], "random").otherwise("text")))),
                            ",").alias("judged"))
