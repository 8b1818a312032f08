"""Token ids of public vocabularies, as fast as a task can make them.

Both encoders return exactly what ``tokenizers`` returns with ``add_special_tokens=False``.
They take a quicker way for ordinary text and hand everything else to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 1
LONG_TEXT = 1 << 20
MEMO_ENTRIES = 400_000
# Latin text without control or combining characters: composed and split alike everywhere.
UNUSUAL = re.compile(r"[^\t\n\r -~¡-ſ]")
JOINED_PIECES = 100


def _members(kind: str) -> str:
    """The letters or numbers of usual text in lower case, for a character class."""
    usual = map(chr, [*range(0x21, 0x180), 0x307])
    return "".join(re.escape(c) for c in usual if regex.match(kind, c))


_LETTERS, _NUMBERS = _members(r"\p{L}"), _members(r"\p{N}")
PIECES_AND_GAPS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|"
                             rf"[^\s{_LETTERS}{_NUMBERS}]+| ")

_encoders: dict[tuple, object] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ByteEncoder:
    """Byte-level BPE. ``ranks`` names the same vocabulary in rank form; None goes without it."""

    def __init__(self, path: str, ranks: str | None = None):
        self.slow = _tokenizer(path)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            if self.fast is None or "<|" in text or len(text) > LONG_TEXT:
                out.append(self.slow.encode(text, add_special_tokens=False).ids)
            else:
                out.append(self.fast.encode_ordinary(text))
        return out


def expanded(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``index`` of ``values`` end to end, and the offsets of these runs."""
    sizes = offsets[index + 1] - offsets[index]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(ends[-1]) + np.repeat(offsets[index] - ends[:-1], sizes)], ends


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """BPE within words. Every distinct word of a call is taken apart once, and the ids of its pieces
    are remembered up to a bound.

    No piece of the vocabulary's pattern holds white space, so a word's ids do not depend on the
    words around it. Unseen pieces go to ``tokenizers`` many in one text: the last id of each piece
    is one that ends a word, and no other is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.slow = _tokenizer(path)
        # The same model for pieces that are normalised and taken apart already.
        self.quick = Tokenizer(self.slow.model)
        self.quick.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.slow.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items()
                        if t.endswith(self.slow.model.end_of_word_suffix)]] = True
        self.pieces: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        texts = [pieces[i:i + JOINED_PIECES] for i in range(0, len(pieces), JOINED_PIECES)]
        made = self.quick.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False)
        for own, found in zip(texts, made):
            ids = np.asarray(found.ids, dtype="<u4")
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * ids.itemsize).tolist()
            raw = ids.tobytes()
            for piece, begin, end in zip(own, [0, *ends], ends, strict=False):
                self.pieces[piece] = raw[begin:end]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and the offsets of the words."""
        parts = pa.array(PIECES_AND_GAPS.findall(" ".join(words)), pa.string()).dictionary_encode()
        distinct = _strings(parts.dictionary)
        index = parts.indices.to_numpy()
        if len(self.pieces) > MEMO_ENTRIES:
            self.pieces.clear()
        self.pieces[" "] = b""
        self._learn([p for p in distinct if p not in self.pieces])
        found = list(map(self.pieces.__getitem__, distinct))
        offsets = np.cumsum([0, *map(len, found)]) // 4
        ids, ends = expanded(np.frombuffer(b"".join(found), dtype="<u4"), offsets, index)
        gaps = np.flatnonzero(index == distinct.index(" ")) if " " in distinct else []
        return ids, np.concatenate([[0], ends[gaps], ends[-1:]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        usual = [not UNUSUAL.search(text) and "<|" not in text for text in texts]
        lowered = pa.array([t.lower() for t, easy in zip(texts, usual) if easy], pa.large_string())
        split = pc.ascii_split_whitespace(lowered)
        words = split.flatten().dictionary_encode()
        own, ends = self._words(_strings(words.dictionary))
        ids, ends = expanded(own, ends, words.indices.to_numpy())
        bounds = ends[split.offsets.to_numpy()].tolist()
        quick = iter(zip(bounds, bounds[1:]))
        return [ids[slice(*next(quick))] if easy else
                np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
                for text, easy in zip(texts, usual)]


def encoder(kind: str, *paths: str):
    """One encoder per worker process and vocabulary."""
    key = (kind, *paths)
    if key not in _encoders:
        _encoders[key] = {"byte": ByteEncoder, "word": WordEncoder}[kind](*paths)
    return _encoders[key]
