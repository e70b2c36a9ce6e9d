"""Byte-pair encoding and decoding by segment trees over adjacent pair ranks.

For each word a segment tree holds, at leaf i, the rank of the pair that
starts at symbol i (with i behind it to break ties). Its root is the leftmost
lowest-rank merge; after a merge three leaves change, and each change climbs
the tree's levels. Merging ends when the root holds no rank. The trees of
many distinct words are laid side by side and worked in step by numpy.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .common import text_or_empty

#: Encoded words that a worker keeps.
CACHE_WORDS = 150_000
#: Leaves of the trees that are worked in step.
TREE_LEAVES = 1 << 20
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in plain else next(other) for b in range(256)]


class Model:
    """Merges and vocabulary of a word-end BPE file, and the words encoded so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.last = np.array([vocab[s + end] for s in byte_symbols()], np.int64)
        size = len(self.tokens)
        pairs = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if not isinstance(merge, str) else merge.split(" ")
            pairs.append((vocab[a] * size + vocab[b], rank, vocab[a + b]))
        pairs.sort()
        table = np.array(pairs, np.int64)
        self.size, self.pairs, self.ranks = size, table[:, 0], table[:, 1]
        self.made = np.zeros(len(table), np.int64)
        self.made[table[:, 1]] = table[:, 2]
        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, tuple[str, str, int]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or _NONE; -1 is no symbol."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where((self.pairs[at] == code) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merge rows of symbols (-1 behind each word's end); merged-away places become -1."""
        n, width = symbols.shape
        levels = width.bit_length() - 1
        left = np.tile(np.arange(-1, width - 1), (n, 1))
        right = np.tile(np.arange(1, width + 1), (n, 1))
        symbols = np.concatenate([symbols, np.full((n, 1), -1)], axis=1)  # place `width` is none
        tree = np.full((n, 2 * width), _NONE)
        ranks = self.rank(symbols[:, :width], symbols[:, 1:])
        place = np.arange(width)
        tree[:, width:] = np.where(ranks == _NONE, _NONE, ranks * width + place)
        for level in range(levels - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[rows, node] = value
            for _ in range(levels):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair_key(rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
            found = self.rank(symbols[rows, leaf], symbols[rows, np.minimum(right[rows, leaf], width)])
            return np.where(found == _NONE, _NONE, found * width + leaf)

        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            rows, root = rows[root != _NONE], root[root != _NONE]
            if not len(rows):
                return symbols[:, :width]
            here = root % width
            gone = right[rows, here]
            after = right[rows, gone]
            symbols[rows, here] = self.made[root // width]
            symbols[rows, gone] = -1
            right[rows, here] = after
            inside = after < width
            left[rows[inside], after[inside]] = here[inside]
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, here, pair_key(rows, here))
            before = left[rows, here]
            held = before >= 0
            if held.any():
                put(rows[held], before[held], pair_key(rows[held], before[held]))

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, words of one tree width at a time."""
        raw = [w.encode() for w in words]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        widths: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            if r:
                widths.setdefault(max(4, 1 << (len(r) - 1).bit_length()), []).append(i)
        for width, which in widths.items():
            step = max(1, TREE_LEAVES // width)
            for a in range(0, len(which), step):
                part = which[a : a + step]
                sizes = np.array([len(raw[i]) for i in part])
                codes = np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
                row, col = np.repeat(np.arange(len(part)), sizes), np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                symbols = np.full((len(part), width), -1, np.int64)
                symbols[row, col] = self.inner[codes]
                ends = np.cumsum(sizes) - 1
                symbols[np.arange(len(part)), sizes - 1] = self.last[codes[ends]]
                symbols = self.merge(symbols)
                kept = symbols >= 0
                for i, ids in zip(part, np.split(symbols[kept], np.cumsum(kept.sum(axis=1))[:-1]), strict=True):
                    out[i] = ids
        return out

    def learn(self, words: list[str]) -> None:
        """Put words into the cache: ids as text, tokens as text, and how many."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = words
        for w, ids in zip(new, self.encode_words(new), strict=True):
            ids = ids.tolist()
            self.cache[w] = (" ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]), len(ids))

    def normalise(self, text: str) -> str:
        """What the file's normaliser makes of it; without combining marks that is lower case."""
        return text.lower() if text.isascii() or max(text) < "̀" else self.library.normalizer.normalize_str(text)

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, codes, and where each text's codes begin."""
        plain = [self.normalise(t) for t in texts]
        got = pretoken.split_pattern(plain, spaced=False)
        words, codes, first = got.words.to_pylist(), got.codes, got.first
        if not got.sure.all():
            index = {w: i for i, w in enumerate(words)}
            parts = np.split(codes, first[1:-1])
            for d in np.flatnonzero(~got.sure):
                cut = [plain[d][a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain[d])]
                parts[d] = np.array([index.setdefault(w, len(index)) for w in cut], np.int64)
            words, codes = list(index), np.concatenate(parts).astype(np.int64)
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return words, codes, first

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of ids, the ids joined by a blank, and the decoded text."""
        parts: list[str] = []
        whose: list[int] = []
        extra: dict[int, int] = {}
        for d, text in enumerate(texts):
            for piece in self.split_special.split(text) if self.split_special and "<" in text else (text,):
                if piece in self.special:
                    extra[len(parts)] = self.special[piece]
                    piece = ""
                parts.append(piece)
                whose.append(d)
        words, codes, first = self.cut(parts)
        self.learn([words[c] for c in np.unique(codes)])
        known = [self.cache.get(w, ("", "", 0)) for w in words]
        ids, tokens = (np.array([k[i] for k in known], object) for i in (0, 1))
        counts = np.array([k[2] for k in known], np.int64)
        at = 0
        for d in range(len(texts)):
            n, told, shown = 0, [], []
            while at < len(parts) and whose[at] == d:
                if at in extra:
                    n, told, shown = n + 1, [*told, str(extra[at])], [*shown, self.tokens[extra[at]]]
                own = codes[first[at] : first[at + 1]]
                if len(own):
                    n += int(counts[own].sum())
                    told.append(" ".join(ids[own]))
                    shown.append(" ".join(tokens[own]))
                at += 1
            yield n, " ".join(told), " ".join(shown)


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def decode(ids: list[int], path: str) -> str:
    """What the library's ``decode(ids, skip_special_tokens=False)`` gives for a file without a decoder."""
    tokens = model(path).tokens
    return " ".join([tokens[i] for i in ids])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` for every row; with ``texts`` also ``ids, decoded``.

    A null text counts as empty: no ids, and digests of the empty string.
    Null ids and repeated rows are rows like others; texts of any length
    are encoded whole; only two columns are read. A word is worked on once
    for each batch of texts that holds it, whatever its number of uses. No
    shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids string, decoded string" if texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            held = batch.column(1).to_pylist()
            for a, b in pretoken.chunks(held):
                rows = [(n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), *((i, t) if texts else ())) for n, i, t in own.encode(held[a:b])]
                kinds = [pa.int64(), *[pa.string()] * (4 if texts else 2)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=names[: 1 + len(columns)])

    out = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    return out.withColumnRenamed("_id", id_col)
