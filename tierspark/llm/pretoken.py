"""Vectorised splitting of many texts into pieces.

Texts are split by numpy over their concatenation, and the pieces are put
into one Arrow string array over the same bytes, whose dictionary gives the
distinct pieces. What follows works on distinct pieces and integer codes.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE, UNSURE = 0, 1, 2, 3, 9
#: The code points with Unicode's White_Space property, as ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Characters of text worked on at once.
CHUNK_CHARS = 2_000_000


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point below 0x10000.

    A code point whose category is not the same in Unicode 3.2 and in this
    Python is UNSURE: libraries with other versions may differ on it, so
    texts that hold one take the library's own path.
    """
    old = unicodedata.ucd_3_2_0.category
    out = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind != old(c) or kind == "Cs":
            out[cp] = UNSURE
        elif kind[0] == "L":
            out[cp] = LETTER
        elif kind[0] == "N":
            out[cp] = NUMBER
    for a, b in WHITE_SPACE:
        out[a : b + 1] = SPACE
    return out


@dataclass
class Pieces:
    """Pieces of texts: piece ``i`` is ``words[codes[i]]``; text ``d`` has pieces ``first[d]:first[d+1]``."""

    words: pa.Array
    codes: np.ndarray
    first: np.ndarray
    sure: np.ndarray


def chunks(texts: Sequence[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` characters together, or one text each."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def _coded(data: bytes, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct pieces of ``data`` between the byte offsets ``at``, and each piece's code."""
    offsets = pa.py_buffer(np.ascontiguousarray(at, np.int32))
    found = pa.StringArray.from_buffers(len(at) - 1, offsets, pa.py_buffer(data)).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def split_words(texts: Sequence[str]) -> Pieces:
    """Words ``[^\\x20\\x09-\\x0D]+``, on the bytes."""
    raw = [t.encode() for t in texts]
    data = b"\n".join(raw) + b"\n"
    bytes_ = np.frombuffer(data, np.uint8)
    space = (bytes_ == 32) | ((bytes_ >= 9) & (bytes_ <= 13))
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))  # starts and ends, in turn
    ends = np.cumsum([len(r) + 1 for r in raw])
    if not len(edge):
        return Pieces(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool))
    words, codes = _coded(data, edge)
    codes = codes[::2]  # every other piece is a gap
    first = np.searchsorted(edge[::2], np.concatenate([[0], ends]))
    return Pieces(words, codes, first, np.ones(len(texts), bool))


def _contractions(cps: np.ndarray, begins: np.ndarray, at: np.ndarray, ends: np.ndarray) -> None:
    """Mark ``'s 't 'm 'd 're 've 'll`` at the apostrophes ``at``, each a piece's first character."""
    n = len(cps)
    stop = ends[np.searchsorted(ends, at, side="right")]  # of the text
    one = cps[np.minimum(at + 1, n - 1)]
    two = cps[np.minimum(at + 2, n - 1)]
    short = (at + 1 < stop) & np.isin(one, [ord(c) for c in "stmd"])
    long = (at + 2 < stop) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for hit, size in ((short, 2), (long, 3)):
        p = at[hit]
        begins[p + 1] = False
        p = p + size
        begins[p[p < n]] = True


def split_pattern(texts: Sequence[str], spaced: bool) -> Pieces:
    """Pieces as two public byte-pair encodings cut them before merging.

    ``spaced``: contractions, then letters, numbers or other characters with
    one blank before them, then white space (``byte_bpe_50k``). Otherwise:
    contractions, letters, single numbers, other characters, and white space
    dropped (``word_bpe_49k``).
    """
    big = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if not big:
        return Pieces(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool))
    cps = np.frombuffer(big.encode("utf-32-le"), np.uint32)
    kind = class_table()[np.minimum(cps, 0xFFFF)]
    kind = np.where(cps > 0xFFFF, np.uint8(UNSURE), kind)
    first_char = np.concatenate([[0], ends[:-1]])[sizes > 0]
    sure = np.ones(len(texts), bool)
    if (kind == UNSURE).any():
        bad = np.flatnonzero(kind == UNSURE)
        sure[np.unique(np.searchsorted(ends, bad, side="right"))] = False
    run = np.empty(len(cps), bool)  # starts of runs of one class
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run[first_char] = True
    space = kind == SPACE
    begins = run.copy()
    if spaced:
        head = np.zeros(len(cps), bool)
        head[first_char] = True
        after = np.flatnonzero(run & ~space & ~head)
        after = after[space[after - 1]]  # runs with white space before them
        begins[after - 1] = True
        begins[after[cps[after - 1] == 32]] = False
    else:
        begins |= kind == NUMBER
    quotes = np.flatnonzero(cps == 39)
    if len(quotes):
        quotes = quotes[run[quotes] & begins[quotes]]
        _contractions(cps, begins, quotes, ends)
    start = np.flatnonzero(begins)
    data = big.encode()
    if len(data) == len(cps):
        at = start
    else:
        width = np.ones(len(cps), np.int64)
        for least in (0x80, 0x800, 0x10000):
            width += cps >= least
        at = (np.cumsum(width) - width)[start]
    words, codes = _coded(data, np.append(at, len(data)))
    if not spaced:
        keep = ~space[start]
        start, codes = start[keep], codes[keep]
    return Pieces(words, codes, np.searchsorted(start, np.concatenate([[0], ends])), sure)


def gather(flat: np.ndarray, first: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``flat[first[c]:first[c+1]]`` for each code; also where each one starts."""
    sizes = np.diff(first)[codes]
    at = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat(first[:-1][codes] - at[:-1], sizes) + np.arange(at[-1])
    return flat[index], at
