"""Best-fit packing of documents into token sequences by swap-based local search."""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .bpe import byte_symbols
from .common import stored, text_or_empty

#: Pieces packed together. A sequence never mixes blocks, so each block
#: leaves less than one sequence unfilled at best.
BLOCK_PIECES = 8192
#: Encoded pieces of text that a worker keeps.
CACHE_PIECES = 200_000


@functools.cache
def _tokenizer(path: str):
    """The file's tokenizer, a faster encoder for single pieces, and a cache.

    A byte-level file whose merges make the ids in their order is a table of
    ranks, for which another library has a leaner encoder with equal ids;
    for other files the pieces are encoded by the file's tokenizer.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m if not isinstance(m, str) else m.split(" ") for m in model["merges"]]
    if not model.get("end_of_word_suffix") and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        one = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        one = lambda w: tok.encode(w, add_special_tokens=False).ids
    return tok, one, {}


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The tokenizer's merges never cross the pieces that its pattern cuts, so
    each distinct piece is encoded once. Texts with a special token's string,
    or with characters on which Unicode versions differ, are encoded by the
    library whole.
    """
    tok, one, cache = _tokenizer(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    out: list[np.ndarray] = []
    for a, b in pretoken.chunks(texts):
        part = texts[a:b]
        got = pretoken.split_pattern(part, spaced=True)
        words = got.words.to_pylist()
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > CACHE_PIECES:
            cache.clear()
            new = words
        cache.update((w, one(w)) for w in new)
        held = [cache[w] for w in words]
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))])
        flat = np.fromiter(chain.from_iterable(held), np.uint32, first[-1])
        ids, at = pretoken.gather(flat, first, got.codes)
        for d, text in enumerate(part):
            if got.sure[d] and not any(s in text for s in special):
                out.append(ids[at[got.first[d]] : at[got.first[d + 1]]])
            else:
                out.append(np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32))
    return out


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """``id, piece, start, length, ids_crc32``; a long document's first piece is its odd part."""
    kind = docs.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pretoken.chunks(texts):
                rows: list[tuple[int, int, int, int, int]] = []
                for d, ids in enumerate(encode(texts[a:b], path), a):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start, n = 0, len(ids)
                    size = n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        rows.append((d, k, start, size, zlib.crc32(ids[start : start + size])))
                        start, size = start + size, capacity
                at, *rest = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, rest)], names=["_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return chosen.mapInArrow(cut, f"_id {kind.simpleString()}, piece long, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that it fits."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            held = by_room[room]
            b = held.pop()
            if not held:
                del by_room[room]
                rooms.pop(at)
            bins[b].append(int(i))
        else:
            room, b = capacity, len(bins)
            bins.append([int(i)])
        room -= size
        if room:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append(b)
    return bins


class _Search:
    """Local search over the underfull bins, raising the sum of squared fills.

    A step takes a bin A and moves one document of it to another bin B, or
    exchanges one for one, two of A for one of B, or one of A for two of B,
    so that B gains d > 0 tokens within its room. The gain of the objective
    is 2 d (fill B - fill A + d). A bin that runs empty is gone.

    What a bin can give is told by size: each of its sizes and each sum of
    two of them once, so a bin of 1024 tokens has a thousand entries at most,
    however many documents it holds. For an entry of B, the best entry of A
    is the largest that B has room for, as the gain rises with d.
    """

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = {b: list(x) for b, x in enumerate(bins)}
        self.fill = {b: int(sizes[x].sum()) for b, x in self.bins.items()}
        self.least = -(-int(sizes.sum()) // capacity)

    def gives(self, b: int) -> np.ndarray:
        """Rows ``tokens, first size, second size (0: one document; both 0: none)`` of a bin."""
        own, many = np.unique(self.sizes[self.bins[b]], return_counts=True)
        i, j = np.triu_indices(len(own))
        some = (i != j) | (many[i] > 1)
        pairs = np.stack([own[i] + own[j], own[i], own[j]], 1)[some]
        pairs = pairs[np.unique(pairs[:, 0], return_index=True)[1]]
        none = np.zeros_like(own)
        return np.concatenate([[[0, 0, 0]], np.stack([own, own, none], 1), pairs])

    def table(self) -> None:
        """What each underfull bin can give: nothing, one document or two."""
        self.rows = np.zeros((0, 4), np.int64)
        self.refresh(*[b for b in self.bins if self.fill[b] < self.capacity])

    def refresh(self, *changed: int) -> None:
        live = [b for b in changed if b in self.bins and self.fill[b] < self.capacity]
        new = [np.insert(self.gives(b), 0, b, axis=1) for b in live]
        self.rows = np.concatenate([self.rows[~np.isin(self.rows[:, 0], changed)], *new])
        self.fills = np.array([self.fill[b] for b in self.rows[:, 0].tolist()], np.int64)

    def step(self, a: int) -> bool:
        """The exchange of bin ``a`` with the greatest gain, if one raises the objective."""
        fill_a, own = self.fill[a], self.gives(a)[1:]
        best, how = 0, None
        for rows, from_a in ((self.rows[:, 3] == 0, own), (self.rows[:, 3] > 0, own[own[:, 2] == 0])):  # two for two is not a move of this search
            rows = np.flatnonzero(rows & (self.rows[:, 0] != a))
            if not len(rows) or not len(from_a):
                continue
            from_a = from_a[np.argsort(from_a[:, 0], kind="stable")]
            at = np.searchsorted(from_a[:, 0], self.rows[rows, 1] + self.capacity - self.fills[rows], "right") - 1
            d = np.where(at >= 0, from_a[at, 0] - self.rows[rows, 1], 0)
            gain = np.where(d > 0, d * (self.fills[rows] - fill_a + d), 0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, how = int(gain[k]), (from_a[at[k]], self.rows[rows[k]])
        if how is None:
            return False
        (_, *given), (b, _, *taken) = how[0].tolist(), how[1].tolist()
        for sizes, src, dst in ((given, a, b), (taken, b, a)):
            moved = []
            for size in filter(None, sizes):
                item = next(i for i in self.bins[src] if self.sizes[i] == size and i not in moved)
                moved.append(item)
            sizes[:] = moved
        for items, src, dst in ((given, a, b), (taken, b, a)):
            for item in items:
                self.bins[src].remove(item)
                self.bins[dst].append(item)
        for x in (a, b):
            self.fill[x] = int(self.sizes[self.bins[x]].sum())
            if not self.bins[x]:
                del self.bins[x], self.fill[x]
        self.refresh(a, b)
        return True

    def run(self) -> list[list[int]]:
        """Until a pass over all underfull bins, least filled first, makes no exchange, or no fewer bins are possible."""
        if len(self.bins) > self.least:
            self.table()
        while len(self.bins) > self.least:
            moved, failed = False, set()
            for a in sorted((b for b in self.bins if self.fill[b] < self.capacity), key=lambda b: self.fill[b]):
                while a in self.bins and self.fill[a] < self.capacity and len(self.bins) > self.least:
                    alike = np.sort(self.sizes[self.bins[a]]).tobytes()
                    if alike in failed or not self.step(a):
                        failed.add(alike)
                        break
                    moved = True
            if not moved:
                break
        return list(self.bins.values())


def pack_sizes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: a best-fit start, then the local search."""
    return _Search(best_fit(sizes, capacity), sizes, capacity).run()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``: a row per piece.

    A null text counts as empty and is the end id alone; documents longer
    than ``capacity`` are cut, the first piece being the odd part, so that
    each has one piece to pack at most and full sequences otherwise. Null
    ids and repeated rows are rows like others. Texts of any length are
    encoded whole, and any number of short or equal ones may meet. Only two
    columns are read. An empty table gives no rows.

    Pieces are written to the shared folder and dealt to blocks of about
    ``block_pieces`` by their place there, which no retried task changes and
    no key decides. Blocks are packed one by one: each leaves at most a
    sequence unfilled that a larger block might have filled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    cut = stored(pieces(docs, path, id_col, text_col, capacity, end_id), "pieces")
    blocks = max(1, round(cut.count() / block_pieces))
    place = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("length", "ids_crc32", "start")])
        sizes = rows.column("length").to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        small = np.flatnonzero(sizes < capacity)
        bins = [small[b] for b in pack_sizes(sizes[small], capacity)] if len(small) else []
        for n, items in enumerate(bins):
            sequence[items] = n
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        full = np.flatnonzero(sizes >= capacity)
        sequence[full] = len(bins) + np.arange(len(full))
        block = rows.column("_block").to_numpy()
        return rows.drop_columns(["_block"]).append_column("sequence_id", pa.array((block << 32) + sequence)).append_column("offset", pa.array(offset))

    dealt = cut.select("*", F.pmod(place, F.lit(blocks)).alias("_block"))
    made = dealt.groupBy("_block").applyInArrow(packed, f"_id {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return made.select(F.col("_id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
