"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

The trie's nodes are contexts of 0 to ``order`` bytes, all exact, and the
counts of all training documents go in, so it grows with the corpus. A byte
is predicted by the longest context that knows it; each context passed over
costs its escape (method C: as many escapes as distinct symbols), and its
symbols are excluded further down. Codes (a context and its byte) are dealt
to buckets by the three bytes before the byte: a bucket holds whole nodes of
three bytes and more, and all that lie above them. Levels 0 to 2, which have
2^24 counts at most by nature, go to every bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .common import is_fold, stored, text_or_empty

#: Bytes of the longest context in the query.
ORDER = 5
#: Characters of text whose distinct words and codes are counted together.
BATCH_CHARS = 3_000_000
#: Documents for each bucket of words and codes.
BUCKET_DOCS = 2048


def _contexts(raw: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte, its code (``order`` bytes before it, itself); which text begins where.

    Before a text stand zero bytes.
    """
    pad = b"\0" * order
    data = np.frombuffer(pad + pad.join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    code = data[: len(data) - order].astype(np.int64)
    for k in range(1, order + 1):
        code <<= 8
        code |= data[k : len(data) - order + k]
    ends = np.cumsum(sizes + order)
    real = np.ones(len(code), bool)
    for k in range(order):
        real[ends[:-1] - order + k] = False
    return code[real], np.concatenate([[0], np.cumsum(sizes)]), sizes


def _tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.diff(codes, prepend=codes[:1] ^ 1))
    return codes[at], np.diff(np.append(at, len(codes)))


def _dealt(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct codes by bucket, and where each bucket begins."""
    mixed = ((codes >> 8) & 0xFFFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


class Trie:
    """Counts by level, and the code length of a byte in its context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, mid: tuple[np.ndarray, np.ndarray]):
        """Sorted codes and counts of the highest level, and of level 2 (``mid``)."""
        self.order, self.levels = order, [(codes, counts)]
        for k in range(order - 1, 2, -1):
            low, back = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.levels.append((low, np.bincount(back, counts, len(low)).astype(np.int64)))
        self.levels.append(mid)
        for mask in (0xFFFF, 0xFF):
            low = mid[0] & mask
            summed = np.bincount(low, mid[1], mask + 1).astype(np.int64)
            self.levels.append((np.flatnonzero(summed), summed[summed > 0]))

    def known(self) -> np.ndarray:
        """log10 of the probability of each code of the highest level."""
        codes, counts = self.levels[0]
        if not len(codes):
            return np.zeros(0)
        new = np.diff(codes >> 8, prepend=-1) != 0
        first = np.flatnonzero(new)
        total, kinds = np.add.reduceat(counts, first), np.diff(np.append(first, len(codes)))
        rest = np.where(kinds == 256, 0, kinds)  # nothing is left to escape to
        return np.log10(counts / (total + rest)[np.cumsum(new) - 1])

    def chain(self, code: int) -> float:
        """log10 of the probability of one byte, down from the highest level."""
        symbol = code & 0xFF
        out, barred = 0.0, np.zeros(256, bool)
        for k, (codes, counts) in zip(range(self.order, -1, -1), self.levels, strict=True):
            node = (code >> 8) & ((1 << 8 * k) - 1)
            a, b = np.searchsorted(codes, [node << 8, (node + 1) << 8])
            symbols, held = codes[a:b] & 0xFF, counts[a:b]
            free = ~barred[symbols]
            symbols, held = symbols[free], held[free]
            if not len(symbols):
                continue
            barred[symbols] = True
            escapes = 0 if barred.all() else len(symbols)
            whole = held.sum() + escapes
            own = held[symbols == symbol]
            if len(own):
                return out + np.log10(own[0] / whole)
            out += np.log10(escapes / whole)
        return out - np.log10(256 - barred.sum())


def _packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as compressed bytes, byte plane by byte plane; rising ones as their differences."""
    if rising:
        values = np.diff(values, prepend=0)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type, rising: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd"), np.uint8).reshape(width, n)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values) if rising else values


def _packed_texts(texts: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([texts], names=["t"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked_texts(data: pa.Scalar) -> list[str]:
    return pa.ipc.open_stream(data.as_buffer()).read_all().column(0).to_pylist()


def _fields(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("_id"), is_fold(5, id_col).alias("_held"), text.alias("_text"))


def _lists(values: np.ndarray | pa.Array, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _batches(docs: DataFrame) -> DataFrame:
    """Batches of texts (``ids, helds``, packed ``texts``), and rows of their training counts at level 2 (``codes, tallies``)."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 32
        for record in batches:
            texts = record.column(2).to_pylist()
            for a, b in pretoken.chunks(texts, BATCH_CHARS):
                n = b - a
                helds = record.column(1).slice(a, n).to_numpy(zero_copy_only=False).astype(bool)
                code, _, _ = _contexts([t.encode() for t, h in zip(texts[a:b], helds, strict=True) if not h], 2)
                found, tallies = _tally(code.astype(np.uint32))
                one, all_of = np.array([0, n]), np.array([0, len(found)])
                whole = [_lists(pa.array(record.column(c).slice(a, n)), one) for c in range(2)]
                made = [*whole, pa.array([_packed_texts(record.column(2).slice(a, n))], pa.binary()), _lists(found.astype(np.int32), all_of), _lists(tallies.astype(np.int64), all_of)]
                yield pa.RecordBatch.from_arrays([pa.array([uid]), *made], names=["batch", "ids", "helds", "texts", "codes", "tallies"])
                uid += 1

    return docs.mapInArrow(run, f"batch long, ids array<{kind}>, helds array<boolean>, texts binary, codes array<int>, tallies array<long>")


class _Words:
    """The words of a batch of texts, its distinct words by bucket, and where each bucket begins."""

    def __init__(self, texts: list[str], buckets: int):
        got = pretoken.split_words([t.encode().lower().decode() for t in texts])  # bytes: A-Z alone
        used, codes = np.unique(got.codes, return_inverse=True)
        names = [got.words[i].as_py() for i in used.tolist()] if len(used) < 64 else got.words.take(pa.array(used)).to_pylist()
        bucket = np.array([zlib.crc32(w.encode()) % buckets for w in names], np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.codes = place[codes] if len(codes) else codes
        self.counts = np.diff(got.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.names = [names[i] for i in order.tolist()]
        self.edge = np.searchsorted(bucket[order], np.arange(buckets + 1))


def _ask(whole: DataFrame, buckets: int, order: int) -> DataFrame:
    """For each batch and bucket that have any, the distinct words and codes with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for row in range(len(record)):
                texts, held = _unpacked_texts(record.column(2)[row]), np.array(record.column(1)[row].as_py(), bool)
                words = _Words(texts, buckets)
                trained = np.bincount(words.codes[~held[words.text]], minlength=len(words.names)).astype(np.int64)
                code, _, sizes = _contexts([t.encode() for t in texts], order)
                code <<= 1
                code |= np.repeat(~held, sizes)
                del texts
                code.sort()
                at = np.flatnonzero(np.diff(code >> 1, prepend=-1))
                tallies = (np.add.reduceat(code & 1, at) if len(at) else np.zeros(0, np.int64)).astype(np.int32)
                code = code[at] >> 1
                by, edge = _dealt(code, buckets)
                code, tallies = code[by], tallies[by]
                for k in np.flatnonzero((np.diff(edge) > 0) | (np.diff(words.edge) > 0)).tolist():
                    (a, b), (c, d) = words.edge[k : k + 2], edge[k : k + 2]
                    made = [pa.array([words.names[a:b]], pa.list_(pa.string())), pa.array([_packed(trained[a:b])]), pa.array([d - c], pa.int32()), pa.array([_packed(code[c:d], True)]), pa.array([_packed(tallies[c:d])])]
                    yield pa.RecordBatch.from_arrays([record.column(0).slice(row, 1), pa.array([k], pa.int32()), *made], names=["batch", "bucket", "words", "counts", "n", "codes", "tallies"])

    return whole.select("batch", "helds", "texts").mapInArrow(run, "batch long, bucket int, words array<string>, counts binary, n int, codes binary, tallies binary")


def _answer(table: pa.Table, order: int, mid: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """For each batch that asked: corpus counts of one bucket's words, log10 probabilities of its codes; and the bucket's sums."""
    words = table.column("words").combine_chunks()
    sizes, many = table.column("n").to_numpy(), pa.compute.list_value_length(words).to_numpy()
    unpacked = lambda name, n, *how: np.concatenate([_unpacked(x.as_buffer(), k, *how) for x, k in zip(table.column(name), n.tolist(), strict=True)])
    ends, word_ends = np.cumsum(sizes), np.cumsum(many)
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(codes, unpacked("counts", many, np.int64), len(coded.dictionary)).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
    distinct, place = np.unique(unpacked("codes", sizes, np.int64, True), return_inverse=True)
    n = np.bincount(place, unpacked("tallies", sizes, np.int32), len(distinct)).astype(np.int64)
    trie = Trie(distinct[n > 0], n[n > 0], order, mid)
    cost = np.empty(len(distinct), np.float32)
    cost[n > 0] = trie.known()
    cost[n == 0] = [trie.chain(c) for c in distinct[n == 0].tolist()]
    out = pa.table({
        "batch": table.column("batch").combine_chunks(), "bucket": table.column("bucket").combine_chunks(), "m": pa.array(many, pa.int32()), "n": pa.array(sizes, pa.int32()),
        "corpus": pa.array([_packed(total[codes[e - k : e]]) for e, k in zip(word_ends.tolist(), many.tolist(), strict=True)], pa.binary()),
        "costs": pa.array([_packed(cost[place[e - k : e]]) for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
        "tokens": pa.nulls(len(table), pa.int64()), "kinds": pa.nulls(len(table), pa.int64()),
    })
    sums = {"bucket": table.column("bucket").slice(0, 1).combine_chunks(), "tokens": pa.array([int(total.sum())]), "kinds": pa.array([int((total > 0).sum())])}
    return pa.concat_tables([out, pa.table({f.name: sums.get(f.name, pa.nulls(1, f.type)) for f in out.schema})])


def _scores(docs: pa.Table, answers: pa.Table, buckets: int, order: int) -> pa.Table:
    """For each document of a batch: its words, the known ones, their sum of log10(c + 0.5), and the score."""
    answers = answers.sort_by("bucket")
    got = lambda name, n, kind: np.concatenate([np.zeros(0, kind), *[_unpacked(x.as_buffer(), k.as_py(), kind) for x, k in zip(answers.column(name), answers.column(n), strict=True)]])
    corpus, costs = got("corpus", "m", np.int64), got("costs", "n", np.float32)
    out = []
    for row in range(len(docs)):
        texts = _unpacked_texts(docs.column("texts")[row])
        words = _Words(texts, buckets)
        c = corpus[words.codes]
        code, first, sizes = _contexts([t.encode() for t in texts], order)
        distinct, back = np.unique(code, return_inverse=True)
        place = np.empty(len(distinct), np.int64)
        place[_dealt(distinct, buckets)[0]] = np.arange(len(distinct))
        score, full = np.zeros(len(texts)), sizes > 0
        if full.any():
            score[full] = np.add.reduceat(costs[place][back].astype(np.float64), first[:-1][full])
        out.append(pa.table({
            "_id": docs.column("ids")[row].values, "_held": docs.column("helds")[row].values, "_words": pa.array(words.counts.astype(np.int64)),
            "_known": pa.array(np.bincount(words.text, c > 0, len(texts)).astype(np.int64)),
            "_sum": pa.array(np.bincount(words.text, np.log10(c + 0.5), len(texts)).astype(np.float64)), "score": pa.array(score),
        }))
    return pa.concat_tables(out)


def _level_2(batches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The summed counts of level 2, at most 2^24, to the driver."""
    got = batches.select(F.explode(F.arrays_zip("codes", "tallies")).alias("z")).groupBy(F.col("z.codes").alias("code")).agg(F.sum("z.tallies").alias("n")).toArrow()
    code, n = (got.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(code)
    return code[order], n[order].astype(np.int64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Counts come from all rows whose fold (crc32 of the id as text, mod 5) is
    not 1. Null texts count as empty: one token, the end, and ``score`` 0; a
    null id is not held out; repeated rows each count and each get a row;
    only two columns are read; an empty table gives no rows. ``order``, the
    bytes of the longest context, is 3 to 6.

    Each batch of texts sends its distinct words and codes, with their
    training counts, to buckets, and gets corpus counts and probabilities
    back; so each travels once for each batch that holds it, and neither
    vocabulary nor trie is broadcast.
    """
    if not 3 <= order <= 6:
        raise ValueError("contexts have 3 to 6 bytes at most")
    fields = _fields(docs, id_col, text_col)
    buckets = max(1, round(docs.count() / BUCKET_DOCS))
    kind = docs.schema[id_col].dataType.simpleString()
    batches = stored(_batches(fields), "lm-batches")
    model = docs.sparkSession.sparkContext.broadcast(_level_2(batches))
    asked = _ask(batches, buckets, order).groupBy("bucket").applyInArrow(
        lambda t: _answer(t, order, model.value), "batch long, bucket int, m int, n int, corpus binary, costs binary, tokens long, kinds long"
    )
    answers = stored(asked, "lm-answers")
    whole = batches.select("batch", "ids", "helds", "texts")
    scored = whole.groupBy("batch").cogroup(answers.where("batch is not null").select("batch", "bucket", "m", "n", "corpus", "costs").groupBy("batch")).applyInArrow(
        lambda d, a: _scores(d, a, buckets, order), f"_id {kind}, _held boolean, _words long, _known long, _sum double, score double"
    )

    words, kinds = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = fields.where(~F.col("_held")).count()
    tokens, kinds = words + ends, kinds + (ends > 0)
    norm = F.lit(float(np.log10(tokens + 0.5 * (kinds + 1))))
    end_log = F.lit(float(np.log10(ends + 0.5)))
    return scored.select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        (F.col("_words") + 1).alias("n_tokens"),
        (F.col("_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("_sum") + end_log - (F.col("_words") + 1) * norm).alias("base_score"),
        "score",
    )
