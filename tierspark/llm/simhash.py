"""Near-duplicate detection by SimHash and a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the embedding is
the vector of their bit counts. The Manhattan distance of two embeddings is
a lower bound of the Hamming distance of the fingerprints. The coordinates
are dealt to six parts or more: where the distance is at most 4, at most four
parts differ, so two embeddings agree on all the others. Each choice of all
parts but four is one grid whose cells are the coordinates in those parts;
fingerprints that share a cell are compared by Manhattan distance, then
exactly. More parts make more grids with smaller cells; their number follows
the number of fingerprints, and any number gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, join_counted, stored, text_or_empty
from .components import components

#: Words in a shingle of the contract, its seed, and the distance that links.
SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
#: Entries that one task compares with one another; larger cells are split.
CELL_ENTRIES = 2048
#: Entries in the buckets of cells that tasks take.
BUCKET_ENTRIES = 100_000
#: Comparisons of pairs that cost as much as an entry of a grid.
PAIRS_PER_ENTRY = 50

_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_ODD = 0x5555555555555555


def fingerprint(text: str, words_each: int = SHINGLE_WORDS) -> int:
    """Majority bits over the XXH64 hashes of word shingles, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: ASCII case and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_each, len(words))
    hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    lanes = _LANES[np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)]  # eight counters of a byte in each word
    counts = np.zeros(64, np.int64)
    for a in range(0, len(lanes), 255):
        counts += lanes[a : a + 255].sum(axis=0).view(np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", words_each: int = SHINGLE_WORDS, out: str = "_fp", carry: list[Column] | None = None) -> DataFrame:
    """The columns ``carry`` and the fingerprint as a (signed) long, for every row; null and blank texts have zero."""
    carried = docs.select(*(carry or []), text_or_empty(text_col).alias("_text"))
    kept = carried.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            made = np.array([fingerprint(t.as_py(), words_each) for t in batch.column(last)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(made)], names=[*[f.name for f in kept], out])

    return carried.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"{out} long"]))


def parts_for(prints: int) -> int:
    """Into how many parts to deal the coordinates, for the least work: entries of grids and pairs in their cells.

    Two random embeddings agree on a coordinate with a chance of 3/8; an
    entry costs as much as ``PAIRS_PER_ENTRY`` comparisons.
    """

    def work(parts: int) -> float:
        same = 0.375 ** (32 * (parts - 4) / parts)
        return comb(parts, 4) * (prints + prints**2 / 2 * same / PAIRS_PER_ENTRY)

    return min(range(6, 13), key=work)


def grid_masks(parts: int) -> list[int]:
    """The bits that the cells of each grid hold: those of all parts but four."""
    edges = [round(i * 32 / parts) for i in range(parts + 1)]
    bits = [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(bits, parts - 4)]


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in its two bits."""
    low, high = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings, whose fields are 0, 1 or 2."""
    v = a ^ b
    odd = np.uint64(_ODD)
    v = v - ((v & (v >> np.uint64(1)) & odd) << np.uint64(1))  # 1 against 2 gives 3: the difference is 1
    return np.bitwise_count(v & odd).astype(np.int64) + 2 * np.bitwise_count((v >> np.uint64(1)) & odd).astype(np.int64)


def _links(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """A spanning forest of the links within the cells of one bucket."""
    cell = rows[["_grid", "_cell", "_part"]].to_numpy(np.int64)
    fp = rows["_fp"].to_numpy(np.int64)
    order = np.lexsort((fp, cell[:, 2], cell[:, 1], cell[:, 0]))
    cell, fp = cell[order], fp[order].view(np.uint64)
    packed = fp - ((fp >> np.uint64(1)) & np.uint64(_ODD))
    new = np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)])
    run = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], len(fp))[run]
    nodes, node = np.unique(fp, return_inverse=True)
    root = np.arange(len(nodes))
    out: list[tuple[int, int]] = []
    at, step = np.arange(len(fp)), 1

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            break
        a, b = at, at + step
        a, b = a[(near := _distance(packed[a], packed[b]) <= most)], b[near]
        exact = np.bitwise_count(fp[a] ^ fp[b]) <= most
        a, b = node[a[exact]], node[b[exact]]
        apart = root[a] != root[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((x, y))
        while apart.any() and (root != (up := root[root])).any():
            root[:] = up
        step += 1
    made = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": nodes[made[:, 0]].view(np.int64), "b": nodes[made[:, 1]].view(np.int64)})


def links(prints: DataFrame, most: int = MOST_BITS, parts: int | None = None) -> DataFrame:
    """``a, b``: links that connect all distinct ``_fp`` within ``most`` bits of one another.

    ``most`` is 4 at most, for the grids to miss nothing; ``parts`` is chosen
    by the number of fingerprints unless given. A cell of more than
    ``CELL_ENTRIES`` is dealt to blocks, and each pair of blocks is a task of
    its own; no pairs are emitted but a spanning forest's.
    """
    if not 0 <= most <= 4:
        raise ValueError("the grids hold for distances up to 4")
    count, emb = prints.count(), embedding(F.col("_fp"))
    grids = [F.struct(F.lit(g).alias("_grid"), emb.bitwiseAND(F.lit(_signed(mask))).alias("_cell")) for g, mask in enumerate(grid_masks(parts or parts_for(count)))]
    entries = prints.select("_fp", F.explode(F.array(*grids)).alias("g")).select("_fp", "g.*")
    blocks = F.ceil(F.col("n") / CELL_ENTRIES).cast("int")
    large = entries.groupBy("_grid", "_cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ENTRIES).select("_grid", "_cell", blocks.alias("_blocks"))
    own = F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("_blocks") - 1)
    # the tasks (i, j), i <= j, that an entry of block `own` is in
    pairs = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(other, lambda k: F.least(own, k) * F.col("_blocks") + F.greatest(own, k)))
    buckets = max(1, round(count * len(grids) / BUCKET_ENTRIES))
    dealt = (
        entries.join(large, ["_grid", "_cell"], "left")
        .select("_fp", "_grid", "_cell", F.explode(pairs).alias("_part"))
        .withColumn("_bucket", F.pmod(F.xxhash64("_grid", "_cell", "_part"), F.lit(buckets)))
    )
    return dealt.groupBy("_bucket").applyInPandas(lambda rows: _links(rows, most), "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def classes(found: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``_fp, component_id, _rows`` of every fingerprint in ``found`` (``_id, _fp``); ``_rows`` is how many have it."""
    own = found.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_rows"))
    own = stored(own, "prints")
    roots = stored(components(stored(links(own, most), "links")), "roots")
    linked = own.join(roots, own["_fp"] == roots["node"]).select("_fp", "_least", "root")
    least = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    linked = linked.join(least, "root").select("_fp", "component_id")
    return own.join(linked, "_fp", "left").select("_fp", F.coalesce("component_id", "_least").alias("component_id"), "_rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """``id, fingerprint, component_id`` for every row.

    Components are those of the graph that links fingerprints at ``most`` or
    fewer differing bits; ``component_id`` is the least id in it. Null and
    blank texts have fingerprint zero, which links like any other; texts
    with fewer words than a shingle are one shingle. Null ids are rows but
    never name a component (one of null ids alone has a null name); repeated
    rows stay; texts of any length are read whole; only two columns are read,
    so others may have any names; an empty table gives no rows.
    """
    found = stored(fingerprints(docs, text_col, carry=[F.col(id_col).alias("_id")]), "fingerprints")
    return (
        join_counted(found, stored(classes(found, most), "classes"), ["_fp"], "_rows", found.count())
        .select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """The rows that stay, with all their columns: of each component the one with the least id.

    Of several rows with that id, the one whose text has the least hash
    stays; repeats of it go. Null ids come after all others; null and blank
    texts are alike; an empty table stays empty; no column's name is taken.
    """
    text_hash = F.xxhash64(text_or_empty(text_col))
    found = stored(fingerprints(docs, text_col, words_each, carry=[F.col(id_col).alias("_id"), text_hash.alias("_hash")]), "fingerprints")
    first = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    own = found.groupBy("_fp").agg(F.min(first).alias("_first"))  # copies meet before the join
    won = own.join(classes(found, most).withColumnRenamed("component_id", "_component").drop("_rows"), "_fp")
    won = won.groupBy(F.coalesce(F.col("_component").cast("string"), F.concat(F.lit("print "), F.col("_fp"))).alias("_c")).agg(F.min("_first").alias("w"))
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], id_key(id_col).alias("_key"), text_hash.alias("_hash"))
    won = won.select(id_key("w.id").alias("_key"), F.col("w.hash").alias("_hash")).distinct()
    # repeats go without another shuffle, as they are grouped by the join's keys
    return keyed.join(won, ["_key", "_hash"]).dropDuplicates(["_key", "_hash"]).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
