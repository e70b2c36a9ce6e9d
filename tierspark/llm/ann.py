"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt to shards of bounded size. In a shard, each tree is a sorted
array of long hash strings (signs of random projections, as 64-bit numbers)
with its row numbers. A query descends every tree to the longest prefix that
some row shares with it, and all trees are then ascended together, a bit at
a time, until the rows under the shared prefixes are enough. These are scored
exactly, in double precision, and the shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a shard about; queries of a block that are worked on at once; blocks that a task takes.
SHARD_ROWS, QUERY_BLOCK, TASK_BLOCKS = 4096, 512, 8
#: Trees, bits of a hash string, projections that the trees draw theirs from, and
#: the rows to gather at least: a share of a shard's, and some for each result.
TREES, BITS, POOL, SHARE, PER_RESULT = 64, 64, 512, 0.45, 8
EVERY = 20


def _draws(dim: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared projections, and the ones that each tree's string takes, in its order."""
    rng = np.random.default_rng([dim, trees])
    return rng.normal(size=(dim, POOL)), np.stack([rng.permutation(POOL)[:BITS] for _ in range(trees)])


def hash_strings(x: np.ndarray, trees: int) -> np.ndarray:
    """(trees, rows): the signs of each tree's 64 projections, the first in the highest bit."""
    projections, chosen = _draws(x.shape[1], trees)
    signs = x @ projections > 0
    return np.stack([np.ascontiguousarray(np.packbits(signs[:, c], axis=1)).view(">u8").ravel().astype(np.uint64) for c in chosen])


class Forest:
    """Sorted arrays of hash strings over the rows of ``x``."""

    def __init__(self, x: np.ndarray, trees: int = TREES):
        self.x, self.trees = x, trees
        hashes = hash_strings(x, trees)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def _under(self, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, the run of rows that share its first ``depth`` bits."""
        mask = np.uint64(((1 << depth) - 1) << (BITS - depth))
        low, high = wanted & mask, wanted | ~mask
        a = np.stack([np.searchsorted(s, w, "left") for s, w in zip(self.sorted, low, strict=True)])
        b = np.stack([np.searchsorted(s, w, "right") for s, w in zip(self.sorted, high, strict=True)])
        return a, b

    def candidates(self, queries: np.ndarray, least: int) -> np.ndarray:
        """(queries, rows) boolean: rows gathered when ``least`` distinct ones are under the prefixes."""
        wanted = hash_strings(queries, self.trees)
        n = len(self.x)
        got = np.zeros((len(queries), n), bool)
        open_ = np.arange(len(queries))
        for depth in range(self._longest(wanted), -1, -1):  # all trees ascend together
            a, b = self._under(wanted[:, open_], depth)
            some = np.flatnonzero((b - a).sum(axis=0) >= least)  # repeats count here, so no row is missed
            if not len(some):
                continue
            for t in range(self.trees):
                size = (b - a)[t, some]
                at = np.repeat(a[t, some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                got[np.repeat(open_[some], size), self.order[t, at]] = True
            done = some[got[open_[some]].sum(axis=1) >= min(least, n)]
            open_ = np.delete(open_, done)
            if not len(open_):
                break
        return got

    def _longest(self, wanted: np.ndarray) -> int:
        """Descend: the longest prefix that any query shares with any row of any tree."""
        most = 0
        for s, w in zip(self.sorted, wanted, strict=True):
            at = np.searchsorted(s, w)
            for near in (np.minimum(at, len(s) - 1), np.maximum(at - 1, 0)):
                apart = int((s[near] ^ w).min())
                most = max(most, BITS - apart.bit_length())
        return most


def _search(index: pd.DataFrame, queries: pd.DataFrame, k: int, share: float, trees: int) -> pd.DataFrame:
    """The shard's ``k`` best rows for each query that visits it."""
    columns = ["query_id", "vec_id", "score"]
    if not len(index) or not len(queries):
        return pd.DataFrame(columns=columns)
    index = index.sort_values("_id", kind="stable")
    ids = index["_id"].to_numpy()
    x = np.stack(index["_vec"].to_numpy()).astype(np.float64)
    forest = Forest(x, trees)
    out: list[tuple[np.ndarray, ...]] = []
    for block in queries["_block"]:
        qid = np.array([q["id"] for q in block])
        q = np.stack([np.asarray(q["vec"], np.float64) for q in block])
        gathered = forest.candidates(q, int(np.ceil(share * len(x))) + PER_RESULT * k)
        for i in range(len(q)):
            rows = np.flatnonzero(gathered[i] & (ids != qid[i]))
            score = x[rows] @ q[i]
            if len(rows) > k:
                floor = np.partition(score, len(rows) - k)[len(rows) - k]
                rows = rows[score >= floor - 1e-9 * (1 + abs(floor))]  # with ties, before exact sums
            score = (x[rows] * q[i]).sum(axis=1)
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), qid[i]), ids[rows[best]], score[best]))
    return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else pd.DataFrame(columns=columns)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = EVERY, share: float = SHARE, trees: int = TREES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of greatest inner product found for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all rows but those with the query's own id; ties go to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do null ids; rows that repeat both id and vector count
    once; vectors are compared with those of the same length. Empty tables
    give no rows, and with fewer than ``k`` candidates all are returned.

    Every row is indexed, in one shard of about ``SHARD_ROWS``, by a hash of
    id and vector, so that no common vector fills a shard. Queries visit all
    shards, in blocks of ``QUERY_BLOCK``: a task is one shard and at most
    ``TASK_BLOCKS`` blocks, whatever the table's size, and the work is that
    of the query set against all rows, less what the forest leaves out.
    With ``share`` 1 all rows are scored and the result is exact.
    """
    valid = F.coalesce(F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False)) & F.exists(vec_col, lambda v: v != 0)
    rows = (
        vectors.where(F.col(id_col).isNotNull() & valid)
        .select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"))
        .distinct()
        .withColumn("_dim", F.size("_vec"))
    )
    asked = F.col("_id") % every == 0
    count, queries = vectors.agg(F.count("*"), F.count_if(F.col(id_col) % every == 0)).first()
    shards, blocks = max(1, round(count / SHARD_ROWS)), max(1, round(queries / QUERY_BLOCK))
    rounds = -(-blocks // TASK_BLOCKS)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = rows.withColumn("_shard", F.pmod(F.xxhash64("_id", "_vec"), F.lit(shards))).withColumn("_round", numbers(rounds))
    wanted = (
        rows.where(asked)
        .groupBy("_dim", F.pmod(F.xxhash64("_vec", "_id"), F.lit(blocks)).alias("_b"))
        .agg(F.collect_list(F.struct(F.col("_id").alias("id"), F.col("_vec").alias("vec"))).alias("_block"))
        .select("_dim", F.pmod("_b", F.lit(rounds)).alias("_round"), numbers(shards).alias("_shard"), "_block")
    )
    found = (
        index.groupBy("_dim", "_shard", "_round").cogroup(wanted.groupBy("_dim", "_shard", "_round"))
        .applyInPandas(lambda a, b: _search(a, b, k, share, trees), "query_id long, vec_id long, score double")
    )
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
