"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Shards are the leaves of a tree region / rack / shard. For a key, a shard
draws a hash value -ln(u) / weight, and a rack or region has the least draw
of its children, which is a draw of their summed weight; so the draws of a
node and of its children agree. A document descends from the root to the
child of least draw, and each child gets its share by weight. A shard's draw
depends on the key, its number and its weight alone: when weights change,
rows move only into or out of the subtrees whose weights changed, and one
more shard, wherever it hangs, takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty

#: Shards to a rack and racks to a region, filled in the order of their numbers.
RACK_SHARDS, REGION_RACKS = 2, 2
#: Rows of a block about: each shard's rows are numbered block by block.
BLOCK_ROWS = 50_000


def topology(weights: Sequence[float]) -> list[list[list[tuple[int, float]]]]:
    """Regions of racks of (shard, weight), filled in order."""
    leaves = list(enumerate(map(float, weights)))
    racks = [leaves[i : i + RACK_SHARDS] for i in range(0, len(leaves), RACK_SHARDS)]
    return [racks[i : i + REGION_RACKS] for i in range(0, len(racks), REGION_RACKS)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """Exponential with rate ``weight``: 53 bits of a hash of key and child."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a string key: at the root, in the region and in the rack, the child of least draw; ties go to the first."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    least = lambda nodes: nodes[0] if len(nodes) == 1 else F.least(*nodes)
    leaf = lambda s, w: F.struct(_draw(key, f"shard {s}", w).alias("draw"), F.lit(s).alias("shard"))
    regions = [least([least([leaf(s, w) for s, w in rack]) for rack in racks]) for racks in topology(weights)]
    return least(regions)["shard"]


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The law is ``key``: id and shard count decide. ``grown_shard`` is the
    shard with one more of weight 1, which moves rows into the new shard
    alone, for any number of shards. A null text has size 1 and the checksum of the empty
    text; a null id counts as ''; repeated rows share a shard and get slots
    of their own; an empty table gives no rows. Only two columns are read.

    Slots: rows that are equal in all outputs are counted first, so that a
    hot id is one row; then the rows of a (shard, block of a content hash)
    are numbered, and the blocks' sizes are summed to offsets. Their number
    follows the table's, so no task holds a whole shard. The offsets meet
    the numbered rows where these already are.
    """
    weights = list(weights or [1.0] * n_shards)
    blocks = max(1, -(-docs.count() // (BLOCK_ROWS * len(weights))))
    text = text_or_empty(text_col)
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .groupBy("_id", "size", "text_crc32")
        .agg(F.count("*").alias("_n"))
        .withColumn("shard", shard_of(key, weights))
        .withColumn("_block", F.pmod(F.xxhash64("_id", "size", "text_crc32"), F.lit(blocks)).cast("int"))
    )
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "_block").agg(F.sum("_n").alias("_rows"))
        .select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("shard", "_block").orderBy("_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("_end", F.sum("_n").over(inside))
        .join(offsets, ["shard", "_block"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("_offset") + F.col("_end") - F.col("_copy")).alias("slot"),
            shard_of(key, [*weights, 1.0]).cast("int").alias("grown_shard"),
        )
    )
