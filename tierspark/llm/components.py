"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 30))).first()
    return got[0], got[1] or 0


def _star(edges: DataFrame, both: bool, total: int) -> DataFrame:
    """One star step on edges u > v: hang neighbours on each node's least neighbour.

    ``both``: a node's neighbours on either side count and those above it
    are moved (large star); otherwise those below it and itself (small star).
    The least is aggregated map-side and joined back by ``join_counted``, so
    that a node with very many edges fills no task.
    """
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    met = join_counted(around, least, ["u"], "n", total * (1 + both)).drop("n")
    if both:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: long): root is the least node reachable.

    Alternates large and small stars until nothing changes, which takes a
    number of rounds that grows with the logarithm of the node count. Every
    round is written to the shared folder, and the one before it deleted;
    only a count and a checksum come to the driver. Loops and repeated edges
    do no harm; without edges there are no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    loops = now.select(F.col("u").alias("node")).union(now.select(F.col("v").alias("node"))).distinct()
    now = stored(now.where("u > v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = stored(_star(now, True, state[0]), "edges")
        after = stored(_star(large, False, large.count()), "edges")
        discard(now)
        discard(large)
        now = after
        state, before = _state(now), state
        if state == before:
            break
    return loops.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
