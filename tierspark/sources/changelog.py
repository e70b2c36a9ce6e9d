"""Change logs on storage: an operation, its place in the order, the key, and fields that may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.layers import Layer
from ..operators.mutate import OPS
from .writers import write

#: Flags of the operations as they are stored.
FLAGS = {"insert": 1, "delete": 2, "update": 3, "upsert": 6}


def write_log(log: DataFrame, path: str, layer: Layer, mode: str = "append") -> None:
    """Store changes of one layer: a flag, ``seq``, the key as one struct, and the other fields.

    An operation that is not known is an error when it is written.
    """
    flag = F.raise_error(F.concat(F.lit("no such operation: "), F.coalesce("op", F.lit("null")))).cast("tinyint")
    for op in OPS:
        flag = F.when(F.col("op") == op, F.lit(FLAGS[op]).cast("tinyint")).otherwise(flag)
    fields = [c for c in layer.df.columns if c not in layer.pk]
    given = [F.col(c) if c in log.columns else F.lit(None).cast(layer.df.schema[c].dataType).alias(c) for c in fields]
    write(log.select(flag.alias("flag"), F.col("seq").cast("long").alias("seq"), F.struct(*layer.pk).alias("key"), *given), path, mode)


def read_log(spark: SparkSession, path: str, layer: Layer, since: int | None = None) -> DataFrame:
    """``op, seq`` and the layer's columns; with ``since``, changes from that place on."""
    schema = layer.df.schema
    kept = T.StructType([T.StructField("flag", T.ByteType()), T.StructField("seq", T.LongType()), T.StructField("key", T.StructType([schema[k] for k in layer.pk])), *[f for f in schema if f.name not in layer.pk]])
    log = spark.read.schema(kept).parquet(path)
    if since is not None:
        log = log.where(F.col("seq") >= since)
    op = F.element_at(F.create_map(*[F.lit(x) for o, f in FLAGS.items() for x in (f, o)]), F.col("flag").cast("int"))
    return log.select(op.alias("op"), "seq", *[F.col(f"key.{c}").alias(c) if c in layer.pk else F.col(c) for c in layer.df.columns])
