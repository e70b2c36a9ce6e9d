"""What the operators of this subpackage share: table reading and shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.storage import discard, stored

__all__ = ["ASCII_SPACE", "discard", "id_key", "is_fold", "join_counted", "stored", "table", "text_or_empty"]

#: The six ASCII white-space characters [\x20\x09-\x0D] that the contracts name.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder; only Spark's own readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def is_fold(mod: int, col: Column | str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod ``mod`` is 1; a null id counts as ''."""
    col = F.col(col) if isinstance(col, str) else col
    key = F.coalesce(col.cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % mod == 1


def id_key(col: Column | str) -> Column:
    """An id as text that is never null, so that joins and groupings on it share one partitioning."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


#: Keys with more than a row in so many are joined by broadcast; there are no more of them than that.
HOT_SHARE = 256


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a key and in ``count`` how many of ``rows`` have it.

    ``total`` is the number of ``rows``. The keys that hold more than a
    ``HOT_SHARE``-th of them, fewer than ``HOT_SHARE`` by nature, are
    broadcast, and their rows are spread over all tasks; the others meet by
    shuffle. So no key fills a task, and ``rows`` are read once. Keys are
    never null.
    """
    floor = max(1, total // HOT_SHARE)
    values = [c for c in keyed.columns if c not in keys]
    struct = F.struct(*values)
    hot = keyed.where(F.col(count) > floor).select(*keys, struct.alias("_hot"))
    cool = keyed.where(F.col(count) <= floor).select(*[F.col(k).alias(f"_cool_{k}") for k in keys], struct.alias("_cool"), F.pmod(F.col(count), F.lit(1)).cast("long").alias("_cool_spread"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    # the zero of `_cool_spread` is not a constant to the optimizer, which would deal the rows by the keys alone
    marked = marked.withColumn("_spread", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns)))
    on = [F.col(k) == F.col(f"_cool_{k}") for k in keys] + [F.col("_spread") == F.col("_cool_spread")]
    met = marked.join(cool, on, "left").withColumn("_got", F.coalesce("_hot", "_cool")).where(F.col("_got").isNotNull())
    return met.select(*rows.columns, *[F.col(f"_got.{c}").alias(c) for c in values])
