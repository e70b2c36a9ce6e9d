"""Exact deduplication on normalised text.

Rows are grouped by a 128-bit content hash; inside a group the bytes of the
normalised texts are compared, so that a hash collision splits into classes.
Of each class the row with the most code points in its original text stays,
ties going to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, id_key, join_counted, text_or_empty


def normalised(text: Column | str = "text") -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(text_or_empty(text), ASCII_SPACE, "")


def _digest(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    norm = normalised(text_col)
    return [
        F.col(id_col).alias("_id"),
        F.unhex(F.md5(norm)).alias("_hash"),
        F.sha2(norm, 256).alias("_sha"),
        F.char_length(text_or_empty(text_col)).cast("long").alias("_chars"),
    ]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per class of equal texts: ``_hash, _sha, keep_id, keep_chars, group_size``.

    The grouping key holds the hash and, behind it, the normalised bytes:
    rows meet by hash and are told apart by bytes. Map-side partial
    aggregation folds the copies of a hot group before the shuffle, and an
    aggregation buffer holds one text, however large the group is.
    """
    norm = normalised(text_col)
    best = F.struct(
        (-F.char_length(text_or_empty(text_col)).cast("long")).alias("less"),
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"),
    )
    return (
        docs.select(F.unhex(F.md5(norm)).alias("_hash"), norm.alias("_norm"), best.alias("_best"))
        .groupBy("_hash", "_norm")
        .agg(F.min("_best").alias("_best"), F.count("*").alias("group_size"))
        .select(
            "_hash",
            F.sha2("_norm", 256).alias("_sha"),
            F.col("_best.id").alias("keep_id"),
            (-F.col("_best.less")).alias("keep_chars"),
            "group_size",
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``.

    Only two columns of the input are read, so other columns may have any
    names. Null text counts as empty; null ids sort after all others;
    repeated rows (same id, same text) each get a row and exactly one of a
    class is kept; an empty table gives no rows. Texts of any length are
    compared whole.
    """
    rows = docs.select(*_digest(docs, id_col, text_col)).groupBy("_id", "_hash", "_sha", "_chars").agg(F.count("*").alias("_n"))
    best = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("keep_chars"))
    return (
        join_counted(rows, classes(docs, id_col, text_col), ["_hash", "_sha"], "group_size", docs.count())
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            (best & (F.col("_copy") == 1)).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Joins the whole rows with the winners on hash, id and length, so that no
    join key is hotter than one row; repeats of the winning row go without
    another shuffle, as they are grouped by the join's keys. Null texts count
    as empty; null ids come after all others; columns may have any names; an
    empty table stays empty.
    """
    names, keys = docs.columns, ["_hash", "_sha", "_chars", "_key"]
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *_digest(docs, id_col, text_col)).withColumn("_key", id_key("_id"))
    won = classes(docs, id_col, text_col).select("_hash", "_sha", F.col("keep_chars").alias("_chars"), id_key("keep_id").alias("_key"))
    return keyed.join(won, keys).dropDuplicates(keys).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
