"""Point and positional access."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .layers import Layer, has_map
from .nest import nest


def _is_key(names: tuple[str, ...], key: object) -> Column:
    values = key if isinstance(key, (tuple, list)) else (key,)
    out = F.lit(True)
    for name, value in zip(names, values, strict=True):
        out = out & (F.col(name) == F.lit(value))
    return out


def point_search(df: DataFrame, pk: tuple[str, ...], key: object, columns: list[str] | None = None) -> DataFrame:
    """The row with this key. Equality on a sorted Parquet column prunes row groups by their statistics."""
    return df.where(_is_key(pk, key)).select(*(columns or df.columns))


def exists_keys(keys: DataFrame, df: DataFrame, pk: tuple[str, ...]) -> DataFrame:
    """``keys`` with ``exists``: whether ``df`` has a row for each."""
    there = df.select(*pk).distinct().withColumn("__there", F.lit(True))
    return keys.join(there, list(pk), "left").withColumn("exists", F.coalesce("__there", F.lit(False))).drop("__there")


def numbered(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows with ``row_no`` from 0 in the given order (names or sort columns), without one task for all rows.

    Range partitions are sorted and numbered on their own; the partitions'
    sizes, one row each, are summed to offsets.
    """
    from ..streaming.storage import stored

    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # a row hash behind the order, so that rows alike in it can fill several partitions
    mix = [F.col(f"`{f.name}`") for f in df.schema if not has_map(f.dataType)]
    dealt = stored(df.repartitionByRange(*order, F.xxhash64(*mix)).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = W.partitionBy("__part").orderBy(*order)
    return dealt.join(F.broadcast(offsets), "__part").withColumn("row_no", F.row_number().over(inside) - 1 + F.col("__off")).drop("__part", "__off")


class SortedTable:
    """A stored table whose files follow one another in key order, as ``write_sorted`` makes them.

    Rows have ordinals without a sort: a file's place in the order of names,
    and a row's place in its file, which the reader knows. Only the files'
    names and row counts come to the driver. Searches by key are pushed to
    the scan, where files, row groups and pages are skipped by their
    statistics and Bloom filters.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] | str):
        self.df = spark.read.parquet(path)
        self.keys = (keys,) if isinstance(keys, str) else tuple(keys)
        self._files: list[tuple[str, int, int]] | None = None

    @property
    def files(self) -> list[tuple[str, int, int]]:
        """``path, first ordinal, rows`` of each file that has rows."""
        if self._files is None:
            counts = self.df.groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("n")).collect()
            self._files, at = [], 0
            for path, n in sorted((r.p, r.n) for r in counts):
                self._files.append((path, at, n))
                at += n
        return self._files

    def rows(self, first: int, count: int, columns: list[str] | None = None) -> DataFrame:
        """Rows by ordinal, with ``row_no``; only the files that hold them are read."""
        columns, place = columns or self.df.columns, F.col("_metadata.row_index")
        out = None
        for path, at, n in self.files:
            low, high = max(first, at), min(first + count, at + n)
            if low < high:
                part = self.df.where((F.col("_metadata.file_path") == path) & place.between(low - at, high - at - 1))
                part = part.select(*columns, (place + at).alias("row_no"))
                out = part if out is None else out.unionByName(part)
        return self.df.select(*columns, F.lit(0).cast("long").alias("row_no")).where(F.lit(False)) if out is None else out

    def search(self, key: object, columns: list[str] | None = None) -> DataFrame:
        return point_search(self.df, self.keys, key, columns)

    def offsets(self, key: object) -> DataFrame:
        """``keys, row_no`` of the rows with this key: nothing but the key is read."""
        found = self.df.where(_is_key(self.keys, key)).select(*self.keys, F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
        # as an expression, for the files may be many but each is a name and a number
        firsts = self.df.sparkSession.createDataFrame([(p, at) for p, at, _ in self.files] or [("", 0)], "__path string, __first long")
        return found.join(F.broadcast(firsts), "__path").select(*self.keys, (F.col("__row") + F.col("__first")).alias("row_no"))

    def seek(self, key: object) -> DataFrame:
        """All rows from the first key that is not less than ``key``, on the leading key column."""
        return self.df.where(F.col(self.keys[0]) >= F.lit(key))

    def between(self, low: object, high: object, descending: bool = False, together: list[str] | None = None) -> DataFrame:
        """Rows with low <= leading key < high, in key order.

        With ``together``, equal keys are one row and these columns arrays of
        their values, in order.
        """
        out = self.df.where((F.col(self.keys[0]) >= F.lit(low)) & (F.col(self.keys[0]) < F.lit(high)))
        if together:
            entries = F.array_sort(F.collect_list(F.struct(*together)))
            out = out.groupBy(*self.keys).agg(entries.alias("__all")).select(*self.keys, *[F.col("__all")[c].alias(c) for c in together])
        return out.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in self.keys])


def nth_rows(df: DataFrame, order: list[str | Column], row: int, count: int = 1) -> DataFrame:
    """Rows by ordinal of a table that is not stored in order.

    One pass deals rows to range partitions and counts them; only the
    partitions that hold the rows are sorted.
    """
    from ..streaming.storage import stored

    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "dealt")
    at, wanted = 0, []
    for r in sorted(dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        if at < row + count and at + r.n > row:
            wanted.append((r["__part"], at))
        at += r.n
    first = F.lit(0).cast("long")
    for part, before in wanted:
        first = F.when(F.col("__part") == part, F.lit(before)).otherwise(first)
    inside = W.partitionBy("__part").orderBy(*order)
    some = dealt.where(F.col("__part").isin([p for p, _ in wanted])).withColumn("row_no", F.row_number().over(inside) - 1 + first)
    return some.where((F.col("row_no") >= row) & (F.col("row_no") < row + count)).drop("__part")


def row_at(df: DataFrame, order: list[str], row: int) -> DataFrame:
    return nth_rows(df, order, row)


def row_range(df: DataFrame, order: list[str], row: int, count: int) -> DataFrame:
    return nth_rows(df, order, row, count)


def raw_keys(df: DataFrame, pk: tuple[str, ...]) -> DataFrame:
    """The key columns alone; nothing else is read."""
    return df.select(*pk)


def layer_index(root: Layer, name: str) -> DataFrame:
    """``pk, back, forward``: each key of a layer with its parent's key and, by child layer, its children's keys.

    ``back`` is null for the root; ``forward`` has an array of key structs
    for each child layer. Keys alone are read and nested.
    """
    path = root.line_to(name)
    layer = path[-1]
    back = F.struct(*[F.col(c).alias(p) for c, p in zip(layer.fk, path[-2].pk, strict=True)]) if len(path) > 1 else F.lit(None).cast("string")
    out = layer.df.select(*layer.pk, *[c for c in layer.fk if c not in layer.pk]).withColumn("back", back)
    for child in layer.children:
        keys = child.df.select(*dict.fromkeys([*child.fk, *child.pk]))
        out = nest(out, layer.pk, keys, child.fk, child.pk, child.name)

    def keys_of(child: Layer) -> Column:
        return F.transform(child.name, lambda x: F.struct(*[x[k].alias(k) for k in child.pk])).alias(child.name)

    forward = F.struct(*map(keys_of, layer.children)) if layer.children else F.lit(None).cast("string")
    return out.select(*layer.pk, "back", forward.alias("forward"))


def merge_forward(stored_keys: Column, pending: Column) -> Column:
    """Child keys of an index with pending toggles: keys that are in one list only, in order.

    A pending key that the index has is one that left; any other came.
    """
    return F.array_sort(F.array_union(F.array_except(stored_keys, pending), F.array_except(pending, stored_keys)))


def path_key(path: list[Layer], columns: Mapping[str, str] | None = None) -> list[Column]:
    """Sort columns of a nested path: the keys of all layers from the root down, each column once."""
    seen = dict.fromkeys(c for layer in path for c in layer.pk)
    return [F.col((columns or {}).get(c, c)) for c in seen]


def file_row(path_df: DataFrame, row: int) -> DataFrame:
    """Rows by their ordinal in each Parquet file, which the reader knows."""
    return path_df.where(F.col("_metadata.row_index") == row)


def array_offsets(n: DataFrame, array: str, key: str) -> DataFrame:
    """``key, length, end_offset``: array lengths, and their running sum in key order."""
    sized = n.select(key, F.size(array).cast("long").alias("length"))
    return with_running_sum(sized, key, "length", "end_offset")


def with_running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Running sum in order, by range partitions as in ``numbered``."""
    from ..streaming.storage import stored

    dealt = stored(df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()), "summed")
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__s"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"))
    inside = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return dealt.join(F.broadcast(offsets), "__part").withColumn(out, F.sum(value).over(inside) + F.col("__off")).drop("__part", "__off")


def parent_keys(child: Layer, parent: Layer) -> DataFrame:
    """``child pk, parent pk``: derived from the foreign key."""
    return child.df.select(*child.pk, *[F.col(c).alias(p) for c, p in zip(child.fk, parent.pk, strict=True)])


def child_keys(n: DataFrame, pk: tuple[str, ...], array: str, child_pk: tuple[str, ...]) -> DataFrame:
    """``pk, keys``: for each record the keys of its children, in order."""
    keys = F.transform(array, lambda x: F.struct(*[x[c].alias(c) for c in child_pk]))
    return n.select(*pk, keys.alias("keys"))


def read_column(df: DataFrame, number: int) -> DataFrame:
    """One column by its number."""
    return df.select(df.columns[number])
