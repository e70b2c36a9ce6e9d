"""Sorted runs: external sort, merge, concatenation, and schema-driven order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASC, DESC, IGNORE = "ascending", "descending", "ignore"


def external_sort(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A total order; Spark range-partitions and spills as it has to."""
    return df.orderBy(*keys)


def concat_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of runs with equal schemas (name and type, any order)."""
    first = sorted((f.name, f.dataType.simpleString()) for f in runs[0].schema)
    for r in runs[1:]:
        if sorted((f.name, f.dataType.simpleString()) for f in r.schema) != first:
            raise ValueError("runs differ in schema")
    return reduce(DataFrame.unionByName, runs)


def merge_runs(runs: Sequence[DataFrame], keys: Sequence[str], run: str | None = None) -> DataFrame:
    """K-way merge: one ordered table from sorted runs; ``run`` names a column for the number of a row's run."""
    if run is not None:
        runs = [r.withColumn(run, F.lit(i)) for i, r in enumerate(runs)]
    return concat_runs(runs).orderBy(*keys, *([run] if run else []))


def placed(run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A run with ``place``, each row's ordinal in it."""
    from .access import numbered

    return numbered(run, list(keys)).withColumnRenamed("row_no", "place")


def run_order(runs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """``row_no, run, place``: from which run, and which place in it, each row of the merge comes.

    ``runs`` have ``place``. Equal keys come in the order of the runs.
    """
    from .access import numbered

    every = concat_runs([r.select(*keys, "place").withColumn("run", F.lit(i)) for i, r in enumerate(runs)])
    return numbered(every, [*keys, "run", "place"]).select("row_no", "run", "place")


def replay(order: DataFrame, runs: Sequence[DataFrame]) -> DataFrame:
    """Any columns of the runs (with ``place``), with ``row_no`` by a recorded order."""
    every = concat_runs([r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)])
    return every.join(order, ["run", "place"]).drop("run", "place")


def record_order(df: DataFrame, order: Mapping[str, str] | None = None) -> list[Column]:
    """Sort columns of a record comparison: fields in schema order, ascending unless told otherwise.

    ``IGNORE`` fields do not count; maps cannot be compared. Enum fields,
    marked by ``symbols`` in their metadata, order by position.
    """
    out = []
    for f in df.schema:
        how = (order or {}).get(f.name, f.metadata.get("order", ASC))
        if how == IGNORE:
            continue
        if f.dataType.typeName() == "map":
            raise TypeError(f"maps have no order: {f.name}")
        col = F.col(f"`{f.name}`")
        if "symbols" in f.metadata:
            col = enum_ordinal(col, f.metadata["symbols"])
        out.append(col.desc() if how == DESC else col.asc())
    return out


def enum_ordinal(col: Column, symbols: Sequence[str]) -> Column:
    """The place of an enum symbol, from 0; null for an unknown one."""
    at = F.array_position(F.array(*[F.lit(s) for s in symbols]), col)
    return F.when(at > 0, (at - 1).cast("int"))


def sorted_records(df: DataFrame, order: Mapping[str, str] | None = None) -> DataFrame:
    return df.orderBy(*record_order(df, order))


def top_batches(df: DataFrame, size: int):
    """Rows to the driver in batches of at most ``size``, a partition at a time."""
    batch: list = []
    for row in df.toLocalIterator():
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
