"""Nest joins: a chain of keyed tables becomes one table of nested records, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layers import Layer, in_order


def nest(parent: DataFrame, pk: tuple[str, ...], child: DataFrame, fk: tuple[str, ...], child_pk: tuple[str, ...], name: str) -> DataFrame:
    """``parent`` with ``name``: the array of its child rows, ascending by the child's key.

    Left outer: a parent without children has an empty array. Orphans drop
    out. Both sides are hashed by the same key, so the grouping's exchange
    serves the join; children of one parent become one row and have to fit
    in memory, for which flat layers stay available.
    """
    first = [c for c in child_pk if c not in fk]
    entry = F.struct(F.struct(*first).alias("k"), F.struct(*child.columns).alias("v")) if first else F.struct(F.lit(0).alias("k"), F.struct(*child.columns).alias("v"))
    entries = in_order(F.collect_list(entry), ["k"], ["v"], [f.dataType for f in child.schema])
    grouped = child.groupBy(*[F.col(c).alias(f"__{p}") for c, p in zip(fk, pk, strict=True)]).agg(entries["v"].alias(name))
    on = [F.col(p) == F.col(f"__{p}") for p in pk]
    empty = F.array().cast(T.ArrayType(child.schema, False))
    return parent.join(grouped, on, "left").select(*parent.columns, F.coalesce(name, empty).alias(name))


def nest_all(root: Layer) -> DataFrame:
    """Nest a tree of layers, folding from the deepest up."""
    out = root.df
    for child in root.children:
        out = nest(out, root.pk, nest_all(child), child.fk, child.pk, child.array)
    return out


def descendant_counts(root: Layer, inner: tuple[str, ...] = ()) -> DataFrame:
    """The root's key and, for each layer below, how many rows of it hang under the key: ``n_<layer>``.

    Counts travel up by foreign key, folded before each shuffle, and no
    child row is collected; orphans do not count.
    """
    out = root.df.select(*root.pk, *inner)
    for child in root.children:
        below = descendant_counts(child, tuple(c for c in child.fk if c not in child.pk))
        sums = [c for c in below.columns if c.startswith("n_")]
        made = below.groupBy(*[F.col(c).alias(f"__{p}") for c, p in zip(child.fk, root.pk, strict=True)]).agg(F.count("*").alias(f"n_{child.name}"), *[F.sum(c).alias(c) for c in sums])
        names = [f"n_{child.name}", *sums]
        met = out.join(made, [F.col(p) == F.col(f"__{p}") for p in root.pk], "left")
        out = met.select(*out.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
    return out


def arrays(schema: T.StructType) -> list[str]:
    """The fields of a record that are arrays of records."""
    return [f.name for f in schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]


def unnest(n: DataFrame, *path: str, keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """Flat rows of the layer at ``path``; ``keep`` are columns of outer layers to carry along.

    With ``outer``, records whose array is empty give one row of nulls.
    """
    keep = list(keep or [])
    explode = F.inline_outer if outer else F.inline
    out = n
    for i, name in enumerate(path):
        carried = [c for c in keep if c in out.columns]
        out = out.select(*carried, explode(F.col(name)))
        if i == len(path) - 1:
            inner = [c for c in out.columns if c not in arrays(out.schema)]
            out = out.select(*inner)
    return out


def layer_counts(n: DataFrame) -> DataFrame:
    """``layer, n``: the number of records at each level of a nested table."""

    def sizes(schema: T.StructType, col, prefix: str) -> list[tuple[str, Column]]:
        out = []
        for name in arrays(schema):
            arr = col(name)
            out.append((f"{prefix}{name}", F.size(arr).cast("long")))
            inner = schema[name].dataType.elementType
            for path, _ in sizes(inner, lambda c: F.lit(None), f"{prefix}{name}."):
                out.append((path, None))
        return out

    def total(col: Column, schema: T.StructType, path: list[str]) -> Column:
        arr = col[path[0]]
        if len(path) == 1:
            return F.size(arr).cast("long")
        return F.aggregate(arr, F.lit(0).cast("long"), lambda acc, x: acc + total(x, None, path[1:]))

    paths = [p for p, _ in sizes(n.schema, lambda c: F.col(c), "")]
    row = F.struct(*[F.col(c) for c in n.columns])
    sums = n.select(F.lit(1).cast("long").alias("root"), *[total(row, n.schema, p.split(".")).alias(p.replace(".", "/")) for p in paths])
    sums = sums.agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in sums.columns])
    return sums.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in sums.columns]), F.array(*[F.col(f"`{c}`") for c in sums.columns]))).alias("layer", "n"))


def split_paths(n: DataFrame, *path: str) -> DataFrame:
    """Denormalise: a nested record for each record at the end of ``path``, every array on the way holding one element."""
    names, out = n.columns, n
    for i, name in enumerate(path):
        source = F.col(name) if i == 0 else F.col(f"__x{i - 1}.{name}")
        out = out.select("*", F.explode(source).alias(f"__x{i}"))
    whole = F.array(F.col(f"__x{len(path) - 1}"))
    for i in range(len(path) - 1, 0, -1):
        whole = F.array(F.col(f"__x{i - 1}").withField(path[i], whole))
    return out.withColumn(path[0], whole).select(*names)
