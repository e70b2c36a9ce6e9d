"""Layers: flat tables in a 1:N chain or tree, with primary and foreign keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Layer:
    """One flat table. ``fk`` are its columns that hold the parent's ``pk``, in order."""

    name: str
    df: DataFrame
    pk: tuple[str, ...]
    fk: tuple[str, ...] = ()
    children: list[Layer] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.pk, self.fk = tuple(self.pk), tuple(self.fk)

    @property
    def array(self) -> str:
        """The name of this layer's array inside its parent."""
        return f"{self.name}Arr"

    def with_children(self, *children: Layer) -> Layer:
        return replace(self, children=list(children))

    def walk(self, depth: int = 0):
        """Each layer with its number: 0 for the root, one more for each level."""
        yield depth, self
        for child in self.children:
            yield from child.walk(depth + 1)

    def level(self, name: str) -> int:
        for depth, layer in self.walk():
            if layer.name == name:
                return depth
        raise KeyError(name)

    def line_to(self, name: str) -> list[Layer]:
        """The layers from this one down to the one named."""
        if self.name == name:
            return [self]
        for child in self.children:
            try:
                return [self, *child.line_to(name)]
            except KeyError:
                continue
        raise KeyError(name)

    def subtree(self, name: str) -> list[Layer]:
        """The layer named and all below it."""
        return [x for _, x in self.line_to(name)[-1].walk()]


def chain(*layers: Layer) -> Layer:
    """Layers from the root down, each the child of the one before."""
    out = layers[-1]
    for layer in reversed(layers[:-1]):
        out = layer.with_children(out)
    return out


def with_surrogate(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each ``within`` group from 1, for tables without a unique key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(*order)))


def duplicate_keys(layer: Layer) -> DataFrame:
    """Primary keys held by more than one row, and how many."""
    return layer.df.groupBy(*layer.pk).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: Layer, parent: Layer) -> DataFrame:
    """Rows of ``child`` without a parent row (null foreign keys included). A layer may be its own parent."""
    keys = parent.df.select(*[F.col(p).alias(f"__parent_{i}") for i, p in enumerate(parent.pk)])
    return child.df.join(keys, [F.col(c) == F.col(f"__parent_{i}") for i, c in enumerate(child.fk)], "left_anti")


def has_map(kind: T.DataType) -> bool:
    """Whether a type holds a map, which has no order."""
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)


def in_order(entries: Column, keys: Sequence[str], payload: Sequence[str], kinds: Iterable[T.DataType]) -> Column:
    """An array of structs (fields ``keys``, then ``payload``, of the types ``kinds``) ascending by its keys.

    Where the payload can be compared it breaks ties; where it holds maps,
    the keys alone are compared.
    """
    if not any(has_map(k) for k in kinds):
        return F.array_sort(entries)
    first = lambda x: F.struct(*[x[k].alias(k) for k in keys])
    return F.array_sort(entries, lambda a, b: F.when(first(a) < first(b), -1).when(first(a) > first(b), 1).otherwise(0))


def schema_keys(layer: Layer) -> dict[str, list[str]]:
    """The derived column lists of a layer: its key and its non-key columns."""
    return {"key": list(layer.pk), "mid": [c for c in layer.df.columns if c not in layer.pk]}
