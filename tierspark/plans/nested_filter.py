"""Conjunctive filter and projection over a nested table.

A record survives where all predicates on its layer hold, all its ancestors
survive, and for each layer below it that bears predicates, at least one
descendant there survives. Arrays keep survivors only; layers without
predicates on or below them keep all children, empty arrays included.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicate import Pred, Root, Udf, by_layer


def _below(preds: list[Pred], path: tuple[str, ...]) -> list[str]:
    """The arrays of the layer at ``path`` that bear predicates, themselves or deeper."""
    return list(dict.fromkeys(p.path[len(path)] for p in preds if len(p.path) > len(path) and p.path[: len(path)] == path))


def _own(preds: list[Pred], path: tuple[str, ...], record: object) -> Column | None:
    out = None
    for p in preds:
        if p.path == path:
            out = p.on(record) if out is None else out & p.on(record)
    return out


def _survives(preds: list[Pred], path: tuple[str, ...], record: object, but: str | None = None) -> Column | None:
    """Whether a record has all it needs at its layer and below; ``but`` leaves out one branch."""
    out = _own(preds, path, record)
    for name in _below(preds, path):
        if name != but:
            some = F.coalesce(F.exists(record[name], _survivor(preds, (*path, name))), F.lit(False))
            out = some if out is None else out & some
    return out


def _survivor(preds: list[Pred], path: tuple[str, ...]):
    """The test of an array's element, as a function of one argument."""
    return lambda x: _or_true(_survives(preds, path, x))


def _shape(schema: T.StructType, preds: list[Pred], path: tuple[str, ...], project: Sequence[str] | None):
    return lambda x: F.struct(*_pruned(schema, x, preds, path, project))


def _or_true(cond: Column | None) -> Column:
    return F.lit(True) if cond is None else cond


def _wanted(project: Sequence[str] | None, name: str) -> tuple[bool, list[str] | None]:
    """Whether a field is projected, and what of its elements."""
    if project is None or name in project:
        return True, None
    inner = [p.split(".", 1)[1] for p in project if p.startswith(f"{name}.")]
    return bool(inner), inner


def _pruned(schema: T.StructType, record: object, preds: list[Pred], path: tuple[str, ...], project: Sequence[str] | None) -> list[Column]:
    """The fields of a surviving record, its arrays pruned to survivors."""
    bearing, out = _below(preds, path), []
    for f in schema:
        take, inner = _wanted(project, f.name)
        if not take:
            continue
        value = record[f.name]
        nested = isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
        if nested and f.name in bearing:
            value = F.filter(value, _survivor(preds, (*path, f.name)))
        if nested and (f.name in bearing and _below(preds, (*path, f.name)) or inner is not None):
            value = F.transform(value, _shape(f.dataType.elementType, preds, (*path, f.name), inner))
        out.append(value.alias(f.name))
    return out


def _mask(depth: int, func):
    """A Python predicate over arrays nested ``depth`` deep, as a function of series."""

    def run(v, d: int):
        if d:
            return None if v is None else [run(x, d - 1) for x in v]
        return None if v is None or v != v else bool(func(v))

    def mask(values: pd.Series) -> pd.Series:
        return values.map(lambda v: run(v, depth))

    return mask


def _with_masks(n: DataFrame, udfs: list[Udf]) -> tuple[DataFrame, list[Pred]]:
    """Evaluate Python predicates, as vectorised UDFs over the arrays of their fields.

    The outcome is stored in each record of the layer, under a name of its
    own, where an ordinary predicate reads it.
    """
    preds = []
    for k, u in enumerate(udfs):
        mark = f"__mask{k}"
        kind: T.DataType = T.BooleanType()
        value: Column = F.col(u.path[0]) if u.path else F.col(u.field)
        for _ in u.path:
            kind = T.ArrayType(kind)

        def pick(arr: Column, rest: tuple[str, ...], name: str = u.field) -> Column:
            return F.transform(arr, lambda x: pick(x[rest[0]], rest[1:]) if rest else x[name])

        if u.path:
            value = pick(value, u.path[1:])


        def put(arr: Column, marks: Column, rest: tuple[str, ...], schema: T.StructType, name: str = mark) -> Column:
            def one(x: Column, i: Column) -> Column:
                fields = [(put(x[f.name], marks[i], rest[1:], f.dataType.elementType) if rest and f.name == rest[0] else x[f.name]).alias(f.name) for f in schema]
                return F.struct(*fields, *([] if rest else [marks[i].alias(name)]))

            return F.transform(arr, one)

        # nondeterministic to the optimizer, which must not move the call into a lambda, where Python cannot run
        n = n.withColumn(mark, F.pandas_udf(_mask(len(u.path), u.func), kind).asNondeterministic()(value))
        if u.path:
            top = u.path[0]
            n = n.withColumn(top, put(F.col(top), F.col(mark), u.path[1:], n.schema[top].dataType.elementType)).drop(mark)
        preds.append(Pred(u.path, lambda r, m=mark: r[m]))
    return n, preds


def nested_filter(n: DataFrame, preds: Sequence[Pred | Udf] = (), project: Sequence[str] | None = None) -> DataFrame:
    """Surviving root records, arrays pruned; ``project`` are dotted field paths (default: all).

    One narrow stage without a shuffle: higher-order functions inside one
    projection. Predicates on the root are ordinary filters and are pushed
    to the scan. For a scan that reads no other leaves, read with
    ``narrow_schema``.
    """
    udfs = [p for p in preds if isinstance(p, Udf)]
    marked, extra = _with_masks(n, udfs)
    preds = by_layer([*[p for p in preds if isinstance(p, Pred)], *extra])
    cond = _survives(preds, (), Root())
    out = marked if cond is None else marked.where(cond)
    out = out.select(*_pruned(out.schema, Root(), preds, (), project))
    return _unmarked(out) if udfs else out


def _unmarked(n: DataFrame) -> DataFrame:
    """Drop what Python predicates stored in the records."""

    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(value, lambda x: F.struct(*[clean(x[f.name], f.dataType).alias(f.name) for f in kind.elementType if not f.name.startswith("__mask")]))
        return value

    return n.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in n.schema if not f.name.startswith("__mask")])


def flat_filter(n: DataFrame, preds: Sequence[Pred], path: Sequence[str], columns: Sequence[str], outer: bool = False) -> DataFrame:
    """Flat surviving rows of the layer at ``path``, with ``columns`` of it and of its ancestors.

    The arrays on the path are exploded one by one, each filtered first, so
    that Catalyst prunes nested leaves; other branches with predicates are
    tested by ``exists``. ``outer`` keeps records whose array at the end of
    the path is empty and bears no predicates.
    """
    preds, path = by_layer(list(preds)), tuple(path)
    out, record = n, Root()
    for depth in range(len(path) + 1):
        at = path[:depth]
        cond = _survives(list(preds), at, record, but=path[depth] if depth < len(path) else None)
        if cond is not None:
            out = out.where(cond)
        if depth < len(path):
            last = outer and depth == len(path) - 1 and path[depth] not in _below(list(preds), at)
            needed = [c for c in out.columns if c in columns]
            out = out.select(*needed, (F.inline_outer if last else F.inline)(F.col(path[depth])))
    return out.select(*columns)


def survivor_counts(n: DataFrame, preds: Sequence[Pred], layers: Sequence[Sequence[str]]) -> DataFrame:
    """``layer, n``: how many records survive at each of ``layers`` (paths; () is the root)."""
    out = nested_filter(n, preds)
    row = Root()

    def count(record: object, rest: tuple[str, ...]) -> Column:
        if not rest:
            return F.lit(1).cast("long")
        if len(rest) == 1:
            return F.size(record[rest[0]]).cast("long")
        return F.aggregate(record[rest[0]], F.lit(0).cast("long"), lambda acc, x: acc + count(x, rest[1:]))

    names = ["/".join(p) or "root" for p in layers]
    sums = out.agg(*[F.coalesce(F.sum(count(row, tuple(p))), F.lit(0)).alias(f"c{i}") for i, p in enumerate(layers)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(nm).alias("layer"), F.col(f"c{i}").alias("n")) for i, nm in enumerate(names)])).alias("x")).select("x.*")


def narrow_schema(schema: T.StructType, preds: Sequence[Pred | Udf], project: Sequence[str]) -> T.StructType:
    """The part of ``schema`` that the predicates and the projection need, for ``spark.read.schema``."""
    wanted = [*project, *[".".join([*p.path, f]) for p in preds for f in p.fields]]

    def take(struct: T.StructType, paths: Sequence[str] | None) -> T.StructType:
        out = []
        for f in struct:
            use, inner = _wanted(paths, f.name)
            if use:
                kind = f.dataType
                if inner is not None and isinstance(kind, T.ArrayType):
                    kind = T.ArrayType(take(kind.elementType, inner), kind.containsNull)
                out.append(T.StructField(f.name, kind, f.nullable, f.metadata))
        return T.StructType(out)

    return take(schema, wanted)
