"""The same filters on flat layers, before nesting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layers import Layer
from ..operators.nest import nest_all
from .nested_filter import _mask, nested_filter
from .predicate import Pred, Root, Udf


def filter_layers(layer: Layer, preds: Sequence[Pred | Udf], path: tuple[str, ...] = ()) -> Layer:
    """The layers reduced to survivors, so that ``nest_all`` gives what ``nested_filter`` gives after nesting.

    Predicates reach the scans of their layers, if the layers' tables are
    plain scans (a key numbered on the fly keeps them above it). A parent of a layer that
    bears predicates, itself or below, is semi-joined with its surviving
    children; children of parents that went drop out of the nest join. For
    tables that are not stored nested, this moves far less data than nesting
    everything first.
    """
    df, children = layer.df, []
    for p in preds:
        if p.path == path:
            df = df.where(F.pandas_udf(_mask(0, p.func), "boolean")(p.field) if isinstance(p, Udf) else p.on(Root()))
    for child in layer.children:
        below = (*path, child.array)
        kept = filter_layers(child, preds, below)
        children.append(kept)
        if any(p.path[: len(below)] == below for p in preds):
            keys = kept.df.select(*[F.col(c).alias(k) for c, k in zip(kept.fk, layer.pk, strict=True)])
            df = df.join(keys, list(layer.pk), "left_semi").select(*layer.df.columns)
    return replace(layer, df=df, children=children)


def prune_layers(layer: Layer, project: Sequence[str], preds: Sequence[Pred] = (), path: tuple[str, ...] = ()) -> Layer:
    """The layers with only their keys, the projected columns (dotted paths) and what predicates read.

    Columns inside collected structs are not pruned by the optimizer, so
    this is done before nesting.
    """
    at = ".".join(path) + "." if path else ""
    below = [c.array for c in layer.children]
    wanted = [p[len(at) :] for p in project if p.startswith(at) and "." not in p[len(at) :] and p[len(at) :] not in below]
    wanted += [f for p in preds if p.path == path for f in p.fields]
    used = [c for c in layer.df.columns if c in wanted or c in layer.pk or c in layer.fk]
    children = [prune_layers(c, project, preds, (*path, c.array)) for c in layer.children]
    return replace(layer, df=layer.df.select(*used), children=children)


def filtered(source: Layer | DataFrame, preds: Sequence[Pred | Udf], project: Sequence[str] | None = None) -> DataFrame:
    """Surviving nested records, by the plan that the shape of the source asks for.

    Flat layers are pruned and filtered before they are nested, so that
    predicates reach each table's scan; a table that is stored nested is
    filtered in place, without a shuffle.
    """
    if isinstance(source, DataFrame):
        return nested_filter(source, preds, project)
    pruned = source if project is None else prune_layers(source, project, preds)
    return nest_all(filter_layers(pruned, preds))
