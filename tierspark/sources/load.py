"""Bulk loads: text or tables to sorted, stored layers, and to one stored nested table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.layers import Layer, with_surrogate
from ..operators.nest import nest_all
from .readers import delimited
from .writers import write_sorted


def load_layer(layer: Layer, path: str) -> Layer:
    """Store one layer, sorted by its key, with Bloom filters on the key; the layer as it is stored.

    Queries on it push predicates to plain scans, whatever ``layer.df`` was.
    """
    write_sorted(layer.df, path, layer.pk, bloom=layer.pk)
    return replace(layer, df=layer.df.sparkSession.read.parquet(path))


def load_layers(root: Layer, path: str) -> Layer:
    """Store every layer of a tree, each in a folder by its name."""
    out = load_layer(root, f"{path}/{root.name}")
    return replace(out, children=[load_layers(c, path) for c in root.children])


def load_nested(root: Layer, path: str) -> DataFrame:
    """Nest a tree and store it, sorted by the root's key."""
    write_sorted(nest_all(root), path, root.pk, bloom=root.pk)
    return root.df.sparkSession.read.parquet(path)


def load_text(spark: SparkSession, path: str, root: Layer, files: Mapping[str, str], schemas: Mapping[str, T.StructType], sep: str = "|") -> DataFrame:
    """Delimited text files, one for each layer, to one stored nested table.

    ``root`` gives names and keys of the layers; their tables are not used.
    """

    def filled(layer: Layer) -> Layer:
        schema = schemas[layer.name]
        tail = T.StructType([*schema.fields, T.StructField("__end", T.StringType())])  # behind a trailing separator
        return replace(layer, df=delimited(spark, files[layer.name], tail, sep).select(*schema.fieldNames()), children=[filled(c) for c in layer.children])

    return load_nested(filled(root), path)


def keyed(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows with a surrogate key, to be made once, at load."""
    return with_surrogate(df, within, order, name)
