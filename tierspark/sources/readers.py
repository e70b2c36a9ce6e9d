"""Readers: delimited text, Parquet with a narrow schema, files' metadata, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.nest import arrays


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", empty_is_null: bool = True) -> DataFrame:
    """Typed records from delimited lines, by position; a trailing separator and missing trailing fields are fine."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", "false").option("enforceSchema", "true")
    if empty_is_null:
        reader = reader.option("nullValue", "")
    else:
        reader = reader.option("nullValue", "\0").option("emptyValue", "")
    return reader.csv(path)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def columnar(spark: SparkSession, path: str, schema: T.StructType | None = None, recursive: bool = False, verify: bool = False) -> DataFrame:
    """Parquet; with a narrower ``schema`` only its leaves are read, matched by name.

    A field that the files lack is an error, as columns have no defaults.
    ``verify``: the checksums of pages are compared as they are read.
    """
    reader = spark.read
    if verify:
        reader = reader.option("parquet.page.verify-checksum.enabled", "true")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if schema is None:
        return reader.parquet(path)
    _check(reader.parquet(path).schema, schema, "")
    return reader.schema(schema).parquet(path)


def _check(have: T.DataType, want: T.DataType, at: str) -> None:
    if isinstance(want, T.ArrayType):
        _check(have.elementType, want.elementType, f"{at}[]")
    elif isinstance(want, T.StructType):
        names = {f.name: f for f in have}
        for f in want:
            if f.name not in names:
                raise ValueError(f"no such column: {at}{f.name}")
            _check(names[f.name].dataType, f.dataType, f"{at}{f.name}.")


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def decode_json(df: DataFrame, column: str, schema: T.StructType | str, out: str) -> DataFrame:
    return df.withColumn(out, F.from_json(column, schema))


def metadata(df: DataFrame) -> dict[str, dict]:
    """User metadata by column."""
    return {f.name: dict(f.metadata) for f in df.schema}


def root_columns(df: DataFrame) -> list[str]:
    """Columns that are not arrays of records."""
    nested = arrays(df.schema)
    return [c for c in df.columns if c not in nested]


def header(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of each leaf, arrays and records dotted."""

    def leaves(kind: T.DataType, at: str, null: bool):
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from leaves(f.dataType, f"{at}.{f.name}" if at else f.name, f.nullable)
        elif isinstance(kind, T.ArrayType):
            yield from leaves(kind.elementType, f"{at}[]", kind.containsNull)
        else:
            yield at, kind.simpleString(), null

    return list(leaves(df.schema, "", True))


def files(df: DataFrame) -> DataFrame:
    """``path, size, rows`` of the files behind a table."""
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).groupBy("path", "size").agg(F.count("*").alias("rows"))


def warm_up(df: DataFrame, *columns: str) -> None:
    """Read columns and throw them away, to measure the scan."""
    df.select(*columns).write.format("noop").mode("overwrite").save()


def batches(df: DataFrame, size: int = 100_000):
    """Records to the driver in batches, one partition at a time."""
    from ..operators.runs import top_batches

    return top_batches(df, size)
