"""Writers: nested Parquet, sorted Parquet, appends, metadata, compression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codecs that the Parquet writer has.
CODECS = ["none", "snappy", "gzip", "zstd", "lz4"]
_RESERVED = "spark."


def add_codec(name: str) -> None:
    """Accept another codec of the Parquet writer, for which the cluster has the library (brotli, lzo ...)."""
    if name not in CODECS:
        CODECS.append(name)


def write(df: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd", records_per_file: int = 0, checksum: bool = True, bloom: Sequence[str] = ()) -> None:
    """Parquet, with page checksums and, for key columns, Bloom filters."""
    if codec not in CODECS:
        raise ValueError(f"no such codec: {codec}")
    out = df.write.mode(mode).option("compression", codec).option("parquet.page.write-checksum.enabled", str(checksum).lower())
    if records_per_file:
        out = out.option("maxRecordsPerFile", records_per_file)
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], **how) -> None:
    """Range-partitioned and sorted by key, so that files and row groups have narrow key ranges."""
    write(df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys), path, **how)


def append(df: DataFrame, path: str, **how) -> None:
    write(df, path, mode="append", **how)


def concatenate(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of tables whose schemas are equal."""
    if a.schema != b.schema:
        raise ValueError("schemas differ")
    return a.unionByName(b)


def with_metadata(df: DataFrame, column: str, **values: object) -> DataFrame:
    """User metadata on a column, kept in Parquet; some keys are reserved."""
    if any(k.startswith(_RESERVED) for k in values):
        raise ValueError(f"keys that begin with {_RESERVED} are reserved")
    old = dict(df.schema[column].metadata)
    return df.select(*[F.col(c).alias(c, metadata={**old, **values}) if c == column else F.col(c) for c in df.columns])


def with_guards(n: DataFrame, array: str, bounds: Mapping[str, str]) -> DataFrame:
    """Top-level min and max of array fields (``field -> prefix``), which a scan can skip row groups by."""
    out = n
    for name, prefix in bounds.items():
        values = F.col(f"{array}.{name}")
        out = out.withColumn(f"{prefix}_min", F.array_min(values)).withColumn(f"{prefix}_max", F.array_max(values))
    return out
