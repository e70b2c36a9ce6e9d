"""Lineage cuts and versions of tables on storage that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A session on one machine that names none gets a temporary folder; on a
    cluster that is an error, as executors do not see the driver's folders.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tierspark-"))
        found = context.getCheckpointDir()
    folder = f"{found}/tierspark-{context.applicationId}"
    _clean_at_exit(spark, folder)
    return folder


_watched: set[str] = set()


def _clean_at_exit(spark: SparkSession, folder: str) -> None:
    """What a session has stored goes with it."""
    if folder not in _watched:
        _watched.add(folder)

        def clean() -> None:
            if spark.sparkContext._jsc is not None:
                delete(spark, folder)

        atexit.register(clean)


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any store that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    Unlike a cache, the written table survives the loss of any executor. It
    goes with the session, or before that by ``discard``.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing that reads it is still to run."""
    if path := getattr(df, "_stored_at", None):
        delete(df.sparkSession, path)


class Versions:
    """A table as a folder of numbered versions, with a small table that tells which there are.

    ``kind`` is ``base`` (the whole table) or ``delta`` (changes since the
    version before). A version is named in the list only when it is written,
    so a reader never sees half of one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def at(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number}"

    def known(self) -> list[tuple[int, str, int]]:
        """``number, kind, next_seq`` in order; one entry a version."""
        rows = self.spark.read.parquet(f"{self.path}/_list").groupBy("number", "kind").agg(F.max("next_seq").alias("next_seq")).collect()
        return sorted((r.number, r.kind, r.next_seq) for r in rows)

    def _put(self, rows: list[tuple[int, str, int]], mode: str) -> None:
        made = F.array(*[F.struct(F.lit(n).cast("long").alias("number"), F.lit(k).alias("kind"), F.lit(s).cast("long").alias("next_seq")) for n, k, s in rows])
        self.spark.range(1).select(F.explode(made).alias("r")).select("r.*").coalesce(1).write.mode(mode).parquet(f"{self.path}/_list")

    def write(self, df: DataFrame, number: int, kind: str = "base", next_seq: int = 0, first: bool = False) -> None:
        df.write.mode("overwrite").parquet(self.at(kind, number))
        self.announce(number, kind, next_seq, first)

    def announce(self, number: int, kind: str, next_seq: int, first: bool = False) -> None:
        self._put([(number, kind, next_seq)], "overwrite" if first else "append")

    def base(self, before: int | None = None) -> int:
        """The newest whole version; ``before``: of those with a smaller number."""
        return max(n for n, kind, _ in self.known() if kind == "base" and (before is None or n < before))

    def read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.parquet(self.at(kind, number))

    def expire(self, keep: int) -> None:
        """Delete all that the ``keep`` newest whole versions do not need."""
        known = self.known()
        bases = sorted(n for n, kind, _ in known if kind == "base")[-keep:]
        for n, kind, _ in known:
            if n < bases[0] or (kind == "delta" and n == bases[0]):
                delete(self.spark, self.at(kind, n))
