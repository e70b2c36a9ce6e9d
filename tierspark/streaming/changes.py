"""A stream of changes applied to a stored layer, batch by batch."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import Layer
from ..operators.mutate import apply_changes
from .storage import Versions


class StreamedLayer:
    """A layer as a whole version and the changes since, which readers fold in.

    Each batch of changes is written as it comes, so its cost is that of the
    batch. After ``compact`` batches they are folded into a new whole
    version; all but the ``keep`` newest of these, and the changes they hold,
    are deleted. A version is named by its batch, so a batch that runs again
    after a failure overwrites its own files.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, pk: tuple[str, ...], compact: int = 16, keep: int = 2):
        self.spark, self.name, self.pk = spark, name, pk
        self.compact, self.keep = compact, keep
        self.versions = Versions(spark, path)
        self.path = path

    def create(self, df: DataFrame) -> None:
        self.versions.write(df, -1, first=True)

    def newest(self) -> int:
        return max(n for n, _, _ in self.versions.known())

    def read(self, number: int | None = None) -> DataFrame:
        """The layer after batch ``number`` (default: the last)."""
        known = self.versions.known()
        last = max(n for n, _, _ in known) if number is None else number
        whole = max(n for n, kind, _ in known if kind == "base" and n <= last)
        base = self.versions.read("base", whole)
        deltas = [n for n, kind, _ in known if kind == "delta" and whole < n <= last]
        if not deltas:
            return base
        log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.versions.read("delta", n) for n in deltas])
        return apply_changes(Layer(self.name, base, self.pk), {self.name: log}).df

    def apply(self, changes: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: changes have ``op, seq`` and the layer's columns; later batches come after earlier ones."""
        known = self.versions.known()
        if any(n == batch and kind == "base" for n, kind, _ in known):
            return  # it ran to its end before
        before = [x for x in known if x[0] < batch]
        start = max(s for _, _, s in before)
        path = self.versions.at("delta", batch)
        low, high = changes.agg(F.min("seq"), F.max("seq")).first()
        if low is None:
            low, high = 0, -1
        changes.withColumn("seq", (F.col("seq") - low + start).cast("long")).write.mode("overwrite").parquet(path)
        self.versions.announce(batch, "delta", start + high - low + 1)
        whole = max(n for n, kind, _ in before if kind == "base")
        if sum(kind == "delta" and n > whole for n, kind, _ in before) + 1 >= self.compact:
            self.versions.write(self.read(batch), batch, next_seq=start + high - low + 1)
            self.versions.expire(self.keep)

    def follow(self, stream: DataFrame, checkpoint: str | None = None):
        """Start the query over a stream of changes."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint or f"{self.path}/_progress-{uuid.uuid4().hex}").trigger(availableNow=True).start()
