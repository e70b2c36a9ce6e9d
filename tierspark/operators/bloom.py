"""Existence gates in front of a join: Bloom filters as DataFrame expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import hash_128

#: False positives of a gate, as a share; bits of a filter at most (it travels with every task).
FPP, MOST_BITS = 0.01, 1 << 27


def sizing(items: int, fpp: float = FPP) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for so many items."""
    bits = max(64, math.ceil(-items * math.log(fpp) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, items) * math.log(2)))


class Bloom:
    """A Bloom filter over key columns; no false negatives.

    ``items`` sizes it. More keys than that make more false positives and
    nothing else. The filter is an array of 64-bit words, made by one
    aggregation whose result, of at most ``MOST_BITS``, is a scalar of the
    plans that probe it.
    """

    def __init__(self, keys: DataFrame, columns: str | tuple[str, ...], items: int, fpp: float = FPP):
        self.columns = (columns,) if isinstance(columns, str) else tuple(columns)
        self._words: list[int] | None = None
        self.bits, self.hashes = sizing(items, fpp)
        if self.bits > MOST_BITS:
            raise ValueError(f"a filter of {self.bits} bits is too large to send to every task")
        self.kinds = [f.dataType for f in keys.select(*self.columns).schema]
        at = F.explode(F.array(*self._places([F.col(c) for c in self.columns])))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("at"), F.lit(64)).cast("int"))
        masks = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("w"), one.alias("m"))
        empty = keys.sparkSession.range(-(-self.bits // 64)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("m"))
        words = masks.union(empty).groupBy("w").agg(F.bit_or("m").alias("m"))
        self.table = words.agg(F.array_sort(F.collect_list(F.struct("w", "m")))["m"].alias("words"))  # of a fixed size

    def _places(self, values: list[Column]) -> list[Column]:
        a, b = (F.pmod(h, F.lit(self.bits).cast("long")) for h in hash_128(*values))
        return [F.pmod(a + F.lit(i) * b, F.lit(self.bits).cast("long")) for i in range(self.hashes)]

    def gate(self, *columns: str | Column) -> Column:
        """Whether a row's key may be in the filter, as a condition to filter by."""
        values = [F.col(c) if isinstance(c, str) else c for c in columns or self.columns]
        words = self.table.scalar()
        hit = lambda at: F.call_function("shiftright", F.get(words, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return reduce(lambda x, y: x & y, [hit(at) for at in self._places(values)])

    def might_contain(self, value: object) -> bool:
        """Whether one key may be in the filter, whose words come to the driver once."""
        if self._words is None:
            self._words = self.table.first().words
        key = value if isinstance(value, tuple) else (value,)
        given = [F.lit(v).cast(k) for v, k in zip(key, self.kinds, strict=True)]
        places = self.table.sparkSession.sql("SELECT 1 AS x").select(F.array(*self._places(given)).alias("at")).first()["at"]
        return all(self._words[at >> 6] >> (at & 63) & 1 for at in places)


def gated_semi_join(probe: DataFrame, keys: DataFrame, column: str, items: int, fpp: float = FPP) -> DataFrame:
    """Rows of ``probe`` whose key is in ``keys``: a Bloom filter of the keys, and a join of what passes it.

    The filter goes over the scan of ``probe``, so that only rows of the keys
    and a share ``fpp`` of the others are shuffled; the join is exact.
    ``items`` is about the number of keys.
    """
    gate = Bloom(keys, column, items, fpp)
    return probe.where(gate.gate(column)).join(keys.select(column).distinct(), column, "left_semi")


def parquet_bloom_options(*columns: str) -> dict[str, str]:
    """Write options for Bloom filters in Parquet column chunks."""
    return {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
