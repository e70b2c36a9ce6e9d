"""Record values: resolution of schemas, validation, hashing, JSON, inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: To which types each type may be promoted.
PROMOTIONS = {"integer": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("binary",), "binary": ("string",)}
_UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def resolve(df: DataFrame, reader: T.StructType) -> DataFrame:
    """Written rows as the reader's schema has them, at every depth.

    Fields match by name, then by the reader's aliases; types are promoted;
    a missing field takes its default, or null where it may be null, and is
    an error otherwise; fields that the reader lacks go. Records in records,
    arrays, maps and unions are resolved alike. A written value goes to the
    first branch of a read union that has its type, or else that it can be
    promoted to; a branch of a written union that the reader has no place
    for is an error when a row holds it.
    """
    return df.select(*_fields(df.schema, reader, lambda n: F.col(f"`{n}`"), ""))


def _fields(have: T.StructType, reader: T.StructType, get, at: str) -> list[Column]:
    written, out = {f.name: f for f in have}, []
    for f in reader:
        name = next((n for n in [f.name, *f.metadata.get("aliases", [])] if n in written), None)
        if name is None:
            if "default" not in f.metadata and not f.nullable:
                raise ValueError(f"no value and no default for {at}{f.name}")
            value = _literal(f.metadata.get("default"), f.dataType)
        else:
            value = _resolved(get(name), written[name].dataType, written[name].metadata, f.dataType, f.metadata, f"{at}{f.name}")
        out.append(value.alias(f.name, metadata=f.metadata))
    return out


def _literal(value: object, kind: T.DataType) -> Column:
    """A default, as JSON gives it, as a value of a type."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value.get(f.name, f.metadata.get("default")), f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*[c for k, v in value.items() for c in (F.lit(k), _literal(v, kind.valueType))]).cast(kind)
    if isinstance(kind, T.BinaryType) and isinstance(value, str):
        value = value.encode("latin-1")  # one byte a character
    return F.lit(value).cast(kind)


def _fits(have: T.DataType, want: T.DataType) -> int:
    """2 where a type is another, 1 where it can become it, 0 otherwise."""
    if have.typeName() == want.typeName():
        return 2
    return int(want.typeName() in PROMOTIONS.get(have.typeName(), ()))


def _place(have: T.DataType, branches: T.StructType) -> int | None:
    """The branch of a union for a type."""
    fits = [_fits(have, f.dataType) for f in branches]
    return fits.index(max(fits)) if fits and max(fits) else None


def _refused(col: Column, want: T.DataType, why: str) -> Column:
    """Null for null; any other value is an error."""
    return F.when(col.isNull(), F.lit(None).cast(want)).otherwise(F.raise_error(F.lit(why)).cast(want))


def _resolved(col: Column, have: T.DataType, wrote: Mapping, want: T.DataType, meta: Mapping, at: str) -> Column:
    if "union" in wrote and isinstance(have, T.StructType):
        return _from_union(col, have, want, meta, at)
    if "union" in meta and isinstance(want, T.StructType):
        i = _place(have, want)
        if i is None:
            raise TypeError(f"{at}: no branch for {have.simpleString()}")
        made = _resolved(col, have, wrote, want[i].dataType, want[i].metadata, at)
        return F.when(col.isNotNull(), F.struct(*[(made if k == i else F.lit(None).cast(f.dataType)).alias(f.name) for k, f in enumerate(want)]))
    if "symbols" in meta:
        known = F.array(*[F.lit(s) for s in meta["symbols"]])
        return F.when(col.isNull() | F.array_contains(known, col), col).otherwise(F.raise_error(F.concat(F.lit("unknown symbol "), col)).cast("string"))
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        return F.when(col.isNotNull(), F.struct(*_fields(have, want, lambda n: col[n], f"{at}.")))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(col, lambda x: _resolved(x, have.elementType, {}, want.elementType, {}, f"{at}[]"))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        return F.transform_values(col, lambda _, v: _resolved(v, have.valueType, {}, want.valueType, {}, f"{at}{{}}"))
    if not _fits(have, want):
        raise TypeError(f"{at}: {have.simpleString()} cannot become {want.simpleString()}")
    return col.cast(want)


def _from_union(col: Column, have: T.StructType, want: T.DataType, meta: Mapping, at: str) -> Column:
    """The branch that a written union holds, as a read type or union."""
    if "union" in meta and isinstance(want, T.StructType):
        places = [_place(f.dataType, want) for f in have]
        made = []
        for k, target in enumerate(want):
            from_here = [_resolved(col[f.name], f.dataType, f.metadata, target.dataType, target.metadata, at) for f, p in zip(have, places, strict=True) if p == k]
            made.append((F.coalesce(*from_here) if from_here else F.lit(None).cast(target.dataType)).alias(target.name))
        lost = [_refused(col[f.name], T.BooleanType(), f"{at}: no branch for {f.dataType.simpleString()}") for f, p in zip(have, places, strict=True) if p is None]
        out = F.when(col.isNotNull(), F.struct(*made))
        return F.when(F.coalesce(*lost), F.lit(None)).otherwise(out) if lost else out
    taken = []
    for f in have:
        if _fits(f.dataType, want):
            taken.append(_resolved(col[f.name], f.dataType, f.metadata, want, meta, at))
        else:
            taken.append(_refused(col[f.name], want, f"{at}: {f.dataType.simpleString()} cannot become {want.simpleString()}"))
    return F.coalesce(*taken)


def validate(schema: T.StructType, row: object = None) -> Column:
    """Whether a row holds what the schema asks for: no null where none may be, symbols, fixed sizes, uuids."""
    get = (lambda n: F.col(f"`{n}`")) if row is None else (lambda n: row[n])
    out = F.lit(True)
    for f in schema:
        out = out & _valid(get(f.name), f.dataType, f.nullable, f.metadata)
    return F.coalesce(out, F.lit(False))


def _valid(col: Column, kind: T.DataType, nullable: bool, meta: Mapping) -> Column:
    ok = F.lit(True)
    if "symbols" in meta:
        ok = F.array_contains(F.array(*[F.lit(s) for s in meta["symbols"]]), col)
    elif "size" in meta:
        ok = F.length(col) == meta["size"]
    elif meta.get("logicalType") == "uuid":
        ok = col.rlike(_UUID)
    elif isinstance(kind, T.StructType):
        ok = validate(kind, col)
    elif isinstance(kind, T.ArrayType):
        ok = F.forall(col, lambda x: _valid(x, kind.elementType, kind.containsNull, {}))
    elif isinstance(kind, T.MapType):
        ok = F.forall(F.map_values(col), lambda x: _valid(x, kind.valueType, kind.valueContainsNull, {}))
    return F.when(col.isNull(), F.lit(nullable)).otherwise(ok)


def record_hash(df: DataFrame, order: Mapping[str, str] | None = None) -> Column:
    """A 64-bit hash of the fields that count in comparison."""
    used = [f.name for f in df.schema if (order or {}).get(f.name, f.metadata.get("order")) != "ignore"]
    return F.xxhash64(*[F.col(f"`{c}`") for c in used])


def hash_128(*columns: str | Column, seed: int = 0) -> tuple[Column, Column]:
    """Two independent 64-bit halves of a hash; equal values of different types hash apart."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(F.lit(2 * seed), *cols), F.xxhash64(F.lit(2 * seed + 1), *cols)


def to_json(df: DataFrame, columns: Sequence[str] | None = None, out: str = "json") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct(*(columns or df.columns))))


def from_json(col: str, schema: T.StructType | str) -> Column:
    return F.from_json(col, schema)


def induce(value: object) -> T.DataType:
    """The type of a Python value; arrays must have one type, and empty collections have none."""
    if isinstance(value, Mapping):
        if not value:
            raise ValueError("an empty record has no schema")
        return T.StructType([T.StructField(k, induce(v), v is None) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        kinds = [induce(v) for v in value]
        if not kinds:
            raise ValueError("an empty array has no schema")
        if any(k != kinds[0] for k in kinds):
            raise TypeError("an array of several types")
        return T.ArrayType(kinds[0], False)
    for kind, spark in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType())):
        if isinstance(value, kind):
            return spark
    if value is None:
        return T.NullType()
    raise TypeError(type(value).__name__)


def group(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Pack columns into one struct column, and the others before it."""
    return df.select(*[c for c in df.columns if c not in columns], F.struct(*columns).alias(name, metadata={"group": True}))


def ungroup(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], f"{name}.*")


def union_branch(col: Column, schema: T.StructType) -> Column:
    """Which branch of a union struct holds a value, from 0; null for none."""
    out = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(schema))):
        out = F.when(col[f.name].isNotNull(), F.lit(i)).otherwise(out)
    return out


def array_set(col: Column, at: int, value: Column) -> Column:
    """The array with the element at ``at`` (from 0) replaced."""
    return F.transform(col, lambda x, i: F.when(i == at, value).otherwise(x))


def array_remove_at(col: Column, at: int) -> Column:
    return F.filter(col, lambda x, i: i != at)


def array_append(col: Column, value: Column) -> Column:
    return F.concat(col, F.array(value))


def array_peek(col: Column, at: int = 0) -> Column:
    """The element at ``at`` (from 0); null behind the end."""
    return F.get(col, F.lit(at))


def array_reverse(col: Column) -> Column:
    return F.reverse(col)


def array_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: arrays compare element by element, a shorter one before its continuations."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def shred_map(df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """A map as rows ``key, value``."""
    return df.select(*keep, F.explode(name).alias("key", "value"))


def key_text(df: DataFrame, columns: Sequence[str], out: str = "key_text") -> DataFrame:
    """A key record as text, which ``from_json`` restores."""
    return df.withColumn(out, F.to_json(F.struct(*columns)))


def parse_typed(col: Column, kind: T.DataType) -> Column:
    """Text as a typed value; an empty text is null, and so is what cannot be read."""
    return F.when(col == "", None).otherwise(col).try_cast(kind)
