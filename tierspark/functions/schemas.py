"""Record schemas in JSON, and Spark types."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Primitive and logical type names of the JSON dialect, and the Spark types for them.
PRIMITIVE = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}
LOGICAL = {"date": T.DateType(), "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType(), "uuid": T.StringType()}


class Conversion:
    """How a logical type that users define is stored and read.

    ``spark`` is the stored type; ``read`` and ``write`` turn a stored value
    into a logical one and back, as expressions on columns.
    """

    def __init__(self, name: str, spark: T.DataType, read: Callable[[Column], Column] = lambda c: c, write: Callable[[Column], Column] = lambda c: c):
        self.name, self.spark, self.read, self.write = name, spark, read, write


#: Conversions that users have registered, by the name of the logical type.
CONVERSIONS: dict[str, Conversion] = {}


def register(conversion: Conversion) -> None:
    """Schemas that are parsed from now on know the logical type."""
    if conversion.name in LOGICAL or conversion.name in ("decimal", "time-millis", "time-micros"):
        raise ValueError(f"{conversion.name} is built in")
    CONVERSIONS[conversion.name] = conversion


def converted(df: DataFrame, schema: T.StructType, write: bool = False) -> DataFrame:
    """Columns of registered logical types as logical values, or (``write``) as stored ones; others as they are."""
    out = []
    for f in schema:
        how = CONVERSIONS.get(f.metadata.get("logicalType"))
        col = F.col(f"`{f.name}`")
        out.append(col if how is None else (how.write if write else how.read)(col).alias(f.name))
    return df.select(*out)


def record(name: str, fields: Sequence[Mapping], group: bool = False) -> dict:
    """Builders: the parts of a schema, to be put together and parsed."""
    return {"type": "group" if group else "record", "name": name, "fields": list(fields)}


def field(name: str, kind: object, **more: object) -> dict:
    """A field; ``more`` are default, aliases and order."""
    return {"name": name, "type": kind, **more}


def enum(name: str, *symbols: str) -> dict:
    return {"type": "enum", "name": name, "symbols": list(symbols)}


def array(items: object) -> dict:
    return {"type": "array", "items": items}


def mapping(values: object) -> dict:
    return {"type": "map", "values": values}


def fixed(name: str, size: int) -> dict:
    return {"type": "fixed", "name": name, "size": size}


def union(*branches: object) -> list:
    if len(branches) > 32:
        raise ValueError("more than 32 branches")
    return list(branches)


def logical(kind: str, name: str, **more: object) -> dict:
    return {"type": kind, "logicalType": name, **more}


def _time(precision: int) -> T.DataType:
    """Times of day; sessions have to set ``spark.sql.timeType.enabled`` where that is off."""
    return T.TimeType(precision) if hasattr(T, "TimeType") else T.LongType()


def parse(text: str | Mapping) -> T.StructType:
    """A record (or group) schema as a StructType.

    ``[null, T]`` is nullable T; other unions are structs with a field per
    branch (``member0`` ...). Enum symbols, fixed sizes, sort orders,
    defaults, aliases and union branches stay in the fields' metadata. Named
    types may be used again by name, but not within themselves.
    """
    spec = json.loads(text) if isinstance(text, str) else text
    kind, _, _ = _type(spec, {}, ())
    if not isinstance(kind, T.StructType):
        raise ValueError("not a record")
    return kind


def _type(spec: object, named: dict[str, object], inside: tuple[str, ...]) -> tuple[T.DataType, bool, dict]:
    """Type, whether null is in it, and metadata."""
    if isinstance(spec, list):
        branches = [s for s in spec if s != "null"]
        if len(branches) == 1:
            kind, _, meta = _type(branches[0], named, inside)
            return kind, len(branches) < len(spec), meta
        if len(spec) > 32:
            raise ValueError("more than 32 branches")
        kinds = [_type(b, named, inside) for b in branches]
        fields = [T.StructField(f"member{i}", k, True, m) for i, (k, _, m) in enumerate(kinds)]
        return T.StructType(fields), True, {"union": [b if isinstance(b, str) else b.get("type") for b in spec]}
    if isinstance(spec, str):
        if spec in PRIMITIVE:
            return PRIMITIVE[spec], spec == "null", {}
        if spec in inside:
            raise ValueError(f"recursive schema: {spec}")
        if spec in named:
            return _type(named[spec], named, inside)
        raise ValueError(f"no such type: {spec}")
    what = spec["type"]
    logical = spec.get("logicalType")
    if logical == "decimal":
        precision, scale = spec["precision"], spec.get("scale", 0)
        if not 0 < precision <= 38 or not 0 <= scale <= precision:
            raise ValueError(f"decimal({precision},{scale}) is out of range")
        return T.DecimalType(precision, scale), False, {}
    if logical in ("time-millis", "time-micros"):
        return _time(3 if logical == "time-millis" else 6), False, {"logicalType": logical}
    if logical in CONVERSIONS:
        return CONVERSIONS[logical].spark, False, {"logicalType": logical, "stored": what}
    if logical in LOGICAL:
        return LOGICAL[logical], False, {"logicalType": logical}
    if what in ("record", "group", "error"):
        name = spec.get("name", "")
        named[name] = spec
        fields = []
        for f in spec["fields"]:
            kind, null, meta = _type(f["type"], named, (*inside, name))
            meta = {**meta, **{k: f[k] for k in ("order", "aliases", "default") if k in f}}
            fields.append(T.StructField(f["name"], kind, null, meta))
        return T.StructType(fields), False, {"group": True} if what == "group" else {}
    if what == "enum":
        named[spec.get("name", "")] = spec
        return T.StringType(), False, {"symbols": list(spec["symbols"])}
    if what == "fixed":
        named[spec.get("name", "")] = spec
        return T.BinaryType(), False, {"size": spec["size"]}
    if what == "array":
        kind, null, _ = _type(spec["items"], named, inside)
        return T.ArrayType(kind, null), False, {}
    if what == "map":
        kind, null, _ = _type(spec["values"], named, inside)
        return T.MapType(T.StringType(), kind, null), False, {}
    return _type(what, named, inside)


_NAMES = {"boolean": "boolean", "integer": "int", "long": "long", "float": "float", "double": "double", "string": "string", "binary": "bytes", "void": "null"}


def to_json(schema: T.StructType, name: str = "record") -> str:
    """A schema printed in the JSON dialect; groups keep the type ``group``."""
    return json.dumps(_spec(schema, {}, name))


def _spec(kind: T.DataType, meta: Mapping, name: str) -> object:
    if "union" in meta and isinstance(kind, T.StructType):
        inner = [_spec(f.dataType, f.metadata, f"{name}_{f.name}") for f in kind]
        return (["null"] if "null" in meta["union"] else []) + inner
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind:
            spec = _spec(f.dataType, f.metadata, f"{name}_{f.name}")
            if f.nullable and not isinstance(spec, list) and spec != "null":
                spec = ["null", spec]
            fields.append({"name": f.name, "type": spec, **{k: f.metadata[k] for k in ("order", "aliases", "default") if k in f.metadata}})
        return {"type": "group" if meta.get("group") else "record", "name": name, "fields": fields}
    if isinstance(kind, T.ArrayType):
        inner = _spec(kind.elementType, {}, f"{name}_item")
        return {"type": "array", "items": ["null", inner] if kind.containsNull else inner}
    if isinstance(kind, T.MapType):
        inner = _spec(kind.valueType, {}, f"{name}_value")
        return {"type": "map", "values": ["null", inner] if kind.valueContainsNull else inner}
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    if isinstance(kind, T.DateType):
        return {"type": "int", "logicalType": "date"}
    if "stored" in meta:
        return {"type": meta["stored"], "logicalType": meta["logicalType"]}
    if "logicalType" in meta:
        return {"type": "int" if meta["logicalType"] == "time-millis" else "string" if meta["logicalType"] == "uuid" else "long", "logicalType": meta["logicalType"]}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "long", "logicalType": "timestamp-micros"}
    if "symbols" in meta:
        return {"type": "enum", "name": name, "symbols": list(meta["symbols"])}
    if "size" in meta:
        return {"type": "fixed", "name": name, "size": meta["size"]}
    return _NAMES[kind.typeName()]
