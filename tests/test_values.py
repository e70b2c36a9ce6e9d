"""Schemas, resolution, validation and values."""

import datetime as dt
import decimal
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierspark.functions import records, schemas


def record(*fields):
    return schemas.parse({"type": "record", "name": "r", "fields": list(fields)})


def test_parse_and_print():
    kind = record(
        {"name": "id", "type": "int", "order": "ignore"},
        {"name": "g", "type": {"type": "group", "name": "g", "fields": [{"name": "b", "type": "bytes"}]}},
        {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["LOW", "MEDIUM", "HIGH"]}},
        {"name": "f", "type": {"type": "fixed", "name": "f", "size": 4}},
        {"name": "m", "type": {"type": "map", "values": ["null", "int"]}},
        {"name": "a", "type": {"type": "array", "items": "string"}},
        {"name": "n", "type": ["null", "double"]},
        {"name": "u", "type": ["int", "string"]},
        {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}},
        {"name": "t", "type": {"type": "long", "logicalType": "timestamp-micros"}},
    )
    assert kind["n"].nullable and not kind["id"].nullable
    assert kind["g"].metadata["group"] and kind["e"].metadata["symbols"][1] == "MEDIUM"
    assert kind["d"].dataType == T.DecimalType(9, 2) and kind["m"].dataType.valueContainsNull
    again = schemas.parse(schemas.to_json(kind))
    assert again.fieldNames() == kind.fieldNames() and [f.dataType for f in again] == [f.dataType for f in kind]
    assert '"type": "group"' in schemas.to_json(kind)


def test_bad_schemas():
    for bad in (
        {"type": "record", "name": "r", "fields": [{"name": "r", "type": "r"}]},
        {"type": "record", "name": "r", "fields": [{"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 39}}]},
        {"type": "record", "name": "r", "fields": [{"name": "d", "type": "nope"}]},
    ):
        with pytest.raises(ValueError):
            schemas.parse(json.dumps(bad))


def test_resolution(spark):
    df = spark.createDataFrame([(1, "x", 2)], "a int, s string, gone int")
    out = records.resolve(df, record({"name": "b", "type": "double", "aliases": ["a"]}, {"name": "s", "type": "bytes"}, {"name": "new", "type": "long", "default": 7}))
    assert tuple(out.first()) == (1.0, bytearray(b"x"), 7)
    with pytest.raises(ValueError):
        records.resolve(df, record({"name": "new", "type": "long"}))
    with pytest.raises(TypeError):
        records.resolve(df, record({"name": "s", "type": "int"}))
    enum = record({"name": "s", "type": {"type": "enum", "name": "e", "symbols": ["y"]}})
    with pytest.raises(Exception, match="unknown symbol"):
        records.resolve(df, enum).collect()


def test_validation(spark):
    kind = record(
        {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["A"]}},
        {"name": "f", "type": {"type": "fixed", "name": "f", "size": 2}},
        {"name": "u", "type": ["null", {"type": "string", "logicalType": "uuid"}]},
        {"name": "l", "type": {"type": "array", "items": "int"}},
    )
    good = ("A", b"12", "123e4567-e89b-12d3-a456-426614174000", [1])
    rows = [good, ("B", *good[1:]), (good[0], b"123", *good[2:]), (*good[:2], "no", good[3]), (*good[:2], None, good[3]), (None, *good[1:]), (*good[:3], [1, None])]
    df = spark.createDataFrame(rows, "e string, f binary, u string, l array<int>")
    assert [r[0] for r in df.select(records.validate(kind)).collect()] == [True, False, False, False, True, False, False]


def test_values(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 2), decimal.Decimal("1.25"))], "i int, d date, m decimal(9,2)")
    text = records.to_json(df).first().json
    assert json.loads(text) == {"i": 1, "d": "2020-01-02", "m": 1.25}
    back = spark.createDataFrame([(text,)], "j string").select(records.from_json("j", df.schema).alias("r")).select("r.*")
    assert tuple(back.first()) == tuple(df.first())
    assert records.ungroup(records.group(df, "g", ["i", "d"]), "g").columns == ["m", "i", "d"]
    a = df.select(F.array(F.lit(1), F.lit(2)).alias("a"))
    assert a.select(records.array_set(F.col("a"), 1, F.lit(9)), records.array_remove_at(F.col("a"), 0)).first()[:] == ([1, 9], [2])
    one, two = (spark.createDataFrame([(1, x)], "a int, b int") for x in (1, 2))
    hashes = [d.select(records.record_hash(d, {"b": "ignore"})).first()[0] for d in (one, two)]
    assert hashes[0] == hashes[1]
    parsed = spark.createDataFrame([("",), ("7",), ("x",)], "s string").select(records.parse_typed(F.col("s"), T.IntegerType()).alias("v")).collect()
    assert [r.v for r in parsed] == [None, 7, None]


def test_key_text_round_trip(spark):
    row = (1, [(0, [0, 1]), (1, [0, 1])])
    df = spark.createDataFrame([row], "ak int, bA array<struct<bk:int,cA:array<int>>>")
    text = records.key_text(df, df.columns)
    assert text.select(records.from_json("key_text", df.schema).alias("r")).select("r.*").first() == df.first()


def test_induce():
    kind = records.induce({"a": 1, "b": [1.5], "c": {"d": "x"}})
    assert kind["b"].dataType == T.ArrayType(T.DoubleType(), False) and kind["c"].dataType.fieldNames() == ["d"]
    for bad in ([], {}, [1, "x"], object()):
        with pytest.raises((ValueError, TypeError)):
            records.induce(bad)


def test_nested_records_resolve_by_name(spark):
    df = spark.createDataFrame([(1, Row(a=1, b=2), [Row(x=1, y="u")], {"k": Row(a=5, b=6)}), (2, None, None, None)], "id int, s struct<a:int,b:int>, r array<struct<x:int,y:string>>, m map<string,struct<a:int,b:int>>")
    inner = schemas.record("i", [schemas.field("b", "long"), schemas.field("c", ["null", "string"]), schemas.field("a", "double")])
    reader = schemas.parse(schemas.record("r", [
        schemas.field("m", ["null", schemas.mapping(inner)]), schemas.field("s", ["null", inner]),
        schemas.field("r", ["null", schemas.array(schemas.record("e", [schemas.field("z", "bytes", aliases=["y"]), schemas.field("w", schemas.array("int"), default=[7, 8]), schemas.field("x", "float")]))]),
        schemas.field("id", "long"), schemas.field("d", inner, default={"b": 1, "a": 2})]))
    one, two = records.resolve(df, reader).orderBy("id").collect()
    assert one.s == Row(b=2, c=None, a=1.0) and one.m == {"k": Row(b=6, c=None, a=5.0)} and one.r == [Row(z=bytearray(b"u"), w=[7, 8], x=1.0)]
    assert one.d == Row(b=1, c=None, a=2.0) and (two.s, two.r, two.m) == (None, None, None)
    with pytest.raises(ValueError, match="s.new"):
        records.resolve(df, schemas.parse(schemas.record("r", [schemas.field("s", schemas.record("i", [schemas.field("new", "int")]))])))
    with pytest.raises(TypeError, match="r\\[\\].x"):
        records.resolve(df, schemas.parse(schemas.record("r", [schemas.field("r", schemas.array(schemas.record("i", [schemas.field("x", "string")])))])))


def test_unions_resolve_branch_by_branch(spark):
    u = lambda *kinds: schemas.parse(schemas.record("r", [schemas.field("u", schemas.union(*kinds))]))
    plain = spark.createDataFrame([(1,), (None,)], "u int")
    assert [r.u for r in records.resolve(plain, u("string", "long")).collect()] == [Row(member0=None, member1=1), None]
    wrote = spark.createDataFrame([(Row(member0=1, member1=None),), (Row(member0=None, member1="x"),), (None,)], "u struct<member0:int,member1:string>").select(F.col("u").alias("u", metadata={"union": ["int", "string"]}))
    assert [r.u for r in records.resolve(wrote, u("double", "bytes")).collect()] == [Row(member0=1.0, member1=None), Row(member0=None, member1=bytearray(b"x")), None]
    assert [r.u for r in records.resolve(wrote.where("u.member1 is null"), schemas.parse(schemas.record("r", [schemas.field("u", ["null", "long"])]))).collect()] == [1, None]
    with pytest.raises(Exception, match="cannot become"):
        records.resolve(wrote, schemas.parse(schemas.record("r", [schemas.field("u", ["null", "long"])]))).collect()
    with pytest.raises(Exception, match="no branch"):
        records.resolve(wrote, u("double", "boolean")).collect()


def test_builders_conversions_and_times(spark):
    spec = schemas.record("r", [schemas.field("e", schemas.enum("s", "b", "a"), order="descending"), schemas.field("f", schemas.fixed("h", 2)), schemas.field("g", schemas.record("p", [schemas.field("m", schemas.mapping("int"))], group=True))])
    kind = schemas.parse(spec)
    assert schemas.parse(schemas.to_json(kind)) == kind
    with pytest.raises(ValueError):
        schemas.union(*["int"] * 33)
    if "test-days" not in schemas.CONVERSIONS:
        schemas.register(schemas.Conversion("test-days", T.IntegerType(), lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c), lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))))
    days = schemas.parse(schemas.record("r", [schemas.field("d", schemas.logical("int", "test-days"))]))
    assert "test-days" in schemas.to_json(days)
    stored = schemas.converted(spark.sql("SELECT DATE'1970-01-03' AS d"), days, write=True)
    assert stored.first().d == 2 and str(schemas.converted(stored, days).first().d) == "1970-01-03"
    with pytest.raises(ValueError):
        schemas.register(schemas.Conversion("date", T.IntegerType()))
    times = schemas.parse(schemas.record("r", [schemas.field("ms", schemas.logical("int", "time-millis")), schemas.field("us", schemas.logical("long", "time-micros"))]))
    if hasattr(T, "TimeType"):
        spark.conf.set("spark.sql.timeType.enabled", "true")  # off by default in this version
        got = spark.sql("SELECT '12:34:56.789' AS t").select(*[F.col("t").cast(f.dataType).cast("string").alias(f.name) for f in times]).first()
        assert (got.ms, got.us) == ("12:34:56.789", "12:34:56.789")
