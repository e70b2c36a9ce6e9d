"""Nesting, filters and access on hand-made tables and random trees."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierspark import queries
from tierspark.operators import access, bloom, layers, nest, runs
from tierspark.operators.layers import Layer, chain
from tierspark.plans import predicate
from tierspark.plans.layer_filter import filter_layers, filtered
from tierspark.plans.nested_filter import flat_filter, narrow_schema, nested_filter
from tierspark.plans.predicate import Pred, Udf, by_layer, less_than
from tierspark.sources import changelog, load, readers, writers


def family(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "p int, name string")
    children = spark.createDataFrame([(1, 11, 5), (1, 10, None), (3, 12, 7), (9, 13, 1), (None, 14, 1)], "p_id int, k int, v int")
    return Layer("parent", parents, ("p",)), Layer("child", children, ("k",), ("p_id",))


def test_left_outer_order_and_orphans(spark):
    parent, child = family(spark)
    n = nest.nest_all(chain(parent, child)).orderBy("p").collect()
    assert [[c.k for c in r.childArr] for r in n] == [[10, 11], [], [12]]
    assert sorted(r.k for r in layers.orphans(child, parent).collect()) == [13, 14]


def test_null_leaf_is_no_match_and_empty_is_kept(spark):
    n = nest.nest_all(chain(*family(spark)))
    kept = nested_filter(n, [Pred(("childArr",), lambda r: r["v"] >= 5)]).orderBy("p").collect()
    assert [(r.p, [c.k for c in r.childArr]) for r in kept] == [(1, [11]), (3, [12])]
    assert nested_filter(n, [Pred((), lambda r: r["name"] != "c")]).count() == 2
    assert nested_filter(n).count() == 3


def test_unnest_outer_and_counts(spark):
    n = nest.nest_all(chain(*family(spark)))
    assert nest.unnest(n, "childArr", keep=["p"]).count() == 3
    assert nest.unnest(n, "childArr", keep=["p"], outer=True).count() == 4
    assert {r.layer: r.n for r in nest.layer_counts(n).collect()} == {"root": 3, "childArr": 3}


LEAF = T.StructType([T.StructField("z", T.IntegerType())])
MID = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("A2", T.ArrayType(LEAF)), T.StructField("A3", T.ArrayType(LEAF))])
ROOT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("A", T.ArrayType(MID)), T.StructField("B", T.ArrayType(LEAF))])
FIELD = {(): "x", ("A",): "y", ("A", "A2"): "z", ("A", "A3"): "z", ("B",): "z"}


def random_root(rng):
    leaf = lambda: [Row(z=rng.randrange(6)) for _ in range(rng.randrange(3))]
    return Row(x=rng.randrange(6), A=[Row(y=rng.randrange(6), A2=leaf(), A3=leaf()) for _ in range(rng.randrange(3))], B=leaf())


def expected(record, preds, path=()):
    """The definition, record by record: the pruned record, or None."""
    if any(p == path and not record[FIELD[path]] < bound for p, bound in preds):
        return None
    out = {}
    for name, value in record.asDict().items():
        if isinstance(value, list):
            below = (*path, name)
            bearing = any(p[: len(below)] == below for p, _ in preds)
            kept = [expected(v, preds, below) for v in value]
            value = [v for v in kept if v is not None]
            if bearing and not value:
                return None
        out[name] = value
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    rows = [random_root(rng) for _ in range(60)]
    preds = [(rng.choice(list(FIELD)), rng.randrange(2, 6)) for _ in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, ROOT)
    got = nested_filter(df, [less_than(p, FIELD[p], b) for p, b in preds]).collect()
    want = [e for e in (expected(r, preds) for r in rows) if e is not None]
    assert sorted(map(repr, (r.asDict(recursive=True) for r in got))) == sorted(map(repr, want))
    flat = flat_filter(df, [less_than(p, FIELD[p], b) for p, b in preds], ("A", "A2"), ["x", "y", "z"]).collect()
    assert sorted((r.x, r.y, r.z) for r in flat) == sorted((r["x"], a["y"], z["z"]) for r in want for a in r["A"] for z in a["A2"])
    udf = nested_filter(df, [Udf(p, FIELD[p], lambda v, b=b: v < b) for p, b in preds]).collect()
    assert sorted(map(repr, (r.asDict(recursive=True) for r in udf))) == sorted(map(repr, want))


def test_predicates_sort_and_tell_their_fields():
    deep, shallow = Pred(("a", "b"), lambda r: r["u"] == r["v"]), Pred((), lambda r: r["w"] > 1)
    assert by_layer([deep, shallow]) == [shallow, deep] and deep.fields == ["u", "v"]


def test_narrow_schema_prunes_the_scan(spark, tmp_path):
    n = nest.nest_all(chain(*family(spark)))
    writers.write_sorted(n, str(tmp_path / "n"), ["p"], bloom=["p"])
    preds = [Pred(("childArr",), lambda r: r["v"] > 0)]
    df = readers.columnar(spark, str(tmp_path / "n"), narrow_schema(n.schema, preds, ["p"]))
    assert df.schema["childArr"].dataType.elementType.fieldNames() == ["v"]
    assert "name" not in df.columns
    with pytest.raises(ValueError):
        readers.columnar(spark, str(tmp_path / "n"), T.StructType([T.StructField("nope", T.IntegerType())]))
    assert readers.columnar(spark, str(tmp_path), recursive=True).count() == 3


def test_root_filter_is_pushed(spark, tmp_path):
    n = nest.nest_all(chain(*family(spark)))
    writers.write(n, str(tmp_path / "n"))
    plan = nested_filter(spark.read.parquet(str(tmp_path / "n")), [Pred((), lambda r: r["p"] > 1)])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p,1)" in plan and "Exchange" not in plan


def test_text_empty_and_trailing(spark, tmp_path):
    (tmp_path / "t").write_text("1|x||\n2||3|\n4|y\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.IntegerType()), T.StructField("end", T.StringType())])
    got = readers.delimited(spark, str(tmp_path / "t"), schema).orderBy("a").select("a", "b", "c").collect()
    assert [tuple(r) for r in got] == [(1, "x", None), (2, None, 3), (4, "y", None)]
    assert readers.line_count(spark, str(tmp_path / "t")) == 3


def test_metadata_and_codecs(spark, tmp_path):
    df = writers.with_metadata(spark.range(3), "id", owner="me")
    writers.write(df, str(tmp_path / "m"), codec="gzip", records_per_file=1)
    assert readers.metadata(spark.read.parquet(str(tmp_path / "m")))["id"]["owner"] == "me"
    writers.append(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 6
    with pytest.raises(ValueError):
        writers.with_metadata(df, "id", **{"spark.x": 1})
    with pytest.raises(ValueError):
        writers.write(df, str(tmp_path / "x"), codec="rar")
    with pytest.raises(ValueError):
        writers.concatenate(df, df.withColumn("b", F.lit(1)))


def test_guards(spark):
    n = writers.with_guards(nest.nest_all(chain(*family(spark))), "childArr", {"v": "__v"}).orderBy("p").collect()
    assert [(r["__v_min"], r["__v_max"]) for r in n] == [(5, 5), (None, None), (7, 7)]


def test_bloom_has_no_false_negatives(spark):
    gate = bloom.Bloom(spark.range(0, 1000, 3), "id", 400)
    assert all(gate.might_contain(i) for i in range(0, 1000, 3))
    assert sum(gate.might_contain(i) for i in range(1, 1000, 3)) < 30
    bits, hashes = bloom.sizing(1000)
    assert 9000 < bits < 10000 and hashes == 7


def test_order_and_batches(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "s string, i int")
    assert [r.s for r in runs.sorted_records(df, {"s": runs.DESC}).collect()] == ["b", "a"]
    assert [r.s for r in runs.merge_runs([df, df], ["s"]).collect()] == ["a", "a", "b", "b"]
    with pytest.raises(ValueError):
        runs.concat_runs([df, df.select("s")])
    with pytest.raises(TypeError):
        runs.record_order(df.select(F.create_map("s", "i").alias("m")))
    assert [len(b) for b in readers.batches(spark.range(5), 2)] == [2, 2, 1]
    enum = df.select(F.col("s").alias("s", metadata={"symbols": ["b", "a"]}))
    assert [r.s for r in runs.sorted_records(enum).collect()] == ["b", "a"]


def test_positions(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "r"))
    assert access.file_row(spark.read.parquet(str(tmp_path / "r")), 4).first().id == 4
    assert [r.id for r in access.row_range(spark.range(10), ["id"], 3, 2).orderBy("id").collect()] == [3, 4]
    assert access.read_column(spark.range(2), 0).columns == ["id"]


def test_predicates_travel_as_text(spark):
    preds = predicate.loads(predicate.dumps([predicate.compare((), "name", "ne", "c"), predicate.compare(("childArr",), "v", "from_to", [5, 7])]))
    assert [r.p for r in nested_filter(nest.nest_all(chain(*family(spark))), preds).collect()] == [1]


def test_split_into_paths(spark):
    df = spark.createDataFrame([random_root(random.Random(9)) for _ in range(20)], ROOT)
    got = nest.split_paths(df, "A", "A2").collect()
    want = [(r.x, a.y, z.z) for r in df.collect() for a in r.A for z in a.A2]
    assert sorted((r.x, r.A[0].y, r.A[0].A2[0].z) for r in got) == sorted(want)
    assert all(len(r.A) == 1 and len(r.A[0].A2) == 1 for r in got)


def test_filtering_before_nesting_is_the_same(spark):
    parent, child = family(spark)
    grand = Layer("toy", spark.createDataFrame([(100, 10, 1), (101, 10, 9), (102, 11, 9)], "t int, k_id int, w int"), ("t",), ("k_id",))
    root = chain(parent, child, grand)
    for preds in ([less_than(("childArr", "toyArr"), "w", 5)], [less_than(("childArr",), "v", 6)], [less_than((), "p", 3), less_than(("childArr", "toyArr"), "w", 50)], []):
        a = nested_filter(nest.nest_all(root), preds).collect()
        b = nest.nest_all(filter_layers(root, preds)).collect()
        assert sorted(map(repr, a)) == sorted(map(repr, b))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_over_stored_flat_layers_reach_the_scans(spark, tmp_path):
    parent, child = family(spark)
    root = load.load_layers(chain(parent, child), str(tmp_path / "l"))
    preds = [less_than((), "p", 3), less_than(("childArr",), "v", 6)]
    got = filtered(root, preds, ["name", "childArr.v"])
    shown = plan(got)
    assert "LessThan(p,3)" in shown and "LessThan(v,6)" in shown
    assert [(r.p, [c.v for c in r.childArr]) for r in got.collect()] == [(1, [5])]
    n = load.load_nested(root, str(tmp_path / "n"))
    assert "Exchange" not in plan(filtered(n, preds)) and filtered(n, preds).first().p == 1
    odd = filter_layers(root, [Udf(("childArr",), "v", lambda v: v == 5)])
    assert [r.p for r in nest.nest_all(odd).collect()] == [1]


def test_the_gate_keeps_few_rows_and_all_matches(spark):
    probe, keys = spark.range(20000).withColumnRenamed("id", "k"), spark.range(0, 20000, 100).withColumnRenamed("id", "k")
    gate = bloom.Bloom(keys, "k", 200)
    passed = probe.where(gate.gate("k"))
    assert 200 <= passed.count() < 200 + 0.03 * 20000
    joined = bloom.gated_semi_join(probe, keys, "k", 200)
    assert sorted(r.k for r in joined.collect()) == list(range(0, 20000, 100))
    assert "Subquery" in plan(joined)
    assert sorted(r.k for r in bloom.gated_semi_join(probe, keys, "k", 5).collect()) == list(range(0, 20000, 100))
    assert bloom.gated_semi_join(probe, keys.limit(0), "k", 5).count() == 0
    with pytest.raises(ValueError):
        bloom.Bloom(keys, "k", 10**9)


def test_sorted_tables_know_places(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 2).alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    writers.write_sorted(df, str(tmp_path / "t"), ["k"], bloom=["k"])
    t = access.SortedTable(spark, str(tmp_path / "t"), "k")
    assert [(r.k, r.row_no) for r in t.rows(498, 3).orderBy("k").collect()] == [(996, 498), (998, 499), (1000, 500)]
    assert t.rows(2000, 5).count() == 0
    assert [(r.k, r.row_no) for r in t.offsets(700).collect()] == [(700, 350)] and t.offsets(701).count() == 0
    assert t.search(701).count() == 0 and "EqualTo(k,700)" in plan(t.search(700))
    assert [r.k for r in t.between(10, 16, descending=True).collect()] == [14, 12, 10]
    assert t.seek(1990).count() == 5


def test_checksums_are_verified(spark, tmp_path):
    writers.write(spark.range(5000).coalesce(1), str(tmp_path / "c"), codec="none")
    file = next(p for p in (tmp_path / "c").iterdir() if p.name.startswith("part"))
    for crc in (tmp_path / "c").glob(".*.crc"):
        crc.unlink()
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 0xFF
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="(?i)corrupt|checksum"):
        readers.columnar(spark, str(tmp_path / "c"), verify=True).agg(F.sum("id")).collect()


def test_logs_with_unknown_operations_are_refused(spark, tmp_path):
    layer = Layer("p", spark.createDataFrame([(1, 1)], "p long, v int"), ("p",))
    with pytest.raises(Exception, match="no such operation"):
        changelog.write_log(spark.createDataFrame([("merge", 1, 1)], "op string, seq long, p long"), str(tmp_path / "l"), layer)


def test_descendants_are_counted_without_orphans(spark):
    parent, child = family(spark)
    grand = Layer("toy", spark.createDataFrame([(100, 10), (101, 10), (102, 11), (103, 13), (104, None)], "t int, k_id int"), ("t",), ("k_id",))
    got = nest.descendant_counts(chain(parent, child, grand))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 3), (2, 0, 0), (3, 1, 0)]
    assert got.columns == ["p", "n_child", "n_toy"]


def test_five_layers_are_counted_without_a_row_that_holds_a_subtree(spark):
    """The counts are those of the five layers nested, and nothing is collected for them."""
    sf = "/root/testdata/sf0.001"
    made = queries.nest5_counts(spark, sf)
    assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    n = nest.nest_all(chain(
        Layer("region", t("region"), ("r_regionkey",)), Layer("nation", t("nation"), ("n_nationkey",), ("n_regionkey",)), Layer("customer", t("customer"), ("c_custkey",), ("c_nationkey",)),
        Layer("orders", t("orders"), ("o_orderkey",), ("o_custkey",)), Layer("lineitem", t("lineitem"), ("l_orderkey", "l_linenumber"), ("l_orderkey",)),
    ))
    want = [
        (r.r_name, x.n_name, len(x.customerArr), sum(len(c.ordersArr) for c in x.customerArr), sum(len(o.lineitemArr) for c in x.customerArr for o in c.ordersArr))
        for r in n.collect() for x in r.nationArr
    ]
    assert sorted(map(tuple, made.collect())) == sorted(want) and len(want) == 25
