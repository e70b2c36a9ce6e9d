"""Change logs against a model in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tierspark.operators.layers import Layer, chain, duplicate_keys, orphans
from tierspark.operators.mutate import Store, apply_changes, cascade, merge_one_per_key
from tierspark.streaming.changes import StreamedLayer

OPS = ("insert", "upsert", "update", "delete")


class Model:
    """Two layers as dictionaries, changed one operation at a time."""

    def __init__(self, parents, children):
        self.parents, self.children = {p: v for p, v in parents}, {k: (f, v) for k, f, v in children}

    def parent(self, op, p, v):
        if op == "delete":
            if self.parents.pop(p, "none") != "none":
                self.children = {k: c for k, c in self.children.items() if c[0] != p}
        elif p in self.parents:
            if op in ("update", "upsert") and v is not None:
                self.parents[p] = v
        elif op in ("insert", "upsert"):
            self.parents[p] = v

    def child(self, op, k, f, v):
        if op == "delete":
            self.children.pop(k, None)
        elif k in self.children:
            if op in ("update", "upsert"):
                old = self.children[k]
                new = (old[0] if f is None else f, old[1] if v is None else v)
                if new[0] == old[0] or new[0] in self.parents:
                    self.children[k] = new
        elif op in ("insert", "upsert") and f in self.parents:
            self.children[k] = (f, v)


@pytest.mark.parametrize("seed", range(5))
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    parents = [(p, p * 10) for p in range(5)]
    children = [(k, rng.randrange(5), k) for k in range(12)]
    model, plog, clog = Model(parents, children), [], []
    for seq in range(80):
        op = rng.choice(OPS)
        if rng.random() < 0.3:
            p, v = rng.randrange(7), rng.choice([None, rng.randrange(100)])
            plog.append((op, seq, p, v))
            model.parent(op, p, v)
        else:
            k, f, v = rng.randrange(16), rng.choice([None, rng.randrange(8)]), rng.choice([None, rng.randrange(100)])
            clog.append((op, seq, k, f, v))
            model.child(op, k, f, v)
    root = chain(Layer("p", spark.createDataFrame(parents, "p long, v int"), ("p",)), Layer("c", spark.createDataFrame(children, "k long, f long, v int"), ("k",), ("f",)))
    after = apply_changes(root, {"p": spark.createDataFrame(plog, "op string, seq long, p long, v int"), "c": spark.createDataFrame(clog, "op string, seq long, k long, f long, v int")})
    assert {r.p: r.v for r in after.df.collect()} == model.parents
    assert {r.k: (r.f, r.v) for r in after.children[0].df.collect()} == model.children


def test_store_merges_on_leaving(spark):
    root = Layer("p", spark.createDataFrame([(1, 1)], "p long, v int"), ("p",))
    with Store(root) as store:
        store.change("p", "insert", spark.createDataFrame([(2, 5)], "p long, v int"))
        store.change("p", "update", spark.createDataFrame([(2, 6)], "p long, v int"))
        assert store.search("p", 2).first().v == 6 and store.root is root
    assert {r.p: r.v for r in store.root.df.collect()} == {1: 1, 2: 6} and not store.pending
    with pytest.raises(ValueError):
        store.change("p", "merge", root.df)
    limited = Store(root, limit=1)
    limited.change("p", "delete", root.df.select("p", F.lit(None).cast("int").alias("v")))
    assert limited.root.df.count() == 0


def table(spark, rows, *columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} long" if c in ("seq", "a", "b", "c") else f"{c} string" for c in columns))


def three(spark):
    """a1 over b1, b2; a2 over b3; b1 over c1, c2; b3 over c3."""
    return chain(
        Layer("A", table(spark, [(1, "x"), (2, "x")], "a", "v"), ("a",)),
        Layer("B", table(spark, [(1, 1, "x"), (2, 1, "x"), (3, 2, "x")], "b", "a", "v"), ("b",), ("a",)),
        Layer("C", table(spark, [(1, 1, "x"), (2, 1, "x"), (3, 3, "x")], "c", "b", "v"), ("c",), ("b",)),
    )


#: Steps (layer, operation, key, parent, value) and what is left of the layers they reach: {layer: {key: (parent, value)}}.
DECISIONS = [
    ([("A", "insert", 1, None, "n")], {"A": {1: "x", 2: "x"}}),
    ([("A", "insert", 9, None, "n")], {"A": {1: "x", 2: "x", 9: "n"}}),
    ([("A", "upsert", 1, None, "n")], {"A": {1: "n", 2: "x"}}),
    ([("A", "upsert", 9, None, "n")], {"A": {1: "x", 2: "x", 9: "n"}}),
    ([("A", "update", 1, None, "n")], {"A": {1: "n", 2: "x"}}),
    ([("A", "update", 1, None, None)], {"A": {1: "x", 2: "x"}}),
    ([("A", "update", 9, None, "n")], {"A": {1: "x", 2: "x"}}),
    ([("A", "delete", 9, None, None)], {"A": {1: "x", 2: "x"}}),
    ([("A", "delete", 1, None, None)], {"A": {2: "x"}, "B": {3: (2, "x")}, "C": {3: (3, "x")}}),
    ([("A", "delete", 1, None, None), ("A", "insert", 1, None, "n")], {"A": {1: "n", 2: "x"}, "B": {3: (2, "x")}, "C": {3: (3, "x")}}),
    ([("A", "delete", 1, None, None), ("A", "insert", 1, None, "n"), ("B", "insert", 1, 1, "m")], {"B": {1: (1, "m"), 3: (2, "x")}, "C": {3: (3, "x")}}),
    ([("A", "delete", 1, None, None), ("B", "insert", 1, 1, "m")], {"B": {3: (2, "x")}}),
    ([("A", "delete", 1, None, None), ("A", "update", 1, None, "n")], {"A": {2: "x"}}),
    ([("A", "delete", 1, None, None), ("A", "upsert", 1, None, None)], {"A": {1: None, 2: "x"}}),
    ([("A", "insert", 9, None, "n"), ("A", "update", 9, None, "m")], {"A": {1: "x", 2: "x", 9: "m"}}),
    ([("A", "insert", 9, None, "n"), ("A", "delete", 9, None, None)], {"A": {1: "x", 2: "x"}}),
    ([("A", "insert", 9, None, "n"), ("B", "insert", 9, 9, "m"), ("A", "delete", 9, None, None)], {"B": {1: (1, "x"), 2: (1, "x"), 3: (2, "x")}}),
    ([("B", "insert", 9, 2, "n")], {"B": {1: (1, "x"), 2: (1, "x"), 3: (2, "x"), 9: (2, "n")}}),
    ([("B", "insert", 9, 7, "n")], {"B": {1: (1, "x"), 2: (1, "x"), 3: (2, "x")}}),
    ([("B", "insert", 9, None, "n")], {"B": {1: (1, "x"), 2: (1, "x"), 3: (2, "x")}}),
    ([("B", "upsert", 9, 7, "n")], {"B": {1: (1, "x"), 2: (1, "x"), 3: (2, "x")}}),
    ([("B", "insert", 9, 7, "n"), ("A", "insert", 7, None, "n")], {"B": {1: (1, "x"), 2: (1, "x"), 3: (2, "x")}}),
    ([("A", "insert", 7, None, "n"), ("B", "insert", 9, 7, "n")], {"B": {1: (1, "x"), 2: (1, "x"), 3: (2, "x"), 9: (7, "n")}}),
    ([("B", "update", 1, 2, None)], {"B": {1: (2, "x"), 2: (1, "x"), 3: (2, "x")}, "C": {1: (1, "x"), 2: (1, "x"), 3: (3, "x")}}),
    ([("B", "update", 1, 7, "n")], {"B": {1: (1, "x"), 2: (1, "x"), 3: (2, "x")}}),
    ([("B", "update", 1, 1, "n")], {"B": {1: (1, "n"), 2: (1, "x"), 3: (2, "x")}}),
    ([("B", "update", 1, 2, None), ("B", "update", 1, 1, None)], {"B": {1: (1, "x"), 2: (1, "x"), 3: (2, "x")}}),
    ([("B", "update", 1, 2, None), ("A", "delete", 1, None, None)], {"B": {1: (2, "x"), 3: (2, "x")}, "C": {1: (1, "x"), 2: (1, "x"), 3: (3, "x")}}),
    ([("B", "update", 1, 2, None), ("A", "delete", 2, None, None)], {"B": {2: (1, "x")}, "C": {}}),
    ([("B", "update", 1, 2, None), ("B", "update", 1, 1, None), ("A", "delete", 2, None, None)], {"B": {1: (1, "x"), 2: (1, "x")}, "C": {1: (1, "x"), 2: (1, "x")}}),
    ([("A", "delete", 2, None, None), ("B", "update", 1, 2, "n")], {"B": {1: (1, "x"), 2: (1, "x")}}),
    ([("B", "delete", 1, None, None)], {"B": {2: (1, "x"), 3: (2, "x")}, "C": {3: (3, "x")}}),
    ([("B", "delete", 1, None, None), ("B", "insert", 1, 2, "n")], {"B": {1: (2, "n"), 2: (1, "x"), 3: (2, "x")}, "C": {3: (3, "x")}}),
    ([("B", "delete", 1, None, None), ("B", "insert", 1, 2, "n"), ("C", "upsert", 1, 1, None)], {"C": {1: (1, None), 3: (3, "x")}}),
    ([("C", "update", 1, 3, "n"), ("B", "delete", 1, None, None)], {"C": {1: (3, "n"), 3: (3, "x")}}),
    ([("C", "update", 3, 1, None), ("A", "delete", 2, None, None)], {"C": {1: (1, "x"), 2: (1, "x"), 3: (1, "x")}}),
    ([("C", "delete", 1, None, None), ("C", "update", 1, 3, "n")], {"C": {2: (1, "x"), 3: (3, "x")}}),
    ([("C", "insert", 1, 3, "n")], {"C": {1: (1, "x"), 2: (1, "x"), 3: (3, "x")}}),
    ([("C", "upsert", 1, None, "n"), ("C", "upsert", 1, 3, None)], {"C": {1: (3, "n"), 2: (1, "x"), 3: (3, "x")}}),
    ([("A", "delete", 1, None, None), ("A", "delete", 2, None, None), ("C", "insert", 9, 1, "n")], {"A": {}, "B": {}, "C": {}}),
]


def test_decisions(spark):
    """All decisions side by side, each with keys of its own."""
    wide, logs = 100, {"A": [], "B": [], "C": []}
    key = lambda k, i: None if k is None else k + i * wide
    many = lambda df, keys: df.crossJoin(spark.range(len(DECISIONS)).withColumnRenamed("id", "i")).select(*[(F.col(c) + F.col("i") * wide).alias(c) if c in keys else c for c in df.columns])
    a, b, c = [x for _, x in three(spark).walk()]
    root = chain(Layer("A", many(a.df, ["a"]), ("a",)), Layer("B", many(b.df, ["b", "a"]), ("b",), ("a",)), Layer("C", many(c.df, ["c", "b"]), ("c",), ("b",)))
    for i, (steps, _) in enumerate(DECISIONS):
        for seq, (layer, op, k, parent, v) in enumerate(steps):
            logs[layer].append((op, seq, key(k, i), *(() if layer == "A" else (key(parent, i),)), v))
    names = {"A": ("op", "seq", "a", "v"), "B": ("op", "seq", "b", "a", "v"), "C": ("op", "seq", "c", "b", "v")}
    after = apply_changes(root, {n: table(spark, rows, *names[n]) for n, rows in logs.items()})
    for _, layer in after.walk():
        held = [{} for _ in DECISIONS]
        for r in layer.df.collect():
            own = r[layer.pk[0]]
            held[own // wide][own % wide] = r.v if layer.name == "A" else (r[layer.fk[0]] % wide, r.v)
        for i, (steps, want) in enumerate(DECISIONS):
            if layer.name in want:
                assert held[i] == want[layer.name], (layer.name, steps)


def test_big_integers_nulls_and_maps_survive_the_fold(spark):
    big = 9007199254740995
    root = Layer("p", spark.createDataFrame([(big, None, {"k": 1}), (None, 5, None), (3, 4, None)], "p long, v long, m map<string, int>"), ("p",))
    log = spark.createDataFrame([("update", 1, big, big + 2, None), ("update", 2, 3, None, {"z": 2}), ("insert", 3, None, 7, None)], "op string, seq long, p long, v long, m map<string, int>")
    got = {(r.p, r.v, tuple((r.m or {}).items())) for r in apply_changes(root, {"p": log}).df.collect()}
    assert got == {(big, big + 2, (("k", 1),)), (None, 5, ()), (3, 4, (("z", 2),))}
    merged = merge_one_per_key(root.df, log.drop("m"), ("p",))
    assert {(r.p, r.v) for r in merged.collect()} == {(big, big + 2), (None, 5), (3, 4)}


def test_a_layer_over_itself(spark):
    own = Layer("e", spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id long, boss long"), ("id",), ("boss",))
    assert sorted(r.id for r in orphans(own, own).collect()) == [1, 3]
    assert [r.id for r in cascade(own.df, ("boss",), own.df, ("id",)).collect()] == [2]
    assert duplicate_keys(own).count() == 0


def test_store_writes_versions_and_expires_them(spark, tmp_path):
    store = Store(three(spark), path=str(tmp_path), keep=1)
    for i in range(3):
        store.change("A", "update", table(spark, [(1, f"v{i}")], "a", "v"))
        store.merge()
    assert {r.a: r.v for r in store.root.df.collect()} == {1: "v2", 2: "x"}
    assert sorted(p.name for p in (tmp_path / "A").iterdir() if p.name.startswith("base")) == ["base=3"]
    store.change("A", "delete", table(spark, [(1, None)], "a", "v"))
    assert store.search("C", 1).count() == 0 and store.search("C", 3).count() == 1
    assert store.search("B", 3).first().a == 2


def test_streamed_batches_fold_in_order_and_compact(spark, tmp_path):
    layer = StreamedLayer(spark, str(tmp_path / "s"), "p", ("p",), compact=3, keep=1)
    layer.create(spark.createDataFrame([(1, "x"), (2, "x")], "p long, v string"))
    for batch in range(7):
        log = [("update", 5, 1, f"b{batch}"), ("insert", 9, 10 + batch, "new"), ("delete", 1, 9 + batch, None)]
        layer.apply(spark.createDataFrame(log, "op string, seq long, p long, v string"), batch)
        if batch % 2:
            layer.apply(spark.createDataFrame(log, "op string, seq long, p long, v string"), batch)  # again, after a failure
        assert {r.p: r.v for r in layer.read().collect()} == {1: f"b{batch}", 2: "x", 10 + batch: "new"}
    kept = sorted(p.name for p in (tmp_path / "s").iterdir() if "=" in p.name)
    assert kept == ["base=5", "delta=6"] and layer.newest() == 6
    layer.apply(spark.createDataFrame([], "op string, seq long, p long, v string"), 7)
    assert layer.read().count() == 3
