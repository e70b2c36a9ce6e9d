"""Keyed changes to layers: a change log is folded and merged, copy on write.

A change has ``op`` (insert, upsert, update, delete), ``seq`` (its place in
the order of calls), the key, and fields; null fields mean "keep the old
value". Layers stay flat while they change and are nested again afterwards.

Rules: an insert of a live key and an update or delete of a dead one do
nothing; an insert needs a live parent at its time; patches merge field by
field; an insert after a delete starts afresh; a delete takes all rows below
it along; an update of the foreign key moves the row, and all below it with
it, if the new parent is live.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.storage import Versions, stored
from .layers import Layer, chain, in_order

OPS = ("insert", "upsert", "update", "delete")


def merge_one_per_key(base: DataFrame, log: DataFrame, pk: tuple[str, ...]) -> DataFrame:
    """Merge a log with at most one change per key, on one layer: a join and no Python.

    Base rows with a null in the key match no change and stay; changes with a
    null in the key do nothing.
    """
    fields = [c for c in base.columns if c not in pk]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in pk])
    patched = [(F.col(c) if c in log.columns else F.lit(None).cast(base.schema[c].dataType)).alias(f"__new_{c}") for c in fields]
    changes = log.where(whole).select(*[F.col(k).alias(f"__key_{k}") for k in pk], F.col("op").alias("__op"), *patched)
    marked = base.withColumn("__base", F.lit(True))
    both = marked.join(changes, [F.col(k) == F.col(f"__key_{k}") for k in pk], "full_outer")
    op, there = F.col("__op"), F.coalesce("__base", F.lit(False))
    kept = F.when(there, op.isNull() | (op != "delete")).otherwise(op.isin("insert", "upsert"))
    patch = there & F.coalesce(op.isin("update", "upsert"), F.lit(False))
    out = {k: F.when(there, F.col(k)).otherwise(F.col(f"__key_{k}")) for k in pk}
    out |= {c: F.when(patch, F.coalesce(F.col(f"__new_{c}"), F.col(c))).when(there, F.col(c)).otherwise(F.col(f"__new_{c}")) for c in fields}
    return both.where(kept).select(*[out[c].alias(c) for c in base.columns])


def legal(log: DataFrame, fk: tuple[str, ...], parents: DataFrame, parent_pk: tuple[str, ...]) -> DataFrame:
    """Changes whose parent row exists."""
    keys = parents.select(*[F.col(p).alias(f"__parent_{i}") for i, p in enumerate(parent_pk)])
    return log.join(keys, [F.col(c) == F.col(f"__parent_{i}") for i, c in enumerate(fk)], "left_semi")


def cascade(child: DataFrame, fk: tuple[str, ...], parents: DataFrame, parent_pk: tuple[str, ...]) -> DataFrame:
    """Rows of ``child`` whose parent is still there."""
    return legal(child, fk, parents, parent_pk)


def _fold(columns: list[str], kinds: dict[str, T.DataType], fk: list[str]) -> Column:
    """The state machine of a key, over ``__base``, ``__log`` and its parents' ``__lives``, as one aggregate in the JVM.

    The state is whether the row lives, the row, and when it came and went.
    ``fk`` is empty for a root layer, whose rows need no parent.
    """

    def same(a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in fk], F.lit(True))

    def parent_lives(values: Column, seq: Column) -> Column:
        """Whether the parent named by ``values`` lives just before ``seq``."""
        if not fk:
            return F.lit(True)
        return F.aggregate("__lives", F.lit(False), lambda found, x: F.when(same(x, values) & (x["seq"] < seq), x["alive"]).otherwise(found))

    def bound(value: Column, use) -> Column:
        """``use(value)``, the value being worked out once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def step(state: Column, e: Column) -> Column:
        live, row, kind = state["live"], state["row"], e["kind"]

        def outcome(patched: Column) -> Column:
            died = live & ((kind == "delete") | ((kind == "death") & same(row, e["vals"])))
            born = ~live & kind.isin("insert", "upsert") & parent_lives(e["vals"], e["seq"])
            patch = live & kind.isin("update", "upsert") & (same(patched, row) | parent_lives(patched, e["seq"]))
            return F.when(died, 1).when(born, 2).when(patch, 3).otherwise(0)

        def after(patched: Column, what: Column) -> Column:
            told = F.concat(state["out"], F.array(F.struct(e["seq"].alias("seq"), (what == 2).alias("alive"))))
            made = lambda live, row, out: F.struct(live.alias("live"), row.alias("row"), out.alias("out"))
            return F.when(what == 0, state).when(what == 1, made(F.lit(False), row, told)).when(what == 2, made(F.lit(True), e["vals"], told)).otherwise(made(live, patched, state["out"]))

        patch_of = F.struct(*[F.coalesce(e["vals"][c], row[c]).alias(c) for c in columns])
        return bound(patch_of, lambda patched: bound(outcome(patched), lambda what: after(patched, what)))

    start = F.struct(
        F.col("__base").isNotNull().alias("live"),
        F.struct(*[F.col("__base")[c].cast(kinds[c]).alias(c) for c in columns]).alias("row"),
        F.array().cast("array<struct<seq:bigint,alive:boolean>>").alias("out"),
    )
    events = F.col("__log")
    if fk:
        none = lambda c: F.lit(None).cast(kinds[c])
        ends = F.transform(
            F.filter("__lives", lambda x: ~x["alive"] & (x["seq"] >= 0)),
            # behind the changes of the same step
            lambda x: F.struct(x["seq"].alias("seq"), F.lit(2).alias("rank"), F.lit("death").alias("kind"), F.struct(*[(x[c] if c in fk else none(c)).cast(kinds[c]).alias(c) for c in columns]).alias("vals")),
        )
        events = F.concat(events, ends)
    return F.aggregate(in_order(events, ["seq", "rank"], ["vals"], kinds.values()), start, step)


def apply_changes(root: Layer, logs: dict[str, DataFrame]) -> Layer:
    """The layer tree after all changes, in the order of ``seq`` over all layers.

    ``logs`` has for each layer's name a table of ``op, seq`` and the
    layer's columns. Layers are worked top-down. Only keys with changes of
    their own are folded, each over the sorted array of its changes; of the
    others, those of a parent that died go by an anti join, and the rest is
    carried over. Rows with a null in the key are carried over, and changes
    with one do nothing. A patch of a composite foreign key gives all of it.
    """
    return _apply(root, None, logs)


def _apply(layer: Layer, parents: DataFrame | None, logs: dict[str, DataFrame]) -> Layer:
    """``parents``: this layer's foreign key with __seq and __alive, when each parent came and went; -1 is before the log."""
    base, columns, pk, fk = layer.df, layer.df.columns, list(layer.pk), list(layer.fk)
    rooted = parents is None
    kinds = {f.name: f.dataType for f in base.schema}
    alive = base.select(*pk).withColumn("__seq", F.lit(-1).cast("long")).withColumn("__alive", F.lit(True))
    deaths = None if rooted else parents.where("__seq >= 0 and not __alive").groupBy(*fk).agg(F.min("__seq").alias("__seq"))
    log = logs.get(layer.name)
    if log is None:
        # no changes of its own: rows go with their parents, and that is all
        gone = None if rooted else base.join(deaths, fk).select(*pk, "__seq", F.lit(False).alias("__alive"))
        after = base if rooted else base.join(deaths, fk, "left_anti").select(*columns)
        out = Layer(layer.name, after, layer.pk, layer.fk)
        return _with_children(out, layer, alive if gone is None else alive.unionByName(gone), logs)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in pk])
    vals = F.struct(*[(F.col(c).cast(kinds[c]) if c in log.columns else F.lit(None).cast(kinds[c])).alias(c) for c in columns])
    change = F.struct(F.col("seq").cast("long").alias("seq"), F.lit(1).alias("rank"), F.col("op").alias("kind"), vals.alias("vals"))
    own = stored(log.where(whole).groupBy(*pk).agg(F.collect_list(change).alias("__log")), "changes")
    quiet = base.join(own.select(*pk), pk, "left_anti")
    gone = None
    if not rooted:
        gone = quiet.join(deaths, fk).select(*pk, "__seq", F.lit(False).alias("__alive"))
        quiet = quiet.join(deaths, fk, "left_anti")
    rows = own.join(base.select(*pk, F.struct(*columns).alias("__base")), pk, "left")
    if not rooted:
        named = lambda x: F.struct(*[x[c].alias(f"__fk_{c}") for c in fk])
        wanted = rows.select(*[F.col(k).alias(f"__pk_{k}") for k in pk], F.explode(F.array_distinct(F.concat(F.array(named(F.col("__base"))), F.transform("__log", lambda e: named(e["vals"]))))).alias("p"))
        told = parents.select(*[F.col(c).alias(f"__of_{c}") for c in fk], "__seq", "__alive")
        lives = wanted.select("*", "p.*").join(told, [F.col(f"__fk_{c}") == F.col(f"__of_{c}") for c in fk])
        life = F.struct(F.col("__seq").alias("seq"), F.col("__alive").alias("alive"), *[F.col(f"__of_{c}").alias(c) for c in fk])
        lives = lives.groupBy(*[F.col(f"__pk_{k}").alias(k) for k in pk]).agg(F.array_sort(F.collect_list(life)).alias("__lives"))
        rows = rows.join(lives, pk, "left").withColumn("__lives", F.coalesce("__lives", F.array().cast(lives.schema["__lives"].dataType)))
    folded = stored(rows.select(*pk, _fold(columns, kinds, [] if rooted else fk).alias("s")), "folded")
    after = quiet.select(*columns).unionByName(folded.where("s.live").select("s.row.*"))
    out = Layer(layer.name, after, layer.pk, layer.fk)
    lived = alive.unionByName(folded.select(*pk, F.explode("s.out").alias("x")).select(*pk, F.col("x.seq").alias("__seq"), F.col("x.alive").alias("__alive")))
    return _with_children(out, layer, lived if gone is None else lived.unionByName(gone), logs)


def _with_children(out: Layer, layer: Layer, lived: DataFrame, logs: dict[str, DataFrame]) -> Layer:
    """Work the children; ``lived`` tells when each key of this layer came and went."""
    for child in layer.children:
        named = lived.select(*[F.col(p).alias(c) for p, c in zip(layer.pk, child.fk, strict=True)], "__seq", "__alive")
        out.children.append(_apply(child, named, logs))
    return out


class Store:
    """Layers with pending changes: reads see them, ``merge`` writes them, as does leaving the context.

    With a ``path``, ``merge`` writes each layer that a change can have
    reached as a new version there and reads it again; all but the ``keep``
    newest versions are deleted. Without one the layers stay plans.
    """

    def __init__(self, root: Layer, limit: int | None = None, path: str | None = None, keep: int = 2):
        self.root, self.limit, self.path, self.keep = root, limit, path, keep
        self.pending: dict[str, DataFrame] = {}
        self.seq, self.version = 0, 0

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *error: object) -> None:
        if error[0] is None:
            self.merge()

    def change(self, layer: str, op: str, rows: DataFrame) -> None:
        """Stage rows of one operation, in one step of the order."""
        if op not in OPS:
            raise ValueError(op)
        staged = rows.withColumn("op", F.lit(op)).withColumn("seq", F.lit(self.seq).cast("long"))
        self.seq += 1
        old = self.pending.get(layer)
        self.pending[layer] = staged if old is None else old.unionByName(staged, allowMissingColumns=True)
        if self.limit is not None and self.seq >= self.limit:
            self.merge()

    def current(self) -> Layer:
        """The layers with all pending changes applied."""
        return apply_changes(self.root, self.pending) if self.pending else self.root

    def search(self, layer: str, key: object) -> DataFrame:
        """Read your writes: one row by its key.

        Rows and changes of that key alone are folded, and of its parents,
        as far up as the tree goes.
        """
        from .access import _is_key, point_search

        path = self.root.line_to(layer)
        last, logs, kept = path[-1], {}, []
        df, log = last.df.where(_is_key(last.pk, key)), self.pending.get(layer)
        log = None if log is None else log.where(_is_key(last.pk, key))
        for at, above in zip(reversed(path), [*reversed(path[:-1]), None], strict=True):
            kept.append(Layer(at.name, df, at.pk, at.fk))
            if log is not None:
                logs[at.name] = log
            if above is not None:
                keys = lambda rows, at=at, above=above: rows.select(*[F.col(c).alias(p) for c, p in zip(at.fk, above.pk, strict=True)])
                wanted = keys(df)
                if log is not None and all(c in log.columns for c in at.fk):
                    wanted = wanted.unionByName(keys(log))
                wanted = wanted.distinct()
                df = above.df.join(wanted, list(above.pk), "left_semi")
                log = self.pending.get(above.name)
                log = None if log is None else log.join(wanted, list(above.pk), "left_semi")
        found = apply_changes(chain(*reversed(kept)), logs).line_to(layer)[-1]
        return point_search(found.df, found.pk, key)

    def merge(self) -> Layer:
        changed = {x.name for name in self.pending for x in self.root.subtree(name)}
        after = self.current()
        if self.path and changed:
            self.version += 1
            after = self._written(after, changed)
        self.root, self.pending, self.seq = after, {}, 0
        return self.root

    def _written(self, layer: Layer, changed: set[str]) -> Layer:
        children = [self._written(c, changed) for c in layer.children]
        df = layer.df
        if layer.name in changed:
            versions = Versions(df.sparkSession, f"{self.path}/{layer.name}")
            versions.write(df, self.version, first=self.version == 1)
            versions.expire(self.keep)
            df = versions.read("base", self.version)
        return Layer(layer.name, df, layer.pk, layer.fk, children)
