"""Predicates on layers of a nested table."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Recorder:
    """Stands for a record while a predicate's field names are found out."""

    def __init__(self) -> None:
        self.names: list[str] = []

    def __getitem__(self, name: str) -> Column:
        self.names.append(name)
        return F.col(name)


class Root:
    """The root record: its fields are top-level columns, so that filters on them reach the scan."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


@dataclass(frozen=True)
class Pred:
    """A condition on the records of one layer.

    ``path`` names the arrays from the root to the layer; ``test`` takes a
    record (``r["field"]``) and gives a boolean Column; null is no match.
    """

    path: tuple[str, ...]
    test: Callable[[object], Column]

    @property
    def fields(self) -> list[str]:
        seen = _Recorder()
        self.test(seen)
        return list(dict.fromkeys(seen.names))

    def on(self, record: object) -> Column:
        return self.test(record)


@dataclass(frozen=True)
class Udf:
    """A condition in Python on one field: ``func(value) -> bool``. Opaque, so nothing is pushed down."""

    path: tuple[str, ...]
    field: str
    func: Callable[[object], bool]

    @property
    def fields(self) -> list[str]:
        return [self.field]


def by_layer(preds: list) -> list:
    """Shallow layers first."""
    return sorted(preds, key=lambda p: (len(p.path), p.path))


def less_than(path: tuple[str, ...], name: str, bound: object) -> Pred:
    return Pred(path, lambda r: r[name] < F.lit(bound))


def half_open(path: tuple[str, ...], name: str, low: object, high: object) -> Pred:
    """``low <= field < high``."""
    return Pred(path, lambda r: (r[name] >= F.lit(low)) & (r[name] < F.lit(high)))


#: Comparisons of a predicate that is stored as text.
COMPARE = {
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "in": lambda c, v: c.isin(v),
    "from_to": lambda c, v: (c >= F.lit(v[0])) & (c < F.lit(v[1])),
}


def compare(path: tuple[str, ...], name: str, op: str, value: object) -> Pred:
    """``field op value``, which ``dumps`` can write."""
    how = COMPARE[op]
    return Spec(tuple(path), lambda r: how(r[name], value), (name, op, value))


@dataclass(frozen=True)
class Spec(Pred):
    """A predicate that keeps what it was made from."""

    spec: tuple = ()


def dumps(preds: list[Spec]) -> str:
    """Predicates as JSON, for a job's configuration."""
    return json.dumps([[list(p.path), *p.spec] for p in preds])


def loads(text: str) -> list[Pred]:
    return [compare(tuple(path), name, op, value) for path, name, op, value in json.loads(text)]
