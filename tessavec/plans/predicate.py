"""Typed predicates with two-valued logic: a comparison with a missing value is false, and its negation true."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Resolve = Callable[[str], Column]


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Both(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Either(self, other)

    def __invert__(self) -> Predicate:
        return Negated(self)

    def column(self, resolve: Resolve) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Comparison(Predicate):
    op: str
    name: str
    value: Any

    def column(self, resolve: Resolve) -> Column:
        x, v = resolve(self.name), F.lit(self.value)
        if self.op == "==":
            return x.eqNullSafe(v)
        if self.op == "!=":
            return ~x.eqNullSafe(v)
        found = {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[self.op]
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class TextMatch(Predicate):
    op: str
    name: str
    value: str

    def column(self, resolve: Resolve) -> Column:
        return F.coalesce(getattr(resolve(self.name), self.op)(self.value), F.lit(False))


@dataclass(frozen=True)
class Both(Predicate):
    left: Predicate
    right: Predicate

    def column(self, resolve: Resolve) -> Column:
        return self.left.column(resolve) & self.right.column(resolve)


@dataclass(frozen=True)
class Either(Predicate):
    left: Predicate
    right: Predicate

    def column(self, resolve: Resolve) -> Column:
        return self.left.column(resolve) | self.right.column(resolve)


@dataclass(frozen=True)
class Negated(Predicate):
    inner: Predicate

    def column(self, resolve: Resolve) -> Column:
        return ~self.inner.column(resolve)


class field:  # noqa: N801  reads as a word in predicates: field("price") < 5
    """A top-level item field; comparing it makes a predicate."""

    def __init__(self, name: str) -> None:
        self.name = name

    __hash__ = None

    def __eq__(self, value) -> Comparison:  # type: ignore[override]
        return Comparison("==", self.name, value)

    def __ne__(self, value) -> Comparison:  # type: ignore[override]
        return Comparison("!=", self.name, value)

    def __lt__(self, value) -> Comparison:
        return Comparison("<", self.name, value)

    def __le__(self, value) -> Comparison:
        return Comparison("<=", self.name, value)

    def __gt__(self, value) -> Comparison:
        return Comparison(">", self.name, value)

    def __ge__(self, value) -> Comparison:
        return Comparison(">=", self.name, value)

    def contains(self, text: str) -> TextMatch:
        return TextMatch("contains", self.name, text)

    def startswith(self, text: str) -> TextMatch:
        return TextMatch("startswith", self.name, text)


def lookups(predicate: Predicate, indexed) -> list[tuple[str, Any]] | None:
    """(field, value) pairs of a conjunction of equalities on indexed fields with values; None for anything else."""
    if isinstance(predicate, Both):
        left, right = lookups(predicate.left, indexed), lookups(predicate.right, indexed)
        return None if left is None or right is None else left + right
    if isinstance(predicate, Comparison) and predicate.op == "==" and predicate.name in indexed and predicate.value is not None:
        return [(predicate.name, predicate.value)]
    return None
