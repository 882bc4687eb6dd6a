"""Queries as data: clauses, order, page.  Every query syntax is parsed to these."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

Value = int | float | bool | str


@dataclass(frozen=True)
class Clause:
    """Base of all clauses; ``str`` gives the canonical text."""

    def __str__(self) -> str:
        return canonical(self)


@dataclass(frozen=True, repr=True)
class Compare(Clause):
    field: str
    value: Value

    __str__ = Clause.__str__


class Eq(Compare):
    """The field has the value."""


class NotEq(Compare):
    """The field has another value; null doesn't count on nullable fields."""


class Gt(Compare):
    """Greater than."""


class Gte(Compare):
    """Greater than or equal."""


class Lt(Compare):
    """Less than."""


class Lte(Compare):
    """Less than or equal."""


@dataclass(frozen=True)
class In(Clause):
    field: str
    values: tuple[Value, ...]

    __str__ = Clause.__str__


@dataclass(frozen=True)
class NotIn(Clause):
    field: str
    values: tuple[Value, ...]

    __str__ = Clause.__str__


@dataclass(frozen=True)
class IsNull(Clause):
    field: str

    __str__ = Clause.__str__


@dataclass(frozen=True)
class IsNotNull(Clause):
    field: str

    __str__ = Clause.__str__


@dataclass(frozen=True)
class And(Clause):
    clauses: tuple[Clause, ...]

    __str__ = Clause.__str__


@dataclass(frozen=True)
class Or(Clause):
    clauses: tuple[Clause, ...]

    __str__ = Clause.__str__


@dataclass(frozen=True)
class Not(Clause):
    clause: Clause

    __str__ = Clause.__str__


@dataclass(frozen=True)
class InBucket(Clause):
    """Rows in a time bucket; ``bucket`` None is the empty set.  Made by snapping, not by parsers."""

    field: str
    bucket: str | None

    __str__ = Clause.__str__


@dataclass(frozen=True)
class Everything(Clause):
    """All rows."""

    __str__ = Clause.__str__


@dataclass(frozen=True)
class Registered(Clause):
    """A registered prefilter; replaces the clauses that it stands for."""

    name: str

    __str__ = Clause.__str__


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = True


@dataclass(frozen=True)
class Cursor:
    """The last row of the page before: its sort value and id."""

    sort_value: int
    id: int


@dataclass(frozen=True)
class Query:
    filters: tuple[Clause, ...] = ()
    sort: Sort | None = None
    limit: int = 50
    cursor: Cursor | None = None
    offset: int | None = None
    include_docs: bool | tuple[str, ...] = False


_TEXT = {Eq: "=", NotEq: "!=", Gt: ">", Gte: ">=", Lt: "<", Lte: "<="}


def canonical(clause: Clause) -> str:
    """A text that is equal for clauses that only differ in the order or nesting of conjunctions and disjunctions."""
    c = simplified(clause)
    lit = json.dumps
    if type(c) in _TEXT:
        return f"{c.field} {_TEXT[type(c)]} {lit(c.value)}"
    if isinstance(c, (In, NotIn)):
        return f"{c.field} {'IN' if isinstance(c, In) else 'NOT IN'} [{', '.join(sorted(set(map(lit, c.values))))}]"
    if isinstance(c, (IsNull, IsNotNull)):
        return f"{c.field} IS {'NOT ' * isinstance(c, IsNotNull)}NULL"
    if isinstance(c, (And, Or)):
        return "(" + (" AND " if isinstance(c, And) else " OR ").join(sorted({canonical(x) for x in c.clauses})) + ")"
    if isinstance(c, Not):
        return f"NOT {canonical(c.clause)}"
    if isinstance(c, InBucket):
        return f"{c.field} IN BUCKET {c.bucket}"
    return f"PREFILTER {c.name}" if isinstance(c, Registered) else "TRUE"


def simplified(clause: Clause) -> Clause:
    """Nested conjunctions and disjunctions flattened, double negations removed, doubles dropped."""
    if isinstance(clause, Not):
        inner = simplified(clause.clause)
        return inner.clause if isinstance(inner, Not) else Not(inner)
    if isinstance(clause, (And, Or)):
        kind = type(clause)
        parts: list[Clause] = []
        for c in map(simplified, clause.clauses):
            parts += c.clauses if type(c) is kind and c.clauses else (c,)
        parts = list(dict.fromkeys(parts))
        return parts[0] if len(parts) == 1 else kind(tuple(parts))
    return clause


def conjuncts(filters: Iterable[Clause]) -> tuple[Clause, ...]:
    """The top-level list with its conjunctions opened."""
    out: list[Clause] = []
    for c in map(simplified, filters):
        out += c.clauses if isinstance(c, And) and c.clauses else (c,)
    return tuple(dict.fromkeys(out))
