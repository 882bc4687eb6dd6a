"""Clauses compiled to one DataFrame predicate.

Rules that plain SQL doesn't have:

- A negation is two-valued: ``Not(c)`` holds where c is unknown.
- ``NotEq`` and ``NotIn`` drop nulls on nullable fields and keep them on others.
- A nested empty And is false, an empty Or and an empty In are false; the empty
  top-level list is true.
- Literals that a field can't hold match nothing in ``Eq`` and ``In`` and are an
  error in ranges.

Predicates that sources can evaluate stay in the form that reaches them: plain
comparisons, and ``NOT (a <=> v)`` instead of ``coalesce``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FieldNotFound, InvalidValue, QueryTooExpensive
from ..spec import FieldSpec, IndexSpec
from .ast import And, Clause, Compare, Eq, Everything, Gt, Gte, In, InBucket, IsNotNull, IsNull, Lt, Lte, Not, NotEq, NotIn, Or, Query, Registered, Value, conjuncts
from .lineage import cut

MS_FROM = 100_000_000_000


def seconds(ts: int) -> int:
    """A time in seconds; values that can only be milliseconds are divided."""
    return ts // 1000 if ts > MS_FROM else ts


def fields_of(clause: Clause) -> set[str]:
    if isinstance(clause, (And, Or)):
        return set().union(*map(fields_of, clause.clauses)) if clause.clauses else set()
    if isinstance(clause, Not):
        return fields_of(clause.clause)
    return {clause.field} if hasattr(clause, "field") else set()


def validate(query: Query, spec: IndexSpec) -> None:
    """Raises FieldNotFound for any unknown field, whether or not the data would reach it."""
    for clause in query.filters:
        for name in fields_of(clause):
            if name != spec.id and not spec.has(name):
                raise FieldNotFound(name)
    if query.sort and query.sort.field != spec.id:
        if not spec.has(query.sort.field):
            raise FieldNotFound(query.sort.field)
        if not spec.field(query.sort.field).sort:
            raise InvalidValue(f"{query.sort.field} is not a sort field")


# --- time buckets --------------------------------------------------------------------------------


def nearest_bucket(duration: int, spec: IndexSpec) -> str | None:
    """The bucket within the tolerance of its own duration that is closest, the shorter of two as close."""
    near = [(abs(duration - b.duration), b.duration, b.name) for b in spec.time.buckets if abs(duration - b.duration) <= round(b.duration * spec.time.tolerance)]
    return min(near)[2] if near else None


def covering_bucket(duration: int, spec: IndexSpec) -> str:
    """The shortest bucket that covers the duration, else the longest."""
    ordered = sorted(spec.time.buckets, key=lambda b: b.duration)
    return next((b.name for b in ordered if b.duration >= duration), ordered[-1].name)


def snap(clause: Clause, spec: IndexSpec, now: int) -> Clause:
    """Ranges over the bucket field become buckets; conjunctions and disjunctions are entered, negations not."""
    if isinstance(clause, (And, Or)):
        return type(clause)(tuple(snap(c, spec, now) for c in clause.clauses))
    time = spec.time
    if not isinstance(clause, (Gt, Gte, Lt, Lte)) or clause.field != time.field or not time.buckets or isinstance(clause.value, (bool, str, float)):
        return clause
    at = seconds(clause.value)
    duration = max(0, now - at)
    if isinstance(clause, (Gt, Gte)):
        name = nearest_bucket(duration, spec)
        if name is None and time.always_snap:
            name = covering_bucket(duration, spec)
        return InBucket(clause.field, name)
    if at >= now:
        return Everything()
    name = nearest_bucket(duration, spec)
    return Not(InBucket(clause.field, name)) if name else clause


# --- predicates ----------------------------------------------------------------------------------


def resolve(f: FieldSpec, value: Value) -> Value | None:
    """The literal as the field stores it, or None if the field can't hold it."""
    if isinstance(value, str):
        if f.string_map is not None:
            if f.case_sensitive:
                return f.string_map.get(value)
            return {k.lower(): v for k, v in f.string_map.items()}.get(value.lower())
        return value if f.text else None
    if f.boolean:
        return bool(value) if value in (0, 1) else None
    if f.text or isinstance(value, float):
        return None
    return int(value)


def _folded(f: FieldSpec, value: Value) -> tuple[Column, Column]:
    """The two sides of an equality."""
    if f.text and not f.case_sensitive:
        return F.lower(F.col(f.name)), F.lit(str(value).lower())
    return F.col(f.name), F.lit(value)


def _array(f: FieldSpec) -> Column:
    return F.coalesce(F.col(f.name), F.array().cast("array<bigint>"))


def _equals(f: FieldSpec, value: Value) -> Column:
    found = resolve(f, value)
    if found is None:
        return F.lit(False)
    if f.multi:
        return F.array_contains(_array(f), F.lit(found).cast("long"))
    left, right = _folded(f, found)
    return left == right


def _member(f: FieldSpec, values: Iterable[Value]) -> Column:
    found = list(dict.fromkeys(v for v in (resolve(f, v) for v in values) if v is not None))
    if not found:
        return F.lit(False)
    if f.multi:
        return F.arrays_overlap(_array(f), F.array(*[F.lit(v).cast("long") for v in found]))
    if f.text and not f.case_sensitive:
        return F.lower(F.col(f.name)).isin(list(dict.fromkeys(str(v).lower() for v in found)))
    return F.col(f.name).isin(found)


def _other(f: FieldSpec, same: Column, value: Value | None = None) -> Column:
    """Neither ``same`` nor, on nullable fields, null."""
    if f.nullable:
        return F.col(f.name).isNotNull() & ~same
    if value is not None and not f.multi:
        left, right = _folded(f, value)
        return ~left.eqNullSafe(right)
    return ~F.coalesce(same, F.lit(False))


_RANGE: dict[type, Callable[[Column, Column], Column]] = {
    Gt: lambda c, v: c > v,
    Gte: lambda c, v: c >= v,
    Lt: lambda c, v: c < v,
    Lte: lambda c, v: c <= v,
}


class Compiler:
    """Compiles clauses for one index at one time; ``prefilters`` gives the frames of registered clause sets."""

    def __init__(self, spec: IndexSpec, now: int | None = None, snapping: bool = True):
        self.spec, self.now, self.snapping = spec, now, snapping

    def _id(self) -> FieldSpec:
        return FieldSpec(self.spec.id, filter="single_value", sort=True)

    def field(self, name: str) -> FieldSpec:
        return self._id() if name == self.spec.id else self.spec.field(name)

    def clause(self, c: Clause) -> Column:
        if isinstance(c, Eq):
            f = self.field(c.field)
            if c.field == self.spec.id and (isinstance(c.value, bool) or not isinstance(c.value, int)):
                raise InvalidValue("an id is an integer")
            return _equals(f, c.value)
        if isinstance(c, NotEq):
            f = self.field(c.field)
            return _other(f, _equals(f, c.value), resolve(f, c.value))
        if isinstance(c, In):
            f = self.field(c.field)
            values = [v for v in c.values if c.field != self.spec.id or isinstance(v, int) and not isinstance(v, bool)]
            return _member(f, values)
        if isinstance(c, NotIn):
            f = self.field(c.field)
            return _other(f, _member(f, c.values))
        if type(c) in _RANGE:
            return self._range(c)
        if isinstance(c, IsNull):
            return F.col(self.field(c.field).name).isNull()
        if isinstance(c, IsNotNull):
            return F.col(self.field(c.field).name).isNotNull()
        if isinstance(c, And):
            return reduce(lambda a, b: a & b, map(self.clause, c.clauses)) if c.clauses else F.lit(False)
        if isinstance(c, Or):
            return reduce(lambda a, b: a | b, map(self.clause, c.clauses)) if c.clauses else F.lit(False)
        if isinstance(c, Not):
            return ~F.coalesce(self.clause(c.clause), F.lit(False))
        if isinstance(c, InBucket):
            return self._bucket(c)
        if isinstance(c, Everything):
            return F.lit(True)
        raise InvalidValue(f"unknown clause {c!r}")

    def _range(self, c: Compare) -> Column:
        f = self.field(c.field)
        value = c.value
        if isinstance(value, str) and f.string_map is not None:
            value = resolve(f, value)
        if isinstance(value, (str, float)) or value is None or f.text:
            raise InvalidValue(f"{c.field}: a range needs an integer, not {c.value!r}")
        test, bound = _RANGE[type(c)], F.lit(int(value))
        if f.multi:
            return F.exists(_array(f), lambda x: test(x, bound))
        return test(F.col(f.name).cast("int") if f.boolean else F.col(f.name), bound)

    def _bucket(self, c: InBucket) -> Column:
        if c.bucket is None:
            return F.lit(False)
        if self.now is None:
            raise InvalidValue("time buckets need the time")
        duration = next(b.duration for b in self.spec.time.buckets if b.name == c.bucket)
        return F.col(c.field).between(self.now - duration, self.now)

    def rewritten(self, filters: Iterable[Clause]) -> tuple[Clause, ...]:
        """The top-level list after snapping."""
        filters = tuple(filters)
        if self.snapping and self.now is not None:
            filters = tuple(snap(c, self.spec, self.now) for c in filters)
        return filters

    def predicate(self, filters: Iterable[Clause]) -> Column | None:
        """The conjunction of the top-level list; None if it is empty."""
        parts = [self.clause(c) for c in self.rewritten(filters)]
        return reduce(lambda a, b: a & b, parts) if parts else None


def visible(spec: IndexSpec, now: int | None) -> Column | None:
    """Rows whose schedule has come; None if the index has no schedule."""
    if not spec.time.deferred or now is None:
        return None
    at = F.col(spec.time.deferred)
    return at.isNull() | (at <= now)


def matching(table: DataFrame, filters: Iterable[Clause], spec: IndexSpec, now: int | None = None, snapping: bool = True) -> DataFrame:
    """The visible rows that all clauses hold for."""
    show = visible(spec, now)
    if show is not None:
        table = table.where(show)
    found = Compiler(spec, now, snapping).predicate(filters)
    return table if found is None else table.where(found)


def matches(table: DataFrame, id: int, filters: Iterable[Clause], spec: IndexSpec, now: int | None = None) -> bool:
    """Whether one row is there and satisfies the clauses."""
    return bool(matching(table.where(F.col(spec.id) == id), filters, spec, now).limit(1).count())


def guard_ranges(table: DataFrame, filters: Iterable[Clause], spec: IndexSpec) -> None:
    """Raises QueryTooExpensive for a range over a field with more distinct values than the index allows."""
    if spec.max_range_values is None:
        return
    todo, names = list(filters), set()
    while todo:
        c = todo.pop()
        todo += c.clauses if isinstance(c, (And, Or)) else [c.clause] if isinstance(c, Not) else []
        if type(c) in _RANGE:
            names.add(c.field)
    if names:
        counts = table.agg(*[F.approx_count_distinct(n).alias(n) for n in sorted(names)]).first()
        for n in sorted(names):
            if counts[n] > spec.max_range_values:
                raise QueryTooExpensive(f"{n} has about {counts[n]} values")


# --- prefilters ----------------------------------------------------------------------------------


class Prefilters:
    """Named clause sets whose matching ids are stored; a query that contains a whole set uses them.

    The ids are those of the last ``register`` or ``refresh``: later changes of the
    table count from the next one on.  At most ``MOST`` sets; the largest one that fits is substituted, then again
    for what is left.
    """

    MOST = 32

    def __init__(self) -> None:
        self.sets: dict[str, tuple[frozenset[str], DataFrame]] = {}
        self._clauses: dict[str, tuple[Clause, ...]] = {}
        self._at: dict[str, int] = {}

    def register(self, name: str, filters: Iterable[Clause], table: DataFrame, spec: IndexSpec, now: int | None = None) -> None:
        parts = conjuncts(filters)
        if not parts:
            raise InvalidValue("a prefilter needs clauses")
        if name not in self.sets and len(self.sets) >= self.MOST:
            raise InvalidValue(f"at most {self.MOST} prefilters")
        ids = cut(matching(table, parts, spec, now).select(spec.id))
        self.sets[name] = (frozenset(map(str, parts)), ids)
        self._clauses[name], self._at[name] = tuple(parts), now or 0

    def refresh(self, name: str, table: DataFrame, spec: IndexSpec, now: int | None = None) -> None:
        self.register(name, self._clauses[name], table, spec, now)

    def refresh_due(self, every: int, table: DataFrame, spec: IndexSpec, now: int) -> list[str]:
        """Refreshes the sets that are ``every`` seconds old or older; their names."""
        due = [n for n in self.list() if now - self._at[n] >= every]
        for name in due:
            self.refresh(name, table, spec, now)
        return due

    def remove(self, name: str) -> None:
        for of in (self.sets, self._clauses, self._at):
            of.pop(name)

    def list(self) -> list[str]:
        return sorted(self.sets)

    def substitute(self, filters: Iterable[Clause]) -> tuple[Clause, ...]:
        left = list(conjuncts(filters))
        used: list[Clause] = []
        while True:
            texts = {str(c) for c in left}
            fits = [(len(s), n) for n, (s, _) in self.sets.items() if s <= texts]
            if not fits:
                return (*used, *left)
            name = max(fits)[1]
            left = [c for c in left if str(c) not in self.sets[name][0]]
            used.append(Registered(name))

    def apply(self, table: DataFrame, filters: Iterable[Clause], spec: IndexSpec) -> tuple[DataFrame, tuple[Clause, ...]]:
        """The table semi-joined with the sets in use, and the clauses that remain."""
        rest = []
        for c in self.substitute(filters):
            if isinstance(c, Registered):
                table = table.join(self.sets[c.name][1], spec.id, "left_semi")
            else:
                rest.append(c)
        return table, tuple(rest)
