"""Raw values to field values, and derived columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import MAX_ID, FieldSpec, IndexSpec

MS_FROM = 100_000_000_000


def to_seconds(c: Column) -> Column:
    """Milliseconds to seconds."""
    return F.floor(c / 1000).cast("long")


def auto_seconds(c: Column) -> Column:
    """Times in either unit to seconds; beyond 1e11 they can only be milliseconds."""
    return F.when(c > MS_FROM, to_seconds(c)).otherwise(c)


def as_integer(c: Column, kind: T.DataType) -> Column:
    """Integers as they are, other numbers truncated, numeric text read, anything else null."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("long")
    text = c.cast("string")
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def as_boolean(c: Column, kind: T.DataType) -> Column:
    """Booleans, and t, f, true, false, 0 and 1 as text; anything else null."""
    return c if isinstance(kind, T.BooleanType) else c.cast("string").try_cast("boolean")


def mapped(c: Column, f: FieldSpec) -> Column:
    """The number of a string; unknown strings are 0, missing ones stay missing."""
    key = c.cast("string") if f.case_sensitive else F.lower(c.cast("string"))
    pairs = [F.lit(x) for k, v in (f.string_map or {}).items() for x in (k if f.case_sensitive else k.lower(), v)]
    found = F.element_at(F.create_map(*pairs), key).cast("long") if pairs else F.lit(None).cast("long")
    return F.when(c.isNotNull(), F.coalesce(found, F.lit(0)))


def integers(c: Column, kind: T.DataType) -> Column:
    """The integers of an array, others skipped; none at all is no value."""
    inner = kind.elementType if isinstance(kind, T.ArrayType) else T.StringType()
    if not isinstance(kind, T.ArrayType):
        c = F.from_json(c.cast("string"), "array<string>")
    found = F.array_distinct(F.filter(F.transform(c, lambda x: as_integer(x, inner)), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found)


def converted(c: Column, f: FieldSpec, kind: T.DataType) -> Column:
    """A raw column of type ``kind`` as the field's type; values that don't fit are null."""
    if f.value_type == "exists_boolean":
        return c.isNotNull()
    if f.multi:
        return integers(c, kind)
    if f.value_type == "mapped_string":
        return mapped(c, f)
    if f.boolean:
        return as_boolean(c, kind)
    if f.text:
        return c.cast("string")
    number = as_integer(c, kind)
    return to_seconds(number) if f.ms_to_seconds else number


def loaded(f: FieldSpec, schema: T.StructType) -> Column:
    """The field from the columns of a raw table.

    The source counts if it isn't null, converted; else the fallback, without the
    conversion of units; else the default.
    """
    types = {s.name: s.dataType for s in schema}
    source = f.source or f.name
    parts = []
    if source in types:
        parts.append(converted(F.col(f"`{source}`"), f, types[source]))
    if f.fallback and f.fallback in types and f.value_type != "exists_boolean":
        plain = FieldSpec(**{**f.__dict__, "ms_to_seconds": False})
        parts.append(converted(F.col(f"`{f.fallback}`"), plain, types[f.fallback]))
    if f.value_type == "exists_boolean" and f.fallback and f.fallback in types:
        parts = [parts[0] | F.col(f"`{f.fallback}`").isNotNull()] if parts else [F.col(f"`{f.fallback}`").isNotNull()]
    if f.default is not None:
        default = F.array(*[F.lit(v) for v in f.default]) if isinstance(f.default, (list, tuple)) else F.lit(f.default)
        parts.append(default.cast(f.data_type()))
    if not parts:
        return F.lit(False if f.value_type == "exists_boolean" else None).cast(f.data_type()).alias(f.name)
    return (parts[0] if len(parts) == 1 else F.coalesce(*parts)).cast(f.data_type()).alias(f.name)


def computed(f: FieldSpec) -> Column:
    """The greatest or least of the sources that are there."""
    sources = [F.col(s) for s in f.sources]
    if len(sources) == 1:
        return sources[0].cast("long").alias(f.name)
    return (F.greatest if f.computed == "greatest" else F.least)(*sources).cast("long").alias(f.name)


def with_computed(table, spec: IndexSpec):
    """``table`` with its computed fields derived anew."""
    derived = {f.name: computed(f) for f in spec.fields if f.computed and all(s in table.columns for s in f.sources)}
    return table.withColumns(derived) if derived else table


def valid_id(c: Column) -> Column:
    """Whether the value can be a row's id."""
    return F.coalesce((c >= 0) & (c <= MAX_ID), F.lit(False))


def snapped(ts: Column, interval: int) -> Column:
    """``ts`` rounded down to a grid; interval 0 leaves it."""
    return ts if interval == 0 else (F.floor(ts / interval) * interval).cast("long")


def array_added(values: Column, new: Column) -> Column:
    return F.array_union(F.coalesce(values, F.array().cast("array<bigint>")), new)


def array_removed(values: Column, gone: Column) -> Column:
    return F.array_except(F.coalesce(values, F.array().cast("array<bigint>")), gone)


def flag(bits: Column, on: tuple[int, ...] = (), off: tuple[int, ...] = ()) -> Column:
    """Whether all of some bits are set and others not; null bits are null."""
    tests = [F.getbit(bits, F.lit(b)) == 1 for b in on] + [F.getbit(bits, F.lit(b)) == 0 for b in off]
    return reduce(lambda a, b: a & b, tests)
