"""Writes as functions from table to table.  Tables are immutable; the caller swaps the reference or stores the result."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Conflict, FieldNotFound, InvalidValue, RowNotFound
from ..functions.convert import valid_id, with_computed
from ..plans.ast import Clause
from ..plans.compile import Compiler
from ..spec import FieldSpec, IndexSpec

PRESENT = "_present"


def _last(rows: DataFrame, spec: IndexSpec, order: str | None) -> DataFrame:
    """One row for each id: the last by ``order`` (without one, any single row of equal ids)."""
    if order is None:
        return rows.dropDuplicates([spec.id])
    names = [c for c in rows.columns if c != spec.id]
    last = rows.groupBy(spec.id).agg(F.max_by(F.struct(*names), order).alias("_row"))
    return last.select(spec.id, *[F.col(f"_row.{c}").alias(c) for c in names])


def aligned(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the table's columns, missing ones null."""
    kinds = {f.name: f.dataType for f in table.schema}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in table.columns])


def put(table: DataFrame, rows: DataFrame, spec: IndexSpec, order: str | None = None) -> DataFrame:
    """Upsert: each row replaces the one of its id whole; fields it doesn't have are cleared."""
    new = with_computed(aligned(_last(rows.where(valid_id(F.col(spec.id))), spec, order), table), spec)
    return table.join(new.select(spec.id), spec.id, "left_anti").select(*table.columns).unionByName(new)


def patch(table: DataFrame, rows: DataFrame, spec: IndexSpec, order: str | None = None, insert: bool = False) -> DataFrame:
    """Only the fields that ``rows`` has change; a null counts as a value unless ``_present`` (an array of field names) leaves the field out.

    Ids that aren't there are ignored, or with ``insert`` become rows.
    """
    changed = [c for c in rows.columns if c not in (spec.id, PRESENT, order) and c in table.columns]
    rows = _last(rows, spec, order)
    side = rows.select(F.col(spec.id).alias("_id"), *[F.col(c).alias(f"_new_{c}") for c in changed], *([PRESENT] if PRESENT in rows.columns else []))
    joined = table.join(side, F.col(spec.id) == F.col("_id"), "full" if insert else "left")

    def value(c: str) -> Column:
        if c == spec.id:
            return F.coalesce(spec.id, "_id").alias(c)
        if c not in changed:
            return F.col(c)
        given = F.col("_id").isNotNull()
        if PRESENT in rows.columns:
            given &= F.array_contains(PRESENT, c)
        return F.when(given, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return with_computed(joined.select(*map(value, table.columns)), spec)


def patch_pairs(table: DataFrame, pairs: DataFrame, spec: IndexSpec) -> DataFrame:
    """Old and new values: ``pairs`` has the id and, for each changed field f, ``old_f`` and ``new_f``.

    A field changes where its value is the old one.  An id that isn't there is an error.
    """
    missing = pairs.join(table, spec.id, "left_anti").limit(1).collect()
    if missing:
        raise RowNotFound(str(missing[0][spec.id]))
    fields = [c[4:] for c in pairs.columns if c.startswith("new_") and c[4:] in table.columns]
    joined = table.join(pairs, spec.id, "left")
    new = {f: F.when(F.col(f"new_{f}").isNotNull() & (F.col(f).eqNullSafe(F.col(f"old_{f}"))), F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields}
    return with_computed(joined.withColumns(new).select(*table.columns), spec)


def delete(table: DataFrame, ids: DataFrame, spec: IndexSpec, strict: bool = False) -> DataFrame:
    """Without the rows of ``ids``; with ``strict`` an id that isn't there is an error."""
    if strict and ids.join(table, spec.id, "left_anti").limit(1).count():
        raise RowNotFound("an id that isn't there")
    return table.join(ids.select(spec.id).distinct(), spec.id, "left_anti").select(*table.columns)


def delete_where(table: DataFrame, filters: Iterable[Clause], spec: IndexSpec, now: int | None = None) -> DataFrame:
    """Without the rows that all clauses hold for."""
    found = Compiler(spec, now).predicate(filters)
    if found is None:
        return table.limit(0)
    return table.where(~F.coalesce(found, F.lit(False)))


def filter_sync(table: DataFrame, sets: DataFrame, field: str, spec: IndexSpec) -> DataFrame:
    """Replaces all values of a filter-only multi-value field for the ids given; other ids keep theirs."""
    f = spec.field(field)
    if not (f.filter_only and f.multi):
        raise InvalidValue(f"{field} is not a filter-only multi-value field")
    side = sets.groupBy(spec.id).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(field)))).alias("_new"))
    joined = table.join(side, spec.id, "left")
    return joined.withColumn(field, F.coalesce("_new", field)).select(*table.columns)


def batch(table: DataFrame, rows: DataFrame, spec: IndexSpec, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A batch upsert that applies what it can: the new table, and the rows that failed with an ``error``."""
    error = F.when(F.col(spec.id).isNull(), "no id").when(~valid_id(F.col(spec.id)), "id out of range")
    for f in spec.fields:
        if f.filter and not f.nullable and f.default is None and not f.computed and f.name in rows.columns:
            error = error.when(F.col(f.name).isNull(), f"{f.name}: null without a default")
    judged = rows.withColumn("error", error)
    return put(table, judged.where("error IS NULL").drop("error"), spec, order), judged.where("error IS NOT NULL")


def rebuild(table: DataFrame, spec: IndexSpec, fields: Iterable[str] | None = None) -> DataFrame:
    """Computed fields (or some of them) derived again from the stored ones."""
    chosen = [f for f in spec.fields if f.computed and (fields is None or f.name in set(fields))]
    from ..functions.convert import computed

    return table.withColumns({f.name: computed(f) for f in chosen}) if chosen else table


def add_field(table: DataFrame, spec: IndexSpec, f: FieldSpec, value: Column | None = None) -> tuple[DataFrame, IndexSpec]:
    """A new field, null or from ``value``; its name must be free."""
    if spec.has(f.name) or f.name == spec.id:
        raise Conflict(f.name)
    column = F.lit(None) if value is None else value
    return with_computed(table.withColumn(f.name, column.cast(f.data_type())), new := spec.with_field(f)), new


def drop_field(table: DataFrame, spec: IndexSpec, name: str) -> tuple[DataFrame, IndexSpec]:
    if not spec.has(name):
        raise FieldNotFound(name)
    return table.drop(name), spec.without_field(name)


def next_ids(table: DataFrame, spec: IndexSpec, recycled: DataFrame | None = None) -> DataFrame:
    """Where new ids come from: ``recycled`` ids, lowest first, then those above ``high_water``."""
    top = table.agg(F.coalesce(F.max(spec.id) + 1, F.lit(0)).alias("high_water"))
    if recycled is None:
        return top.withColumn("lowest_recycled", F.lit(None).cast("long"))
    return top.crossJoin(recycled.agg(F.min(spec.id).alias("lowest_recycled")))  # one row each
