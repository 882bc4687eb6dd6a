"""Documents: column selection, defaults by schema version, lookup by ids."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import FieldSpec, IndexSpec

VERSION = "_schema_version"


def literal(value: Any, f: FieldSpec) -> Column:
    """A default as a column of the field's type."""
    kind = f.data_type()
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def filled(f: FieldSpec, spec: IndexSpec, versions: str | None = None) -> Column:
    """The field with its default, or its type's; rows of older schema versions with the default of theirs."""
    own = spec.default_of(f.name)
    last = literal(f.type_default() if own is None else own, f)
    if versions:
        cases = None
        for v in range(1, spec.schema_version):
            old = spec.default_of(f.name, v)
            if old is not None and old != own:
                test = F.col(versions) == v
                cases = F.when(test, literal(old, f)) if cases is None else cases.when(test, literal(old, f))
        if cases is not None:
            last = cases.otherwise(last)
    return F.coalesce(F.col(f.name), last)


def reversed_map(f: FieldSpec, column: Column | None = None) -> Column:
    """The string that a stored number stands for; null if there is none."""
    column = F.col(f.name) if column is None else column
    names: dict[int, str] = {}
    for name, number in (f.string_map or {}).items():
        names.setdefault(number, name)
    if not names:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for number, name in names.items() for x in (number, name)]
    return F.element_at(F.create_map(*pairs), column.cast("int"))


def shown(rows: DataFrame, spec: IndexSpec, fields: Iterable[str] | None = None, versions: str | None = None) -> DataFrame:
    """Documents with the id and the chosen fields (all: None or "*"), defaults filled, numbers shown as their strings."""
    wanted = list(fields or ["*"])
    chosen = [f for f in spec.fields if not f.filter_only and ("*" in wanted or f.name in wanted)]
    if "*" not in wanted:
        for name in wanted:
            if name != spec.id:
                spec.field(name)
    versions = versions if versions and versions in rows.columns else None
    columns = []
    for f in chosen:
        if f.name not in rows.columns:
            columns.append(literal(f.type_default() if f.default is None else f.default, f).alias(f.name))
        elif f.string_map is not None:
            columns.append(reversed_map(f).alias(f.name))
        else:
            columns.append(filled(f, spec, versions).alias(f.name))
    return rows.select(spec.id, *columns)


def compacted(rows: DataFrame, spec: IndexSpec) -> DataFrame:
    """For storage: values equal to their default become null, and the schema version is noted."""
    columns = []
    for name in rows.columns:
        f = spec.field(name) if spec.has(name) else None
        if f and f.default is not None:
            columns.append(F.when(~F.col(name).eqNullSafe(literal(f.default, f)), F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return rows.select(*columns).withColumn(VERSION, F.lit(spec.schema_version))


def by_ids(table: DataFrame, ids: DataFrame, spec: IndexSpec, position: str = "position") -> DataFrame:
    """One row for each id of ``ids``, missing rows with nulls; ``ids`` has the id and, if order matters, ``position``."""
    found = ids.join(table, spec.id, "left")
    return found.orderBy(position) if position in ids.columns else found
