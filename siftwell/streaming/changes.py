"""Changes between two states of a table as operations, and the rows that they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import OP, as_value, op
from ..spec import IndexSpec

_EMPTY = "array<bigint>"


def _array(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_EMPTY))


def _each(kind: str, field: str):
    """What makes an operation of each value of an array."""
    return lambda v: op(kind, field, text=v.cast("string"))


def diff(old: DataFrame, new: DataFrame, spec: IndexSpec, patch: bool = False) -> DataFrame:
    """Operations that turn ``old`` into ``new``: (``entity_id``, ``creates_slot``, ``ops``), rows without a change left out.

    Scalars give remove(old) and set(new) where they differ, nulls compared as
    values; multi-value fields an add or remove for each value; a row that has gone
    gives a delete, a new one alive and its values.  With ``patch`` rows of ``new`` are
    partial: missing fields and missing rows stay as they are.
    """
    fields = [f for f in spec.fields if not f.computed and f.name in new.columns and (f.name in old.columns)]
    o = old.select(F.col(spec.id).alias("_oid"), *[F.col(f.name).alias(f"_o_{f.name}") for f in fields])
    n = new.select(F.col(spec.id).alias("_nid"), *[F.col(f.name).alias(f"_n_{f.name}") for f in fields])
    both = o.join(n, F.col("_oid") == F.col("_nid"), "right" if patch else "full")
    none = F.array().cast(f"array<{OP}>")
    parts: list[Column] = [F.when(F.col("_oid").isNull(), F.array(op("alive"))).otherwise(none)]
    for f in fields:
        a, b = F.col(f"_o_{f.name}"), F.col(f"_n_{f.name}")
        if f.multi:
            gone = F.transform(F.array_except(_array(f"_o_{f.name}"), _array(f"_n_{f.name}")), _each("remove", f.name))
            came = F.transform(F.array_except(_array(f"_n_{f.name}"), _array(f"_o_{f.name}")), _each("add", f.name))
            change = F.concat(gone, came)
            parts.append(F.when(b.isNotNull(), change).otherwise(none) if patch else change)
        else:
            changed = ~a.eqNullSafe(b) & (b.isNotNull() if patch else F.lit(True))
            parts.append(F.when(changed & a.isNotNull(), F.array(op("remove", f.name, a))).otherwise(none))
            parts.append(F.when(changed & b.isNotNull(), F.array(op("set", f.name, b))).otherwise(none))
    ops = F.when(F.col("_nid").isNull(), F.array(op("delete"))).otherwise(F.concat(*parts))
    return both.select(F.coalesce("_oid", "_nid").alias("entity_id"), F.col("_oid").isNull().alias("creates_slot"), ops.alias("ops")).where(F.size("ops") > 0)


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` of which some column differs from ``old``, with the old values as ``old_<column>``."""
    side = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"old_{c}") for c in columns])
    joined = new.join(side, F.col(key) == F.col("_k"), "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return joined.where(differs | F.col("_k").isNull()).drop("_k")


def parent_to_query(parents: DataFrame, key: str, target: str, fields: dict[str, str]) -> DataFrame:
    """Changed parent rows as fan-outs: one operation set for all rows whose ``target`` is the parent's key."""
    nested = F.to_json(F.array(*[F.struct(F.lit("set").alias("op"), F.lit(t).alias("field"), as_value(F.col(c)).alias("value")) for c, t in fields.items()]))
    return parents.select(F.col(key).cast("long").alias("entity_id"), F.lit(False).alias("creates_slot"), F.array(op("queryOpSet", query=F.concat(F.lit(f"{target} eq "), F.col(key).cast("string")), ops=nested)).alias("ops"))


def parent_to_children(parents: DataFrame, key: str, children: DataFrame, foreign: str, child_id: str, fields: dict[str, str]) -> DataFrame:
    """Changed parent rows as operations of each of their child rows."""
    p = parents.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_p_{c}") for c in fields])
    joined = children.join(p, F.col(foreign) == F.col("_key"))
    return joined.select(F.col(child_id).cast("long").alias("entity_id"), F.lit(False).alias("creates_slot"), F.array(*[op("set", t, F.col(f"_p_{c}")) for c, t in fields.items()]).alias("ops"))
