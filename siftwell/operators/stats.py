"""Counts of an index and of its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import IndexSpec


def slot_counts(ids: DataFrame, alive: str, cleaned: str | None = None, id: str = "id") -> DataFrame:
    """``alive``, ``clean`` and ``dead``; dead counts all ids up to the highest that are neither, gaps included."""
    clean = F.count_if(F.col(cleaned)) if cleaned else F.lit(0).cast("long")
    counts = ids.agg(F.count_if(F.col(alive)).alias("alive"), clean.alias("clean"), F.coalesce(F.max(id) + 1, F.lit(0)).alias("top"))
    return counts.select("alive", "clean", (F.col("top") - F.col("alive") - F.col("clean")).alias("dead"))


def _values(table: DataFrame, field: str, spec: IndexSpec) -> DataFrame:
    f = spec.field(field)
    value = F.explode(field) if f.multi else F.col(field)
    return table.select(F.col(spec.id), value.alias("value")).where("value IS NOT NULL")


def value_counts(table: DataFrame, field: str, spec: IndexSpec) -> DataFrame:
    """``value`` and ``n``, the rows that have it."""
    rows = _values(table, field, spec)
    if spec.field(field).multi:
        rows = rows.distinct()
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def distinct_values(table: DataFrame, fields: list[str], spec: IndexSpec) -> DataFrame:
    """One row: the number of distinct values of each field."""
    single = [n for n in fields if not spec.field(n).multi]
    found = table.agg(*[F.count_distinct(n).alias(n) for n in single], F.count("*").alias("_rows"))
    for name in (n for n in fields if spec.field(n).multi):
        one = table.select(F.explode(name).alias("v")).distinct().agg(F.count("v").alias(name))
        found = found.crossJoin(one)  # one row each
    return found.select(*fields)


def dictionary(table: DataFrame, field: str, spec: IndexSpec, order: str | None = None) -> DataFrame:
    """Strings of a field by their folded form, in the casing that came first (by ``order``, else by id)."""
    by = F.col(order or spec.id)
    return table.where(F.col(field).isNotNull()).groupBy(F.lower(field).alias("folded")).agg(F.min_by(field, by).alias("value"), F.count("*").alias("n"))


def conditional_sums(rows: DataFrame, key: str, amount: str, kind: str, sums: dict[str, list[str]]) -> DataFrame:
    """For each key, the amount summed over the rows of some kinds, one column for each group of kinds."""
    return rows.groupBy(key).agg(*[F.sum(F.when(F.col(kind).isin(kinds), F.col(amount)).otherwise(F.lit(0))).alias(name) for name, kinds in sums.items()])


def collected(pairs: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Distinct values of each key as an ascending array."""
    return pairs.where(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(name))


def size_histogram(sizes: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """Rows by the first edge that their size doesn't exceed (null: above all)."""
    edge = None
    for e in edges:
        edge = F.when(F.col(column) <= e, e) if edge is None else edge.when(F.col(column) <= e, e)
    return sizes.groupBy(edge.alias("up_to")).agg(F.count("*").alias("n"))


def percentiles(rows: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    return rows.agg(*[F.percentile_approx(column, s, accuracy).alias(f"p{round(s * 100)}") for s in shares])


def first_page_overlap(a: DataFrame, b: DataFrame, id: str = "id") -> DataFrame:
    """The Jaccard similarity of two pages of ids."""
    both = a.select(id).distinct().withColumn("_a", F.lit(1)).join(b.select(id).distinct().withColumn("_b", F.lit(1)), id, "full")
    return both.agg((F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.greatest(F.count("*"), F.lit(1))).alias("jaccard"))
