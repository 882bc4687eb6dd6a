"""Sliding time buckets and scheduled visibility, always with the time given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import snapped
from ..spec import BucketSpec, IndexSpec


def member(spec: IndexSpec, bucket: BucketSpec, now: int, field: str | None = None) -> Column:
    """Whether a row's time lies in the last ``duration`` seconds."""
    return F.col(field or spec.time.field).between(now - bucket.duration, now)


def memberships(table: DataFrame, spec: IndexSpec, now: int) -> DataFrame:
    """(bucket, id) rows, the materialised form of all buckets."""
    flags = [F.when(member(spec, b, now), F.lit(b.name)) for b in spec.time.buckets]
    return table.select(F.explode(F.array_compact(F.array(*flags))).alias("bucket"), F.col(spec.id))


def refreshed(old: DataFrame, table: DataFrame, spec: IndexSpec, bucket: str, last_cutoff: int, now: int, last_now: int) -> DataFrame:
    """A bucket's ids moved from one time to a later one without a full scan of its rows.

    Rows between the old and the new cutoff leave, rows that have come since enter.
    """
    b = next(x for x in spec.time.buckets if x.name == bucket)
    at = F.col(spec.time.field)
    cutoff = now - b.duration
    gone = table.where((at >= last_cutoff) & (at < cutoff)).select(spec.id)
    new = table.where((at > last_now) & (at <= now)).select(spec.id)
    return old.join(gone, spec.id, "left_anti").union(new).distinct()


def cutoff_grid(spec: IndexSpec, bucket: str, now: int) -> int:
    """The cutoff rounded down to the bucket's refresh interval."""
    b = next(x for x in spec.time.buckets if x.name == bucket)
    return (now - b.duration) // b.refresh * b.refresh


def grid_column(ts: Column, interval: int) -> Column:
    return snapped(ts, interval)


def audit(table: DataFrame, kept: DataFrame, spec: IndexSpec, now: int, most: int = 1000, order: str = "lowest_id") -> DataFrame:
    """For each bucket: ``n`` ids kept, ``n_missing`` and ``n_stale`` against the table, and samples of both.

    ``order`` of the samples: lowest_id, highest_id or random; at most ``most`` ids each.
    """
    true = memberships(table, spec, now)
    both = kept.select("bucket", spec.id).withColumn("_kept", F.lit(1)).join(true.withColumn("_true", F.lit(1)), ["bucket", spec.id], "full")
    missing, stale = F.col("_kept").isNull(), F.col("_true").isNull()
    key = {"lowest_id": F.col(spec.id).asc(), "highest_id": F.col(spec.id).desc(), "random": F.xxhash64(spec.id).asc()}[order]
    from pyspark.sql import Window

    counts = both.groupBy("bucket").agg(F.count_if(F.col("_kept").isNotNull()).alias("n"), F.count_if(missing).alias("n_missing"), F.count_if(stale).alias("n_stale"))
    odd = both.where(missing | stale).withColumn("_kind", F.when(missing, "missing").otherwise("stale"))
    ranked = odd.withColumn("_rank", F.row_number().over(Window.partitionBy("bucket", "_kind").orderBy(key))).where(F.col("_rank") <= most)
    samples = ranked.groupBy("bucket").agg(
        *[F.transform(F.sort_array(F.collect_list(F.when(F.col("_kind") == kind, F.struct("_rank", spec.id)))), lambda s: s[spec.id]).alias(kind) for kind in ("missing", "stale")]
    )
    names = spec.time.buckets and [(b.name,) for b in spec.time.buckets]
    every = table.sparkSession.createDataFrame(names, "bucket string")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_missing", "n_stale")]
    lists = [F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("missing", "stale")]
    return every.join(counts, "bucket", "left").join(samples, "bucket", "left").select("bucket", *zero, *lists)


def visible_rows(table: DataFrame, spec: IndexSpec, now: int) -> DataFrame:
    """Rows whose schedule has come or who have none."""
    at = F.col(spec.time.deferred)
    return table.where(at.isNull() | (at <= now))


def due(table: DataFrame, spec: IndexSpec, after: int, now: int) -> DataFrame:
    """Rows that became visible between two times."""
    at = F.col(spec.time.deferred)
    return table.where((at > after) & (at <= now))
