"""Streams that keep a stored table current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import conditional_sums
from ..sources.store import Cursors, TableStore
from ..sources.tables import stream_log
from ..spec import IndexSpec
from .ops import apply


class OpsRunner:
    """Applies an operation log to a stored table, each micro-batch once.

    The batch's number is part of the name of the version that it gave, so both appear at
    once; a batch that is run again after a failure finds it and does nothing.
    """

    def __init__(self, store: TableStore, spec: IndexSpec, cursors: Cursors, name: str = "ops", clock: Callable[[], int] | None = None, most: int | None = None):
        self.store, self.spec, self.cursors, self.name, self.clock, self.most = store, spec, cursors, name, clock, most

    def batch(self, rows: DataFrame, number: int) -> None:
        last = self.cursors.get(self.name)
        if last is not None and int(last) >= number or self.store.has(f"{self.name}-{number}"):
            return
        table = self.store.load(self.spec)
        self.store.save(apply(table, rows, self.spec, self.clock() if self.clock else None, self.most), f"{self.name}-{number}")
        self.cursors.set(self.name, str(number))

    def start(self, spark: SparkSession, log: str, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream_log(spark, log).writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def lag(log: DataFrame, position: int) -> DataFrame:
    """Operations beyond a position of the log: ``n`` and the highest ``seq``."""
    return log.where(F.col("seq") > position).agg(F.count("*").alias("n"), F.coalesce(F.max("seq"), F.lit(position)).alias("head"))


def reconciled(events: DataFrame, state: DataFrame | None, key: str, ts: str, low: int, high: int, amount: str, kind: str, sums: dict[str, list[str]]) -> DataFrame:
    """Totals over all time of the entities that were active in [low, high), without those whose totals haven't changed.

    Windows may overlap: totals are absolute, so an entity that comes twice gives
    the same row and nothing the second time.
    """
    active = events.where((F.col(ts) >= low) & (F.col(ts) < high)).select(key).distinct()
    totals = conditional_sums(events.join(active, key, "left_semi"), key, amount, kind, sums)
    if state is None:
        return totals
    same = totals.alias("t").join(state.alias("s"), (F.col(f"t.{key}") == F.col(f"s.{key}")), "left")
    differs = F.lit(False)
    for name in sums:
        differs = differs | ~F.col(f"t.{name}").eqNullSafe(F.col(f"s.{name}"))
    return same.where(differs).select("t.*")


def windows(position: int, now: int, overlap: int, most: int) -> list[tuple[int, int]]:
    """The windows to reconcile: the trailing one with its overlap, or bounded pieces of a longer gap."""
    out, low = [], position - overlap
    while now - low > most:
        out.append((low, low + most))
        low += most
    return [*out, (low, now)]


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window; on a stream rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
