"""Named indexes with the verbs of a server, as Python calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Conflict, FieldNotFound
from .operators import buckets, documents, mutate, stats
from .operators.query import Result
from .plans.ast import Clause, Query
from .plans.compile import Prefilters, matches
from .plans.parsers import Registry, standard_registry
from .sources import dump, ndjson
from .sources.store import Cursors, TableStore
from .spec import FieldSpec, IndexSpec
from .streaming import ops as op_batches


class Index:
    """One table under one specification.  Writes give a new frame; ``snapshot`` stores it."""

    def __init__(self, spark: SparkSession, spec: IndexSpec, path: str, clock: Callable[[], int], registry: Registry):
        self.spark, self.spec, self.path, self.clock, self.registry = spark, spec, path, clock, registry
        self.store = TableStore(spark, f"{path}/table")
        self.cursors = Cursors(spark, f"{path}/cursors")
        self.prefilters = Prefilters()
        self.manifest = dump.Manifest()
        self.table: DataFrame = spark.createDataFrame([], spec.schema())

    # reads

    def query(self, text: str | bytes | dict | Query, format: str | None = None, now: int | None = None) -> Result:
        query = text if isinstance(text, Query) else self.registry.parse(text, format)
        return Result(self.table, query, self.spec, self.clock() if now is None else now, self.prefilters if self.prefilters.sets else None, documents.VERSION)

    def get(self, ids: Iterable[int]) -> DataFrame:
        """Documents in the order of the ids; those that aren't there have the id alone."""
        rows = self.spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{self.spec.id} long, position int")
        found = documents.by_ids(documents.shown(self.table, self.spec), rows, self.spec)
        return found.drop("position")

    def matches(self, id: int, filters: Iterable[Clause]) -> bool:
        return matches(self.table, id, filters, self.spec, self.clock())

    def explain(self, text: str | bytes | dict | Query, format: str | None = None) -> None:
        self.query(text, format).rows.explain("formatted")

    def stats(self) -> dict[str, Any]:
        names = [f.name for f in self.spec.fields if f.filter and f.name in self.table.columns]
        row = stats.distinct_values(self.table, names, self.spec).withColumn("_alive", F.lit(self.table.count())).first().asDict()
        return {"alive": row.pop("_alive"), "distinct": row}

    def dictionary(self, field: str) -> DataFrame:
        return stats.dictionary(self.table, field, self.spec)

    # writes

    def upsert(self, rows: DataFrame, order: str | None = None, cursor: tuple[str, str] | None = None) -> DataFrame:
        """Applies what it can; returns the rows that failed, with their errors."""
        self.table, failed = mutate.batch(self.table, rows, self.spec, order)
        if cursor:
            self.cursors.set(*cursor)
        return failed

    def patch(self, rows: DataFrame, order: str | None = None) -> None:
        self.table = mutate.patch(self.table, rows, self.spec, order)

    def delete(self, ids: DataFrame, strict: bool = False) -> None:
        self.table = mutate.delete(self.table, ids, self.spec, strict)

    def delete_where(self, filters: Iterable[Clause]) -> int:
        """Deletes and counts."""
        before, filters = self.table.count(), tuple(filters)
        self.table = mutate.delete_where(self.table, filters, self.spec, self.clock())
        return before - self.table.count()

    def filter_sync(self, sets: DataFrame, field: str) -> None:
        self.table = mutate.filter_sync(self.table, sets, field, self.spec)

    def apply_ops(self, batch: DataFrame, most: int | None = None) -> None:
        self.table = op_batches.apply(self.table, batch, self.spec, self.clock(), most)

    # loads

    def load_ndjson(self, path: str, id_source: str | None = None) -> DataFrame:
        """Upserts a file; returns the lines that failed."""
        rows, failed = ndjson.load(self.spark, path, self.spec, id_source)
        self.table = mutate.put(self.table, rows, self.spec)
        return failed

    def load_dumps(self, requests: Iterable[dump.DumpRequest]) -> bool:
        """Runs the phases that have changed and merges them; False if none has."""
        todo = [r for r in requests if self.manifest.changed(r)]
        if not todo:
            return False
        loaded = dump.merged([dump.phase(self.spark, r, self.spec.id) for r in todo], self.spec.id)
        kinds = {f.name: f for f in self.spec.fields}
        typed = [F.col(c).cast(kinds[c].data_type()).alias(c) if c in kinds else F.col(c) for c in loaded.columns]
        self.table = mutate.patch(self.table, dump.kept(loaded.select(*typed), self.spec.id), self.spec, insert=True)
        for r in todo:
            self.manifest.loaded(r)
        return True

    # maintenance

    def snapshot(self) -> int:
        version = self.store.save(self.table)
        self.table = self.store.load(self.spec)
        return version

    def restore(self, version: int | None = None) -> None:
        self.table = self.store.load(self.spec, version)

    def rebuild(self, fields: Iterable[str] | None = None) -> None:
        self.table = mutate.rebuild(self.table, self.spec, fields)

    def compact(self) -> int:
        return self.store.compact(self.spec)

    def add_field(self, f: FieldSpec, value: Column | None = None) -> None:
        self.table, self.spec = mutate.add_field(self.table, self.spec, f, value)

    def remove_field(self, name: str) -> None:
        self.table, self.spec = mutate.drop_field(self.table, self.spec, name)

    def configure(self, **changes: Any) -> None:
        self.spec = self.spec.replace(**changes)

    def register_prefilter(self, name: str, filters: Iterable[Clause]) -> None:
        self.prefilters.register(name, filters, self.table, self.spec, self.clock())

    def refresh_prefilters(self, every: int) -> list[str]:
        """Refreshes the prefilters that are ``every`` seconds old or older."""
        return self.prefilters.refresh_due(every, self.table, self.spec, self.clock())

    def refresh_prefilter(self, name: str) -> None:
        self.prefilters.refresh(name, self.table, self.spec, self.clock())

    def bucket_rows(self) -> DataFrame:
        return buckets.memberships(self.table, self.spec, self.clock())

    def audit_buckets(self, kept: DataFrame, most: int = 1000, order: str = "lowest_id") -> DataFrame:
        return buckets.audit(self.table, kept, self.spec, self.clock(), most, order)


class Engine:
    """Indexes under one root folder."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] | None = None):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock or (lambda: int(time.time()))
        self.registry = standard_registry()
        self.indexes: dict[str, Index] = {}

    def create(self, spec: IndexSpec) -> Index:
        if spec.name in self.indexes:
            raise Conflict(spec.name)
        self.indexes[spec.name] = Index(self.spark, spec, f"{self.root}/{spec.name}", self.clock, self.registry)
        return self.indexes[spec.name]

    def list(self) -> list[str]:
        return sorted(self.indexes)

    def get(self, name: str) -> Index:
        if name not in self.indexes:
            raise FieldNotFound(f"no index {name}")
        return self.indexes[name]

    def drop(self, name: str) -> None:
        self.get(name)
        del self.indexes[name]

    def formats(self) -> dict[str, Any]:
        return {"formats": self.registry.formats(), "default": self.registry.default}
