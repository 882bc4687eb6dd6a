"""A versioned table on shared storage: Parquet bases, delta files over them, compaction.

Each version is a folder; the newest complete one (it has ``_SUCCESS``) counts, so
a writer that dies leaves the old version in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import IndexSpec


class TableStore:
    """``base-<n>`` folders hold whole tables, ``delta-<n>-<k>`` folders changed rows (``_deleted`` marks deletes)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entries(self) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        done = []
        for status in fs.listStatus(root):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done.append(status.getPath().getName())
        return sorted(done)

    def versions(self) -> list[int]:
        return sorted(int(e[5:13]) for e in self._entries() if e.startswith("base-"))

    def has(self, mark: str) -> bool:
        """Whether a version was saved with this mark."""
        return any(e.startswith("base-") and e[14:] == mark for e in self._entries())

    def save(self, table: DataFrame, mark: str = "") -> int:
        """Writes a new base version; ``mark`` says what it is of and is part of its name."""
        version = (self.versions() or [0])[-1] + 1
        table.write.mode("overwrite").parquet(f"{self.path}/base-{version:08d}{'-' + mark if mark else ''}")
        return version

    def _base(self, version: int) -> str:
        return next(f"{self.path}/{e}" for e in self._entries() if e.startswith(f"base-{version:08d}"))

    def append(self, changes: DataFrame) -> None:
        """Writes changed rows over the newest base; later deltas win."""
        version = self.versions()[-1]
        prefix = f"delta-{version:08d}-"
        number = len([e for e in self._entries() if e.startswith(prefix)])
        rows = changes if "_deleted" in changes.columns else changes.withColumn("_deleted", F.lit(False))
        rows.write.mode("overwrite").parquet(f"{self.path}/{prefix}{number:08d}")

    def load(self, spec: IndexSpec, version: int | None = None) -> DataFrame:
        """The table of a version: its base with its deltas applied."""
        version = version or self.versions()[-1]
        base = self.spark.read.parquet(self._base(version))
        deltas = [e for e in self._entries() if e.startswith(f"delta-{version:08d}-")]
        return overlaid(base, [self.spark.read.parquet(f"{self.path}/{d}") for d in deltas], spec)

    def compact(self, spec: IndexSpec) -> int:
        """A new base with the deltas applied."""
        return self.save(self.load(spec))


def overlaid(base: DataFrame, deltas: list[DataFrame], spec: IndexSpec) -> DataFrame:
    """The base, without the ids that deltas touch, and the newest row of each of these unless it is a delete."""
    if not deltas:
        return base
    rows = None
    for n, d in enumerate(deltas):
        one = d.withColumn("_n", F.lit(n))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    names = [c for c in base.columns if c != spec.id]
    last = rows.groupBy(spec.id).agg(F.max_by(F.struct("_deleted", *names), "_n").alias("_r"))
    kept = base.join(last.select(spec.id), spec.id, "left_anti").select(*base.columns)
    return kept.unionByName(last.where("NOT _r._deleted").select(spec.id, *[F.col(f"_r.{c}").alias(c) for c in names]))


class Cursors:
    """Named positions on shared storage: name -> text, the last one written counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def set(self, name: str, value: str) -> None:
        import time

        row = self.spark.createDataFrame([(name, value, time.time_ns())], "name string, value string, at long")
        row.write.mode("append").parquet(self.path)

    def all(self) -> dict[str, str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return {}
        found = self.spark.read.schema("name string, value string, at long").parquet(self.path)
        return {r["name"]: r["value"] for r in found.groupBy("name").agg(F.max_by("value", "at").alias("value")).collect()}

    def get(self, name: str) -> str | None:
        return self.all().get(name)
