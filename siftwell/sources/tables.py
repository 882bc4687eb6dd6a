"""Tables that loads start from: databases, row parsers for their exports, operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.convert import flag

OP = "struct<op:string,field:string,value:string,query:string,ops:string>"
OPS_SCHEMA = f"seq long, entity_id long, creates_slot boolean, ops array<{OP}>"


def jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database query, split over ``parts`` ranges of ``key``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if key and parts > 1:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def typed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as the types given: long, boolean (t and f) or string; values that don't fit are null, short rows too."""
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")
        return (c if kind == "string" else c.try_cast(kind)).alias(name)

    return rows.select(*[one(n, k) for n, k in kinds.items()])


def flagged(rows: DataFrame, column: str, flags: dict[str, tuple[tuple[int, ...], tuple[int, ...]]]) -> DataFrame:
    """Booleans from bits: each is (bits that must be set, bits that must not)."""
    return rows.withColumns({name: F.coalesce(flag(F.col(column), on, off), F.lit(False)) for name, (on, off) in flags.items()})


def latest(rows: DataFrame, name: str, *times: str) -> DataFrame:
    """The greatest of the times that are there, 0 if none is."""
    return rows.withColumn(name, F.coalesce(F.greatest(*[F.col(t) for t in times]), F.lit(0)))


def as_value(value: Column) -> Column:
    """A column as the JSON text that operations carry."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1)


def op(kind: str, field: str | None = None, value: Column | None = None, query: Column | None = None, ops: Column | None = None, text: Column | None = None) -> Column:
    """One operation; its value is a column, or JSON ``text`` (inside array functions, where a struct loses its names)."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("op"), F.lit(field).cast("string").alias("field"), (text if text is not None else as_value(value) if value is not None else none).alias("value"), (query if query is not None else none).alias("query"), (ops if ops is not None else none).alias("ops")
    ).cast(OP)


def rows_to_ops(rows: DataFrame, id: str, fields: dict[str, str], creates: bool = True) -> DataFrame:
    """Table rows as operations that set each field; ``fields`` maps columns to targets."""
    return rows.select(F.col(id).cast("long").alias("entity_id"), F.lit(creates).alias("creates_slot"), F.array(*[op("set", t, F.col(c)) for c, t in fields.items()]).alias("ops"))


def pairs_to_ops(rows: DataFrame, id: str, column: str, target: str) -> DataFrame:
    """(id, value) rows as operations that add to a multi-value field."""
    return rows.select(F.col(id).cast("long").alias("entity_id"), F.lit(False).alias("creates_slot"), F.array(op("add", target, F.col(column))).alias("ops"))


def append_log(ops: DataFrame, path: str) -> None:
    """Appends a batch of operations to a log folder of JSON lines."""
    ops.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPS_SCHEMA).json(path)


def stream_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The log as a stream; its checkpoint is the reader's cursor."""
    return spark.readStream.schema(OPS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)

