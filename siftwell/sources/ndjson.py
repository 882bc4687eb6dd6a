"""Newline-delimited JSON into an index table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import as_integer, loaded, valid_id, with_computed
from ..spec import FieldSpec, IndexSpec

CORRUPT = "_corrupt"


def raw_type(f: FieldSpec) -> T.DataType:
    """How a source column is read: loosely, so that a value of another type is converted, not lost."""
    return T.ArrayType(T.StringType()) if f.multi else T.BooleanType() if f.value_type == "boolean" else T.StringType()


def raw_schema(spec: IndexSpec, id_source: str | None = None) -> T.StructType:
    columns: dict[str, T.DataType] = {id_source or spec.id: T.StringType()}
    for f in spec.fields:
        if not f.computed:
            columns.setdefault(f.source or f.name, raw_type(f))
            if f.fallback:
                columns.setdefault(f.fallback, raw_type(f))
    return T.StructType([*[T.StructField(n, t) for n, t in columns.items()], T.StructField(CORRUPT, T.StringType())])


def read_raw(spark: SparkSession, path: str, spec: IndexSpec, id_source: str | None = None) -> DataFrame:
    """Every line, those that aren't JSON with their text in ``_corrupt``."""
    return spark.read.schema(raw_schema(spec, id_source)).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def documents(raw: DataFrame, spec: IndexSpec, id_source: str | None = None) -> DataFrame:
    """Raw rows as rows of the index: converted, defaults applied, computed fields derived."""
    key = as_integer(F.col(f"`{id_source or spec.id}`"), raw.schema[id_source or spec.id].dataType).alias(spec.id)
    plain = [loaded(f, raw.schema) for f in spec.fields if not f.computed]
    table = with_computed(raw.select(key, *plain), spec)
    return table.select(spec.id, *[f.name for f in spec.fields if f.name in table.columns])


def problem(raw: DataFrame, spec: IndexSpec, id_source: str | None = None) -> Column:
    """Why a raw row can't be loaded; null if it can."""
    source = id_source or spec.id
    key = as_integer(F.col(f"`{source}`"), raw.schema[source].dataType)
    bad = F.when(F.col(CORRUPT).isNotNull(), "not JSON") if CORRUPT in raw.columns else F.when(F.lit(False), "")
    return bad.when(key.isNull(), "no id").when(~valid_id(key), "id out of range")


def load(spark: SparkSession, path: str, spec: IndexSpec, id_source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that load, and the others with a ``problem``; bad lines are counted, not fatal."""
    raw = read_raw(spark, path, spec, id_source)
    judged = raw.withColumn("problem", problem(raw, spec, id_source))
    return documents(judged.where("problem IS NULL").drop("problem"), spec, id_source), judged.where("problem IS NOT NULL")


def load_stats(raw: DataFrame, spec: IndexSpec, id_source: str | None = None) -> DataFrame:
    """One row: ``loaded`` and ``failed`` lines."""
    failed = problem(raw, spec, id_source).isNotNull()
    return raw.agg(F.count_if(~failed).alias("loaded"), F.count_if(failed).alias("failed"))
