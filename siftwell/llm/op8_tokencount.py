"""Token counts: batch encoding in an Arrow function that returns lengths only.

Batches are balanced by bytes (``shared.steps``), long texts are split at safe
boundaries (``pieces``), and only numbers leave the Python worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted one by one; rows keep a null id; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import encoder
from .shared import arrow_ready, steps

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, cut: str = "before_space", limit: int = LIMIT) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row."""
    arrow_ready(df.sparkSession)

    def count(batches):
        for b in steps(batches):
            n = pa.array(encoder(name, cut, False).lengths(b.column(1)), pa.int64())
            size = pc.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[key].dataType.simpleString()
    pair = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pair.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
