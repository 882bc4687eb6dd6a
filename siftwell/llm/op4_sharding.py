"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0 .. n-1 in ascending ``doc_id`` order.  A keyed
permutation of those numbers is the shuffle; position p goes to shard p % k, slot
p // k, so shard sizes differ by one at most (law ``rows``) and anybody who knows
(seed, n, k) computes a row's place, or the row at a place, without a lookup.

Defined results: a null id sorts first; a null text counts as empty; rows that
are equal in all columns get different numbers among themselves, which of them
gets which does not matter; an empty table gives an empty result; other columns
are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import frugal, mix, shuffle_parts, stored

ROUNDS = 4
SHARDS = 8
SEED = 17


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced Feistel domain of at least n values."""
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _network(x: np.ndarray, keys: np.ndarray, bits: int, back: bool) -> np.ndarray:
    b, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & low
    if back:
        for k in keys[::-1]:
            left, right = right ^ (mix(left + k) & low), left
    else:
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
    return left << b | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The place of each row number below n under the seed's permutation (``back``: the row at each place)."""
    bits, keys = half_bits(n), _keys(seed)
    out = _network(rows.astype(np.uint64), keys, bits, back)
    while len(far := np.flatnonzero(out >= np.uint64(n))):  # walk the cycle until it is back among the rows
        out[far] = _network(out[far], keys, bits, back)
    return out.astype(np.int64)


def numbered(df: DataFrame, by: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with global row numbers in the order of ``by``, without a single-task window.

    A range-partitioned, sorted copy keeps each row's partition and place; the
    partitions' sizes (one number each) then give the offsets.
    """
    part, pos, off = f"{name}__part", f"{name}__pos", f"{name}__off"
    tie = f"{name}__tie"
    parts = shuffle_parts(df.sparkSession)
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *by, tie).sortWithinPartitions(*by, tie)
    at = F.monotonically_increasing_id()
    kept = stored(dealt.drop(tie).withColumns({part: F.shiftright(at, 33).cast("int"), pos: at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = sorted((r[0], r[1]) for r in kept.groupBy(part).count().collect())  # a row for each shuffle partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    # as an Arrow table: rows of a list would start Python workers of another kind, which stay
    offset = df.sparkSession.createDataFrame(pa.table({part: pa.array([p for p, _ in offsets], pa.int32()), off: pa.array([n for _, n in offsets], pa.int64())}))
    out = kept.join(F.broadcast(offset), part).withColumn(name, F.col(off) + F.col(pos)).drop(part, pos, off)
    out.total_rows = total
    return out


def shards(df: DataFrame, by: list[str], k: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with its ``shard``, ``slot`` and ``place`` columns."""
    rows = numbered(df, by)
    n, schema = rows.total_rows, rows.schema

    def place(batches):
        for batch in batches:
            at = permute(batch.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array((at % k).astype(np.int32)), pa.array(at // k)], [*batch.schema.names, "place", "shard", "slot"])

    return rows.mapInArrow(frugal(place), T.StructType([*schema.fields, T.StructField("place", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return shards(small, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op4_feistel_sharding": op4_feistel_sharding}
ORACLE: dict[str, str] = {}
