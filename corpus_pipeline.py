"""The corpus pipeline: five stages over ``documents``, each written before the next one reads it.

1. quality: the rule ledger's policy ``corpus``; documents that it rejects go.
2. near_duplicates: of each group of linked documents the one with the smallest id stays.
3. decontamination: documents with a passage of a benchmark item go.
4. mixing: each document stays with the probability of its rate; rates of 1 and
   more keep it once, so the scaling domain (clean) stays whole, and a domain that is
   below its target is left as it is.
5. sharding: a reproducible shuffle; adds place, shard and slot.

Every stage works on all that its predecessor kept and all but the last return
the columns of ``documents``.  Decisions are taken by ``doc_id``: rows of one id stay
or go together, except that stage 2 keeps one of them.  A row with a null id is
judged by stage 1 alone and otherwise kept.  Null, empty and very long texts,
empty tables and further columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import op1_quality, op3_decontamination, op4_sharding, op6_mixing, op10_jaccard
from siftwell.llm.shared import scratch, stored

_ID = "__decided_id"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone``; other columns may have any names."""
    ids = gone.select(F.col(gone.columns[0]).alias(_ID)).distinct()
    return docs.join(ids, docs["doc_id"] == ids[_ID], "left_anti")


def _pages_by_bytes(spark: SparkSession) -> None:
    """Parquet writers look at a page's bytes after a few rows (by default after 100), since documents may be very long."""
    spark.conf.set("parquet.page.size.row.check.min", "4")
    spark.conf.set("parquet.block.size.row.check.min", "4")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _pages_by_bytes(spark)
    return op1_quality.judged(docs, policy="corpus")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    again = docs.select("doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.limit(1).count():  # rows that share an id: one of them stays
        named = again.withColumnRenamed("doc_id", _ID)
        several = docs.join(named, docs["doc_id"] == named[_ID], "left_semi").dropDuplicates(["doc_id"])
        docs = stored(_without(docs, again).unionByName(several), "single")
    found = op10_jaccard.join_components(docs.select("doc_id", "text").where("doc_id IS NOT NULL"))
    return _without(docs, found.where("doc_id <> component_id").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op3_decontamination.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated AND doc_id IS NOT NULL").select("doc_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op6_mixing.mixed(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), grow=False)
    out = found.where((op6_mixing.drawn() >= F.col("rate")) & F.col("doc_id").isNotNull()).select("doc_id")
    return _without(docs, out)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    placed = op4_sharding.shards(plain.select(names["doc_id"], F.struct(*names.values()).alias("row")), [names["doc_id"]])
    return placed.select(*[F.col(f"row.{n}").alias(c) for c, n in names.items() if c not in ("place", "shard", "slot")], "place", "shard", "slot")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Mixing fits a model; the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
