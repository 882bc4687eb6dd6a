"""What stays of Python workers between tasks."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwell.llm import op3_decontamination as op3
from siftwell.llm import op4_sharding as op4
from siftwell.llm import shared


def resident() -> int:
    """MB of this process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


def test_freed_memory_goes_back():
    """96 MB in small arrays, freed below one that stays: without a trim the process keeps them."""
    stays = []

    def run(batches):
        for b in batches:
            many = [np.ones(8_000) for _ in range(1_500)]
            stays.append(np.ones(8_000))
            yield b
            del many

    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    before = resident()
    assert list(shared.frugal(run)(iter([batch]))) == [batch]
    assert resident() - before < 32


def test_word_strings_are_the_words():
    texts = ["", " a  bb\n", "ccc", "dd", None, "é x"]
    (batch,) = shared.steps(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    words = shared.Words(batch.column(0))
    assert words.strings().to_pylist() == ["a", "bb", "ccc", "dd", "é", "x"] and words.counts.tolist() == [0, 2, 1, 1, 0, 2]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_decontamination_by_one_worker_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "x")], "item_id long, text string")
    found = op3.contamination(docs, items)
    assert plan(found).count("MapInArrow") == 1
    monkeypatch.setattr(op3, "BLOCK_BYTES", 1)
    several = op3.contamination(docs, items)
    assert plan(several).count("MapInArrow") > 1 and sorted(several.collect()) == sorted(found.collect())


def test_row_numbers_start_no_other_workers(spark):
    rows = op4.numbered(spark.range(20).select(F.col("id").alias("doc_id")), ["doc_id"])
    assert "ExistingRDD" not in plan(rows)
    assert [r.row_number for r in rows.orderBy("doc_id").collect()] == list(range(20))
