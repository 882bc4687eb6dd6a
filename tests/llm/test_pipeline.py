"""Mixing against plain Python and held-out labels, and the pipeline's stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import op6_mixing as op6

from .texts import sentence
from .test_pairs import brute_components


def labelled(n=600, seed=4):
    r = random.Random(seed)
    bad = ["awful", "vile", "rotten", "nasty"]
    docs, labels = [], []
    for i in range(n):
        kind = r.choice([0, 0, 0, 1, 2])
        words = sentence(r, r.randint(60, 160))
        if kind == 2:
            for _ in range(6):
                words[r.randrange(len(words))] = r.choice(bad)
        if kind == 1:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    return spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    train, test = labels.where("doc_id % 3 > 0"), op6.domain_of(labels.where("doc_id % 3 = 0"))
    found = op6.posteriors(docs, *op6.fitted(docs, op6.domain_of(train))).join(test, "doc_id")
    right = F.col("domain") == F.when(F.col("q2") > 16, 2).when(F.col("q1") > 16, 1).otherwise(0)
    assert found.agg(F.avg(right.cast("int"))).first()[0] > 0.95
    assert found.where(F.col("q0") + F.col("q1") + F.col("q2") != op6.GRID).count() == 0


def least_squares(q, tokens, want, base):
    """The least weighted squared deviation over all nonnegative rates, by trying every set of positive ones."""
    a = (q / op6.GRID * tokens[:, None]).T / base[:, None] * np.sqrt(base)[:, None]
    b = want / base * np.sqrt(base)
    best = float(b @ b)
    for picked in range(1, 1 << len(q)):
        on = [k for k in range(len(q)) if picked >> k & 1]
        x = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
        if (x >= 0).all():
            best = min(best, float(((a[:, on] @ x - b) ** 2).sum()))
    return best


@pytest.mark.parametrize("seed, targets", [(2, (0.8, 0.15, 0.05)), (3, (0.98, 0.019, 0.001)), (4, (1.0, 0.0, 0.0)), (5, (0.1, 0.1, 0.8)), (6, (0.5, 0.0, 0.5))])
def test_rates_are_the_optimum(seed, targets):
    r = np.random.default_rng(seed)
    q = r.multinomial(op6.GRID, [0.7, 0.2, 0.1], 7)
    if seed % 2:
        q[:3] = op6.GRID * np.eye(3, dtype=int)
    tokens = r.integers(50, 5000, 7)
    rates = np.array(op6.descend([(*map(int, a), int(t)) for a, t in zip(q, tokens)], dict(zip(op6.DOMAINS, targets))))
    share = q / op6.GRID
    base = share.T @ tokens
    want = base[0] / targets[0] * np.array(targets)
    off = (share.T @ (rates * tokens) - want) / base
    assert (rates >= 0).all()
    least = least_squares(q, tokens.astype(float), want, base)
    assert float((base * off * off).sum()) <= least + 1e-6 * max(1.0, least)
    if least < 1e-9:
        assert np.abs(off).max() < 1e-4


def test_mixing_meets_targets_beside_clashing_columns(spark, tables):
    docs, labels = tables
    names = ["domain", "__id", "rate", "feature", "rid", "n_tokens"]
    found = op6.mixed(docs.select("*", *[F.lit("x").alias(n) for n in names]), labels)
    assert found.columns == ["doc_id", "n_tokens", "p_clean", "p_low", "p_toxic", "rate"] and found.count() == 600
    kinds = op6.DOMAINS
    was, now = (found.agg(*[F.sum(F.col(f"p_{d}") * F.col("n_tokens") * w).alias(d) for d in kinds]).first() for w in (F.lit(1.0), F.col("rate")))
    for d in kinds:
        assert abs(now[d] - was["clean"] * op6.TARGETS[d] / op6.TARGETS["clean"]) < 1e-3 * was[d]


def test_mixing_without_labels(spark, tables):
    docs, labels = tables
    found = op6.mixed(docs, labels.where("false"))
    assert found.where("rate <> 1 OR p_clean <> 1").count() == 0 and found.count() == 600
    assert op6.mixed(docs.where("false"), labels).count() == 0


def test_quality_keeps_long_clean_text(spark):
    """200,000 words, 4 percent of them distinct and hardly any three in a row again."""
    r = random.Random(3)
    book = " ".join(f"word{r.randrange(8000)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, book), (2, "too short"), (3, "the same words again " * 3000)], "doc_id long, text string")
    assert [x.doc_id for x in corpus_pipeline.quality(spark, docs, "").collect()] == [1]


def recognised(found, labels, kind):
    """The mean posterior of the domain over the documents that are of it."""
    return found.join(op6.domain_of(labels), "doc_id").where(F.col("domain") == kind).agg(F.avg(F.col(f"q{kind}") / op6.GRID)).first()[0]


def test_mixing_rare_domain(spark, tables, monkeypatch):
    """1,500 clean labels, 12 toxic ones: a sample of 300 has all of these."""
    monkeypatch.setattr(op6, "SAMPLE", 300)
    docs, labels = tables
    r = random.Random(8)
    more = spark.createDataFrame([(10_000 + i, " ".join(sentence(r, 80)), "x") for i in range(1500)], "doc_id long, text string, source string")
    toxic = [x.doc_id for x in labels.where("toxic = 1").orderBy("doc_id").limit(12).collect()]
    gone = spark.createDataFrame([(50_000 + i, 1, 1) for i in range(3000)], labels.schema)  # labels without a document
    some = more.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).union(labels.where(F.col("doc_id").isin(toxic))).union(gone)
    both = docs.union(more)
    chosen, total = op6.sampled(both, op6.domain_of(some))
    n = {x["domain"]: x["count"] for x in chosen.groupBy("domain").count().collect()}
    assert total == [1500, 0, 12] and n[2] == 12 and 200 < n[0] < 380
    found = op6.posteriors(both, *op6.fitted(both, op6.domain_of(some)))
    assert recognised(found, labels.where(~F.col("doc_id").isin(toxic)), 2) > 0.8
    assert recognised(found, some, 0) > 0.98
    rates = op6.mixed(both, some).join(labels.where("quality = 1"), "doc_id").groupBy("toxic").agg(F.avg("rate")).collect()
    assert dict(map(tuple, rates))[1] < 0.25 and dict(map(tuple, rates))[0] > 0.9


def test_mixing_few_labels(spark, tables):
    """80 labels, of them 9 of each small domain."""
    docs, labels = tables
    parts = [labels.where(w).orderBy("doc_id").limit(n) for w, n in (("quality = 1 AND toxic = 0", 62), ("quality = 0", 9), ("toxic = 1", 9))]
    some = parts[0].union(parts[1]).union(parts[2])
    found = op6.posteriors(docs, *op6.fitted(docs, op6.domain_of(some)))
    rest = labels.join(some, "doc_id", "left_anti")
    assert min(recognised(found, rest, d) for d in range(3)) > 0.5


def test_stages(spark, tables, tmp_path):
    docs, labels = tables
    rows = sorted(tuple(r) for r in docs.collect())
    rows += [(1000 + k, t, "y") for k, (_, t, _) in enumerate(rows[:20])] + [(None, rows[0][1], None), (2000, None, "z"), (2001, "too short", "z"), (5, rows[5][1], "again")]
    leak = min(r[0] for r in labels.where("doc_id >= 30 AND quality = 1 AND toxic = 0").collect())
    bench = [(0, " ".join(dict((r[0], r[1]) for r in rows)[leak].split()[3:20]))]
    base = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(f"{base}/documents.parquet")
    labels.write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    kept = spark.read.parquet(f"{base}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept.columns
        out = stage(spark, kept, base)
        out.write.parquet(f"{base}/{name}")
        kept = spark.read.parquet(f"{base}/{name}")
        seen[name] = sorted(r[0] if r[0] is not None else -1 for r in kept.select("doc_id").collect())
        assert name == "sharding" or kept.columns == before
    good = seen["quality"]
    assert not {2000, 2001} & set(good)
    groups = brute_components([(i, t) for i, t, _ in rows if i in set(good)])
    assert [i for i in seen["near_duplicates"] if i >= 0] == sorted({c for _, c in groups.values()}) and seen["near_duplicates"][0] == -1
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {leak}
    kinds = {i: t for i, _, t in [tuple(r) for r in labels.collect()]}
    toxic = [i for i in seen["decontamination"] if kinds.get(i)]
    clean = [i for i in seen["decontamination"] if kinds.get(i) == 0]
    assert len(set(toxic) & set(seen["mixing"])) <= 0.1 * len(toxic) and len(set(clean) - set(seen["mixing"])) <= 0.05 * len(clean)
    assert seen["sharding"] == seen["mixing"] and set(kept.columns) == {"doc_id", "text", "place", "shard", "slot"}
