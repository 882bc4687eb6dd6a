"""Operators on pairs of documents against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwell.llm import op9_substrings as op9
from siftwell.llm import op10_jaccard as op10

from .texts import corpus


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = Counter()
    where = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            for j in where[s]:
                common[j, i] += 1
            where[s].append(i)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def brute_windows(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(b" ".join(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def families(seed):
    """Texts that share a line and little else, copies of one text at all distances, and copies of copies."""
    r = random.Random(seed)

    def some(n):
        return [f"w{r.randrange(10**9)}" for _ in range(n)]

    line, base, rows = some(14), some(120), []
    for _ in range(40):
        rows.append(line + some(r.randrange(0, 40)))
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randrange(0, 9)):
            at = r.randrange(len(copy))
            copy[at : at + r.choice([0, 1, 1])] = [f"e{r.randrange(6)}"] * r.choice([0, 1, 1])
        rows.append(copy)
        if r.random() < 0.4:
            near = list(copy)
            near[r.randrange(len(near))] = "again"
            rows.append(near)
    rows += [base[: 120 - k] for k in range(0, 60, 4)]
    r.shuffle(rows)
    return list(enumerate(" ".join(w) for w in rows))


@pytest.mark.parametrize("heavy", [3, 8, 32])
def test_jaccard_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(op10, "HEAVY", heavy)
    monkeypatch.setattr(op10, "RARE", min(heavy, 5))
    monkeypatch.setattr(op10, "PLACE_PAIRS", 4)
    monkeypatch.setattr(op10, "GROUP_ROWS", 7)
    if heavy == 8:
        monkeypatch.setattr(op10, "BROADCAST_BYTES", 0)
    rows = corpus(heavy)
    rows += [(1000 + i, t) for i, t in families(heavy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r[0]: (r[1], r[2]) for r in op10.join_components(docs).collect()}
    assert found == brute_components(rows)


def test_jaccard_lists_no_pairs_of_a_shared_line(spark, monkeypatch):
    """Texts with one line in common share no rare shingle: none of their pairs is compared."""
    compared = []
    real = op10.verified
    monkeypatch.setattr(op10, "HEAVY", 4)
    monkeypatch.setattr(op10, "RARE", 4)
    monkeypatch.setattr(op10, "verified", lambda texts, pairs: compared.append(pairs.count()) or real(texts, pairs))
    r = random.Random(2)
    line = [f"w{r.randrange(10**9)}" for _ in range(14)]
    rows = [(k, " ".join(line + [f"w{r.randrange(10**9)}" for _ in range(30)])) for k in range(60)]
    found = op10.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({x["component_id"] for x in found}) == 60 and sum(compared) == 0


def test_jaccard_of_rows_without_an_id_of_their_own(spark):
    """Rows that repeat an id or have none are documents of their own; a component is called by its least id."""
    r = random.Random(6)
    rows = []
    for k in range(0, 160, 4):
        large = [f"w{r.randrange(10**9)}" for _ in range(129)]
        other = [f"w{r.randrange(10**9)}" for _ in range(140)]
        rows += [(k, large), (k, large[:100]), (k + 1, other), (k, other[:130]), (None, large[5:]), (None, [f"w{r.randrange(10**9)}" for _ in range(30)]), (k + 2, None), (None, None)]
    r.shuffle(rows)
    text = [(i, None if w is None else " ".join(w)) for i, w in rows]
    brute = brute_components([(k, t) for k, (_, t) in enumerate(text)])
    least = {}
    for k, (n, c) in brute.items():
        if text[k][0] is not None:
            least[c] = min(least.get(c, 10**9), text[k][0])
    docs = spark.createDataFrame(text, "doc_id long, text string").repartition(3)
    found = Counter(tuple(x) for x in op10.join_components(docs).collect())
    assert found == Counter((text[k][0], n, least.get(c)) for k, (n, c) in brute.items())


@pytest.mark.parametrize("common, heavy", [(64, 1_000), (2, 5), (2, 1_000)])
def test_windows_removed(spark, monkeypatch, common, heavy):
    monkeypatch.setattr(op9, "COMMON", common)
    monkeypatch.setattr(op9, "HEAVY", heavy)
    rows = corpus(5) + [(1000 + i, t) for i, t in families(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op9.deduplicated(docs).collect()}
    assert found == brute_windows(rows)


def test_windows_that_documents_repeat(spark, monkeypatch):
    """A window that many documents repeat is sent once by each, and goes at every place of theirs."""
    monkeypatch.setattr(op9, "COMMON", 2)
    monkeypatch.setattr(op9, "HEAVY", 4)
    line = " ".join(f"w{k}" for k in range(13))
    rows = [(k, " ".join(f"{line} own{k}x{i}" if i % 3 else f"{line} {line}" for i in range(20))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    passages = op9.passages(docs.select(F.col("doc_id").alias("doc"), "text"), op9.seeded(docs.select(F.col("doc_id").alias("doc"), "text")).where("kind = 1"))
    sent = passages.where("words IS NOT NULL").groupBy("doc", "words").count()
    assert sent.agg(F.max("count")).first()[0] == 1 and passages.agg(F.max(F.size("starts"))).first()[0] > 15
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op9.deduplicated(docs).collect()}
    assert found == brute_windows(rows)


def test_nulls_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(None, "a b c", 1, 2), (1, None, 1, 2)], "doc_id long, text string, doc long, component_id long")
    assert sorted((tuple(r) for r in op10.join_components(docs).collect()), key=str) == [(1, 0, 1), (None, 1, None)]
    assert sorted((r[0] or 0, r[1], r[2]) for r in op9.deduplicated(docs).collect()) == [(0, 3, 0), (1, 0, 0)]
    none = docs.where("false")
    assert op10.join_components(none).count() == 0 and op9.deduplicated(none).count() == 0


def test_allocation_keeps_the_promise():
    import numpy as np

    r = np.random.default_rng(3)
    for n in [*range(1, 40), 100, 333, 1000]:
        sets = np.sort(r.integers(0, 2**64, (5, n), np.uint64), axis=1).ravel()
        best = {}
        for _, _, _, (row, tag, usable, far, _) in op10.signatures(sets, np.full(5, n)):
            for k, t, u, f in zip(row, tag, usable, far):
                best[k, t // 64] = max(best.get((k, t // 64), -1), u - f)
        assert best and min(best.values()) > 0
