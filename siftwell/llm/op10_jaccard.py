"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A text's set is its distinct word shingles.  Two sets are linked when their
Jaccard similarity reaches ``NUM``/``DEN``; then at most H = (|x| + |y|) *
(DEN - NUM) / (DEN + NUM) shingles belong to one of them alone.

Signatures.  Sets are put into size bands; a set is indexed in its own band and,
if a partner can be there, in the next.  In a band the universe is hashed into m
segments, and a set's signature for a segment is a hash of its shingles there.  A
segment with budget 0 counts one if it is equal in both sets; with budget 1 the
one-deletion neighbourhood is indexed too and it counts two.  ``allocation``
chooses, by cost, how many segments of either kind a band has, so that the
budgets of a set's usable segments exceed H: then a linked pair shares a
signature.  An empty segment is not usable.  A set with too many empty segments
under one hash seed is indexed under the next seed as well, until it has enough;
for each pair the seed at which the first of the two has enough finds it.

Groups.  A signature that more than ``HEAVY`` sets share is heavy and, for a set
that has enough usable segments without it, not needed.  Light groups give
candidate pairs with the number of shared signatures; from it and the segments
of both sets follows a lower bound on their difference, which drops most false
candidates unread.

Crowded sets (too few usable segments without heavy signatures: boilerplate,
families of near copies) get a second partition of the universe, by frequency
among the candidates: the frequent shingles form one segment without a budget, each
rare shingle (at most ``RARE`` sets) is a segment of its own.  A set is indexed by its rarest
ones, as many as no linked set can lack; pairs that share some are candidates if these leave room for a link.  A linked pair that shares
none consists of sets with few rare shingles, one of them a core set (hardly any); such pairs are sought in
the heavy groups, through the group's lead, with which all members are compared
first: only pairs of different components, not separated by their rare
shingles and what they share with the lead, are compared.  No pair is listed
that these bounds exclude.

Every link that counts is verified on the whole sets.  Equal sets are one class
and are represented by their smallest document; the result has a row for
each copy.  Nothing is capped or sampled.  Shingles and sets are compared by
64-bit and 128-bit hashes.

Defined results: a text without words, or null, has an empty set, is linked with
nothing and is its own component; rows that repeat an id, or have none, are
documents of their own, and a component is called by the least id among its rows (null if
none has one); ids are above -2^61; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import bucketed, pack, unpack
from .components import components
from .shared import Words, arrow_ready, frugal, gram_hashes, mix, ranges, shuffle_parts, steps, stored

SHINGLE = 5
NUM, DEN = 3, 4
#: Sets that may share a signature before it is heavy.
HEAVY = 32
#: Candidates that may have a shingle for it to be rare.
RARE = 8
#: Weight of candidates in the cost of a plan.
CROWDING = 3.0
#: Pairs, and shingles of them, that are verified in one place.
PLACE_PAIRS = 200
PLACE_SHINGLES = 1 << 18
#: Documents of a lead's group that one task meets at once.
GROUP_ROWS = 500
#: Tables that are broadcast have at most so many bytes (as counted from their rows); larger ones are shuffled.
BROADCAST_BYTES = 8 << 20
#: Parts of a bucket that are unpacked one after another.
SPLIT = 4
_STEP = 1 << 20


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, row after row, and the size of each row's set."""
    words = Words(col, lower=True)
    h, n = words.hashes(), words.counts
    grams = gram_hashes(h, SHINGLE)
    size = np.maximum(n - SHINGLE + 1, 0)
    out = np.concatenate((grams, np.zeros(len(h) - len(grams), np.uint64)))
    for k in range(1, SHINGLE):  # shorter texts are one shingle
        few = np.flatnonzero(n == k)
        if len(few):
            out[words.first[few]] = mix(gram_hashes(h, k)[words.first[few]] + np.uint64(k))
            size[few] = 1
    sets = out[ranges(words.first[:-1], size)]
    ends = np.cumsum(size)
    for a, b in zip((ends - size).tolist(), ends.tolist()):
        sets[a:b].sort()
    new = np.ones(len(sets), bool)
    new[1:] = sets[1:] != sets[:-1]
    new[(ends - size)[size > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return sets[new], np.diff(kept[np.concatenate(([0], ends))])


def most_apart(a, b):
    """H: the largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


@lru_cache(1)
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest size of each band, its number of segments and how many of these have budget 1."""
    tops = [DEN - 1]
    while tops[-1] < 1 << 30:
        tops.append(max(tops[-1] + DEN - 1, tops[-1] * 3 // 2))
    plans = [allocation(t) for t in tops]
    return np.array(tops), np.array([m for m, _ in plans]), np.array([k for _, k in plans])


def allocation(top: int) -> tuple[int, int]:
    """Segments, and those of budget 1, at the least cost for a set of ``top`` shingles.

    The cost is the number of signatures, each weighed by the candidates it brings: the fewer shingles it has, the more.
    The expected budget of its usable segments must exceed H by one standard deviation of the number of empty ones.
    """
    need = most_apart(top, top) + 1
    if need == 1:
        return 1, 0
    best = (math.inf, 1, 0)
    for ones in range(0, min(need, 4) + 1):
        zeros = np.unique(np.concatenate((np.arange(0, min(need, 200) + 8), np.floor(need * np.linspace(1, 2, 201)))))
        zeros = zeros[zeros + ones > 0]
        m = zeros + ones
        rate = top / m
        empty, single = np.exp(-rate), rate * np.exp(-rate)
        budget = zeros * (1 - empty) + ones * (2 * (1 - empty - single) + single) - np.sqrt(m * empty)
        budget[m == 1] = 2 * ones  # a single segment holds the whole set
        for z in zeros[budget >= need][:1].astype(int).tolist():
            mean = top / (z + ones)
            best = min(best, ((z + ones * (1 + mean)) * (1 + CROWDING / mean), z + ones, ones))
    return best[1], best[2]


def _salt(*parts) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p).astype(np.uint64) + np.uint64(1))
    return out


def signatures(sets: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """Signatures, their rows and tags (band * 64 + seed), and for each (row, tag) what is usable of it."""
    top, m_of, ones_of = bands()
    begin = np.cumsum(size) - size
    own = np.searchsorted(top, size)
    rows = np.flatnonzero(size > 0)
    further = rows[DEN * size[rows] >= NUM * (top[own[rows]] + 1)]
    row, band = np.concatenate((rows, further)), np.concatenate((own[rows], own[further] + 1))
    far = most_apart(size[row], np.minimum(top[band], size[row] * DEN // NUM))
    weight = mix(sets ^ np.uint64(0xA0761D6478BD642F))
    seed = 0
    while len(row):
        m, ones, n = m_of[band], ones_of[band], size[row]
        base = np.cumsum(m) - m
        at = ranges(begin[row], n)
        place = mix(sets[at] + _salt(seed)[0]) >> np.uint64(32)
        segment = (place * np.repeat(m, n).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        key = segment + np.repeat(base, n)
        total = int(m.sum())
        w = weight[at]
        count = np.bincount(key, minlength=total)
        low = np.bincount(key, (w & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(key, (w >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        whole = (high << np.uint64(32)) + low
        of = np.repeat(np.arange(len(row)), m)
        number = np.arange(total) - base[of]
        salt = _salt(band, seed)[of] + mix(number.astype(np.uint64))
        usable = np.where(number < ones[of], np.minimum(count, 2), np.minimum(count, 1))
        credit = np.add.reduceat(usable, base)
        tag = band * 64 + seed
        full = np.flatnonzero(count)
        sig, who = [mix(whole[full] + salt[full])], [of[full]]
        less = np.flatnonzero((segment < np.repeat(ones, n)) & (count[key] > 1))
        if len(less):
            sig.append(mix(whole[key[less]] - w[less] + salt[key[less]]))
            who.append(of[key[less]])
        sig, who = np.concatenate(sig), np.concatenate(who)
        yield sig, row[who], tag[who], (row, tag, credit, far, ones == 0)
        short = credit <= far
        row, band, far = row[short], band[short], far[short]
        seed += 1
        if seed == 64:
            raise ValueError("no seed gives enough usable segments")


_ROW = "kind byte, sig long, doc long, tag int, n int, usable int, far int, exact boolean, fp_a long, fp_b long"
_NAMES = ["kind", "sig", "doc", "tag", "n", "usable", "far", "exact", "fp_a", "fp_b"]
_KINDS = dict(zip(_NAMES, [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]))


def _batch(rows: int, /, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[c]) if c in columns else pa.nulls(rows, _KINDS[c]) for c in _NAMES], _NAMES)


def fingerprints(sets: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set."""
    ends = np.concatenate(([0], np.cumsum(size)))
    return [np.diff(np.concatenate(([np.uint64(0)], np.cumsum(mix(sets ^ _salt(77 + k)[0]), dtype=np.uint64)))[ends]) for k in (0, 1)]


def numbered(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc``, ``text`` under unique ids, and ``doc``, ``name`` of the rows whose id is null or not the only one (None: no such row)."""
    plain = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    again = plain.groupBy("doc").count().where("count > 1 OR doc IS NULL").select("doc")
    if not again.limit(1).count():
        return plain, None
    again = stored(again.where("doc IS NOT NULL"), "again")
    odd = plain.join(again, "doc", "left_semi").select("doc", "text").union(plain.where("doc IS NULL"))
    odd = stored(odd.select((F.monotonically_increasing_id() - F.lit(1 << 62)).alias("number"), "doc", "text"), "odd")
    docs = plain.where("doc IS NOT NULL").join(again, "doc", "left_anti").select("doc", "text").union(odd.select("number", "text"))
    return docs, odd.select(F.col("number").alias("doc"), F.col("doc").alias("name"))


def indexed(docs: DataFrame) -> DataFrame:
    """One pass over ``doc``, ``text``: rows of kind 0 (documents), 1 (their usable segments by tag), 2 (repeated signatures).

    Signatures travel in blobs, one for each batch and bucket.
    """
    spark = docs.sparkSession
    arrow_ready(spark)
    parts = shuffle_parts(spark)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # sets that this task has signed: copies are not signed again
        for b in steps(batches, most=_STEP):
            doc = b.column(0).to_numpy()
            sets, size = shingle_sets(b.column(1))
            prints = fingerprints(sets, size)
            facts = [_batch(len(doc), kind=np.zeros(len(doc)), doc=doc, n=size, fp_a=prints[0].view(np.int64), fp_b=prints[1].view(np.int64))]
            new = np.zeros(len(doc), bool)
            for r, key in enumerate(zip(prints[0].tolist(), prints[1].tolist(), size.tolist())):
                if key not in seen:
                    seen.add(key)
                    new[r] = True
            fresh = sets[np.repeat(new, size)]
            which = np.flatnonzero(new)
            rows: list[tuple] = []
            for sig, row, tag, (owner, tags, usable, far, exact) in signatures(fresh, size[which]):
                rows.append((sig, which[row], tag))
                facts.append(_batch(len(owner), kind=np.ones(len(owner)), doc=doc[which[owner]], tag=tags, n=size[which[owner]], usable=usable, far=far, exact=exact))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, facts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for f in facts:
                    out.write_batch(f)
            buckets, blobs = [int(doc[0]) % parts if len(doc) else 0], [b"F" + sink.getvalue().to_pybytes()]
            if rows:
                sig, row, tag = (np.concatenate(x) for x in zip(*rows))
                order = np.argsort(sig, kind="stable")
                sig, row, tag = sig[order], row[order], tag[order]
                rank, count = ranks(sig)
                hot = count > HEAVY  # known to be heavy: the members need not meet, two of them tell the bucket
                if hot.any():
                    buckets.append(buckets[0])
                    blobs.append(b"H" + pack(sig[hot], doc[row[hot]], tag[hot]))
                    few = ~hot | (rank < 2)
                    sig, row, tag = sig[few], row[few], tag[few]
                for k, blob in bucketed(sig, doc[row], tag, parts * SPLIT):
                    buckets.append(k // SPLIT)
                    blobs.append(b"S" + bytes([k % SPLIT]) + blob)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if blob[:1] == b"F":
                    yield from pa.ipc.open_stream(blob[1:])
                elif blob[:1] == b"H":
                    yield from repeated(*unpack(blob[1:]))
                else:
                    held.setdefault((bucket, blob[1]), []).append(blob[2:])
        for part in sorted(held):
            sig, doc, tag = (np.concatenate(x) for x in zip(*map(unpack, held.pop(part))))
            order = np.argsort(sig)
            sig, doc, tag = sig[order], doc[order], tag[order]
            same = sig[1:] == sig[:-1]
            again = np.concatenate((same, [False])) | np.concatenate(([False], same))
            yield from repeated(sig[again], doc[again], tag[again])

    def repeated(sig: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(sig), 100_000):
            part = slice(a, a + 100_000)
            yield _batch(len(sig[part]), kind=np.full(len(sig[part]), 2), sig=sig[part].view(np.int64), doc=doc[part], tag=tag[part])

    blobs = docs.mapInArrow(frugal(sign), "bucket int, blob binary")
    return stored(blobs.repartition(parts, "bucket").mapInArrow(frugal(gather), _ROW), "signatures")


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values: each one's place among its equals, and how many these are."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(values)))
    return np.arange(len(values)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)


def _sided(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a stored table) marked for broadcast if it is small; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``inter`` (shingles that both have) and ``linked`` of each pair (``a``, ``b``, ``n_a``, ``n_b``), from the whole sets.

    Pairs are dealt by ``b`` into places of about ``PLACE_PAIRS`` pairs and
    ``PLACE_SHINGLES`` shingles; the set of ``b`` comes first in each of its places,
    and only that one is held.
    """
    spark = texts.sparkSession
    arrow_ready(spark)
    load = pairs.groupBy("b").agg(F.ceil(F.greatest(F.count("*") / PLACE_PAIRS, F.sum("n_a") / PLACE_SHINGLES)).cast("int").alias("places"))
    many = stored(load.where("places > 1"), "places")
    placed = pairs.join(_sided(many, 16), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("places", F.lit(1))).cast("int").alias("place"))
    sent = placed.select(F.col("a").alias("doc"), F.col("b").alias("block"), "place").union(placed.select("b", "b", "place").distinct())
    goals = stored(sent.groupBy("doc").agg(F.collect_list(F.struct("block", "place")).alias("goals")), "goals")
    many_goals = goals.agg(F.coalesce(F.sum(F.size("goals")), F.lit(0))).first()[0]
    small = 32 * goals.count() + 24 * many_goals <= BROADCAST_BYTES

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, most=_STEP):
            sets, size = shingle_sets(b.column(1))
            ends = np.cumsum(size)
            doc, lists = b.column(0).to_pylist(), b.column(2)
            to, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
            block, place = to.field(0).to_numpy(zero_copy_only=False), to.field(1).to_numpy(zero_copy_only=False)
            out, held = [], 0
            for g, r in enumerate(np.repeat(np.arange(len(n)), n).tolist()):
                out.append((block[g], place[g], int(block[g] != doc[r]), doc[r], sets[ends[r] - size[r] : ends[r]].tobytes()))
                held += 8 * int(size[r])
                if held > _STEP:
                    yield _rows(out, _SENT)
                    out, held = [], 0
            if out:
                yield _rows(out, _SENT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, out = np.zeros(0, np.uint64), []
        for batch in batches:
            for block, other, a, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                own = np.frombuffer(body, np.uint64)
                if not other:
                    base = own
                    continue
                short, long = sorted((own, base), key=len)
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                inter = int((long[at] == short).sum())
                out.append((a, block, inter, inter * DEN >= (len(own) + len(base) - inter) * NUM))
            if len(out) > 20_000:
                yield _rows(out, _FOUND)
                out = []
        if out:
            yield _rows(out, _FOUND)

    found = texts.join(F.broadcast(goals) if small else goals, "doc").select("doc", "text", "goals").mapInArrow(frugal(send), "block long, place int, other int, a long, body binary")
    dealt = found.repartition(shuffle_parts(spark), "block", "place").sortWithinPartitions("block", "place", "other")
    return stored(dealt.mapInArrow(frugal(compare), "a long, b long, inter long, linked boolean"), "verified")


_SENT = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("other", pa.int32()), ("a", pa.int64()), ("body", pa.binary())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("inter", pa.int64()), ("linked", pa.bool_())])
_RARE = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("id", pa.int64()), ("level", pa.int32()), ("times", pa.int64()), ("docs", pa.list_(pa.int64()))])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def levels() -> int:
    """Classes of rare shingles by the number of documents that have them: 1, 2, up to 4 ... up to ``RARE``."""
    return (RARE - 1).bit_length() + 1


def _sums(doc: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Rows of a document and its counts, by ranges of a hash of the document."""
    bucket = ((mix(doc.view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    for k in np.unique(bucket).tolist():
        at = bucket == k
        yield k, zstandard.ZstdCompressor(level=1).compress(np.diff(doc[at], prepend=0).tobytes() + np.ascontiguousarray(counts[at].T).tobytes())


def _totals(docs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each document once, with the sum of its counts."""
    who, at = np.unique(np.concatenate(docs), return_inverse=True)
    total = np.zeros((len(who), counts[0].shape[1]), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return who, total


def rarities(texts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The second partition of the universe, over the documents of ``ids`` (``doc``, ``crowd``): each rare shingle is a segment, the frequent ones form one.

    First table: ``doc`` and ``upto``, for each level the number of its shingles of that
    level and below.  Second table: the rare shingles that several crowded documents
    have (``id``, ``level``, ``docs``); ``times`` of them have the same documents.
    """
    spark = texts.sparkSession
    arrow_ready(spark)
    parts, wide = shuffle_parts(spark), levels()

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)  # frequent by what this task has sent
        for b in steps(batches, most=_STEP):
            sets, size = shingle_sets(b.column(1))
            doc, crowd = (np.repeat(c, size) for c in (b.column(0).to_numpy(), b.column(2).to_numpy()))
            order = np.argsort(sets, kind="stable")
            order = order[~np.isin(sets[order], known)] if len(known) else order
            rank, count = ranks(sets[order])
            known = np.union1d(known, sets[order[count > RARE]])
            order = order[rank <= RARE]  # one more than a rare shingle has
            found = list(bucketed(sets[order], doc[order], crowd[order], parts * SPLIT))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k // SPLIT for k, _ in found], pa.int32()), pa.array([bytes([k % SPLIT]) + x for k, x in found], pa.binary())], ["bucket", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault((bucket, blob[0]), []).append(blob[1:])
        docs, sums = [], []  # of a bucket's parts
        for part in sorted(held):
            token, doc, crowd = (np.concatenate(x) for x in zip(*map(unpack, held.pop(part))))
            order = np.lexsort((doc, token))
            token, doc, crowd = token[order], doc[order], crowd[order]
            of = ranks(token)[1]
            rare = of <= RARE
            token, doc, crowd = token[rare], doc[rare], crowd[rare]
            level = np.ceil(np.log2(of[rare])).astype(np.int64)
            who, at = np.unique(doc, return_inverse=True)
            docs.append(who)
            sums.append(np.bincount(at * wide + level, minlength=len(who) * wide).reshape(-1, wide))
            if not any(p[0] == part[0] for p in held):
                who, counts = _totals(docs, sums)
                docs, sums = [], []
                if len(who):
                    yield _rows([(k, x, None, None, None, None) for k, x in _sums(who, counts, parts)], _RARE)
            some = crowd > 0
            token, doc, level = token[some], doc[some], level[some]
            size = ranks(token)[1]
            token, doc, level, size = (c[size > 1] for c in (token, doc, level, size))
            start = 0
            lists: dict[bytes, list] = {}
            while start < len(token):
                end = start + int(size[start])
                lists.setdefault(doc[start:end].tobytes(), [int(token[start].view(np.int64)), int(level[start]), 0])[2] += 1
                start = end
                if len(lists) >= 20_000 or start >= len(token):
                    yield _rows([(None, None, *facts, np.frombuffer(key, np.int64)) for key, facts in lists.items()], _RARE)
                    lists = {}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, counts = [np.zeros(0, np.int64)], [np.zeros((0, wide), np.int64)]
        for b in batches:
            for blob in b.column(1).to_pylist():
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
                n = len(raw) // (wide + 1)
                docs.append(np.cumsum(raw[:n]))
                counts.append(raw[n:].reshape(wide, n).T)
        who, total = _totals(docs, counts)
        for k in range(0, len(who), 50_000):
            upto = np.cumsum(total[k : k + 50_000], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(who[k : k + 50_000]), pa.array(list(upto), pa.list_(pa.int64()))], ["doc", "upto"])

    blobs = texts.join(_sided(ids, 24), "doc").select("doc", "text", "crowd").mapInArrow(frugal(scatter), "bucket int, blob binary")
    found = stored(blobs.repartition(parts, "bucket").mapInArrow(frugal(count), "bucket int, blob binary, id long, level int, times long, docs array<long>"), "rarities")
    sums = found.where("bucket IS NOT NULL").select("bucket", "blob").repartition(parts, "bucket").mapInArrow(frugal(add), "doc long, upto array<long>")
    return sums, found.where("bucket IS NULL").select("id", "level", "times", "docs")


def rare_pairs(lists: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs of crowded documents that share rare shingles and that these leave room for a link (``a``, ``b``, ``n_a``, ``n_b``).

    A document takes part with its rarest shingles, level by level, until these are
    more than a linked partner may lack (``reach``; if there are too few, with all rare ones).
    What two documents have in common up to the lesser reach tells how much they differ there.
    """
    each = lists.select("id", "level", "times", F.explode("docs").alias("doc")).join(own.where("reach > 0").select("doc", "reach"), "doc").where("level <= reach")
    again = each.groupBy("id", "times").agg(F.sort_array(F.collect_list("doc")).alias("docs")).where(F.size("docs") > 1)
    firsts = again.select("times", "docs", F.posexplode("docs").alias("at", "b"))
    pairs = firsts.select("times", "b", F.explode(F.slice("docs", F.col("at") + 2, F.lit(RARE))).alias("a")).groupBy("a", "b").agg(F.sum("times").alias("shared"))
    at = lambda name: own.select(F.col("doc").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "reach", "upto")])
    level = F.least("reach_a", "reach_b", F.lit(levels() - 1)) + 1
    differ = F.element_at("upto_a", level) + F.element_at("upto_b", level) - 2 * F.col("shared")
    return pairs.join(at("a"), "a").join(at("b"), "b").where(_sizes_fit() & (differ <= _apart())).select("a", "b", "n_a", "n_b")


def _apart():
    """H of the pair at hand."""
    return F.floor((F.col("n_a") + F.col("n_b")) * (DEN - NUM) / (DEN + NUM))


def _sizes_fit():
    return F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM


def _named(labels: DataFrame, name: str) -> DataFrame:
    return labels.select(F.col("id").alias(name), F.col("component").alias(f"c_{name}"))


def open_pairs(led: DataFrame, tried: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of documents with one lead that may be linked though they share no rare shingle (``a``, ``b``, ``n_a``, ``n_b``).

    They are of different components, so one at least is outside the largest one of the lead's group; one at
    least is a core document; and they differ by their rare shingles and, of the lead's
    others, by the difference of what they share with the lead; that holds for each lead that both have.
    """
    known = tried.select(F.col("a").alias("doc"), F.col("b").alias("lead"), "inter")
    rows = led.join(known, ["doc", "lead"], "left").join(_named(labels, "doc"), "doc", "left")
    rows = stored(rows.select("lead", "r_lead", "doc", "n", "r", _core().alias("core"), F.coalesce("inter", "n").alias("inter"), F.coalesce("c_doc", "doc").alias("c")), "led")
    groups = rows.groupBy("lead", "c").count().groupBy("lead").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.sum("count").alias("size"), F.count("*").alias("components"))
    groups = stored(groups.where("components > 1").select("lead", "main", F.ceil(F.col("size") / GROUP_ROWS).cast("int").alias("salts")), "groups")
    # what each document shares with all its leads: a pair that one of them separates is not open
    leads = rows.groupBy("doc").agg(F.collect_list(F.struct("lead", "inter", "r_lead")).alias("leads"))
    rows = rows.join(_sided(groups, 32), "lead").join(leads, "doc")
    side = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("doc", "n", "r", "core", "inter", "c", "leads")]
    odd = rows.where("c <> main").select("lead", "r_lead", "main", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *side("a"))
    every = rows.select("lead", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), *side("b"))
    own = F.col("r_a") + F.col("r_b")
    differ = own + F.greatest(F.lit(0), F.abs(F.col("inter_a") - F.col("inter_b")) - F.col("r_lead"))
    once = (F.col("c_b") == F.col("main")) | (F.col("doc_a") > F.col("doc_b"))
    near = (F.col("c_a") != F.col("c_b")) & once & (F.col("core_a") | F.col("core_b")) & _sizes_fit() & (differ <= _apart())
    both = lambda x, y: x["lead"] == y["lead"]
    excluded = lambda x, y: both(x, y) & ((x["lead"] < F.col("lead")) | (own + F.abs(x["inter"] - y["inter"]) - x["r_lead"] > _apart()))  # noqa: E731  by that lead, or left to an earlier one
    near = odd.join(every, ["lead", "salt"]).where(near & ~F.exists("leads_a", lambda x: F.exists("leads_b", lambda y: excluded(x, y))))
    first = F.col("doc_a") > F.col("doc_b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return near.select(pick("doc_a", "doc_b", "a"), pick("doc_b", "doc_a", "b"), pick("n_a", "n_b", "n_a"), pick("n_b", "n_a", "n_b"))


def _core():
    """Two documents that aren't core differ by more than H in rare shingles alone, unless they share some."""
    return F.col("r") * (DEN + NUM) <= F.col("n") * (DEN - NUM)


def join_components(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each document."""
    docs, names = numbered(documents, key, text)
    index = indexed(docs)
    facts = index.where("kind = 0").select("doc", "n", "fp_a", "fp_b")
    classes = facts.where("n > 0").groupBy("n", "fp_a", "fp_b").agg(F.min("doc").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size")
    classes = _sided(stored(classes, "classes"), 40)  # only sets of several documents
    members = stored(facts.join(classes, ["n", "fp_a", "fp_b"], "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep")), "members")
    copies = members.where("doc <> rep").select("doc", "rep")
    sizes = members.where("doc = rep").select("doc", "n")

    groups = index.where("kind = 2").select("sig", "tag", "doc").join(copies, "doc", "left").select("sig", "tag", F.coalesce("rep", "doc").alias("doc")).distinct()
    counts = groups.groupBy("sig").agg(F.count("*").alias("size"))
    groups = stored(groups.join(counts.where("size > 1"), "sig"), "groups")
    heavy_of = groups.where(F.col("size") > HEAVY).groupBy("doc", "tag").agg(F.count("*").alias("heavy"))
    signed = index.where("kind = 1").join(copies, "doc", "left").withColumn("doc", F.coalesce("rep", "doc"))
    segments = signed.select("doc", "tag", "n", "usable", "far", "exact").dropDuplicates(["doc", "tag"])
    # heavy signatures of a band with deletions may be several of one segment: none of its budget is trusted then
    left = F.when(F.col("heavy").isNull(), F.col("usable")).when(F.col("exact"), F.col("usable") - F.col("heavy")).otherwise(F.lit(0))
    segments = stored(segments.join(groups.select("doc").distinct(), "doc", "left_semi").join(heavy_of, ["doc", "tag"], "left").select("doc", "tag", "n", "exact", "far", left.alias("left")), "segments")
    crowded = segments.where("left <= far").select("doc", "tag")

    # light groups: all pairs of at most HEAVY members, counted
    lists = groups.where(F.col("size") <= HEAVY).groupBy("sig", "tag").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    firsts = lists.select("tag", "docs", F.posexplode("docs").alias("at", "b"))
    pairs = firsts.select("tag", "b", F.explode(F.slice("docs", F.col("at") + 2, F.lit(HEAVY))).alias("a")).groupBy("tag", "a", "b").agg(F.count("*").alias("shared"))
    of = lambda name: segments.select("tag", F.col("doc").alias(name), F.col("n").alias(f"n_{name}"), F.col("left").alias(f"left_{name}"), F.col("exact").alias(f"exact_{name}"))
    sized = pairs.join(of("a"), ["tag", "a"]).join(of("b"), ["tag", "b"])
    close = sized.where(_sizes_fit() & (~F.col("exact_a") | (F.col("shared") >= F.greatest("left_a", "left_b") - _apart())))
    light = stored(close.groupBy("a", "b").agg(F.max("shared").alias("shared")), "light")

    # heavy groups: only the members that need them, and of these only what the rare shingles leave open
    crowds = stored(groups.where(F.col("size") > HEAVY).join(crowded, ["doc", "tag"]).select("sig", "doc"), "crowds")
    ids = light.select(F.col("a").alias("doc"), F.lit(0).alias("crowd")).union(light.select("b", F.lit(0))).union(crowds.select("doc", F.lit(1)))
    ids = stored(ids.groupBy("doc").agg(F.max("crowd").alias("crowd")), "candidates")
    small = _sided(ids, 24)
    texts = docs if small is not ids else stored(docs.join(ids.select("doc"), "doc", "left_semi").select("doc", "text"), "texts")
    rare_of, lists = rarities(texts, ids)
    upto = F.coalesce("upto", F.array_repeat(F.lit(0).cast("long"), levels()))
    own = ids.join(sizes, "doc").join(rare_of, "doc", "left").select("doc", "crowd", "n", upto.alias("upto"))
    enough = F.floor(F.col("n") * (DEN - NUM) / DEN)
    reach = F.coalesce(*[F.when(F.get("upto", F.lit(k)) > enough, k) for k in range(levels())], F.lit(levels()))
    own = stored(own.select("*", F.get("upto", F.lit(0)).alias("u"), F.get("upto", F.lit(levels() - 1)).alias("r"), reach.alias("reach")), "own")
    at = lambda name: own.select(F.col("doc").alias(name), F.col("n").alias(f"n_{name}"), F.col("u").alias(f"u_{name}"))
    light = stored(light.join(at("a"), "a").join(at("b"), "b").where(F.col("u_a") + F.col("u_b") <= _apart()).select("a", "b", "n_a", "n_b", "shared"), "light")
    rare = stored(rare_pairs(lists, own.where("crowd = 1")), "rare")
    crowds = stored(crowds.join(own.where(F.col("reach") == levels()).select("doc", "n", "r"), "doc"), "crowds")
    # the lead of a group is its core document of the fewest rare shingles, so that a family has few
    leads = stored(crowds.where(_core()).groupBy("sig").agg(F.min(F.struct("r", "doc", "n")).alias("lead")), "leads")
    led = crowds.join(_sided(leads, 40), "sig").select("doc", "n", "r", F.col("lead.doc").alias("lead"), F.col("lead.n").alias("n_lead"), F.col("lead.r").alias("r_lead"))
    led = stored(led.distinct(), "led")

    # first each document's likeliest partner and its leads, then what is still open between components
    best = light.groupBy("a").agg(F.max_by(F.struct("b", "n_a", "n_b"), F.struct("shared", -F.col("b"))).alias("x")).select("a", "x.b", "x.n_a", "x.n_b")
    first = best.union(led.where("doc <> lead").select("doc", "lead", "n", "n_lead")).distinct()
    tried = verified(texts, stored(first, "pairs"))
    labels = components(tried.where("linked").select("a", "b"))
    apart = light.drop("shared").union(rare).join(_named(labels, "a"), "a", "left").join(_named(labels, "b"), "b", "left")
    apart = apart.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b", "n_a", "n_b")
    done = tried.select("a", "b").union(tried.select("b", "a"))
    rest = stored(apart.union(open_pairs(led, tried, labels)).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        labels = components(tried.union(verified(texts, rest)).where("linked").select("a", "b"))

    labelled = members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    if names is None:
        return labelled.withColumnRenamed("doc", key)
    # rows without an id of their own: a component is called by the least id that it has
    told = stored(labelled.join(names.withColumn("odd", F.lit(True)), "doc", "left").select(F.when(F.col("odd"), F.col("name")).otherwise(F.col("doc")).alias(key), "n_shingles", "component_id"), "told")
    least = told.groupBy("component_id").agg(F.min(key).alias("least"))
    return told.join(least, "component_id").select(key, "n_shingles", F.col("least").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}
ORACLE: dict[str, str] = {}
