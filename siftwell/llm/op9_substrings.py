"""Substring dedup with suffix automata of reference shards.

A word goes if a window of ``WINDOW`` words that covers it also begins in a
document with a smaller id.  A suffix automaton of reference passages, whose
states know the smallest document they occur in, is fed a document word by word;
the matching statistics (length of the longest match that ends at each word,
here up to ``WINDOW``) show the windows that occur.

A corpus' automaton has no bounded size, so it isn't broadcast whole: the corpus
is cut into reference shards, and only documents that can match a shard are
streamed through it.

- Each window is known by the smallest hash among its ``SEED``-word grams, its
  seed; equal windows have equal seeds.  Seeds found in one document only are
  settled by this.
- A seed belongs to the smallest document that has it, its owner.  The passages
  around a seed, of all documents, go to the shard of its owner.  There, in
  ascending order of documents, each passage is streamed through the automaton,
  and windows seen for the first time are added to it: it holds each repeated
  passage once.
- Passages around seeds that more than ``COMMON`` documents have first run through
  an automaton of their own batch, so that of a large family of copies each batch
  sends what is new in it once and not every member.  What is left of them goes to
  a shard of the seed alone, so the first document of a family isn't met in one task.
- A seed that more than ``HEAVY`` documents have sends single windows, dealt over
  several shards by their hash, so a line that a third of all documents share
  isn't met in one task.  Equal windows have equal seeds and hashes: they meet all the same.
  A document sends a window once, with the list of its places, however often it repeats it.

Both joins with the texts are shuffled merges at every size.

Documents with equal words are settled beforehand: all but the first lose every
window.  Words are compared by 64-bit hashes.  Groups with more than one in
``GROUPS`` of all documents, hence fewer than ``GROUPS``, are told to the tasks by
broadcast, so a group of copies that is a third of all rows isn't met in one task.

Defined results: a null text has no words; texts of fewer than ``WINDOW`` words
lose none; rows of one id are judged one by one, against smaller ids only; rows
with a null id are kept whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import bucketed, unpack
from .shared import Words, arrow_ready, gram_hashes, mix, shuffle_parts, steps, stored, text_bytes

WINDOW = 13
#: Words of a seed; WINDOW - SEED + 1 must be a power of two.
SEED = 6
#: Documents that may share a seed before its windows are dealt one by one.
HEAVY = 1_000
#: Documents that may share a seed before their passages are matched within the batch.
COMMON = 64
#: Bound of the number of groups of copies that are broadcast.
GROUPS = 100_000
NO_DOC = 1 << 63


class Automaton:
    """A suffix automaton of several word sequences; each state knows the smallest document it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [1 << 63]
        self.last = 0

    def _state(self, length: int, moves: dict[int, int], link: int, least: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q for its suffixes of length(p) + 1 words."""
        moves, link, length = self.next, self.link, self.length
        clone = self._state(length[p] + 1, dict(moves[q]), link[q], self.least[q])
        while p >= 0 and moves[p].get(word) == q:
            moves[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, words: list[int], doc: int) -> None:
        """Adds a sequence of a document; documents come in ascending order."""
        moves, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for word in words:
            q = moves[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
                continue
            new = self._state(length[last] + 1, {}, 0, doc)
            p = last
            while p >= 0 and word not in moves[p]:
                moves[p][word] = new
                p = link[p]
            if p >= 0:
                q = moves[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
            last = new

    def statistics(self, words: list[int], most: int) -> list[int]:
        """For each word the length of the longest match that ends there, up to ``most``."""
        moves, link, length = self.next, self.link, self.length
        state, now, found = 0, 0, []
        for word in words:
            while state and word not in moves[state]:
                state = link[state]
                now = length[state]
            to = moves[state].get(word)
            if to is None:
                now = 0
            else:
                state, now = to, now + 1
                if now > most:
                    now = most
                    while length[link[state]] >= most:
                        state = link[state]
            found.append(now)
        return found


def window_seeds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the first words of all windows within a row, and the windows' seeds."""
    h = words.hashes()
    low = gram_hashes(h, SEED)
    step = 1
    while step < WINDOW - SEED + 1:
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        step *= 2
    row = words.rows()
    at = np.flatnonzero(row[: len(low)] == row[WINDOW - 1 : WINDOW - 1 + len(low)]) if len(low) else np.zeros(0, np.int64)
    return h, at, low[at]


def _prints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row's word sequence."""
    out = np.zeros((2, len(first) - 1), np.uint64)
    for k in range(2):
        base = np.uint64(0x9E3779B97F4A7C17 if k else 0xC2B2AE3D27D4EB4F)
        n = int(np.diff(first).max(initial=0))
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[place], dtype=np.uint64)))
        out[k] = mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))
    return out.view(np.int64)


_ROW = "kind byte, doc long, fp_a long, fp_b long, n int, seed long, owner long, docs int"
_NAMES = ["kind", "doc", "fp_a", "fp_b", "n", "seed", "owner", "docs"]
_KINDS = dict(zip(_NAMES, [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]))


def _batch(rows: int, /, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[c]) if c in columns else pa.nulls(rows, _KINDS[c]) for c in _NAMES], _NAMES)


def seeded(docs: DataFrame) -> DataFrame:
    """One pass over ``doc``, ``text``: rows of kind 0 (documents) and 1 (seeds of several documents, with their owner)."""
    spark = docs.sparkSession
    arrow_ready(spark)
    parts = shuffle_parts(spark)

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in steps(batches):
            doc = b.column(0).to_numpy()
            words = Words(b.column(1))
            h, at, seed = window_seeds(words)
            fp = _prints(h, words.first)
            facts = _batch(len(doc), kind=np.zeros(len(doc)), doc=doc, fp_a=fp[0], fp_b=fp[1], n=words.counts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, facts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(facts)
            buckets, blobs = [int(doc[0]) % parts], [b"F" + sink.getvalue().to_pybytes()]
            new = np.zeros(len(doc), bool)
            for r, key in enumerate(zip(fp[0].tolist(), fp[1].tolist())):
                if seen.get(key, NO_DOC) > doc[r]:  # a later copy of what this task has sown already is settled by its print
                    seen[key] = int(doc[r])
                    new[r] = True
            row = words.rows()[at]
            kept = new[row]
            kept[1:] &= (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
            for k, blob in bucketed(seed[kept], doc[row[kept]], np.zeros(int(kept.sum()), np.int64), parts):
                buckets.append(k)
                blobs.append(b"S" + blob)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def reap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if blob[:1] == b"F":
                    yield from pa.ipc.open_stream(blob[1:])
                else:
                    held.setdefault(bucket, []).append(blob[1:])
        for bucket in sorted(held):
            seed, doc = (np.concatenate(x) for x in list(zip(*map(unpack, held.pop(bucket))))[:2])
            order = np.lexsort((doc, seed))
            seed, doc = seed[order], doc[order]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
            seed, doc = seed[new], doc[new]
            head = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
            size = np.diff(np.append(head, len(seed)))
            count, owner = np.repeat(size, size), np.repeat(doc[head], size)
            at = np.flatnonzero(count > 1)
            for a in range(0, len(at), 100_000):
                part = at[a : a + 100_000]
                yield _batch(len(part), kind=np.ones(len(part)), doc=doc[part], seed=seed[part].view(np.int64), owner=owner[part], docs=count[part])

    blobs = docs.mapInArrow(sow, "bucket int, blob binary")
    return stored(blobs.repartition(parts, "bucket").mapInArrow(reap, _ROW), "seeds")


def runs(starts: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """First and last of each run of ascending numbers that are at most ``gap`` apart."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > gap)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(), starts[np.append(breaks, len(starts) - 1)].tolist()))


def settled(asked: np.ndarray, first: np.ndarray, h: np.ndarray, base: int, key: tuple, local: Automaton, pending: list, out: list) -> np.ndarray:
    """Which of the asked windows occur in the batch's automaton: they go; the others are to be added to it."""
    gone = np.zeros(len(asked), bool)
    for a, e in runs(first[asked], 1):
        words = h[a : e + WINDOW].tolist()
        seen = np.array(local.statistics(words, WINDOW)[WINDOW - 1 :]) >= WINDOW
        gone[np.searchsorted(first, a + np.flatnonzero(seen))] = True
        for x, y in runs(np.flatnonzero(seen), 1):
            out.append((key[0], -2, *key, [a + x - base], y - x + WINDOW, None))
        for x, y in runs(np.flatnonzero(~seen), 1):
            pending.append(words[x : y + WINDOW])
    return gone


def passages(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``owner``, ``salt``, ``doc``, ``fp_a``, ``fp_b``, ``starts`` and ``words`` of each passage around repeated seeds.

    Only single windows have several starts.  Rows without words are word ranges (start, ``size``) that go already.
    """
    by_doc = stored(seeds.groupBy("doc").agg(F.collect_list(F.struct("seed", "owner", "docs")).alias("seeds")), "by-doc")
    joined = docs.join(by_doc.hint("merge"), "doc").select("doc", "text", "seeds")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            words = Words(b.column(1))
            h, at, seed = window_seeds(words)
            fp = _prints(h, words.first)
            row = words.rows()[at]
            docs = b.column(0).to_numpy()
            lists, flat = b.column(2).offsets.to_numpy(), b.column(2).values
            own, of, docs_with = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            own = own.view(np.uint64)
            bounds = np.searchsorted(row, np.arange(len(docs) + 1))
            out: list[tuple] = []
            local, pending, before = Automaton(), [], None
            for r in np.argsort(docs, kind="stable").tolist():
                doc, base, key = int(docs[r]), int(words.first[r]), (int(docs[r]), int(fp[0][r]), int(fp[1][r]))
                if doc != before:
                    for sequence in pending:
                        local.add(sequence, doc)
                    before, pending = doc, []
                w = slice(bounds[r], bounds[r + 1])
                mine = slice(lists[r], lists[r + 1])
                order = np.argsort(own[mine])
                known = own[mine][order]
                if not len(known) or bounds[r] == bounds[r + 1]:
                    continue
                where = np.minimum(np.searchsorted(known, seed[w]), len(known) - 1)
                hit = known[where] == seed[w]
                owner, many = of[mine][order][where], docs_with[mine][order][where]
                first = at[w]
                hit &= ~settled(hit & (many > COMMON), first, h, base, key, local, pending, out)
                light = np.flatnonzero(hit & (many <= HEAVY))
                salts = np.where(many[light] > COMMON, (mix(seed[w][light]) >> np.uint64(34)).astype(np.int64), -1)
                order = np.lexsort((first[light], salts, owner[light]))
                light, salts = light[order], salts[order]
                edges = np.flatnonzero((np.diff(owner[light]) != 0) | (np.diff(salts) != 0)) + 1
                for x, y in zip(np.append(0, edges).tolist(), np.append(edges, len(light)).tolist()):
                    for a, e in runs(first[light[x:y]], WINDOW):
                        out.append((int(owner[light[x]]), int(salts[x]), *key, [a - base], None, h[a : e + WINDOW].tobytes()))
                places: dict[bytes, list[int]] = {}
                of_window: dict[bytes, int] = {}
                for k in np.flatnonzero(hit & (many > HEAVY)).tolist():
                    body = h[first[k] : first[k] + WINDOW].tobytes()
                    places.setdefault(body, []).append(int(first[k]) - base)
                    of_window[body] = k
                for body, starts in places.items():
                    k = of_window[body]
                    salt = int(gram_hashes(np.frombuffer(body, np.uint64), WINDOW)[0] % np.uint64(-(-int(many[k]) // HEAVY) * 16))
                    out.append((int(owner[k]), salt, *key, starts, None, body))
            for a in range(0, len(out), 5_000):
                columns = list(zip(*out[a : a + 5_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()])], ["owner", "salt", "doc", "fp_a", "fp_b", "starts", "size", "words"])

    return joined.mapInArrow(cut, "owner long, salt int, doc long, fp_a long, fp_b long, starts array<int>, size int, words binary")


def matched(found: DataFrame) -> DataFrame:
    """Streams each shard's passages through its automaton: ``doc``, ``fp_a``, ``fp_b`` and ``cuts``, word ranges (start, size) that go."""
    spark = found.sparkSession

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, doc, automaton, pending = None, None, Automaton(), []
        for b in batches:
            out = []
            for owner, salt, d, fp_a, fp_b, starts, size, body in zip(*(c.to_pylist() for c in b.columns)):
                if body is None:
                    out.append((d, fp_a, fp_b, starts[0], size))
                    continue
                if (owner, salt) != shard:
                    shard, doc, automaton, pending = (owner, salt), d, Automaton(), []
                elif d != doc:
                    for words, of in pending:
                        automaton.add(words, of)
                    doc, pending = d, []
                words = np.frombuffer(body, np.uint64).tolist()
                seen = [n >= WINDOW for n in automaton.statistics(words, WINDOW)[WINDOW - 1 :]]
                at, n = 0, len(seen)
                while at < n:
                    to = at + 1
                    while to < n and seen[to] == seen[at]:
                        to += 1
                    if seen[at]:
                        for x, y in runs(np.array(starts) + at, WINDOW):
                            out.append((d, fp_a, fp_b, x, y - x + to - at + WINDOW - 1))
                    else:
                        pending.append((words[at : to + WINDOW - 1], d))
                    at = to
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc", "fp_a", "fp_b", "start", "size"])

    dealt = found.repartition(shuffle_parts(spark), "owner", "salt").sortWithinPartitions("owner", "salt", "doc", "fp_a", "starts")
    cuts = dealt.mapInArrow(stream, "doc long, fp_a long, fp_b long, start long, size long")
    return cuts.groupBy("doc", "fp_a", "fp_b").agg(F.collect_list(F.struct("start", "size")).alias("cuts"))


def later_copies(facts: DataFrame) -> DataFrame:
    """The rows of ``facts`` whose print a smaller document has too."""
    print_of = ["fp_a", "fp_b", "n"]
    first = stored(facts.groupBy(*print_of).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("docs")).where("docs > 1"), "copies")
    most = max(HEAVY, -(-facts.count() // GROUPS))
    large = first.where(F.col("docs") > most).select(*print_of, "first")  # fewer than GROUPS, whatever the input
    rows = facts.join(F.broadcast(large), print_of, "left")
    small = first.where(F.col("docs") <= most).select(*print_of, "first")
    others = rows.where("first IS NULL").drop("first").join(small, print_of)
    return rows.where("first IS NOT NULL").unionByName(others).where("doc > first").drop("first")


def deduplicated(documents: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of each row (and ``kept``, its remaining words)."""
    docs = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    found = seeded(docs.where("doc IS NOT NULL"))
    facts = found.where(f"kind = 0 AND n >= {WINDOW}").select("doc", "fp_a", "fp_b", "n")
    cuts = matched(passages(docs, found.where("kind = 1")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("size")))
    copies = later_copies(facts).select("doc", "fp_a", "fp_b", whole.alias("cuts")).distinct()
    gone = cuts.join(copies, ["doc", "fp_a", "fp_b"], "left_anti").unionByName(copies)
    by_doc = stored(gone.groupBy("doc").agg(F.collect_list(F.struct("fp_a", "fp_b", "cuts")).alias("rows")), "cuts")
    joined = docs.join(by_doc.hint("merge"), "doc", "left").select("doc", "text", "rows")
    names = [key, "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            data, offs = text_bytes(b.column(1))
            raw = data.tobytes()
            rows = b.column(2)
            some = rows.is_valid().to_numpy(zero_copy_only=False)
            prints = None
            n_words, n_removed, sha, texts = [], [], [], []
            for r, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                words = raw[lo:hi].split()
                n, gone = len(words), 0
                if some[r]:
                    if prints is None:
                        own = Words(b.column(1))
                        prints = _prints(own.hashes(), own.first)
                    keep = np.zeros(n + 1, np.int64)
                    for x in rows[r].as_py():
                        if (x["fp_a"], x["fp_b"]) == (prints[0][r], prints[1][r]):
                            for c in x["cuts"]:
                                keep[c["start"]] += 1
                                keep[c["start"] + c["size"]] -= 1
                    stay = np.cumsum(keep[:n]) == 0
                    gone = n - int(stay.sum())
                    words = list(compress(words, stay.tolist()))
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(gone)
                sha.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode())
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * keep_text, names)

    return joined.mapInArrow(digest, f"{key} long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE: dict[str, str] = {}
