"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments.  A segment holds some documents whole: its
term dictionary and, for each term, the ascending positions at which it occurs
(delta-coded, byte planes under zstandard).  A phrase is found in a segment by
taking the postings of its rarest term, shifting them to the phrase's start, and
intersecting the shifted postings of the other terms from rare to frequent.
Terms are compared as strings, so matches are exact.

Building and searching are both one pass over rows without a shuffle: a document
never leaves its segment, and no term, however frequent, gathers in one task.
The phrases searched for are a stated query set; they reach the tasks in blocks
of at most ``BLOCK_BYTES`` of item text, so what is broadcast is bounded.

Defined results: a null text or a text without words has no words, no hits and
no items; a null or wordless item is never found; equal items, also of one id, are found each on
their own; item ids are numbers or strings, a null one counts and is the empty
string in the digest; repeated documents are searched row by row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ALNUM_WORDS, Words, arrow_ready, covered, frugal, ranges, steps, stored

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of text in a segment, about.
SEGMENT_BYTES = 4 << 20
#: Bytes of item text that one search takes to the tasks at once.
BLOCK_BYTES = 2 << 20

_HITS = "row_id long, doc_id long, n_words long, hits binary, items array<string>"
_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_SEGMENT = "row_ids array<long>, doc_ids array<long>, n_words array<int>, terms array<string>, sizes array<int>, postings binary"


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, 4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of all documents, as a table of segments."""
    arrow_ready(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, most=SEGMENT_BYTES):
            words = Words(b.column(2), ALNUM_WORDS, lower=True)
            coded = words.strings().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
            size = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
            at = np.argsort(codes, kind="stable")
            delta = np.diff(at, prepend=0)
            heads = np.cumsum(size) - size
            delta[heads] = at[heads]
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(
                [one(b.column(0), pa.int64()), one(b.column(1), pa.int64()), one(words.counts, pa.int32()), one(coded.dictionary, pa.string()), one(size, pa.int32()), pa.array([_pack(delta)], pa.binary())],
                ["row_ids", "doc_ids", "n_words", "terms", "sizes", "postings"],
            )

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(frugal(segments), _SEGMENT)


class Segment:
    """One segment, opened for searches."""

    def __init__(self, row_ids: pa.Array, doc_ids: pa.Array, n_words: pa.Array, terms: pa.Array, sizes: pa.Array, postings: bytes):
        self.row_ids, self.doc_ids, self.terms = row_ids, doc_ids, terms
        self.counts = n_words.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.size = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.cumsum(self.size) - self.size
        total = int(self.first[-1])
        delta = _unpack(postings, total) if total else np.zeros(0, np.int64)
        sums = np.cumsum(delta)
        begin = np.where(self.at > 0, sums[np.maximum(self.at - 1, 0)] if total else 0, 0)
        self.posts = sums - np.repeat(begin, self.size)
        self.row_of = np.repeat(np.arange(len(self.counts)), self.counts)

    def codes(self, terms: pa.Array) -> np.ndarray:
        """This segment's number of each term, or -1."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def postings(self, code: int) -> np.ndarray:
        return self.posts[self.at[code] : self.at[code] + self.size[code]]

    def phrase(self, codes: np.ndarray) -> np.ndarray:
        """Where the terms stand one after another within a document: their first positions."""
        order = np.argsort(self.size[codes], kind="stable")
        start = self.postings(codes[order[0]]) - order[0]
        for k in order[1:]:
            post = self.postings(codes[k])
            at = np.searchsorted(post, start + k)
            start = start[(at < len(post)) & (post[np.minimum(at, len(post) - 1)] == start + k)]
            if not len(start):
                return start
        start = start[(start >= 0) & (start + len(codes) <= len(self.row_of))]
        return start[self.row_of[start] == self.row_of[start + len(codes) - 1]]

    def near(self, codes: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term of the same document within ``slop`` words."""
        order = np.argsort(self.size[codes], kind="stable")
        mid = self.postings(codes[order[0]])
        for k in order[1:]:
            post = self.postings(codes[k])
            row = self.row_of[mid]
            low, high = np.maximum(mid - slop, self.first[row]), np.minimum(mid + slop, self.first[row + 1] - 1)
            mid = mid[np.searchsorted(post, low) < np.searchsorted(post, high, side="right")]
        return mid


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for b in batches:
        for r in range(b.num_rows):
            parts = [b.column(k)[r].values for k in range(5)]
            yield Segment(*parts, b.column(5)[r].as_py())


def windows(texts: list[str | None]) -> tuple[list[str], dict[int, tuple[np.ndarray, list[np.ndarray]]]]:
    """The terms of the items; by length, the distinct windows (rows of term numbers) and the items of each."""
    words = Words(pa.array([t or "" for t in texts], pa.large_string()), ALNUM_WORDS, lower=True)
    coded = words.strings().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
    found: dict[int, dict[tuple, set]] = {}
    for item, (lo, hi) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        size = min(WINDOW, hi - lo)
        for at in range(lo, hi - size + 1) if size else ():
            found.setdefault(size, {}).setdefault(tuple(codes[at : at + size].tolist()), set()).add(item)
    by_size = {size: (np.array(list(w), np.int32), [np.array(sorted(items)) for items in w.values()]) for size, w in found.items()}
    return coded.dictionary.to_pylist(), by_size


def search(spark: SparkSession, items: list[tuple[str, str | None]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What finds, in segments, per document: ``hits`` (its hit word numbers, packed bits), ``items`` (ids of items with a window in it)."""
    ids = [i for i, _ in items]
    terms, by_size = windows([t for _, t in items])
    sent = spark.sparkContext.broadcast((ids, terms, by_size))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, by_size = sent.value
        terms = pa.array(terms, pa.string())
        for s in opened(batches):
            here = s.codes(terms)
            starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            found: list[set] = [set() for _ in s.counts]
            for size, (rows, owners) in by_size.items():
                codes = here[rows]
                for w in np.flatnonzero((codes >= 0).all(axis=1)):
                    start = s.phrase(codes[w])
                    if len(start):
                        starts.append(start)
                        sizes.append(np.full(len(start), size))
                        for row in set(s.row_of[start].tolist()):
                            found[row].update(owners[w].tolist())
            hit = covered(int(s.first[-1]), np.concatenate(starts), np.concatenate(sizes))
            bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(s.first[:-1], s.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [s.row_ids, s.doc_ids, pa.array(s.counts), pa.array(bits, pa.binary()), pa.array([[ids[k] for k in sorted(f)] for f in found], pa.list_(pa.string()))],
                ["row_id", "doc_id", "n_words", "hits", "items"],
            )

    return look


def proximity(index: DataFrame, queries: dict[str, list[str]], slop: int) -> DataFrame:
    """Documents in which each query's terms all stand within ``slop`` words of its rarest one: ``query``, ``doc_id``, ``n``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in opened(batches):
            for name, terms in queries.items():
                codes = s.codes(pa.array(terms, pa.string()))
                if len(codes) and (codes >= 0).all():
                    rows, n = np.unique(s.row_of[s.near(codes, slop)], return_counts=True)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), s.doc_ids.take(pa.array(rows)), pa.array(n.astype(np.int64))], ["query", "doc_id", "n"])

    return index.mapInArrow(look, "query string, doc_id long, n long")


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """The query set in blocks of at most ``BLOCK_BYTES`` of text (or one item)."""
    block, size = [], 0
    for row in items.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)).toLocalIterator():
        n = len((row[1] or "").encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document with its hit words and the items found in it."""
    index = stored(build_index(docs, key, text), "postings")
    looks = [search(index.sparkSession, block) for block in item_blocks(items, item_key, item_text)]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit, sha = [], []
            for hits, items in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                several = hits if isinstance(hits, list) else [hits]
                n_hit.append(int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in several])).sum()))
                sha.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            n = pa.array(n_hit, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), n, pc.list_value_length(b.column(4)).cast(pa.int64()), pa.array(sha, pa.string()), pc.greater(n, 0)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    if len(looks) == 1:  # in one pass: two would keep twice the Python workers
        only = looks[0]
        return index.mapInArrow(frugal(lambda batches: digest(only(batches))), _RESULT).withColumnRenamed("doc_id", key)
    found = reduce(DataFrame.union, [index.mapInArrow(frugal(look), _HITS) for look in looks])
    found = found.groupBy("row_id", "doc_id", "n_words").agg(F.collect_list("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return found.mapInArrow(frugal(digest), _RESULT).withColumnRenamed("doc_id", key)


def op3_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_positional_decontamination": op3_positional_decontamination}
ORACLE: dict[str, str] = {}
