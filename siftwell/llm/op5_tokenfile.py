"""Token ids in a binary format: independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each of whole documents, then a skippable
frame with an index of the documents, then a skippable frame in the published
seekable format: for each frame its compressed size, size and checksum (the low
32 bits of its content's xxHash64).  Any zstandard decoder reads the file whole;
``Reader`` decompresses the frames of the documents asked for, and checks them.

A frame's content is: number of documents (u32), their ids (i64 each), their
token counts (u32 each), all token ids (u32 each), little-endian.

Documents are range-partitioned and sorted by id; each partition writes one file
into the shared folder under a temporary name and renames it when it is complete,
so a repeated task replaces what a lost one left.

Defined results: a null text is empty and has the end id alone; null ids sort
first and are stored as the smallest long, and read back as null; equal ids keep
their rows (in the order of their texts); an empty table writes no file; other
columns are not read.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import encoder
from .shared import arrow_ready, scratch, shuffle_parts, steps

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Ids of a frame, about; a longer document has a frame of its own.
FRAME_IDS = 1 << 16
NO_ID = -(1 << 63)

_INDEX_MAGIC, _SEEK_MAGIC, _FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class Writer:
    """Writes documents in ascending order of their ids."""

    def __init__(self, out):
        self.out, self.frames, self.index, self.at, self.ids = out, [], [], 0, 0
        self.zip = zstandard.ZstdCompressor(level=3)

    def frame(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        body = struct.pack("<I", len(docs)) + docs.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + ids.astype("<u4").tobytes()
        packed = self.zip.compress(body)
        self.out.write(packed)
        self.frames.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.index.append((int(docs[0]), int(docs[-1]), self.ids, len(docs)))
        self.ids += len(ids)

    def add(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Writes the documents in frames of about ``FRAME_IDS`` ids."""
        ends = np.cumsum(sizes)
        at = 0
        while at < len(docs):
            base = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, base + FRAME_IDS, side="right")))
            self.frame(docs[at:to], sizes[at:to], ids[base : ends[to - 1]])
            at = to

    def close(self) -> None:
        index = b"".join(struct.pack("<qqQI", *x) for x in self.index)
        self.out.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _FOOT_MAGIC)
        self.out.write(struct.pack("<II", _SEEK_MAGIC, len(table)) + table)


class Reader:
    """Reads the frames that are asked for; a damaged frame raises ``ValueError``."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END) or source.tell()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _FOOT_MAGIC or not flags & 0x80:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        self.frames = list(struct.iter_unpack("<III", source.read(12 * n)))
        self.starts = np.cumsum([0, *(f[0] for f in self.frames)])
        source.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != _INDEX_MAGIC:
            raise ValueError("no index")
        self.index = list(struct.iter_unpack("<qqQI", source.read(length)))
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, token counts and token ids of frame k."""
        self.source.seek(int(self.starts[k]))
        body = self.unzip.decompress(self.source.read(self.frames[k][0]), self.frames[k][1])
        if len(body) != self.frames[k][1] or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.frames[k][2]:
            raise ValueError(f"frame {k} is damaged")
        n = struct.unpack_from("<I", body)[0]
        return np.frombuffer(body, "<i8", n, 4), np.frombuffer(body, "<u4", n, 4 + 8 * n), np.frombuffer(body, "<u4", -1, 4 + 12 * n)

    def document(self, doc: int) -> list[np.ndarray]:
        """The ids of the document, or of each document of that id."""
        found = []
        for k, (first, last, _, _) in enumerate(self.index):
            if first <= doc <= last:
                docs, sizes, ids = self.frame(k)
                ends = np.cumsum(sizes, dtype=np.int64)
                found += [ids[ends[r] - sizes[r] : ends[r]] for r in np.flatnonzero(docs == doc)]
        return found


def write_ids(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, cut: str = "spaces", end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Writes the table and returns its files in order: path, documents, ids (one line for each partition)."""
    spark = df.sparkSession
    arrow_ready(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        final, part = f"{root}/part-{task.partitionId():06d}.ids.zst", f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, n_docs = None, 0
        for b in steps(batches):
            ids, sizes = encoder(name, cut, True).ids(b.column(1))
            full = np.full(len(ids) + len(sizes), end_id, np.uint32)
            ends = np.cumsum(sizes + 1)
            kept = np.ones(len(full), bool)
            kept[ends - 1] = False
            full[kept] = ids
            if out is None:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(part)
                out = Writer(stream)
            out.add(pc.fill_null(b.column(0), NO_ID).to_numpy(), sizes + 1, full)
            n_docs += len(sizes)
        if out is not None:
            out.close()
            stream.close()
            fs.move(part, final)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([final]), pa.array([n_docs]), pa.array([out.ids])], ["part", "path", "n_docs", "n_ids"])

    pair = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = pair.repartitionByRange(shuffle_parts(spark), "key").sortWithinPartitions("key", "text")
    files = dealt.mapInArrow(write, "part long, path string, n_docs long, n_ids long").collect()  # a row for each file
    return [(f["path"], f["n_docs"], f["n_ids"]) for f in sorted(files)]


def read_ids(spark: SparkSession, folder: str, files: list[tuple[str, int, int]], key: str = "doc_id") -> DataFrame:
    """From the files: each document's ``start``, ``n_tokens`` and ``ids_crc32``."""
    starts = np.cumsum([0, *(n for _, _, n in files)])
    todo = [(p, int(s)) for (p, _, _), s in zip(files, starts)]
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(path) as source:
                    reader = Reader(source)
                    for k in range(len(reader.frames)):
                        docs, sizes, ids = reader.frame(k)
                        ends = np.cumsum(sizes, dtype=np.int64)
                        crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NO_ID), pa.array(start + reader.index[k][2] + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(todo, "path string, start long")
    return listed.repartition(max(1, len(todo)), "path").mapInArrow(read, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-ids")
    files = write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_ids(spark, folder, files)


QUERIES = {"op5_token_files": op5_token_files}
ORACLE: dict[str, str] = {}
