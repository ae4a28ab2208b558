"""Token files: independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents, in ascending doc_id order, as
little-endian unsigned integers.  It is cut into zstandard frames that can each be
read alone, followed by two skippable frames, so any zstandard reader sees plain ids:

* the document index: for each document its id and where its ids begin in the file,
* the seek table of the public seekable format: compressed size, plain size and
  checksum of each frame, then the frame count, a descriptor and a magic number.

A reader fetches the tables from the end of the file and then only the byte
ranges of the frames that hold the wanted documents.

Files go through `pyarrow.fs`, so the folder may be any store it opens.  A file is
written under a name of its task attempt and then moved to its final name, which
depends on the partition alone: a task that runs again puts the same file there.

Defined cases: a null text is empty and holds the end id alone; a null doc_id
comes first; repeated doc_ids stand side by side, ordered by text; an empty table
gives no files; other columns do not matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedsieve.llm.common import checkpoint, shared_folder, small_batches
from feedsieve.llm.tokenize import encoder

#: Fixed values of the public seekable format: skippable frame, its end, and a frame of our own.
SEEK_FRAME, SEEK_END, INDEX_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CHECKSUMS = 0x80
FRAME_BYTES = 1 << 18
NULL_ID = -(1 << 63)
FILES = "path string, part int, n_docs long, n_tokens long, width int"
DOCS = "part int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file.  width: bytes of an id."""

    def __init__(self, path: str, width: int, frame_bytes: int = FRAME_BYTES):
        self.fs, self.path = _open(path)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.dtype, self.frame_bytes = np.dtype(f"<u{width}"), frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []
        self.held, self.held_bytes, self.n_tokens = [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, self.n_tokens))
        self.n_tokens += len(ids)
        raw = ids.astype(self.dtype).tobytes()
        while raw:
            take = raw[: self.frame_bytes - self.held_bytes]
            self.held.append(take)
            self.held_bytes += len(take)
            raw = raw[len(take) :]
            if self.held_bytes == self.frame_bytes:
                self._frame()

    def _frame(self) -> None:
        plain = b"".join(self.held)
        packed = self.zstd.compress(plain)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.out.write(packed)
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        docs = np.array(self.docs, "<i8").reshape(-1, 2)
        packed = self.zstd.compress(docs.tobytes())
        index = struct.pack("<QQI", len(docs), self.n_tokens, self.dtype.itemsize) + packed
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.out.close()


class Reader:
    """Reads documents of one file; only the frames that hold them are fetched and decompressed."""

    def __init__(self, path: str):
        files, name = _open(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_END or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        self.frames = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        index_at = int(self.frames[:, 0].sum())  # the index follows the frames
        index_size = struct.unpack("<I", self.file.read_at(4, index_at + 4))[0]
        index = self.file.read_at(index_size, index_at + 8)
        n_docs, self.n_tokens, self.width = struct.unpack("<QQI", index[:20])
        self.zstd = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.zstd.decompress(index[20:], max_output_size=16 * n_docs), "<i8").reshape(-1, 2) if n_docs else np.zeros((0, 2), "<i8")
        self.ends = np.append(self.docs[1:, 1], self.n_tokens)
        self.packed_at = np.append(0, np.cumsum(self.frames[:, 0]))
        self.plain_at = np.append(0, np.cumsum(self.frames[:, 1]))
        self.fetched = 0
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            plain = self.zstd.decompress(self.file.read_at(int(self.frames[k, 0]), int(self.packed_at[k])), max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last = (k, plain)
            self.fetched += 1
        return self.last[1]

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in that row of the index."""
        a, b = int(self.docs[row, 1]) * self.width, int(self.ends[row]) * self.width
        first, last = np.searchsorted(self.plain_at, (a, b - 1), side="right") - 1 if b > a else (0, -1)
        plain = b"".join(self.frame(k) for k in range(first, last + 1))
        skip = a - int(self.plain_at[first]) if b > a else 0
        return np.frombuffer(plain[skip : skip + b - a], f"<u{self.width}").astype("<u4")

    def rows_of(self, doc_id: int) -> range:
        a, b = np.searchsorted(self.docs[:, 0], (doc_id, doc_id + 1))
        return range(int(a), int(b))


def write(docs: DataFrame, folder: str, path: str, lower: bool = False, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Writes the token files and returns one row for each: its place in the order, documents and tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc, writer, rows = TaskContext.get(), encoder(path, lower), None, []
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        name = f"{folder}/part-{task.partitionId():06d}.zst"
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = Writer(f"{name}.{task.taskAttemptId()}", width)
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            writer.fs.move(writer.path, _open(name)[1])
            rows = [(name, task.partitionId(), len(writer.docs), writer.n_tokens, width)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], [x.split()[0] for x in FILES.split(", ")])

    files, place = _open(folder)
    files.create_dir(place, recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return checkpoint(ordered.mapInArrow(run, FILES))


def read(spark: SparkSession, files: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents of the files, all or those asked for: part, doc_id, place in the file, n_tokens, crc32 and, if wanted, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), strict=True):
                reader = Reader(path)
                rows = range(len(reader.docs)) if doc_ids is None else [r for d in sorted(doc_ids) for r in reader.rows_of(d)]
                for begin in range(0, len(rows), 500):
                    some = rows[begin : begin + 500]
                    got = [reader.ids(r) for r in some]
                    ids = [None if (d := int(reader.docs[r, 0])) == NULL_ID else d for r in some]
                    cols = [pa.array([part] * len(some), pa.int32()), pa.array(ids, pa.int64()), pa.array([int(reader.docs[r, 1]) for r in some], pa.int64()), pa.array([len(x) for x in got], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in got], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, [*(x.split()[0] for x in DOCS.split(", ")), *["ids"] * with_ids])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = DOCS + ", ids array<long>" * with_ids
    return files.select("path", "part").repartition(n, "part").mapInArrow(run, schema)


def with_starts(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before: a running sum over the files, which are few and have a row each."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = files.select(F.col("part").alias("p"), before.cast("long").alias("first"))
    return rows.join(F.broadcast(first), F.col("part") == F.col("p")).withColumn("start", F.col("first") + F.col("at")).drop("p", "first")


def op10(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    files = write(docs, shared_folder(spark, "tokens"), path, lower=True, end_id=end_id)
    return with_starts(files, read(spark, files)).select("doc_id", "start", "n_tokens", "ids_crc32", F.col("part").alias("file_part"))
