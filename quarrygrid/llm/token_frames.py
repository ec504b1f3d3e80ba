"""Token ids of documents in seekable files of zstandard frames.

A file holds one independent zstandard frame for each document (its ids as little-endian unsigned
32-bit integers, the end id last), then a skippable frame with the documents' ids, then the seek
table of the public "zstandard seekable format": compressed size, decompressed size and checksum
(low 32 bits of XXH64 of the decompressed bytes) of every frame before it, in a skippable frame
that ends with a footer of nine bytes.  A reader takes the footer, the table and then only the
frames it is asked for; any zstandard decoder can read the whole file as one stream.

Files are in ascending doc_id order, first by name and then within each: a range exchange deals
out whole documents, tasks write without holding more than one batch, and a file appears under its
name only when complete, so lost or repeated tasks do no harm.

Defined results: a null text is an empty one (only the end id); a null doc_id comes first; rows
with equal doc_id are all kept, ordered by a hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import renamed, rows, work_dir
from .tokenize import MemoEncoder

#: Fixed values of the zstandard formats: skippable frames of the index and of the seek table, the footer's mark.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "file string, docs long, tokens long, bytes long"


@functools.lru_cache(maxsize=2)
def encoder(path: str, max_parts: int = 1_500_000) -> MemoEncoder:
    """One for each worker process, so that its memo outlives a task."""
    return MemoEncoder(path, max_parts)


def _open(path: str, mode: str):
    """A local or shared path by Python, other stores by Arrow's file systems."""
    if path.startswith("file:") or "://" not in path:
        return open(_local(path), mode)
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    return store.open_output_stream(where) if mode == "wb" else store.open_input_file(where)


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


class TokenFileWriter:
    """Writes one file; it appears at `path` on close()."""

    def __init__(self, path: str, level: int = 1):
        import zstandard

        self.path, self.local = path, _local(path)
        self.own = f"{path}.{uuid.uuid4().hex}.tmp" if self.local else path
        self.out = _open(self.own, "wb")
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.table, self.ids, self.nulls, self.tokens, self.bytes = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        data = np.ascontiguousarray(ids, "<u4").tobytes()
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.tokens += len(ids)
        self.bytes += len(frame)

    def close(self) -> tuple[int, int, int]:
        """How many documents, ids and bytes the file holds."""
        index = self.compressor.compress(np.array(self.ids, "<i8").tobytes() + np.packbits(np.array(self.nulls, bool)).tobytes())
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        table = [*self.table, (len(index), 0, 0)]
        body = np.array(table, "<u4").tobytes() + struct.pack("<IBI", len(table), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(index + struct.pack("<II", TABLE_MAGIC, len(body)) + body)
        self.out.close()
        if self.local:
            os.replace(_local(self.own), self.local)
        return len(self.table), self.tokens, self.bytes + len(index) + len(body) + 8


class TokenFile:
    """Reads a file: the seek table first, then only the documents asked for."""

    def __init__(self, path: str):
        import zstandard

        self.file, self.reader = _open(path, "rb"), zstandard.ZstdDecompressor()
        end = self.file.seek(0, 2) or self.file.tell()
        self.file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table with checksums at its end")
        self.file.seek(end - 9 - 12 * n - 8)
        mark, size = struct.unpack("<II", self.file.read(8))
        if mark != TABLE_MAGIC or size != 12 * n + 9:
            raise ValueError(f"{path}: the seek table is damaged")
        table = np.frombuffer(self.file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        ends = np.cumsum(table[:, 0])
        self.at, self.table = ends - table[:, 0], table
        self.file.seek(int(self.at[-1]) + 8)
        index = self.reader.decompress(self.file.read(int(table[-1, 0]) - 8), max_output_size=9 * n + 8)
        self.docs, k = n - 1, 8 * (n - 1)
        nulls = np.unpackbits(np.frombuffer(index[k:], np.uint8))[: n - 1]
        self.doc_ids = [None if x else int(i) for i, x in zip(np.frombuffer(index[:k], "<i8"), nulls, strict=True)]
        self.n_tokens = table[:-1, 1] // 4

    def read(self, k: int) -> np.ndarray:
        """The ids of the k-th document; no other frame is read."""
        size, length, checksum = (int(x) for x in self.table[k])
        import xxhash

        self.file.seek(int(self.at[k]))
        data = self.reader.decompress(self.file.read(size), max_output_size=max(1, length))
        if len(data) != length or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k}: its checksum does not hold")
        return np.frombuffer(data, "<u4")

    def find(self, doc_id: int | None) -> list[int]:
        return [k for k, x in enumerate(self.doc_ids) if x == doc_id]

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, level: int = 1, batch_bytes: int = 1 << 21) -> DataFrame:
    """Writes docs (doc_id, text) to `folder` and returns its manifest, one row a file in order.

    One exchange by ranges of doc_id moves each text once; more machines mean more and smaller
    ranges.  Rows of one doc_id can fill several ranges: a hash of the text is the second key.
    """
    spark = docs.sparkSession

    if _local(folder):
        os.makedirs(_local(folder), exist_ok=True)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        name, file = f"{TaskContext.get().partitionId():08d}.zst", None
        tokens = encoder(tokenizer)
        for some in rows(batches, batch_bytes):
            file = file or TokenFileWriter(f"{folder}/{name}", level)
            for (doc_id, _), ids in zip(some, tokens.encode([text or "" for _, text in some]), strict=True):
                file.add(doc_id, np.append(ids, np.uint32(end_id)))
        if file:
            n, ids, size = file.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [n], "tokens": [ids], "bytes": [size]})

    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    made = renamed(docs, ["doc_id", "text"]).withColumn("hash", F.xxhash64("text"))
    made = made.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash")
    made.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("file")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the folder: doc_id, file, frame, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it.  The files' totals, one row a file, are added
    up in order; each file is then read by one task.
    """
    from pyspark.sql.window import Window as W

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("tokens").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("before")).repartition(max(2, 2 * spark.sparkContext.defaultParallelism), "file")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in rows(batches):
            for name, before in some:
                file = TokenFile(f"{folder}/{name}")
                crc = [zlib.crc32(file.read(k).tobytes()) for k in range(file.docs)]
                start = before + np.cumsum(file.n_tokens) - file.n_tokens
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(file.doc_ids, pa.int64()), "file": [name] * file.docs, "frame": list(range(file.docs)), "start": start, "n_tokens": file.n_tokens, "ids_crc32": pa.array(crc, pa.int64())})
                file.close()

    return files.mapInArrow(read, "doc_id long, file string, frame long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the files, then returns what they hold; see read_token_files."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    write_token_files(docs, folder, tokenizer, **options)
    return read_token_files(spark, folder)
