"""Token-id output in bit-plane-shuffled blocks.

A file holds the ids of consecutive documents, each closed by an end id. Its ids are cut into blocks of a fixed
number; a block is transposed into byte planes (all low bytes, then all second bytes, ...) and each plane is
compressed by itself with zstandard. The chunk index gives each plane's place and size, the document index each
document's id and length, so a reader fetches any document by reading only the blocks it spans.

    head    4 bytes MPL1, then as little-endian numbers: u32 block size, u64 ids, u64 blocks, u64 documents
    chunks  4 u32 sizes for each block
    docs    i64 id, u64 length, u8 has-id for each document, column by column
    planes  one after another

Documents are dealt into shards by ranges of their id and sorted; a shard's files are rows of a Parquet table in
shared storage (written by Spark's committer, so lost or repeated tasks leave no half files). Ids before a shard
follow from one row of totals for each shard; within it each file states where it starts.

Cases: null or empty text is the end id alone; null ids come first; rows that repeat an id follow each other, by
their texts' hash; one text of any length is encoded piece by piece into blocks; extra columns are ignored; an empty
table gives no file and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import new_path, shuffle_partitions, table

MAGIC, HEAD, PLANES = b"MPL1", "<4sIQQQ", 4
BLOCK_IDS, FILE_IDS, LEVEL = 16_384, 1 << 20, 3


class FileWriter:
    """One file: add ids and close documents, then bytes()."""

    def __init__(self, block_ids: int = BLOCK_IDS):
        self.block_ids, self.n = block_ids, 0
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.planes: list[bytes] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.length = 0
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress

    def add(self, ids) -> None:
        a = np.asarray(ids, "<u4")
        self.rest.append(a)
        self.waiting += len(a)
        self.length += len(a)
        if self.waiting >= self.block_ids:
            joined = np.concatenate(self.rest)
            whole = len(joined) // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._block(joined[k : k + self.block_ids])
            self.rest = [joined[whole:].copy()]
            self.waiting = len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        by_byte = ids.view(np.uint8).reshape(-1, PLANES)
        self.planes += [self.compress(np.ascontiguousarray(by_byte[:, p]).tobytes()) for p in range(PLANES)]

    def close(self, doc_id: int | None, end: int) -> None:
        self.add([end])
        self.doc_ids.append(doc_id)
        self.lengths.append(self.length)
        self.length = 0

    def size(self) -> int:
        return self.n + self.waiting

    def bytes(self) -> bytes:
        if self.waiting:
            self._block(np.concatenate(self.rest))
            self.rest, self.waiting = [], 0
        head = struct.pack(HEAD, MAGIC, self.block_ids, self.n, len(self.planes) // PLANES, len(self.doc_ids))
        sizes = np.array([len(p) for p in self.planes], "<u4")
        docs = (np.array([i or 0 for i in self.doc_ids], "<i8"), np.array(self.lengths, "<u8"), np.array([i is not None for i in self.doc_ids], np.uint8))
        return b"".join((head, sizes.tobytes(), *(d.tobytes() for d in docs), *self.planes))


class FileReader:
    """Random access to a file's documents."""

    def __init__(self, raw: bytes):
        self.raw = memoryview(raw)
        magic, self.block_ids, self.n, blocks, docs = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a plane file")
        at = struct.calcsize(HEAD)
        sizes = np.frombuffer(raw, "<u4", blocks * PLANES, at)
        at += sizes.nbytes
        ids = np.frombuffer(raw, "<i8", docs, at)
        self.lengths = np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
        known = np.frombuffer(raw, np.uint8, docs, at + 16 * docs)
        self.doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.edges = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))) + at + 17 * docs
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))
        self._expand = zstandard.ZstdDecompressor().decompress

    def block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            n = min(self.block_ids, self.n - k * self.block_ids)
            out = np.empty((n, PLANES), np.uint8)
            for p in range(PLANES):
                s, e = self.edges[k * PLANES + p], self.edges[k * PLANES + p + 1]
                out[:, p] = np.frombuffer(self._expand(self.raw[s:e], max_output_size=n), np.uint8)
            self._last = (k, out.view("<u4").ravel())
        return self._last[1]

    def pieces(self, d: int) -> Iterator[np.ndarray]:
        """The ids of the d-th document, block by block."""
        at, end = int(self.starts[d]), int(self.starts[d] + self.lengths[d])
        while at < end:
            k, first = divmod(at, self.block_ids)
            piece = self.block(k)[first : first + end - at]
            yield piece
            at += len(piece)


def write_ids(docs: DataFrame, path: str, vocab: str, end: int = 0, file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Encodes docs (doc_id, text) and writes the files to a Parquet table at path: (shard, start, n_ids, content)."""
    n = shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    parts = 3 * n
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)))
    bounds = F.array(*(F.lit(int(c)) for c in cuts)) if cuts else F.array().cast("array<long>")
    shard = F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    shard = F.when(F.col("doc_id").isNull(), 0).otherwise(shard)
    dealt = docs.withColumn("shard", shard.cast("int")).repartition(n, "shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("text"), "text")

    def run(batches):
        enc = encoder(vocab, library=True)
        now, start, out = None, 0, FileWriter(block_ids)

        def row():
            nonlocal start, out
            raw, first = out.bytes(), start
            start += out.n
            made = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([first], pa.int64()), pa.array([out.n], pa.int64()), pa.array([raw], pa.binary())], names=["shard", "start", "n_ids", "content"])
            out = FileWriter(block_ids)
            return made

        for b in batches:
            rows = zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()))
            for s, i, pieces in rows:
                if s != now:
                    if out.doc_ids:
                        yield row()
                    now, start = s, 0
                for ids in pieces:
                    out.add(ids)
                out.close(i, end)
                if out.size() >= file_ids:
                    yield row()
        if out.doc_ids:
            yield row()

    dealt.mapInArrow(run, "shard int, start long, n_ids long, content binary").write.parquet(path)


def _read(spark: SparkSession, path: str, run, schema: str) -> DataFrame:
    files = spark.read.schema("shard int, start long, n_ids long, content binary").parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each shard
    bases, total = [], 0
    for r in sums:
        bases.append((r.shard, total))
        total += r.n
    base = spark.createDataFrame(bases, "shard int, base long")
    return files.join(F.broadcast(base), "shard").select((F.col("base") + F.col("start")).alias("start"), "content").mapInArrow(run, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of all documents in the files at path."""

    def run(batches):
        for b in batches:
            for start, raw in zip(b.column("start").to_pylist(), b.column("content").to_pylist()):
                f = FileReader(raw)
                ids = [np.concatenate(list(f.pieces(d))) for d in range(len(f.doc_ids))]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(f.starts + start, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return _read(spark, path, run, "doc_id long, start long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files at path."""

    def run(batches):
        for b in batches:
            for start, raw in zip(b.column("start").to_pylist(), b.column("content").to_pylist()):
                f, sums = FileReader(raw), []
                for d in range(len(f.doc_ids)):
                    c = 0
                    for piece in f.pieces(d):
                        c = zlib.crc32(np.ascontiguousarray(piece), c)
                    sums.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(f.starts + start, pa.int64()), pa.array(f.lengths, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(spark, path, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import tokenizer_path

    path = new_path(spark, "token-planes")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_digests(spark, path)
