"""Token ids in binary files: patched frame-of-reference blocks.

A file holds the ids of a range of documents in ascending order of ``doc_id``, in blocks of ``BLOCK`` ids. A block
subtracts its minimum, packs every difference at the width that a percentile of them needs, and keeps the
differences that do not fit in an exception list (positions and values). Layout, little-endian:

    per block: uint32 minimum | uint8 width | uint16 ids | uint16 exceptions | packed differences
               | uint16 position per exception | uint32 difference per exception
    index: uint64 start of each block
    documents: int64 doc_id each | uint8 null flag each | uint64 ids each
    foot: uint64 start of the index | uint64 start of the documents | uint64 ids | uint32 blocks
          | uint64 documents | uint32 block size | magic "PFR1"

A manifest table (Parquet) names the files of successful tasks. A file's name holds its task attempt, so a repeated
attempt never touches a file that a manifest names.
"""

from __future__ import annotations

import posixpath
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.llm.frames import SLICE_ROWS, ready, slices
from millrace.llm.words import word_tokenizer

BLOCK = 4096
PERCENTILE = 0.95
_FOOT, _BLOCK_HEAD = struct.Struct("<QQQIQI4s"), struct.Struct("<IBHH")


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most 65,535 ids."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    at = min(len(rest) - 1, int(percentile * len(rest)))
    width = int(np.partition(rest, at)[at]).bit_length()
    above = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    fits = rest.copy()
    fits[above] = 0
    if width:
        size = 2 if width <= 16 else 4
        bits = np.unpackbits(fits.astype(f"<u{size}").view(np.uint8).reshape(-1, size), axis=1, count=width, bitorder="little")
        packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    else:
        packed = b""
    return (_BLOCK_HEAD.pack(low, width, len(ids), len(above)) + packed + above.astype("<u2").tobytes()
            + rest[above].astype("<u4").tobytes())


def unpack_block(raw: bytes) -> np.ndarray:
    """The ids of ``pack_block``."""
    low, width, count, exceptions = _BLOCK_HEAD.unpack_from(raw)
    at = _BLOCK_HEAD.size
    size = (count * width + 7) // 8
    if width:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=count * width, bitorder="little")
        wide = np.zeros((count, 16 if width <= 16 else 32), np.uint8)
        wide[:, :width] = bits.reshape(count, width)
        ids = np.packbits(wide, axis=1, bitorder="little").view(f"<u{wide.shape[1] // 8}").ravel().astype(np.uint32)
    else:
        ids = np.zeros(count, np.uint32)
    at += size
    ids[np.frombuffer(raw, "<u2", exceptions, at)] = np.frombuffer(raw, "<u4", exceptions, at + 2 * exceptions)
    return ids + np.uint32(low)


class Writer:
    """Writes one file to a stream; ``add`` takes a document's little-endian unsigned 32-bit ids."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block = stream, block
        self.pending, self.held, self.total, self.at = [], 0, 0, 0
        self.starts, self.doc_ids, self.counts = [], [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(raw) // 4)
        self.pending.append(raw)
        self.held += len(raw) // 4
        if self.held >= self.block:
            self._flush(False)

    def _write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        end = len(ids) if last else len(ids) // self.block * self.block
        for begin in range(0, end, self.block):
            self.starts.append(self.at)
            self._write(pack_block(ids[begin:min(begin + self.block, end)]))
        self.total += end
        self.pending, self.held = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        index = self.at
        self._write(np.array(self.starts, "<u8").tobytes())
        documents = self.at
        self._write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self._write(bytes(d is None for d in self.doc_ids))
        self._write(np.array(self.counts, "<u8").tobytes())
        self._write(_FOOT.pack(index, documents, self.total, len(self.starts), len(self.counts), self.block, b"PFR1"))


class Reader:
    """Reads a file block by block; ``source`` is seekable and has ``size()``."""

    def __init__(self, source):
        self.source = source
        foot = self._at(source.size() - _FOOT.size, _FOOT.size)
        index, documents, self.total, blocks, count, self.block, magic = _FOOT.unpack(foot)
        if magic != b"PFR1":
            raise ValueError("not a token file")
        self.starts = [*np.frombuffer(self._at(index, 8 * blocks), "<u8").tolist(), index]
        raw = self._at(documents, 17 * count)
        nulls = np.frombuffer(raw, np.uint8, count, 8 * count)
        self.doc_ids = [None if null else d
                        for d, null in zip(np.frombuffer(raw, "<i8", count).tolist(), nulls.tolist())]
        self.counts = np.frombuffer(raw, "<u8", count, 9 * count).tolist()
        self.cached = (-1, np.empty(0, np.uint32))

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start``."""
        parts = []
        for k in range(start // self.block, -(-(start + count) // self.block)):
            if self.cached[0] != k:
                self.cached = (k, unpack_block(self._at(self.starts[k], self.starts[k + 1] - self.starts[k])))
            begin = k * self.block
            parts.append(self.cached[1][max(0, start - begin):start + count - begin])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def documents(self):
        """(doc_id, start in this file, ids) of each document in order."""
        start = 0
        for doc_id, count in zip(self.doc_ids, self.counts):
            yield doc_id, start, self.read(start, count)
            start += count


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's address; a plain path is a shared mount."""
    if ":/" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_files(df: DataFrame, folder: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
                end_id: int = 1) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the ids in ascending ``doc_id`` order, null ids first.

    Rows of one ``doc_id`` go in order of their texts' hashes; a null text is empty; other columns are not read. An
    empty table writes no file. Writes one file per range of ``doc_id`` under ``folder``, which all executors reach,
    and returns the manifest, written to ``folder/manifest``: file, part (its place in the order), n_ids, n_docs.
    """
    spark = df.sparkSession
    ready(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.col("__h").asc()]
    dealt = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                      F.xxhash64(F.col(f"`{text}`")).alias("__h")) \
        .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    target = f"{folder.rstrip('/')}/ids"

    def run(batches):
        tokenizer, end = word_tokenizer(vocabulary), end_id.to_bytes(4, "little")
        system, path = _file_system(target)
        system.create_dir(path, recursive=True)
        context = TaskContext.get()
        part = context.partitionId()
        name = f"ids-{part:06d}-{context.taskAttemptId()}.pfr"
        writer = stream = None
        for batch in batches:
            if writer is None and batch.num_rows:
                stream = system.open_output_stream(posixpath.join(path, name))
                writer = Writer(stream)
            for piece in slices(batch):
                for key, value in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    writer.add(key, tokenizer.encode(value) + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({
                "file": [name], "part": pa.array([part], pa.int32()), "n_ids": [writer.total],
                "n_docs": [len(writer.counts)]})

    manifest = f"{folder.rstrip('/')}/manifest"
    dealt.mapInArrow(run, "file string, part int, n_ids long, n_docs long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents as the files of ``write_files`` hold them: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers) and, if asked, ids (those bytes)."""
    ready(spark)
    files = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("file", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    dealt = placed.repartitionByRange(max(1, files.count()), "part")
    source = f"{folder.rstrip('/')}/ids"
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] \
        + ([("ids", pa.binary())] if with_ids else [])

    def run(batches):
        system, path = _file_system(source)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(posixpath.join(path, row["file"])) as stream:
                    out = []
                    for doc_id, start, ids in Reader(stream).documents():
                        raw = ids.astype("<u4").tobytes()
                        out.append((doc_id, row["first"] + start, len(ids), zlib.crc32(raw), raw)[:len(fields)])
                        if len(out) == SLICE_ROWS:
                            yield _batch(out, fields)
                            out = []
                    if out:
                        yield _batch(out, fields)

    return dealt.mapInArrow(run, ", ".join(f"{name} {'binary' if name == 'ids' else 'long'}" for name, _ in fields))


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields)],
                                      schema=pa.schema(fields))
