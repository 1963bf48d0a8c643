"""Token ids in files of fixed-width bit-packed blocks.

A file holds documents in order. Layout, little-endian:
  magic     'TKPK'
  blocks    each: the ids' bits in a row, id by id, lowest bit first, padded to a byte
  offsets   u64 for each block, and the end: where its bytes begin in the file
  documents u8 null flags, i64 ids and u64 counts of ids, of all documents
  footer    version u32, bits u32, ids a block u32, ids u64, documents u64, blocks u64, magic
A block holds a fixed number of ids, so id i is in block i // ids_a_block; any range of ids is read by
seeking to its blocks alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

MAGIC, VERSION, IDS_A_BLOCK = b"TKPK", 1, 65_536
FOOTER = struct.Struct("<IIIQQQ4s")


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    as_bits = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(as_bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    def __init__(self, out: BinaryIO, bits: int, ids_a_block: int = IDS_A_BLOCK):
        self.out, self.bits, self.size = out, bits, ids_a_block
        self.rest: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.at = len(MAGIC)
        self.offsets: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.rest.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        while self.waiting >= self.size:
            flat = np.concatenate(self.rest)
            full = len(flat) // self.size * self.size
            for a in range(0, full, self.size):
                self._block(flat[a : a + self.size])
            self.rest, self.waiting = [flat[full:]], len(flat) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(data)
        self.out.write(data)

    def finish(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        self.out.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        null = np.array([d is None for d, _ in self.docs], np.uint8)
        self.out.write(null.tobytes() + np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes())
        self.out.write(FOOTER.pack(VERSION, self.bits, self.size, self.ids, len(self.docs), len(self.offsets), MAGIC))


class Reader:
    """Random access to a file; source: anything that seeks and reads."""

    def __init__(self, source: BinaryIO, size: int):
        self.source = source
        version, self.bits, self.size, self.ids, self.n_docs, self.blocks, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        tail = 8 * (self.blocks + 1) + 17 * self.n_docs
        data = self._at(size - FOOTER.size - tail, tail)
        self.offsets = np.frombuffer(data, "<u8", self.blocks + 1).astype(np.int64)
        at = 8 * (self.blocks + 1)
        self.null = np.frombuffer(data, np.uint8, self.n_docs, at).astype(bool)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at + self.n_docs)
        self.counts = np.frombuffer(data, "<u8", self.n_docs, at + 9 * self.n_docs).astype(np.int64)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, by reading the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.size, (stop - 1) // self.size + 1
        data, base = self._at(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a])), int(self.offsets[a])
        out = [unpack(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], self.bits, min(self.size, self.ids - k * self.size)) for k in range(a, b)]
        return np.concatenate(out)[start - a * self.size : stop - a * self.size]

    def documents(self, blocks_at_once: int = 16) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first position, ids) of each document, reading ahead a bounded number of blocks."""
        at, held, base = 0, np.zeros(0, np.uint32), 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.counts.tolist(), strict=True):
            if at + n > base + len(held):
                stop = min(self.ids, max(at + n, at + blocks_at_once * self.size))
                held, base = self.range(at, stop), at
            yield None if null else doc, at, held[at - base : at - base + n]
            at += n


def open_fs(path: str):
    """The file system of a path and the path in it: file://, hdfs:// and what else pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_tokens(df: DataFrame, tokenizer: str, folder: str, mode: str = "byte", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", ids_a_block: int = IDS_A_BLOCK) -> list[dict]:
    """Encode every text and write files in folder, ids ascending over the files; returns the files in order.

    Rows are range-partitioned and sorted by id (a null id first; equal ids by a hash of their text, and equal rows
    by where they stand, so that they needn't meet in one task), so each task writes one file in order and memory
    holds a batch. What moves are texts: packed ids would be larger than texts as Spark compresses them. A task
    writes under a name of its own attempt and renames at the end: a task that runs again or twice leaves one whole
    file of the same bytes.
    """
    from tokenizers import Tokenizer

    bits = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))

    def write(batches):
        from pyspark import TaskContext

        from .encoding import encoder

        context = TaskContext.get()
        part = context.partitionId()
        enc, system, writer = encoder(tokenizer, mode), None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                piece = batch.slice(a, 512)
                ids, off = enc.encode(piece.column(1), end_id)
                if writer is None:
                    system, base = open_fs(folder)
                    name = f"{base}/part-{part:06d}.tok"
                    temp = f"{base}/.part-{part:06d}-{context.taskAttemptId()}.tmp"
                    out = system.open_output_stream(temp)
                    writer = Writer(out, bits, ids_a_block)
                for k, doc in enumerate(piece.column(0).to_pylist()):
                    writer.add(doc, ids[off[k] : off[k + 1]])
        enc.trim()
        if writer is None:
            return
        writer.finish()
        out.close()
        system.move(temp, name)
        row = {"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}.tok"], "documents": [len(writer.docs)], "ids": [writer.ids]}
        yield pa.RecordBatch.from_pydict(row)

    system, base = open_fs(folder)
    system.create_dir(base)
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "tie", "at").sortWithinPartitions("doc_id", "tie", "at").select("doc_id", "text")
    files = ordered.mapInArrow(write, "part int, path string, documents bigint, ids bigint").collect()  # one row a file
    start, out = 0, []
    for f in sorted(files, key=lambda f: f.part):
        out.append(f.asDict() | {"start": start})
        start += f.ids
    return out


def read_tokens(spark: SparkSession, files: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the files."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = open_fs(path)
                rows: list[tuple] = []
                with system.open_input_file(name) as source:
                    for doc, at, ids in Reader(source, source.size()).documents():
                        rows.append((doc, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(f["path"], f["start"]) for f in files], "path string, start bigint").repartition(max(1, len(files)))
    return listed.mapInArrow(read, schema)


def round_trip(df: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write df's token files and read them back: one row per input row (repeated rows too; no rows for none).

    Null and empty texts have the end id alone. Very long texts are encoded whole; other columns are ignored.
    """
    folder = folder or scratch_path(df.sparkSession, "tokens")
    return read_tokens(df.sparkSession, write_tokens(df, tokenizer, folder, **options))
