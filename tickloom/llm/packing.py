"""Bounded-space online packing of documents into sequences of a fixed window.

Each partition keeps a fixed number of open windows. A document's full windows are cut off at once; what is
left goes to the open window where it fits best. When it fits none, the fullest is topped up with its first
ids (unless the gap is under least_cut, which is padded) and emitted, and the rest is placed again. At the
end the open windows of many partitions are merged, group by group, into full windows, and the last ids of
a group go to sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

WINDOW, OPEN_WINDOWS, LEAST_CUT = 4096, 32, 16
#: Partitions whose leftovers are merged in one task: at most MERGED * OPEN_WINDOWS windows of ids.
MERGED = 8

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: (doc_id, start, ids, doc_tokens)
Piece = tuple[int | None, int, np.ndarray, int]


def rows_of(pieces: list[Piece], sequence: int) -> Iterator[tuple]:
    at = 0
    for doc, start, ids, total in pieces:
        yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, at
        at += len(ids)


class Packer:
    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT):
        self.window, self.most, self.least_cut = window, open_windows, least_cut
        self.open: list[list[Piece]] = []
        self.fill: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Full or emitted windows that the document brings about."""
        at, total, w = 0, len(ids), self.window
        while total - at >= w:
            yield [(doc, at, ids[at : at + w], total)]
            at += w
        while at < total:
            left = total - at
            fits = [(f, k) for k, f in enumerate(self.fill) if f + left <= w]
            if fits or len(self.open) < self.most:
                if fits:
                    k = max(fits)[1]
                else:
                    k = len(self.open)
                    self.open.append([])
                    self.fill.append(0)
                self.open[k].append((doc, at, ids[at:], total))
                self.fill[k] += left
                at = total
            else:
                k = max(range(len(self.fill)), key=self.fill.__getitem__)
                if (gap := w - self.fill[k]) >= self.least_cut:
                    self.open[k].append((doc, at, ids[at : at + gap], total))
                    self.fill[k] += gap
                    at += gap
                yield self._take(k)
            if self.fill and self.fill[k := min(k, len(self.fill) - 1)] == w:
                yield self._take(k)

    def _take(self, k: int) -> list[Piece]:
        self.fill.pop(k)
        return self.open.pop(k)


def merge(pieces: list[Piece], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Full windows of the pieces in a row, then windows of powers of two for the rest."""
    total = sum(len(p[2]) for p in pieces)
    rest, sizes = total % window, [window] * (total // window)
    sizes += [1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1]
    todo = iter(pieces)
    piece = None
    for size in sizes:
        out: list[Piece] = []
        while size:
            doc, start, ids, n = piece or next(todo)
            out.append((doc, start, ids[:size], n))
            piece = (doc, start + size, ids[size:], n) if len(ids) > size else None
            size -= min(size, len(ids))
        yield out


def pack(df: DataFrame, tokenizer: str, mode: str = "word", end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and end_id; null and empty texts have end_id alone. Each id lies in exactly
    one piece. A sequence is shorter than the window by less than least_cut, or a power of two. Rows with
    equal ids are packed as documents of their own; an empty table gives no rows. Texts are encoded once:
    the pieces, and the ids of open windows at the end of a partition, are staged in the shared folder.
    """

    def place(batches):
        from pyspark import TaskContext

        from .encoding import encoder

        part, number = TaskContext.get().partitionId(), 0
        enc, packer, held = encoder(tokenizer, mode), Packer(window, open_windows, least_cut), []

        def table(rows: list[tuple], part: int | None = None, ids: list | None = None):
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array([part] * len(rows), pa.int32()), pa.array(ids or [None] * len(rows), pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, [*COLUMNS, "part", "ids"])

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                piece = batch.slice(a, 512)
                ids, off = enc.encode(piece.column(1), end_id)
                for k, doc in enumerate(piece.column(0).to_pylist()):
                    for done in packer.add(doc, ids[off[k] : off[k + 1]].copy()):
                        held += rows_of(done, part << 28 | number)
                        number += 1
                if len(held) >= 10_000:
                    yield table(held)
                    held = []
        enc.trim()
        if held:
            yield table(held)
        for k, pieces in enumerate(packer.open):
            yield table(list(rows_of(pieces, k)), part, [p[2].astype("<u4").tobytes() for p in pieces])

    def merged(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "sequence_id", "offset"])
        doc_ids = [None if pd.isna(d) else int(d) for d in rows.doc_id]
        pieces = [(d, s, np.frombuffer(x, "<u4"), n) for d, s, x, n in zip(doc_ids, rows.start, rows.ids, rows.doc_tokens, strict=True)]
        out = [r for k, w in enumerate(merge(pieces, window)) for r in rows_of(w, 1 << 60 | key[0] << 28 | k)]
        return pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64"})

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = staged(rows.mapInArrow(place, SCHEMA + ", part int, ids binary"), "packed")
    left = first.where("part is not null").withColumn("group", F.expr(f"part div {MERGED}"))
    return first.where("part is null").select(*COLUMNS).unionByName(left.groupBy("group").applyInPandas(merged, SCHEMA))
