"""Order messages on the wire: length-prefixed big-endian frames, as columns, as files and as a Spark data source.

A file is a sequence of frames, so it is one split; many files are read in parallel. Reading stops at the first
frame that is cut short, has the wrong length for its type, or is of an unknown type, and says so.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickloom.functions.scalars import XorShift64Star, big_endian, to_big_endian
from tickloom.sources.scratch import open_fs

# Fixed values of the format: payload bytes of each type.
LENGTHS = {"A": 36, "E": 31, "X": 23, "D": 19}
OPEN_NS = 34_200_000_000_000
#: First 8 bytes of a journal, its header's bytes, and where data begin.
JOURNAL_MAGIC = (0x314C4E524A424F4C).to_bytes(8, "little")
JOURNAL_HEADER, JOURNAL_DATA = "<8sQQQ", 4096


def encode(messages: DataFrame) -> DataFrame:
    """messages with a column frame: type, stock_locate, tracking, ts_ns, ref, side, qty, stock, price, match as bytes."""
    kind = F.col("type")
    length = F.create_map(*(F.lit(x) for kv in LENGTHS.items() for x in kv))[kind]
    head = [to_big_endian(length, 2), F.encode(kind, "US-ASCII"), to_big_endian(F.col("stock_locate"), 2), to_big_endian(F.col("tracking"), 2), to_big_endian(F.col("ts_ns"), 6), to_big_endian(F.col("ref"), 8)]
    qty = to_big_endian(F.col("qty"), 4)
    add = [F.encode("side", "US-ASCII"), qty, F.encode(F.rpad("stock", 8, " "), "US-ASCII"), to_big_endian(F.col("price"), 4)]
    body = F.when(kind == "A", F.concat(*add)).when(kind == "E", F.concat(qty, to_big_endian(F.col("match"), 8))).when(kind == "X", qty).otherwise(F.lit(b""))
    return messages.withColumn("frame", F.concat(*head, body))


def decode(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """The fields of each frame's payload as columns, next to the others; side as it is on the wire."""
    f = F.col(frame)
    kind = F.substring(f, 3, 1).cast("string")
    field = lambda at, n, on: F.when(kind.isin(*on), big_endian(f, at, n).cast("bigint"))
    text = lambda at, n: F.when(kind == "A", F.rtrim(F.substring(f, at + 1, n).cast("string")))
    every = tuple(LENGTHS)
    return frames.select(
        *(c for c in frames.columns if c != frame), kind.alias("type"), field(3, 2, every).alias("stock_locate"), field(5, 2, every).alias("tracking"), field(7, 6, every).alias("ts_ns"),
        field(13, 8, every).alias("ref"), text(21, 1).alias("side"), F.when(kind == "A", big_endian(f, 22, 4)).when(kind.isin("E", "X"), big_endian(f, 21, 4)).alias("qty"),
        text(26, 8).alias("stock"), field(34, 4, "A").alias("price"), field(25, 8, "E").alias("match"),
    )


def to_side(wire_side: Column) -> Column:
    """'B' is a buy, anything else a sell."""
    return F.when(wire_side == "B", "B").when(wire_side.isNotNull(), "S")


class FrameReader:
    """Frames of a byte stream that is fed in chunks; halted is set at the first bad frame."""

    def __init__(self) -> None:
        self.rest, self.consumed, self.halted = b"", 0, False

    def feed(self, chunk: bytes) -> Iterator[bytes]:
        data, at = self.rest + chunk, 0
        while not self.halted and len(data) - at >= 3:
            size = int.from_bytes(data[at : at + 2], "big")
            if LENGTHS.get(chr(data[at + 2])) != size:
                self.halted = True
            elif len(data) - at < size + 2:
                break
            else:
                yield data[at : at + size + 2]
                at += size + 2
        self.consumed += at
        self.rest = data[at:]

    @property
    def clean_end(self) -> bool:
        return not self.halted and not self.rest


def _chunks(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The wire bytes of a file: of a journal, its committed prefix (checked against the file's size)."""
    system, name = open_fs(path)
    total = system.get_file_info(name).size
    with system.open_input_stream(name) as source:
        head = source.read(struct.calcsize(JOURNAL_HEADER))
        if head[:8] == JOURNAL_MAGIC:
            _, _, committed, _ = struct.unpack(JOURNAL_HEADER, head)
            if JOURNAL_DATA + committed > total:
                raise ValueError(f"{path}: {committed} bytes are committed, the file is shorter")
            source.read(JOURNAL_DATA - struct.calcsize(JOURNAL_HEADER))
            while committed:
                chunk = source.read(min(size, committed))
                committed -= len(chunk)
                yield chunk
        else:
            yield head
            while chunk := source.read(size):
                yield chunk


class _File(InputPartition):
    pass


class WireReader(DataSourceReader):
    def __init__(self, options: dict, status: bool):
        self.paths, self.status = options["path"].split(","), status

    def partitions(self):
        out = []
        for path in self.paths:
            from pyarrow import fs

            system, name = open_fs(path)
            scheme = path.split("://")[0] + "://" if "://" in path else ""
            info = system.get_file_info(name)
            files = [info.path] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
            out += [_File(scheme + f) for f in files]
        return out

    def read(self, partition):
        path, reader, n, frames = partition.value, FrameReader(), 0, []
        for chunk in _chunks(path):
            for frame in reader.feed(chunk):
                frames.append(frame)
                if len(frames) == 10_000 and not self.status:
                    yield self._batch(path, n, frames)
                    n, frames = n + len(frames), []
            if self.status:
                n, frames = n + len(frames), []
        if self.status:
            yield pa.RecordBatch.from_pydict({"path": [path], "frames": [n], "bytes_consumed": [reader.consumed], "clean_eof": [reader.clean_end]})
        elif frames:
            yield self._batch(path, n, frames)

    @staticmethod
    def _batch(path: str, n: int, frames: list[bytes]):
        return pa.RecordBatch.from_pydict({"path": [path] * len(frames), "pos": list(range(n, n + len(frames))), "frame": pa.array(frames, pa.binary())})


class WireSource(DataSource):
    """format('wire'): path (a file, a folder, or several with commas) -> path, pos, frame. With status=true: a row for
    each file: path, frames, bytes_consumed, clean_eof."""

    @classmethod
    def name(cls) -> str:
        return "wire"

    def _status(self) -> bool:
        return self.options.get("status", "false").lower() == "true"

    def schema(self) -> str:
        return "path string, frames bigint, bytes_consumed bigint, clean_eof boolean" if self._status() else "path string, pos bigint, frame binary"

    def reader(self, schema):
        return WireReader(dict(self.options), self._status())


def read_wire(spark, path: str, status: bool = False) -> DataFrame:
    spark.dataSource.register(WireSource)
    return spark.read.format("wire").option("status", str(status).lower()).load(path)


def write_wire(frames: DataFrame, folder: str, key: str = "sym", order: str = "seq", journal_capacity: int | None = None) -> DataFrame:
    """A file of frames for each key, in order; a row for each: path, committed, dropped.

    With journal_capacity the file is a journal: a header page, then the frames while they fit; from the first that
    doesn't, all are dropped and counted. A file is written under another name and renamed when it is whole. Frames
    are written as they come: what a task holds is a batch.
    """
    capacity = journal_capacity

    def write(batches):
        from pyspark import TaskContext

        system = base = out = now = None
        said, held = [], []

        def flush():
            out.write(b"".join(held))
            held.clear()

        def close():
            if out is not None:
                flush()
                out.close()
                system.move(temp(), f"{base}/{now}.bin")

        def temp():
            return f"{base}/.{now}-{TaskContext.get().taskAttemptId()}.tmp"

        for batch in batches:
            waiting = 0
            for k, frame, upto, committed, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or k != now:
                    close()
                    if system is None:
                        system, base = open_fs(folder)
                        system.create_dir(base)
                    now = k
                    out = system.open_output_stream(temp())
                    said.append((f"{folder}/{now}.bin", committed, total - committed))
                    if capacity is not None:
                        held.append(struct.pack(JOURNAL_HEADER, JOURNAL_MAGIC, capacity, committed, total - committed).ljust(JOURNAL_DATA, b"\0"))
                if upto <= committed:
                    held.append(frame)
                    waiting += len(frame)
                    if waiting > 1 << 20:
                        flush()
                        waiting = 0
        close()
        if said:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*said, strict=True)], ["path", "committed", "dropped"])

    of = Window.partitionBy(key)
    upto = F.sum(F.octet_length("frame")).over(of.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = frames.select(key, order, "frame").repartition(key).sortWithinPartitions(key, order).withColumn("upto", upto)
    fits = F.col("upto") if capacity is None else F.when(F.col("upto") <= capacity, F.col("upto"))
    rows = rows.withColumn("committed", F.coalesce(F.max(fits).over(of), F.lit(0).cast("bigint"))).withColumn("total", F.max("upto").over(of))
    rows = rows.sortWithinPartitions(key, order).select(key, "frame", "upto", "committed", "total")
    return rows.mapInArrow(write, "path string, committed bigint, dropped bigint")


def generate_feed(n: int, seed: int, mid: int = 1_032_768) -> list[dict]:
    """A deterministic session of n messages: about 55 % adds, 25 % executes, 12 % partial cancels, 8 % deletes.

    Every message but an add hits a live order; adds stay 1 to 32 ticks from mid on their side, so none crosses.
    The generator is a chain of states, so it runs on the driver.
    """
    rng, live, out = XorShift64Star(seed), [], []
    now, refs, matches = OPEN_NS, 0, 0
    while len(out) < n:
        r = rng.next()
        pick = r % 100 if live else 0
        now += 1 + (r & 1023)
        row = {"seq": len(out), "ts_ns": now, "type": "A", "ref": 0, "side": None, "qty": None, "price": None, "match": None}
        if pick < 55:
            refs += 1
            side, away, qty = ("B" if r >> 8 & 1 else "S"), 1 + (r >> 16 & 31), 4 + (r >> 24 & 31)
            row |= {"ref": refs, "side": side, "qty": qty, "price": mid - away if side == "B" else mid + away}
            live.append([refs, qty])
        else:
            k = (r >> 32) % len(live)
            ref, left = live[k]
            row["ref"] = ref
            if pick < 80:
                matches += 1
                qty = min(1 + (r >> 16 & 7), left)
                row |= {"type": "E", "qty": qty, "match": matches}
                live[k][1] -= qty
            elif pick < 92:
                if left < 2:
                    continue
                qty = 1 + (r >> 16) % (left - 1)
                row |= {"type": "X", "qty": qty}
                live[k][1] -= qty
            else:
                row["type"] = "D"
                live[k][1] = 0
            if live[k][1] == 0:
                live[k] = live[-1]
                live.pop()
        out.append(row)
    return out


def crossing_workload(n: int, seed: int, mid: int = 1_032_768, window: int = 4096) -> list[dict]:
    """A deterministic workload that crosses: 58 % passive adds, 36 % aggressive adds, 6 % cancels of one of the last
    `window` adds (by position; 0 while that place is empty)."""
    rng, out, recent = XorShift64Star(seed), [], [0] * window
    placed = 0
    for seq in range(n):
        r = rng.next()
        pick, side = r % 100, "B" if r >> 8 & 1 else "S"
        sign = -1 if side == "B" else 1
        row = {"seq": seq, "type": "A", "ref": seq + 1, "side": side, "price": None, "qty": None}
        if pick < 58:
            row |= {"price": mid + sign * (1 + (r >> 16 & 31)), "qty": 1 + (r >> 24 & 7)}
        elif pick < 94:
            row |= {"price": mid - sign * 8, "qty": 8 + (r >> 24 & 15)}
        else:
            row |= {"type": "D", "ref": recent[(r >> 32) % window], "side": None}
        if row["type"] == "A":
            recent[placed % window] = row["ref"]
            placed += 1
        out.append(row)
    return out
