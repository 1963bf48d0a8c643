"""The streaming twin: the same book, kept as state for each sym between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.book import Book, signals
from tickloom.operators.kernel import FIELDS, ROWS_A_BATCH, SIGNALS, _apply

PACKED = 100_000  # messages that a task packs together, at least


def _pack(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a sym and some of its messages, a serialized batch of what follows sym in the schema."""

    def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(some).cast(schema).sort_by("sym").combine_chunks().to_batches()[0]
        runs = pc.run_end_encode(rows["sym"])
        starts, ends = [0, *runs.run_ends.to_pylist()], runs.run_ends.to_pylist()
        pieces = [rows.slice(low, high - low).drop_columns("sym").serialize().to_pybytes() for low, high in zip(starts, ends, strict=False)]
        return pa.RecordBatch.from_arrays([runs.values, pa.array(pieces, pa.binary())], ["sym", "messages"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED:
            yield packed(held)
            held = []
    if any(b.num_rows for b in held):
        yield packed(held)


def _messages(frames: Iterable[pd.DataFrame], schema: pa.Schema) -> Iterator[tuple]:
    """The messages of packed rows in order of seq, as tuples of FIELDS."""
    pieces = [pa.ipc.read_record_batch(pa.py_buffer(data), schema) for frame in frames for data in frame["messages"]]
    for batch in pa.Table.from_batches(pieces, schema).sort_by("seq").to_batches(max_chunksize=ROWS_A_BATCH):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _frame(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


STATE = "book binary, last array<bigint>, ofi bigint, seq bigint"


def _advance(key: tuple, messages: Iterator[tuple], state: GroupState):
    """Fold a sym's messages of this micro-batch, in order of seq, and give each change of the top."""
    book, last, ofi, pub = Book(), (-1, 0, -1, 0), 0, 0
    if state.exists:
        data, kept, ofi, pub = state.get
        book, last = pickle.loads(data), tuple(kept)
    at, out = [], []

    def tops():
        for m in messages:
            _apply(book, m)
            at[:] = [m[0]]
            yield book.top()

    for *top, ofi, micro, pub in signals(tops(), last, ofi, pub):
        last = top
        out.append((int(key[0]), at[0], pub, *top, ofi, micro))
        if len(out) == ROWS_A_BATCH:
            yield _frame(out, SIGNALS)
            out = []
    state.update((pickle.dumps(book), list(last), ofi, pub))
    yield _frame(out, SIGNALS)


def stream_signals(tape: DataFrame) -> DataFrame:
    """The signals of a streaming tape; state per sym is its book, the last top, the running imbalance and number.

    Spark sends a group's state along with every Arrow batch of its rows, so messages are packed before they are grouped:
    a sym's messages of a micro-batch are few rows, and its book goes to Python once.
    """
    columns = ["sym", *[c for c in FIELDS if c in tape.columns]]
    tape = tape.select(*columns)
    whole = to_arrow_schema(tape.schema)
    each = whole.remove(0)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _advance(key, _messages(frames, each), state)

    packed = tape.mapInArrow(lambda batches: _pack(batches, whole), f"sym {dict(tape.dtypes)['sym']}, messages binary")
    return packed.groupBy("sym").applyInPandasWithState(advance, SIGNALS, STATE, "append", GroupStateTimeout.NoTimeout)


def paced(spark: SparkSession, messages_a_second: int, burst: int | None = None) -> DataFrame:
    """A stream of numbered ticks to pace a feed by: evenly, or `burst` at a time. It never waits for its readers."""
    if burst is None:
        return spark.readStream.format("rate").option("rowsPerSecond", messages_a_second).load()
    every = max(1, 1000 * burst // messages_a_second)
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", burst).option("advanceMillisPerBatch", every).load()


def drain(updates: DataFrame, consume, checkpoint: str, tap=None):
    """Start a consumer of every update: consume(batch in order of sym and pub_seq, number); tap gets the batch first
    (a journal, say). A batch comes again after a failure with the same number, so consumers can tell. It is kept while
    both use it, since each use (sorting counts as one) would fold its messages anew."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if tap is not None:
                tap(batch, number)
            consume(batch.orderBy("sym", "pub_seq"), number)
        finally:
            batch.unpersist()

    return updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(spark: SparkSession, source: str, sink: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Run over what is in source (Parquet files, in the order of their time stamps) and give what was written to sink."""
    tape = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream_signals(tape).writeStream.format("parquet").option("checkpointLocation", f"{sink}-checkpoint").outputMode("append").trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return spark.read.parquet(sink)
