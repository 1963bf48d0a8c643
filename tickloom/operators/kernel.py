"""The ordered kernel over a tape: one pass over each sym's messages, in order of seq.

Messages come to a task sorted, in Arrow batches, and are folded as they come: what a task holds is the book of one sym
and a batch, however long the tape is. A kernel is a generator over a sym's messages that yields rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from .book import Book, signals, step
from .risk import RiskGate

FIELDS = ["seq", "type", "ref", "side", "price", "qty", "display", "post_only"]
ROWS_A_BATCH = 20_000


def batched_rows(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, ROWS_A_BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _fold(tape: DataFrame, fn: Callable[[int, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that fn(sym, messages) yields for each sym; messages are tuples of FIELDS, as far as the tape has them."""
    columns = ["sym", *[c for c in FIELDS if c in tape.columns]]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        messages = (m for batch in batches for m in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows = (row for sym, of in groupby(messages, key=lambda m: m[0]) for row in fn(sym, (m[1:] for m in of)))
        yield from batched_rows(rows, arrow)

    return tape.select(*columns).repartition("sym").sortWithinPartitions("sym", "seq").mapInArrow(run, schema)


def _apply(book: Book, m: tuple):
    _, kind, ref, side, price, qty, *more = m
    display, post_only = more if len(more) == 2 else (more[0] if more else None, False)
    return step(book, kind, ref, side, price, qty, display=display, post_only=bool(post_only))


TRADES = "sym int, seq bigint, n int, maker_ref bigint, taker_ref bigint, price bigint, qty bigint"


def trades(tape: DataFrame) -> DataFrame:
    """sym, seq (the taker's message), n (its trades in turn), maker_ref, taker_ref, price, qty."""

    def run(sym, messages):
        book = Book()
        for m in messages:
            for n, t in enumerate(_apply(book, m)[2]):
                yield sym, m[0], n, t.maker, t.taker, t.price, t.qty

    return _fold(tape, run, TRADES)


OUTCOMES = "sym int, seq bigint, ref bigint, outcome string, removed bigint, traded bigint"


def outcomes(tape: DataFrame, base: int | None = None) -> DataFrame:
    """What became of every message: outcome, quantity removed (E X D), quantity traded (A). base: the lowest price taken."""

    def run(sym, messages):
        book = Book(base)
        for m in messages:
            outcome, removed, done = _apply(book, m)
            yield sym, m[0], m[2], outcome, removed, sum(t.qty for t in done)

    return _fold(tape, run, OUTCOMES)


SIGNALS = "sym int, seq bigint, pub_seq bigint, bid_px bigint, bid_qty bigint, ask_px bigint, ask_qty bigint, ofi bigint, micro_px bigint"


def book_signals(tape: DataFrame) -> DataFrame:
    """Top of book, order-flow imbalance and micro-price at each change of the top."""

    def run(sym, messages):
        book, at = Book(), []

        def tops():
            for m in messages:
                _apply(book, m)
                at[:] = [m[0]]
                yield book.top()

        for bp, bq, ap, aq, ofi, micro, pub in signals(tops()):
            yield sym, at[0], pub, bp, bq, ap, aq, ofi, micro

    return _fold(tape, run, SIGNALS)


STATE = "sym int, trades bigint, lots bigint, best_bid bigint, best_ask bigint, fingerprint decimal(20,0)"


def book_state(tape: DataFrame, base: int, ticks: int = 1 << 16) -> DataFrame:
    """Per sym at the end: executes that found their order and their lots, best prices, and the book's fingerprint."""

    def run(sym, messages):
        from decimal import Decimal

        book, n, lots = Book(base, ticks), 0, 0
        for m in messages:
            _, removed, _ = _apply(book, m)
            if m[1] == "E" and removed:
                n, lots = n + 1, lots + removed
        yield sym, n, lots, book.best_bid(), book.best_ask(), Decimal(book.fingerprint(base, ticks))

    return _fold(tape, run, STATE)


MASKS = "sym int, seq bigint, mask int, net bigint, open_buy bigint, open_sell bigint"


def risk_verdicts(tape: DataFrame, config: dict, step_ns: int = 1000) -> DataFrame:
    """A verdict for each add of a wire tape, one account per sym; executes fill and reductions cancel what was accepted."""

    def run(sym, messages):
        gate, book, taken = RiskGate(**config), Book(), {}
        for m in messages:
            seq, kind, ref, side, price, qty = m[:6]
            if kind == "A":
                mask = gate.check(side, price, qty, 10**12 + seq * step_ns)
                if mask == 0:
                    taken[ref] = side
                    _apply(book, m)
                yield sym, seq, mask, gate.net, gate.open["B"], gate.open["S"]
            else:
                _, removed, _ = _apply(book, m)
                if removed:
                    (gate.on_fill if kind == "E" else gate.on_cancel)(taken[ref], removed)

    return _fold(tape, run, MASKS)


LOOP = "sym int, seq bigint, side string, price bigint, mask int, traded bigint"


def closed_loop(tape: DataFrame, config: dict, step_ns: int = 1000) -> DataFrame:
    """The strategy's quotes: it reacts to each change of the top that a feed message makes, its order is gated (the old
    quote still counted), and cancel-and-replace happens before the next feed message. Quotes don't make new tops."""

    def run(sym, messages):
        gate, book = RiskGate(**config), Book()
        mine: dict[str, int] = {}
        live: dict[str, int] = {}
        last = (-1, 0, -1, 0)
        for m in messages:
            _apply(book, m)
            top = book.top()
            if top == last:
                continue
            last = top
            bp, bq, ap, aq = top
            pressure = bq >= aq
            for side, px, want in (("B", bp, bp if pressure else bp - 1), ("S", ap, ap + 1 if pressure else ap)):
                if px < 0 or want == mine.get(side):
                    continue
                mask = gate.check(side, want, 1, 10**12 + m[0] * step_ns)
                traded = 0
                if mask == 0:
                    if side in mine:
                        gate.on_cancel(side, 1)
                    mine[side] = want
                    book.cancel(live.get(side, 0))
                    ref = -(2 * m[0] + (side == "S") + 1)  # own orders' refs are negative
                    _, done = book.new_order(ref, side, want, 1)
                    live[side], traded = ref, sum(t.qty for t in done)
                yield sym, m[0], side, want, mask, traded

    return _fold(tape, run, LOOP)
