"""What the streaming twin keeps and sends between micro-batches."""

import pickle
import random

import pytest
from tickloom.operators.book import Book, signals
from tickloom.plans.registry import QUERIES
from tickloom.streaming.book_stream import drain, stream_signals

TAPE = "sym int, seq bigint, type string, ref bigint, side string, price bigint, qty bigint"


def test_book_goes_on_from_its_pickle():
    rng, book = random.Random(3), Book()
    for ref in range(1, 3000):
        if ref % 100 == 0:
            book, was = pickle.loads(pickle.dumps(book)), book
            assert list(book.live) and book.live == was.live and book.top() == was.top()
            for side in "BS":
                queues, old = book.sides[side].queues, was.sides[side].queues
                assert {p: list(q) for p, q in queues.items()} == {p: list(q) for p, q in old.items()} and book.sides[side].depth == was.sides[side].depth
            twin = pickle.loads(pickle.dumps(was))
            assert twin.new_order(-ref, "B", 10_000, 10**6) == was.new_order(-ref, "B", 10_000, 10**6)  # all asks, in turn
        if rng.random() < 0.3:
            book.cancel(rng.randrange(1, ref + 1))
        book.new_order(ref, rng.choice("BS"), 1000 + rng.randint(-9, 9), rng.randint(1, 25), display=rng.choice([None, None, 2]))
    resting = Book()
    for ref in range(50_000):
        resting.new_order(ref + 1, "B", 1000 + ref % 30, 5 + ref % 7)
    assert len(pickle.dumps(resting)) < 20 * 50_000


def _run(spark, tmp_path, parts, confs=()):
    for part in parts:  # a file and so a micro-batch each
        spark.createDataFrame(part, TAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/tape")
    updates = stream_signals(spark.readStream.schema(TAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/tape"))
    for key, value in confs:
        spark.conf.set(key, value)
    try:
        query = updates.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    finally:
        for key, _ in confs:
            spark.conf.unset(key)
    return query, [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("sym", "seq").collect()]


def test_a_book_is_sent_once_a_micro_batch(spark, tmp_path):
    """However many Arrow batches a sym's messages take. All rest, so the top changes rarely and the book only grows."""
    adds = [(0, n, "A", n + 1, "B", 1000 - n % 50, 5) for n in range(20_000)]
    query, got = _run(spark, tmp_path, [adds[:10_000], adds[10_000:]], [("spark.sql.execution.arrow.maxRecordsPerBatch", "100")])
    assert len(got) == 400 and got[-1][4] == 2000
    nodes, sent = [query._jsq.streamingQuery().lastExecution().executedPlan()], None
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if "WithState" in node.nodeName():
            sent = node.metrics().apply("pythonDataSent").value()
    assert sent is not None and sent < 2_000_000  # of 10,000 messages and a book of 10,000 orders


def test_messages_of_a_stream_keep_64_bits(spark, tmp_path):
    far = 2**53 + 1
    rows = [(0, 0, "A", 1, "B", far, 7), (0, 1, "E", 1, None, None, 2), (1, 2, "A", 3, "S", far + 2, 4), (0, 3, "D", 1, None, None, None)]
    _, got = _run(spark, tmp_path, [rows])
    want = []
    for sym, at, tops in ((0, [0, 1, 3], [(far, 7, -1, 0), (far, 5, -1, 0), (-1, 0, -1, 0)]), (1, [2], [(-1, 0, far + 2, 4)])):
        want += [(sym, seq, s[6], *s[:6]) for seq, s in zip(at, signals(tops), strict=True)]
    assert got == want


def test_drain_folds_each_message_once(spark, tmp_path):
    """Whatever tap and consumer do with a batch: rows are counted where they come out of the fold."""
    for low in (0, 500):
        rows = [(n % 2, n, "A", n + 1, "B", 1000 + n, 5) for n in range(low, low + 500)]
        spark.createDataFrame(rows, TAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/tape")
    log = f"{tmp_path}/folded"

    def counted(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write("x" * batch.num_rows)
            yield batch

    updates = stream_signals(spark.readStream.schema(TAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/tape"))
    consumed, tapped = [], []
    drain(updates.mapInArrow(counted, updates.schema), lambda b, n: consumed.append((n, [tuple(r) for r in b.collect()])), f"{tmp_path}/state", lambda b, n: tapped.append((n, b.count(), len(b.collect())))).awaitTermination()
    assert tapped == [(0, 500, 500), (1, 500, 500)]
    assert [n for n, _ in consumed] == [0, 1] and all([(r[0], r[2]) for r in b] == [(s, p) for s in (0, 1) for p in range(250 * n + 1, 250 * n + 251)] for n, b in consumed)
    with open(log) as f:
        assert len(f.read()) == 1000


@pytest.mark.parametrize("n", [0, 1, 40])
def test_stream_queries_on_odd_ids(spark, tmp_path, n):
    """No event at all, one, and ids below zero."""
    rows = [(k - 20, 4 * k + k % 2, ["view", "click", "error", "signup", "view"][k % 5], 1.5 + k, f'{{"k": {k}}}') for k in range(n)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string")
    df.selectExpr("event_id", "timestamp_ntz '2024-01-01' ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    want = {tuple(r) for r in QUERIES["m10_kernel_signals"](spark, str(tmp_path)).collect()}
    assert {tuple(r) for r in QUERIES["t1_stream_signals"](spark, str(tmp_path)).collect()} == want and bool(want) == bool(n)
    got = {r.sym: (r.updates, r.journalled, r.last_pub) for r in QUERIES["t5_drain_and_tap"](spark, str(tmp_path)).collect()}
    assert got == {s: (k, k, k) for s in {r[0] for r in want} for k in [sum(r[0] == s for r in want)]}
