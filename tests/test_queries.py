"""Every query with SQL against DuckDB on a small tape, and what the others must satisfy."""

import json
import random

import duckdb
import pytest
from tickloom.plans.registry import ORACLES, QUERIES
from tickloom.sources import itch


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, top, rows, ts = random.Random(2), str(tmp_path_factory.mktemp("sf")), [], 1_700_000_000_000_000
    for i in range(900):
        ts += rng.randrange(2_000_000)
        rows.append((i, ts, rng.randrange(60), rng.choice(["click", "error", "purchase", "signup", "view"]), rng.randrange(1, 49000) / 100, json.dumps({"k": rng.randrange(100)})))
    df = spark.createDataFrame(rows, "event_id bigint, us bigint, user_id bigint, event_type string, value double, props string")
    df.selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{top}/events.parquet")
    return top


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(round(float(r[k]), 9) if isinstance(r[k], float) else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, got.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_crossing_tape(spark, folder):
    trades = QUERIES["m1_match_trades"](spark, folder).collect()
    assert trades and all(t.qty > 0 for t in trades)
    signals = QUERIES["m1_match_signals"](spark, folder).collect()
    assert all(s.bid_px < s.ask_px for s in signals if -1 not in (s.bid_px, s.ask_px))
    icebergs = QUERIES["m3_iceberg_trades"](spark, folder).collect()
    assert len(icebergs) >= len(trades)
    outcomes = QUERIES["p4_post_only_rejects"](spark, folder).where("outcome = 'rejected'").collect()
    assert outcomes and all(r.ref % 5 == 0 for r in outcomes)


def test_risk_and_loop(spark, folder):
    got = QUERIES["r2_risk_gate"](spark, folder).collect()
    assert {0} < {r["mask"] for r in got}
    loop = QUERIES["t6_closed_loop"](spark, folder).collect()
    assert loop and all(r.traded == 0 for r in loop)


def test_generated(spark, folder):
    r = QUERIES["s5_generated_feed"](spark, folder).first()
    feed = itch.generate_feed(20_000, 0x17C4)
    assert (r.trades, r.traded_lots) == (sum(x["type"] == "E" for x in feed), sum(x["qty"] for x in feed if x["type"] == "E"))
    assert QUERIES["s15_crossing_workload"](spark, folder).first().trades > 5000


def test_journal_and_status(spark, tmp_path):
    path = f"{tmp_path}/cut.bin"
    frame = (19).to_bytes(2, "big") + b"D" + bytes(18)
    with open(path, "wb") as f:
        f.write(frame * 2 + frame[:9])
    assert itch.read_wire(spark, path).count() == 2
    r = itch.read_wire(spark, path, status=True).first()
    assert (r.frames, r.bytes_consumed, r.clean_eof) == (2, 42, False)
    import struct

    head = struct.pack(itch.JOURNAL_HEADER, itch.JOURNAL_MAGIC, 100, 42, 0).ljust(itch.JOURNAL_DATA, b"\0")
    with open(path, "wb") as f:
        f.write(head + frame * 3)
    assert itch.read_wire(spark, path).count() == 2  # the committed prefix only
    with open(path, "wb") as f:
        f.write(head + frame)
    with pytest.raises(Exception, match="shorter"):
        itch.read_wire(spark, path).count()


def test_engine_ids(spark, folder):
    from tickloom.operators.slots import engine_ids
    from tickloom.sources.tapes import cross_tape

    got = QUERIES["m11_engine_ids"](spark, folder).collect()
    ids = [(r.sym, r.engine_id) for r in got if r.engine_id > 0]
    assert len(ids) == len(set(ids)) and any(i >> 32 > 1 for _, i in ids)
    few = engine_ids(cross_tape(spark, folder), capacity=3).collect()
    assert {r.engine_id & 0xFFFFFFFF for r in few if r.engine_id > 0} <= {1, 2, 3}
    assert any(r.engine_id == 0 for r in few)


def test_file_checksum(spark, folder):
    from tickloom.plans import registry
    from tickloom.sources.tapes import wire_tape

    frames = itch.encode(registry._messages(wire_tape(spark, folder))).orderBy("sym", "seq").select("sym", "frame").collect()
    data = {}
    for r in frames:
        data.setdefault(r.sym, bytearray()).extend(r.frame)
    got = {r.sym: (r.length, r.checksum) for r in QUERIES["a16_file_checksum"](spark, folder).collect()}
    assert got == {k: (len(v), sum(v[::4096])) for k, v in data.items()}


def test_stream_drain_and_pacing(spark, folder, tmp_path):
    from tickloom.sources.tapes import wire_tape
    from tickloom.streaming.book_stream import drain, paced, stream_signals

    tape = wire_tape(spark, folder)
    last = tape.agg({"seq": "max"}).first()[0]
    for part in range(3):
        tape.where(f"seq * 3 div {last + 1} = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/tape")
    updates = stream_signals(spark.readStream.schema(tape.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/tape"))
    got, tapped = [], []
    drain(updates, lambda batch, n: got.extend((n, *r) for r in batch.collect()), f"{tmp_path}/state", lambda batch, n: tapped.append((n, batch.count()))).awaitTermination()
    want = {(r.sym, r.seq, r.pub_seq, r.ofi, r.micro_px) for r in QUERIES["ofi_micro"](spark, folder).collect()}
    assert {(r[1], r[2], r[3], r[8], r[9]) for r in got} == want and len(got) == len(want)
    assert [n for n, _ in tapped] == [0, 1, 2] and sum(c for _, c in tapped) == len(got)
    for sym in {r[1] for r in got}:
        numbers = [r[3] for r in got if r[1] == sym]
        assert numbers == list(range(1, len(numbers) + 1))  # in order, none lost
    assert paced(spark, 1000).isStreaming and paced(spark, 1000, 64).isStreaming
