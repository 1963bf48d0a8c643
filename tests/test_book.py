"""Golden cases of the order book, the risk gate, signals and the wire format."""

import random
from collections import defaultdict

import pytest
from tickloom.operators.book import Book, signals, step
from tickloom.operators.risk import RiskGate
from tickloom.sources import itch


class Scripted:
    def __init__(self, base=100_000, ticks=1024):
        self.book, self.n, self.trades = Book(base, ticks), 0, []

    def add(self, side, qty, price, **more):
        self.n += 1
        self.outcome, done = self.book.new_order(self.n, side, price, qty, **more)
        self.trades += [(t.maker, t.qty, t.price) for t in done]
        return self.n


def test_basic_match():
    s = Scripted()
    s.add("S", 100, 100_500)
    assert (s.book.best_ask(), s.book.best_bid()) == (100_500, -1)
    s.add("B", 60, 100_500)
    assert s.trades == [(1, 60, 100_500)] and s.book.level_qty(100_500) == 40
    s.add("B", 50, 100_500)
    assert s.trades[1:] == [(1, 40, 100_500)]
    assert (s.book.best_ask(), s.book.best_bid(), s.book.level_qty(100_500)) == (-1, 100_500, 10)


def test_price_then_time():
    s = Scripted()
    a1, a2, a3 = s.add("S", 10, 100_200), s.add("S", 10, 100_200), s.add("S", 10, 100_100)
    s.add("B", 25, 100_300)
    assert s.trades == [(a3, 10, 100_100), (a1, 10, 100_200), (a2, 5, 100_200)]
    assert s.book.level_qty(100_200) == 5 and s.book.best_ask() == 100_200


def test_cancel():
    s = Scripted()
    b1, b2, b3 = (s.add("B", q, 100_400) for q in (10, 20, 30))
    assert s.book.cancel(b2) and not s.book.cancel(b2) and s.book.level_qty(100_400) == 40
    s.add("S", 40, 100_400)
    assert s.trades == [(b1, 10, 100_400), (b3, 30, 100_400)] and s.book.best_bid() == -1
    c = s.add("B", 5, 100_450)
    s.add("B", 5, 100_440)
    assert s.book.best_bid() == 100_450 and s.book.cancel(c) and s.book.best_bid() == 100_440
    d1 = s.add("B", 7, 100_300)
    assert s.book.cancel(d1)
    d2 = s.add("B", 7, 100_300)
    assert not s.book.cancel(d1) and s.book.cancel(d2)


def test_gap_sweep():
    s = Scripted()
    s.add("S", 5, 100_010), s.add("S", 5, 100_900), s.add("B", 12, 100_950)
    assert [t[2] for t in s.trades] == [100_010, 100_900]
    assert (s.book.best_ask(), s.book.best_bid(), s.book.level_qty(100_950)) == (-1, 100_950, 2)


def test_reduce():
    s = Scripted()
    a, b = s.add("S", 10, 100_600), s.add("S", 5, 100_700)
    assert s.book.reduce(a, 4) == 4 and s.book.best_ask() == 100_600 and s.book.level_qty(100_600) == 6
    assert s.book.reduce(a, 6) == 6 and s.book.best_ask() == 100_700
    assert s.book.reduce(a, 1) == 0 and s.book.reduce(b, 0) == 0 and s.book.reduce(b, -3) == 0
    assert s.book.reduce(b, 99) == 5 and s.book.best_ask() == -1


def test_reduce_keeps_priority():
    s = Scripted()
    a, b = s.add("S", 10, 100_600), s.add("S", 10, 100_600)
    s.book.reduce(a, 4)
    s.add("B", 8, 100_600)
    assert s.trades == [(a, 6, 100_600), (b, 2, 100_600)]


def test_iceberg():
    s = Scripted(1_000_000, 65_536)
    p = 1_000_100
    ice, plain = s.add("S", 30, p, display=10), s.add("S", 5, p)
    assert s.book.level_qty(p) == 15
    s.add("B", 10, p)
    assert s.book.level_qty(p) == 15
    s.add("B", 5, p)
    assert s.book.level_qty(p) == 10
    s.add("B", 3, p)
    assert s.trades == [(ice, 10, p), (plain, 5, p), (ice, 3, p)] and s.book.level_qty(p) == 7
    assert not s.book.cancel(plain)
    assert s.book.reduce(ice, 7) == 7 and s.book.best_ask() == -1  # what is hidden goes with it


def test_iceberg_matches_whole_on_arrival():
    s = Scripted()
    s.add("S", 25, 100_100)
    s.add("B", 40, 100_100, display=4)
    assert s.trades == [(1, 25, 100_100)] and s.book.level_qty(100_100) == 4


def test_post_only():
    s = Scripted(1_000_000, 65_536)
    ask = 1_001_000
    s.add("S", 20, ask)
    for price, outcome in ((ask, "rejected"), (ask + 50, "rejected"), (ask - 100, "rested")):
        s.add("B", 5, price, post_only=True)
        assert s.outcome == outcome
    assert s.book.best_bid() == ask - 100 and not s.trades
    s.add("B", 5, ask)
    assert s.trades == [(1, 5, ask)]


def test_validation():
    s = Scripted()
    for qty, price in ((0, 100_100), (-1, 100_100), (5, 99_999), (5, 101_024)):
        s.add("B", qty, price)
        assert s.outcome == "rejected"
    s.add("B", 5, 100_100, display=0)
    assert s.outcome == "rejected"


class LiteralBook:
    """A plain book: lists, two passes over a level, reloads spliced after the pass."""

    def __init__(self):
        self.levels = {"B": defaultdict(list), "S": defaultdict(list)}

    def add(self, ref, side, price, qty, display):
        other, trades = self.levels["S" if side == "B" else "B"], []
        while qty:
            open_at = [p for p, q in other.items() if q and (p <= price if side == "B" else p >= price)]
            if not open_at:
                break
            p = min(open_at) if side == "B" else max(open_at)
            stay, again = [], []
            for maker in other[p]:
                fill = min(qty, maker[1])
                if fill:
                    trades.append((maker[0], fill, p))
                    qty -= fill
                    maker[1] -= fill
                if maker[1]:
                    stay.append(maker)
                elif maker[2]:
                    maker[1] = min(maker[3], maker[2])
                    maker[2] -= maker[1]
                    again.append(maker)
            other[p] = stay + again
        if qty:
            shown = min(qty, display or qty)
            self.levels[side][price].append([ref, shown, qty - shown, display])
        return trades

    def cancel(self, ref):
        for side in self.levels.values():
            for queue in side.values():
                queue[:] = [m for m in queue if m[0] != ref]


@pytest.mark.parametrize("seed", range(6))
def test_book_equals_a_literal_one(seed):
    rng, book, plain = random.Random(seed), Book(), LiteralBook()
    for ref in range(1, 600):
        if rng.random() < 0.15:
            gone = rng.randrange(1, ref + 1)
            book.cancel(gone), plain.cancel(gone)
            continue
        side, price, qty, display = rng.choice("BS"), 1000 + rng.randint(-6, 6), rng.randint(1, 25), rng.choice([None, None, 1, 3])
        _, trades = book.new_order(ref, side, price, qty, display=display)
        assert [(t.maker, t.qty, t.price) for t in trades] == plain.add(ref, side, price, qty, display)
        for s in "BS":
            want = {p: sum(m[1] for m in q) for p, q in plain.levels[s].items() if q}
            assert book.sides[s].depth == want
        assert book.best_bid() < book.best_ask() or -1 in (book.best_bid(), book.best_ask())


def test_signals():
    bid, ask = 1_001_000, 1_001_010
    book, tops = Book(1_000_000), []
    for n, (side, qty, price) in enumerate([("B", 10, bid), ("S", 30, ask), ("B", 15, bid), ("B", 7, bid + 2), ("S", 5, ask - 3), ("S", 7, bid + 2)], 1):
        step(book, "A", n, side, price, qty)
        tops.append(book.top())
    # the third adds 15 lots to the 10 that rest
    assert [s[4] for s in signals(tops)] == [10, 10, 25, 32, 27, 20]
    assert [s[5] for s in signals(tops)] == [-256, 256256640, 256257163, 256256899, 256257258, 256257493]


def test_rate_limit():
    gate, w, t = RiskGate(100, 0, 10**9, 10**9, 1000, 4), 1000, 10**6
    assert [gate.check("B", 5, 1, x) for x in (t, t + 1, t + 2, t + 3, t + 4, t + w + 5)] == [0, 0, 0, 0, 8, 0]
    assert (gate.accepted, gate.rejected) == (5, 1)


def test_position_limit():
    gate, now = RiskGate(100, 0, 10**9, 10, 0), 10**6
    assert gate.check("B", 5, 8, now) == 0
    assert gate.check("B", 5, 5, now) == 4
    gate.on_cancel("B", 8)
    assert gate.check("B", 5, 5, now) == 0
    gate.on_fill("B", 5)
    assert gate.check("B", 5, 6, now) == 4


def test_all_checks_are_reported():
    gate = RiskGate(10, 100, 200, 5, 0)
    assert gate.check("S", 300, 11, 10**6) == 1 | 2 | 4
    assert gate.check("S", 99, 0, 10**6) == 1 | 2


def test_frames_stop_at_the_first_bad_one():
    good = (19).to_bytes(2, "big") + b"D" + bytes(18)
    for tail, consumed in ((b"", True), (good[:-5], False), (b"\0\x13X" + bytes(18), False), (b"\0\x13Z" + bytes(18), False), (b"\0\0\0", False)):
        for size in (1, 7, 1000):
            reader, data, frames = itch.FrameReader(), good * 3 + tail, []
            for at in range(0, len(data), size):
                frames += reader.feed(data[at : at + size])
            assert frames == [good] * 3 and reader.consumed == 63 and reader.clean_end == consumed


def test_generated_feed_is_consistent():
    rows, left, kinds = itch.generate_feed(5000, 0x17C4), {}, defaultdict(int)
    for r in rows:
        kinds[r["type"]] += 1
        if r["type"] == "A":
            left[r["ref"]] = r["qty"]
            assert (r["price"] < 1_032_768) == (r["side"] == "B") and 4 <= r["qty"] <= 35
        elif r["type"] == "D":
            assert left.pop(r["ref"]) > 0
        else:
            left[r["ref"]] -= r["qty"]
            assert left[r["ref"]] >= (1 if r["type"] == "X" else 0)
    assert [r["ts_ns"] for r in rows] == sorted(r["ts_ns"] for r in rows)
    assert rows == itch.generate_feed(5000, 0x17C4)
    assert abs(kinds["A"] / 5000 - 0.55) < 0.03 and abs(kinds["E"] / 5000 - 0.25) < 0.03


def test_fingerprint_sees_every_level():
    a, b = Book(0, 64), Book(0, 64)
    for book in (a, b):
        book.new_order(1, "B", 10, 5)
    assert a.fingerprint(0, 64) == b.fingerprint(0, 64)
    b.new_order(2, "B", 3, 1)
    assert a.fingerprint(0, 64) != b.fingerprint(0, 64)


def test_slot_arena():
    from tickloom.operators.slots import SlotArena

    arena = SlotArena(8)
    a, b = arena.acquire(), arena.acquire()
    assert a != b and arena.release(b)
    c = arena.acquire()
    assert c & 0xFFFFFFFF == b & 0xFFFFFFFF and c != b and not arena.release(b) and not arena.live(b)
    rest = []
    while (x := arena.acquire()) is not None:
        rest.append(x)
    assert len(rest) == 6
    assert not arena.live(0) and not arena.live(2**64 - 1) and not arena.live(5)
    assert all(arena.release(x) for x in rest)


def test_levels():
    from tickloom.operators.slots import Levels

    bits = Levels(4096)
    assert bits.next_set(0) is None
    for i in (5, 700, 4000):
        bits.set(i)
    assert [bits.next_set(i) for i in (0, 6, 701, 4001)] == [5, 700, 4000, None]
    assert [bits.prev_set(i) for i in (4095, 3999, 699, 4)] == [4000, 700, 5, None]
    bits.reset(700)
    assert bits.next_set(6) == 4000 and not bits.test(700) and bits.test(5)
    every = Levels(4096)
    for i in range(0, 4096, 37):
        every.set(i)
    for i in range(4096):
        want = -(-i // 37) * 37
        assert every.next_set(i) == (want if want < 4096 else None)
