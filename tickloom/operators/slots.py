"""Engine ids and price-level occupancy, for tapes whose ids must be those of a slot arena."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .book import RESTED, Book
from .kernel import _apply, _fold


class SlotArena:
    """Slots by last-in first-out reuse. An id is generation << 32 | slot + 1; the generation moves on at each use and
    release, so an id that was released is never live again."""

    def __init__(self, capacity: int | None = None):
        self.capacity, self.used = capacity, 0
        self.free: list[int] = []
        self.generation: list[int] = []

    def acquire(self) -> int | None:
        """An id, None if no slot is left."""
        if self.free:
            slot = self.free.pop()
        elif self.capacity is None or self.used < self.capacity:
            slot, self.used = self.used, self.used + 1
            self.generation.append(0)
        else:
            return None
        self.generation[slot] += 1
        return self.generation[slot] << 32 | slot + 1

    def live(self, packed: int) -> bool:
        slot, generation = (packed & 0xFFFFFFFF) - 1, packed >> 32
        return 0 <= slot < self.used and generation % 2 == 1 and self.generation[slot] == generation

    def release(self, packed: int) -> bool:
        if not self.live(packed):
            return False
        slot = (packed & 0xFFFFFFFF) - 1
        self.generation[slot] += 1
        self.free.append(slot)
        return True


class Levels:
    """A set of levels as the bits of one number."""

    def __init__(self, size: int):
        self.size, self.bits = size, 0

    def set(self, i: int) -> None:
        self.bits |= 1 << i

    def reset(self, i: int) -> None:
        self.bits &= ~(1 << i)

    def test(self, i: int) -> bool:
        return bool(self.bits >> i & 1)

    def next_set(self, i: int) -> int | None:
        """The lowest level at or above i."""
        up = self.bits >> i
        return i + (up & -up).bit_length() - 1 if up else None

    def prev_set(self, i: int) -> int | None:
        """The highest level at or below i."""
        down = self.bits & (1 << i + 1) - 1
        return down.bit_length() - 1 if down else None


SCANS = "sym int, price bigint, next_level bigint, prev_level bigint"


def scan_levels(levels: DataFrame, base: int, probes: range, ticks: int = 1 << 16) -> DataFrame:
    """sym, price, next_level, prev_level for each probe: the nearest occupied prices at or above, and at or below it, -1 if none.

    levels: sym, price. A sym's ladder of ticks levels from base is one set of bits, 8 KB for 65,536.
    """

    def run(key, group):
        import pandas as pd

        bits = Levels(ticks)
        for p in group["price"].tolist():
            bits.set(int(p) - base)
        out = []
        for p in probes:
            up, down = bits.next_set(p - base), bits.prev_set(p - base)
            out.append((int(key[0]), p, -1 if up is None else base + up, -1 if down is None else base + down))
        return pd.DataFrame(out, columns=["sym", "price", "next_level", "prev_level"])

    inside = levels.where((levels["price"] >= base) & (levels["price"] < base + ticks))
    return inside.groupBy("sym").applyInPandas(run, SCANS)


IDS = "sym int, seq bigint, ref bigint, engine_id bigint"


def engine_ids(tape: DataFrame, capacity: int | None = None) -> DataFrame:
    """sym, seq, ref, engine_id of every add: the id of its slot if it rests, 0 if it is rejected (or no slot is left), -1 if
    it is filled whole (the reference value is all ones)."""

    def run(sym, messages):
        book, arena = Book(), SlotArena(capacity)
        ids: dict[int, int] = {}
        for m in messages:
            seq, kind, ref = m[:3]
            outcome, _, trades = _apply(book, m)
            for maker in dict.fromkeys(t.maker for t in trades):
                if maker not in book.live:
                    arena.release(ids.pop(maker))
            if kind == "A":
                got = 0
                if outcome == RESTED:
                    got = arena.acquire() or 0
                    if got:
                        ids[ref] = got
                    else:
                        book.cancel(ref)  # no slot: what is left of the order is lost, its trades stand
                elif outcome == "filled":
                    got = -1
                yield sym, seq, ref, got
            elif ref in ids and ref not in book.live:
                arena.release(ids.pop(ref))

    return _fold(tape, run, IDS)
