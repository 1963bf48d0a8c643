"""A price-time-priority order book as a pure state machine: no Spark here, so batch and streaming share it."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from tickloom.functions.scalars import FNV_OFFSET, fnv_mix

BUY, SELL = "B", "S"
REJECTED, FILLED, RESTED = "rejected", "filled", "rested"


@dataclass(slots=True)
class Order:
    ref: int
    side: str
    price: int
    qty: int  # visible
    hidden: int = 0
    display: int = 0


@dataclass(slots=True)
class Trade:
    maker: int
    taker: int
    price: int
    qty: int


@dataclass(slots=True)
class Side:
    """Levels of one side: orders by ref in the order of their turn, and a visible quantity each; the best price by a heap
    with late deletion. So an order leaves its level in constant time."""

    sign: int  # 1: the best is the lowest (asks); -1: the highest (bids)
    queues: dict[int, dict[int, Order]] = field(default_factory=dict)
    depth: dict[int, int] = field(default_factory=dict)
    heap: list[int] = field(default_factory=list)

    def add(self, order: Order) -> None:
        if order.price not in self.queues:
            self.queues[order.price] = {}
            self.depth[order.price] = 0
            heapq.heappush(self.heap, self.sign * order.price)
        self.queues[order.price][order.ref] = order
        self.depth[order.price] += order.qty

    def drop_level(self, price: int) -> None:
        del self.queues[price], self.depth[price]

    def best(self) -> int | None:
        while self.heap and self.sign * self.heap[0] not in self.queues:
            heapq.heappop(self.heap)
        return self.sign * self.heap[0] if self.heap else None


class Book:
    """base and ticks bound the prices taken; None takes any positive price."""

    def __init__(self, base: int | None = None, ticks: int = 1 << 16):
        self.base, self.ticks = base, ticks
        self.sides = {BUY: Side(-1), SELL: Side(1)}
        self.live: dict[int, Order] = {}

    def __getstate__(self) -> tuple:
        """Plain columns of each level's orders in turn, about ten bytes an order when pickled; the rest follows from them."""
        levels = [(side, price, list(queue), *([getattr(o, f) for o in queue.values()] for f in ("qty", "hidden", "display"))) for side, s in self.sides.items() for price, queue in s.queues.items()]
        return self.base, self.ticks, levels

    def __setstate__(self, state: tuple) -> None:
        base, ticks, levels = state
        self.__init__(base, ticks)
        for side, price, *columns in levels:
            for ref, qty, hidden, display in zip(*columns, strict=True):
                self.live[ref] = order = Order(ref, side, price, qty, hidden, display)
                self.sides[side].add(order)

    def valid(self, price: int, qty: int) -> bool:
        inside = price > 0 if self.base is None else self.base <= price < self.base + self.ticks
        return inside and qty > 0

    def crosses(self, side: str, price: int) -> bool:
        best = self.sides[SELL if side == BUY else BUY].best()
        return best is not None and (best <= price if side == BUY else best >= price)

    def new_order(self, ref: int, side: str, price: int, qty: int, post_only: bool = False, display: int | None = None) -> tuple[str, list[Trade]]:
        """Match, then rest what is left. display: shown size of an iceberg, whose whole size matches on arrival."""
        if not self.valid(price, qty) or (display is not None and display <= 0) or ref in self.live:
            return REJECTED, []
        if post_only and self.crosses(side, price):
            return REJECTED, []
        trades: list[Trade] = []
        other = self.sides[SELL if side == BUY else BUY]
        while qty > 0 and self.crosses(side, price):
            qty = self._sweep(other, other.best(), qty, ref, trades)
        if qty == 0:
            return FILLED, trades
        shown = qty if display is None else min(display, qty)
        order = Order(ref, side, price, shown, qty - shown, display or 0)
        self.live[ref] = order
        self.sides[side].add(order)
        return RESTED, trades

    def _sweep(self, makers: Side, price: int, qty: int, taker: int, trades: list[Trade]) -> int:
        """Fill from one level, first come first served; an iceberg's next clip goes to the back of the level."""
        queue = makers.queues[price]
        while qty > 0 and queue:
            maker = next(iter(queue.values()))
            fill = min(qty, maker.qty)
            trades.append(Trade(maker.ref, taker, price, fill))
            qty -= fill
            maker.qty -= fill
            makers.depth[price] -= fill
            if maker.qty == 0:
                del queue[maker.ref]
                if maker.hidden > 0:
                    maker.qty = min(maker.display, maker.hidden)
                    maker.hidden -= maker.qty
                    makers.depth[price] += maker.qty
                    queue[maker.ref] = maker
                else:
                    del self.live[maker.ref]
        if not queue:
            makers.drop_level(price)
        return qty

    def _remove(self, order: Order) -> None:
        side = self.sides[order.side]
        del side.queues[order.price][order.ref]
        side.depth[order.price] -= order.qty
        if not side.queues[order.price]:
            side.drop_level(order.price)
        del self.live[order.ref]

    def cancel(self, ref: int) -> bool:
        order = self.live.get(ref)
        if order is None:
            return False
        self._remove(order)
        return True

    def reduce(self, ref: int, qty: int) -> int:
        """Take qty off an order in its place; all of what is visible (and the order with it) if qty is that much."""
        order = self.live.get(ref)
        if order is None or qty <= 0:
            return 0
        if qty < order.qty:
            order.qty -= qty
            self.sides[order.side].depth[order.price] -= qty
            return qty
        self._remove(order)
        return order.qty

    def best_bid(self) -> int:
        best = self.sides[BUY].best()
        return -1 if best is None else best

    def best_ask(self) -> int:
        best = self.sides[SELL].best()
        return -1 if best is None else best

    def level_qty(self, price: int) -> int:
        return sum(s.depth.get(price, 0) for s in self.sides.values())

    def top(self) -> tuple[int, int, int, int]:
        """bid price, bid quantity, ask price, ask quantity; -1 and 0 where a side is empty."""
        bid, ask = self.best_bid(), self.best_ask()
        return bid, self.sides[BUY].depth.get(bid, 0), ask, self.sides[SELL].depth.get(ask, 0)

    def fingerprint(self, base: int, ticks: int = 1 << 16) -> int:
        """FNV-1a over best bid, best ask and every level's quantity from base, modulo 2^64."""
        h = fnv_mix(fnv_mix(FNV_OFFSET, self.best_bid()), self.best_ask())
        depth: dict[int, int] = {}
        for side in self.sides.values():
            for price, qty in side.depth.items():
                depth[price] = depth.get(price, 0) + qty
        for price in range(base, base + ticks):
            h = fnv_mix(h, depth.get(price, 0))
        return h


def step(book: Book, kind: str, ref: int, side: str | None, price: int | None, qty: int | None, taker: int = 0, display: int | None = None, post_only: bool = False) -> tuple[str, int, list[Trade]]:
    """Apply a message: A add, E execute, X reduce, D cancel. Returns (outcome, quantity removed, trades)."""
    if kind == "A":
        outcome, trades = book.new_order(ref, BUY if side == BUY else SELL, price, qty, post_only, display)
        return outcome, 0, trades
    if kind in "EX":
        return "reduced", book.reduce(ref, qty), []
    order = book.live.get(ref)
    gone = order.qty if order else 0
    return "cancelled" if book.cancel(ref) else "stale", gone, []


def signals(tops: Iterable[tuple[int, int, int, int]], last: tuple[int, int, int, int] = (-1, 0, -1, 0), ofi: int = 0, seq: int = 0) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(bid_px, bid_qty, ask_px, ask_qty, ofi, micro_px, seq) whenever the top changes; micro-price in 1/256 tick. last, ofi
    and seq are of the signal before, to carry on from it."""
    for bp, bq, ap, aq in tops:
        if (bp, bq, ap, aq) == last:
            continue
        lbp, lbq, lap, laq = last
        ofi += (bp >= lbp) * bq - (bp <= lbp) * lbq - (ap <= lap) * aq + (ap >= lap) * laq
        total = (bp * aq + ap * bq) * 256
        size = bq + aq or 1
        micro = abs(total) // size * (1 if total >= 0 else -1)  # toward zero
        seq += 1
        last = (bp, bq, ap, aq)
        yield bp, bq, ap, aq, ofi, micro, seq
