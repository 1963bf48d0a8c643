"""Pre-trade risk for one account: size, collar, worst-case position and rate, all checked, state kept on accepts only."""

from __future__ import annotations

from collections import deque

QTY, BAND, POSITION, RATE = 1, 2, 4, 8


class RiskGate:
    def __init__(self, max_qty: int, low: int, high: int, position_limit: int, window: int, depth: int = 256):
        self.max_qty, self.low, self.high, self.limit, self.window = max_qty, low, high, position_limit, window
        self.open = {"B": 0, "S": 0}
        self.net = self.accepted = self.rejected = 0
        self.stamps: deque[int] = deque([0] * depth, depth)

    def check(self, side: str, price: int, qty: int, now: int) -> int:
        """OR of every violated check; 0 accepts and changes the state. now must not decrease."""
        mask = QTY * (qty <= 0 or qty > self.max_qty) | BAND * (price < self.low or price > self.high)
        buy, sell = self.open["B"] + qty * (side == "B"), self.open["S"] + qty * (side != "B")
        mask |= POSITION * (buy + self.net > self.limit or sell - self.net > self.limit)
        mask |= RATE * ((now - self.stamps[0]) % (1 << 64) < self.window)
        if mask:
            self.rejected += 1
            return mask
        self.open = {"B": buy, "S": sell}
        self.stamps.append(now)
        self.accepted += 1
        return 0

    def on_cancel(self, side: str, qty: int) -> None:
        self.open["B" if side == "B" else "S"] -= qty

    def on_fill(self, side: str, qty: int) -> None:
        self.on_cancel(side, qty)
        self.net += qty if side == "B" else -qty
