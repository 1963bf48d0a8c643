"""Scalar functions: fixed-point prices, big-endian fields, packed ids, 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType

# Fixed values that results depend on.
PRICE_SCALE = 10_000
FIBONACCI_MULTIPLIER = 0x9E3779B97F4A7C15
SPARSE_MULTIPLIER = 0xC2B2AE3D27D4EB4F
FNV_OFFSET = 1469598103934665603
FNV_PRIME = 1099511628211
MASK64 = (1 << 64) - 1


def price_to_double(ticks: Column) -> Column:
    return ticks / F.lit(float(PRICE_SCALE))


def price_from_double(price: Column) -> Column:
    """Ticks of a price, halves away from zero."""
    return F.round(price * PRICE_SCALE).cast("bigint")


def big_endian(frame: Column, at: int, size: int) -> Column:
    """Unsigned big-endian number of `size` bytes from byte `at` (0 is the first); 8 bytes as decimal(20,0)."""
    digits = F.conv(F.hex(F.substring(frame, at + 1, size)), 16, 10)
    return digits.cast(DecimalType(20, 0)) if size == 8 else digits.cast("bigint")


def to_big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def pack_id(generation: Column, slot: Column) -> Column:
    """Engine id: generation in the upper 32 bits, slot + 1 in the lower."""
    return F.shiftleft(generation.cast("bigint"), 32).bitwiseOR(slot.cast("bigint") + 1)


def id_generation(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 32)


def id_slot(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) - 1


def indicator(condition: Column) -> Column:
    """1 or 0 as bigint."""
    return condition.cast("int").cast("bigint")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, x))


@F.pandas_udf(LongType())
def fibonacci_slot(key: pd.Series, log2: pd.Series) -> pd.Series:
    """Upper log2 bits of key times the Fibonacci multiplier, modulo 2^64."""
    h = key.to_numpy(np.int64).view(np.uint64) * np.uint64(FIBONACCI_MULTIPLIER)
    return pd.Series((h >> (64 - log2.to_numpy(np.uint64))).astype(np.int64))


@F.pandas_udf(DecimalType(20, 0))
def sparse_key(ref: pd.Series) -> pd.Series:
    """ref times an odd multiplier, modulo 2^64: a bijection that spreads sequential refs."""
    from decimal import Decimal

    h = ref.to_numpy(np.int64).view(np.uint64) * np.uint64(SPARSE_MULTIPLIER)
    return pd.Series([Decimal(int(x)) for x in h])


def fnv_mix(h: int, value: int) -> int:
    return (h ^ (value & MASK64)) * FNV_PRIME & MASK64


class XorShift64Star:
    """The deterministic generator of the synthetic feeds."""

    def __init__(self, seed: int):
        self.state = seed or 1

    def next(self) -> int:
        x = self.state
        x ^= x >> 12
        x ^= x << 25 & MASK64
        x ^= x >> 27
        self.state = x
        return x * 0x2545F4914F6CDD1D & MASK64
