"""Vectorised tokenising and hashing over the bytes of Arrow string columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a
polynomial of its bytes modulo 2^64, mixed; a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
#: Odd multipliers of the words in a shingle, made by a rule.
_K = [(0xD6E8FEB86659FD93 * (2 * i + 3) ** 7 | 1) & (2**64 - 1) for i in range(64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "f" not in _pow or len(_pow["f"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("f", _R), ("i", _RINV)):
            a = np.full(size, base, U)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
    return _pow["f"][:n], _pow["i"][:n]


def settle() -> None:
    """Give memory that a task no longer needs back to the system: workers live on, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type) if hasattr(pa.types, "is_string_view") else False:
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each (a longer row stands alone), to bound working memory."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


class Words:
    """Words of some rows: start and end in the buffer, row, hash. space: what ends a word; lower: hash A-Z as a-z."""

    __slots__ = ("start", "end", "row", "hash", "first", "rows")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, hashed: bool = True, space: np.ndarray = SPACE, lower: bool = True):
        self.rows = len(offsets) - 1
        n = len(buf)
        solid = ~space[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
            before &= ~edge[:n]
            after &= ~edge[1:]
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each row, and the total
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        if hashed:
            f, i = _powers(max(n, 1))
            total = np.zeros(n + 1, U)
            np.cumsum(((LOWER[buf] if lower else buf).astype(U) + U(1)) * f[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * i[self.start] if n else np.zeros(0, U))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, in a row."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, whatever their rows; len(h) - n + 1 values."""
    if len(h) < n:
        return np.zeros(0, U)
    m = len(h) - n + 1
    out = np.full(m, n, U) * U(_K[-1])
    for k in range(n):
        out += h[k : k + m] * U(_K[k])
    return mix(out)


def row_shingles(w: Words, n: int = 5) -> Iterator[np.ndarray]:
    """For each row, its distinct n-word shingle hashes, ascending; a row of fewer words has its whole sequence as one."""
    all_of = windows(w.hash, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(all_of[a : b - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield windows(w.hash[a:b], b - a)
        else:
            yield np.zeros(0, U)
