"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of n words may be matched with up to k = floor(rate * n) edited words. It is split into k + 1
pieces: whatever the k edits hit, one piece is whole. Every document's runs of words are looked up among the
pieces by hash; around each hit the item is searched for with Myers' bit-parallel edit distance, one symbol a
word. Items are a bounded table that each task holds; a larger one is taken in blocks, each against all documents.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

RATE, LEAST_WORDS = 0.2, 5
#: Words of items that a task holds at once: about 100 MB with their pieces.
BLOCK_WORDS = 1_000_000
#: Places of items that are looked at together: about 50 MB.
PLACES = 500_000


def pieces_of(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 spans of nearly equal length that cover n words."""
    cut = [n * i // (k + 1) for i in range(k + 2)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _myers(peq: dict[int, int], m: int, text: list[int], anchored: bool) -> list[int]:
    """After each symbol, the least distance of the pattern to a text ending there; anchored: to the text from its start."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph = ph << 1 & full | anchored
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        out.append(score)
    return out


def _masks(pattern: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


class Items:
    """Test items and their pieces, by length, sorted by hash and item. An item of fewer than least_words words has itself
    as its only piece: it must stand as it is."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE, least_words: int = LEAST_WORDS, short: bool = True):
        buf, off = T.string_buffers(pa.array([t for _, t in items], pa.string()))
        w = T.Words(buf, off)
        self.ids, self.words, self.allowed = [i for i, _ in items], [], []
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k in range(len(items)):
            h = w.hash[w.first[k] : w.first[k + 1]]
            self.words.append(h)
            self.allowed.append(int(rate * len(h) + 1e-9) if len(h) >= least_words else 0)
            if len(h) >= least_words or (short and len(h)):
                for a, b in pieces_of(len(h), self.allowed[k]):
                    found[b - a].append((int(T.windows(h[a:b], b - a)[0]), k, a))
        self.size = np.array(list(map(len, self.words)), np.int64)
        self.edits = np.array(self.allowed, np.int64)
        self.pieces = {}
        for size, rows in found.items():
            rows.sort()
            h = np.array([r[0] for r in rows], T.U)
            seen = np.zeros(1 << 20, bool)
            seen[(h & T.U(0xFFFFF)).astype(np.int64)] = True
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            number = np.cumsum(np.concatenate(([False], h[1:] != h[:-1])))
            item, at = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            # of each distinct piece: the shortest reach of an item that has it
            reach = np.minimum.reduceat(self.size[item] + 2 * self.edits[item], first)
            self.pieces[size] = h[first], number * len(items) + item, at, reach, seen
        self._peq: dict[int, tuple[dict[int, int], dict[int, int]]] = {}

    def masks(self, k: int) -> tuple[dict[int, int], dict[int, int]]:
        if k not in self._peq:
            self._peq[k] = _masks(self.words[k].tolist()), _masks(self.words[k][::-1].tolist())
        return self._peq[k]

    def hits(self, w: T.Words) -> tuple[np.ndarray, ...]:
        """size, number, row, first, last: runs of places of a piece in a row, so close that no item with it falls between."""
        out = []
        for size, (h, _, _, reach, seen) in self.pieces.items():
            got = T.windows(w.hash, size)
            place = np.flatnonzero(seen[(got & T.U(0xFFFFF)).astype(np.int64)] & (w.row[: len(got)] == w.row[size - 1 :]))
            number = np.minimum(np.searchsorted(h, got[place]), len(h) - 1)
            ok = h[number] == got[place]
            place, number = place[ok], number[ok]
            if not len(place):
                continue
            order = np.lexsort((place, number))
            place, number = place[order], number[order]
            row = w.row[place]
            new = np.concatenate(([True], (number[1:] != number[:-1]) | (row[1:] != row[:-1]) | (np.diff(place) > reach[number[1:]])))
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(place)])) - 1
            out.append((np.full(len(first), size), number[first], row[first], place[first], place[last]))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else tuple(np.zeros(0, np.int64) for _ in range(5))

    def candidates(self, w: T.Words) -> Iterator[dict[tuple[int, int], list[tuple[int, int]]]]:
        """(row, item) -> merged spans of words in which an item with a whole piece there must lie, for some items at a time.

        Hits are expanded to the items that share their piece in parts of about PLACES.
        """
        size, number, row, first, last = self.hits(w)
        n = len(self.ids)

        def bounds(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
            """The places of items low to high - 1 of each hit's piece."""
            a, b = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s, (_, key, *_) in self.pieces.items():
                of = np.flatnonzero(size == s)
                a[of], b[of] = np.searchsorted(key, number[of] * n + low), np.searchsorted(key, number[of] * n + high)
            return a, b

        a, b = bounds(0, n)
        parts = max(1, -(-int((b - a).sum()) // PLACES))
        edges = [n * k // parts for k in range(parts + 1)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            a, b = bounds(low, high) if parts > 1 else (a, b)
            count = b - a
            if not count.any():
                continue
            hit = np.repeat(np.arange(len(size)), count)
            index = T.ragged(np.arange(int(b.max())), a, count)
            item, at = np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)
            for s, (_, key, start, *_) in self.pieces.items():
                of = np.flatnonzero(size[hit] == s)
                item[of], at[of] = key[index[of]] % n, start[index[of]]
            where = row[hit]
            begin = np.maximum(first[hit] - at - self.edits[item], w.first[where])
            end = np.minimum(last[hit] - at + self.size[item] + self.edits[item], w.first[where + 1])
            out: dict[tuple[int, int], list[tuple[int, int]]] = {}
            order = np.lexsort((begin, item, where))
            for r, k, x, y in zip(where[order].tolist(), item[order].tolist(), begin[order].tolist(), end[order].tolist(), strict=True):
                spans = out.setdefault((r, k), [])
                if spans and x <= spans[-1][1]:
                    spans[-1] = spans[-1][0], max(spans[-1][1], y)
                else:
                    spans.append((x, y))
            yield out

    def best(self, k: int, text: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, end) of item k's best match in the words, the first and shortest of equals; None beyond its edits."""
        forward, backward = self.masks(k)
        n = len(self.words[k])
        scores = _myers(forward, n, text, False)
        least = min(scores, default=n)
        if least > self.allowed[k]:
            return None
        end = scores.index(least) + 1
        back = _myers(backward, n, text[:end][::-1][: n + least], True)
        return least, end - 1 - back.index(least), end

    def matches(self, w: T.Words) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item) -> (distance, first word, end word) of the best match in the row.

        An item of n words with k edits keeps n - k of its words: where fewer stand in the spans, they aren't searched.
        """
        out = {}
        for part in self.candidates(w):
            for (row, k), spans in part.items():
                found = []
                for a, b in spans:
                    text = w.hash[a:b]
                    if np.isin(self.words[k], text).sum() < self.size[k] - self.allowed[k]:
                        continue
                    if got := self.best(k, text.tolist()):
                        found.append((got[0], a + got[1] - int(w.first[row]), a + got[2] - int(w.first[row])))
                if found:
                    out[row, k] = min(found)
        return out


_held: dict[bytes, Items] = {}


def held_items(block: list[tuple[int | None, str | None]], rate: float, least_words: int, short: bool) -> Items:
    """This worker's items, so that tasks share their index; one block is held at a time."""
    key = hashlib.sha256(repr((block, rate, least_words, short)).encode()).digest()
    if key not in _held:
        _held.clear()
        _held[key] = Items(block, rate, least_words, short)
    return _held[key]


def blocks(items: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS):
    """The items in lists of about block_words words at most, in turn."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.select(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    n = max(1, -(-int(size) // block_words))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r.id, r.text) for r in part.orderBy("id", "text").collect()]


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and test item found in it: id, item, distance, start_word, end_word, item_words.

    Words are runs outside [\\x20\\x09-\\x0D], A-Z lower-cased. Items of fewer than least_words words must stand as
    they are; null and empty ones match nothing. The best match is given: least distance, then first, then shortest.
    Null and empty texts match nothing; rows with equal ids are documents of their own. Other columns are ignored.
    """
    schema = "doc_id bigint, item_id bigint, distance int, start_word int, end_word int, item_words int"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks(items, item_col, item_text_col, block_words):

        def run(batches, block=block):
            held = held_items(block, rate, least_words, True)
            for batch in batches:
                ids = batch.column(0)
                buf, off = T.string_buffers(batch.column(1))
                for a, b in T.slices(off):
                    w = T.Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    got = [(ids[a + r].as_py(), held.ids[k], *m, len(held.words[k])) for (r, k), m in held.matches(w).items()]
                    if got:
                        kinds = [pa.int64()] * 2 + [pa.int32()] * 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], [s.split()[0] for s in schema.split(", ")])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without those in which an item of at least least_words words is found; all columns stay as they are.

    Shorter items are no evidence that a text was copied, so here they match nothing.
    """
    place = docs.columns.index(text_col)
    for block in blocks(items, item_col, item_text_col, block_words):

        def run(batches, block=block):
            held = held_items(block, rate, least_words, False)
            for batch in batches:
                buf, off = T.string_buffers(batch.column(place))
                keep = np.ones(batch.num_rows, bool)
                for a, b in T.slices(off):
                    w = T.Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    for r, _ in held.matches(w):
                        keep[a + r] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
