"""Encoding with public tokenizers, each distinct piece of text once.

A text is cut where a cut can't change its ids. Pieces are found and hashed by numpy over the text's bytes; a
piece that is new is taken apart into a word and its closing marks, and only new words go to the tokenizers
library, many in one call; the ids of known pieces are gathered. Pieces are told apart by 64-bit hashes.
Texts with white space that could bind across a cut, or that Python's and the tokenizer's classes may see
differently, are encoded whole, and so are those that hold one of the tokenizer's added tokens: it gets its own
id there, as the library has it.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from . import textops as T

#: Most pieces and most words that a worker holds, and the share of the oldest (mostly the frequent ones) that stays beyond that.
MOST_PIECES, MOST_WORDS, KEPT_SHARE = 800_000, 200_000, 0.4
#: Words joined in one call.
JOINED = 1000

#: Marks that never bind to a letter or digit before them (an apostrophe can).
_MARKS = ",.;:!?&%$#*\"()[]-"
#: For each mode, what stands between joined words (one id, found in no such word), and the words that may be joined.
_BETWEEN = {"byte": ("\n", re.compile(r" \S+")), "word": (" | ", re.compile(r"[^\s|]+"))}
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[0x20] = True
_BLANK = T.SPACE.copy()
_BLANK[0x1C:0x20] = True


def odd_places(buf: np.ndarray) -> np.ndarray:
    """Where white space beyond 0x20 and 0x09-0x0D stands in UTF-8."""
    n = len(buf)
    at = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)) | ((buf >= 0x1C) & (buf < 0x20)))
    if not len(at):
        return at
    a, b, c = buf[at], buf[np.minimum(at + 1, n - 1)], buf[np.minimum(at + 2, n - 1)]
    odd = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    odd |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return at[odd]


class _Ids:
    """Ids of numbered keys, in a row."""

    def __init__(self) -> None:
        self.flat = np.zeros(1 << 16, np.uint32)
        self.offset = np.zeros(1 << 12, np.int64)
        self.n = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.offset[self.n])
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(used // 2 + len(ids), np.uint32)])
        if self.n + len(lengths) >= len(self.offset):
            self.offset = np.concatenate([self.offset[: self.n + 1], np.zeros(self.n // 2 + len(lengths) + 1, np.int64)])
        self.flat[used : used + len(ids)] = ids
        self.offset[self.n + 1 : self.n + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.n += len(lengths)

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the keys, and how many each has."""
        start = self.offset[index]
        size = self.offset[index + 1] - start
        return T.ragged(self.flat, start, size), size

    def keep(self, n: int) -> None:
        self.flat, self.offset, self.n = self.flat[: int(self.offset[n])].copy(), self.offset[: n + 1].copy(), n


class _Hashes:
    """Hash -> number, by open addressing in numpy arrays."""

    def __init__(self, hashes: np.ndarray | None = None):
        self.n = 0
        self.order = np.zeros(1 << 12, T.U)  # hash of each number
        self.slot_hash = np.zeros(1 << 13, T.U)
        self.slot_number = np.full(1 << 13, -1, np.int32)
        if hashes is not None:
            self.add(hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers, -1 for new ones."""
        mask = T.U(len(self.slot_hash) - 1)
        slot = (h & mask).astype(np.int64)
        out = self.slot_number[slot]
        left = np.flatnonzero((out >= 0) & (self.slot_hash[slot] != h))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & int(mask)
            got = self.slot_number[slot]
            out[left] = got
            more = (got >= 0) & (self.slot_hash[slot] != h[left])
            left, slot = left[more], slot[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers distinct new hashes in their order."""
        if self.n + len(h) > len(self.order):
            self.order = np.concatenate([self.order[: self.n], np.zeros(self.n // 2 + len(h), T.U)])
        self.order[self.n : self.n + len(h)] = h
        first, self.n = self.n, self.n + len(h)
        if 2 * self.n > len(self.slot_hash):
            size = 1 << (4 * self.n - 1).bit_length()
            self.slot_hash, self.slot_number, first = np.zeros(size, T.U), np.full(size, -1, np.int32), 0
        mask = len(self.slot_hash) - 1
        todo = np.arange(first, self.n, dtype=np.int32)
        slot = (self.order[todo] & T.U(mask)).astype(np.int64)
        while len(todo):
            free = self.slot_number[slot] < 0
            self.slot_number[slot[free]] = todo[free]  # of those that want one slot, one gets it
            self.slot_hash[slot[free]] = self.order[todo[free]]
            lost = self.slot_number[slot] != todo
            # the last writer's hash stands with its number
            self.slot_hash[slot] = self.order[self.slot_number[slot]]
            todo, slot = todo[lost], (slot[lost] + 1) & mask


class Encoder:
    """mode 'byte': a byte-level BPE whose pieces begin at single spaces; 'word': one that drops white space."""

    def __init__(self, path: str, mode: str, most_pieces: int = MOST_PIECES, most_words: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode().lower() for t in added]
        # one that is looked for in the normalised text may stand where its characters don't
        self.only_whole = any(t.normalized for t in added)
        self.mode, self.most_pieces, self.most_words = mode, most_pieces, most_words
        self.hashes, self.pieces, self.words, self.word_ids = _Hashes(), _Ids(), {}, _Ids()
        self.between, self.joinable = _BETWEEN[mode]
        self.between_id = self._encode([self.between])[0]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> None:
        """Adds the ids of words: those that may be joined in few calls, the others each for itself."""
        fit = self.joinable.fullmatch
        joined = [k for k, w in enumerate(words) if fit(w)] if len(self.between_id) == 1 else []
        order, flat, sizes = [], [], []
        for a in range(0, len(joined), JOINED):
            some = joined[a : a + JOINED]
            ids = np.array(self._encode([self.between.join([words[k] for k in some])])[0], np.uint32)
            cut = ids == self.between_id[0]
            cuts = np.flatnonzero(cut)
            if len(cuts) == len(some) - 1:
                order += some
                flat.append(ids[~cut])
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        rest = np.ones(len(words), bool)
        rest[order] = False
        if rest.any():
            alone = np.flatnonzero(rest).tolist()
            each = self._encode([words[k] for k in alone])
            order += alone
            flat.append(np.array([x for e in each for x in e], np.uint32))
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        size = np.concatenate(sizes)
        back = np.argsort(np.array(order))
        self.word_ids.add(T.ragged(np.concatenate(flat), (np.cumsum(size) - size)[back], size[back]), size[back])

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of new pieces."""
        if len(self.words) > self.most_words:
            n = int(self.most_words * KEPT_SHARE)
            self.words = dict(zip(list(self.words)[:n], range(n), strict=False))
            self.word_ids.keep(len(self.words))
        words, unseen, at, counts, lower = self.words, [], [], [], self.mode == "word"

        def number(word: str) -> int:
            k = words.get(word)
            if k is None:
                k = words[word] = len(words)
                unseen.append(word)
            return k

        for piece in new:
            if lower and piece.isascii():
                piece = piece.lower()
            word = piece.rstrip(_MARKS)
            if word and len(word) < len(piece) and (word[-1].isalpha() or word[-1] in "0123456789"):
                at += (number(word), number(piece[len(word) :]))
                counts.append(2)
            else:
                at.append(number(piece))
                counts.append(1)
        if unseen:
            self._encode_words(unseen)
        ids, size = self.word_ids.gather(np.array(at, np.int64))
        ends = np.concatenate([[0], np.cumsum(size)])
        self.pieces.add(ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]))

    def _whole(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts must be encoded whole."""
        if self.only_whole:
            return np.ones(len(offsets) - 1, bool)
        odd = odd_places(buf)
        data = buf.tobytes().lower()  # in any case, since pieces may be learnt in lower case
        found = []
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                found.append(at)
                at = data.find(token, at + 1)
        odd = np.concatenate([odd, np.array(found, np.int64)])
        if self.mode == "byte" and len(buf):
            space, blank = buf == 0x20, _BLANK[buf]
            near = np.flatnonzero((space[:-1] & blank[1:]) | (blank[:-1] & space[1:]))
            first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
            odd = np.concatenate([odd, near, near + 1, first[space[first]], last[space[last]]])
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, odd, "right") - 1] = True
        return out

    def trim(self, pieces: int = 200_000, words: int = 80_000) -> None:
        """Keep the oldest pieces and words only: what a worker holds between tasks."""
        if self.hashes.n > pieces:
            self.hashes = _Hashes(self.hashes.order[:pieces].copy())
            self.pieces.keep(pieces)
        if len(self.words) > words:
            self.words = dict(zip(list(self.words)[:words], range(words), strict=False))
            self.word_ids.keep(words)

    def encode(self, column: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and offsets (one more than texts). end_id: appended to each; null: empty."""
        if isinstance(column, list):
            column = pa.array(column, pa.string())
        buf, off = T.string_buffers(column)
        done = [self._some(buf[off[a] : off[b]], off[a : b + 1] - off[a], end_id) for a, b in T.slices(off)]
        if not done:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate([i for i, _ in done]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in done]))])

    def _some(self, buf: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts in a row, and how many each has."""
        if self.hashes.n > self.most_pieces:
            n = int(self.most_pieces * KEPT_SHARE)
            self.hashes = _Hashes(self.hashes.order[:n].copy())
            self.pieces.keep(n)
        w = T.Words(buf, offsets, space=_ONLY_SPACE if self.mode == "byte" else T.SPACE, lower=False)
        h, rows = w.hash, len(offsets) - 1
        if self.mode == "byte":
            head = np.zeros(len(h), bool)
            head[w.first[:-1][w.counts() > 0]] = True  # no space stands before a text's first piece
            h = np.where(head, T.mix(h + T.U(1)), h)
        index = self.hashes.find(h).astype(np.int64)
        if (index < 0).any():
            missing = np.flatnonzero(index < 0)
            new, where = np.unique(h[missing], return_index=True)
            where = missing[np.sort(where)]  # as they come
            data = buf.tobytes()
            lead = ["" if self.mode == "word" or head[k] else " " for k in where.tolist()]
            self._learn([x + data[a:b].decode() for x, a, b in zip(lead, w.start[where].tolist(), w.end[where].tolist(), strict=True)])
            self.hashes.add(h[where])
            index[missing] = self.hashes.find(h[missing])
        ids, size = self.pieces.gather(index)
        whole = self._whole(buf, offsets)
        ends = np.concatenate([[0], np.cumsum(size)])[w.first]
        tail = 0 if end_id is None else 1
        if not whole.any():
            count = np.diff(ends)
            if not tail:
                return ids, count
            return np.insert(ids, ends[1:], np.uint32(end_id)), count + 1
        end = np.array([end_id] * tail, np.uint32)
        parts = []
        for k in range(rows):
            got = np.array(self._encode([buf[offsets[k] : offsets[k + 1]].tobytes().decode()])[0], np.uint32) if whole[k] else ids[ends[k] : ends[k + 1]]
            parts += [got, end]
        return np.concatenate(parts), np.fromiter((len(parts[2 * k]) + tail for k in range(rows)), np.int64, rows)


_held: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, mode: str) -> Encoder:
    """This worker's encoder, so that tasks share what it has seen."""
    if (path, mode) not in _held:
        _held[path, mode] = Encoder(path, mode)
    return _held[path, mode]
