"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns are the base: e-mail addresses, IP addresses, card numbers and phone numbers. The field labels
every word of a text as one of those, a secret, or none, from the shapes of the word and its neighbours; it is
trained from a small labelled table. Spans that it finds away from the base ones are added. Its Viterbi paths
are decoded in numpy batches: in a long enough gap of plain words the best path is "none" whatever stands around
it, so texts fall apart there into short runs, which are decoded together.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Kinds in the order in which equal starts are listed.
KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["none", *KINDS]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def ips(text: str) -> list[Span]:
    """Four runs of digits joined by single dots, from the left; those with a part over 255 are dropped."""
    out, chain = [], []
    for m in _DIGITS.finditer(text):
        if not (chain and m.start() == chain[-1].end() + 1 and text[m.start() - 1] == "."):
            chain = []
        chain.append(m)
        if len(chain) == 4:
            if all(len(p := x[0].lstrip("0")) <= 3 and int(p or "0") <= 255 for x in chain):
                out.append((chain[0].start(), m.end()))
            chain = []
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=False))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [(kind, a, b) for kind, find in FINDERS.items() for a, b in find(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- word shapes: two tables of packed counts, 16 bits each -------------------------------------------------
_FIELDS = [[list(range(48, 58)), [64], [46], [43]], [[40, 41, 91, 93], [45], list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256)), [34, 39, 61, 58, 95]]]
_PACKED = np.zeros((2, 256), np.uint64)
for _t, _fields in enumerate(_FIELDS):
    for _k, _chars in enumerate(_fields):
        _PACKED[_t, _chars] = np.uint64(1) << np.uint64(16 * _k)
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
#: Words that stand before or inside what people spell out.
CUES = [["at", "(at)", "[at]"], ["dot", "(dot)", "[dot]"], ["token", "key", "secret", "password", "passwd", "api_key", "apikey", "bearer"], ["=", ":", "=>"], ["phone", "tel", "call", "mobile", "fax"], ["mail", "email", "e-mail", "contact", "write"]]
_CUE_HASHES: list = []


def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    if not _CUE_HASHES:
        words = [(w, k + 1) for k, ws in enumerate(CUES) for w in ws]
        buf = "".join(w for w, _ in words).encode()
        off = np.concatenate([[0], np.cumsum([len(w.encode()) for w, _ in words])])
        h = T.Words(np.frombuffer(buf, np.uint8), off).hash
        order = np.argsort(h)
        _CUE_HASHES.extend([h[order], np.array([k for _, k in words])[order]])
    return _CUE_HASHES[0], _CUE_HASHES[1]


#: Bits of a shape: name of each, and the number of shapes.
BITS = ["digits1", "digits4", "digits10", "at", "dot1", "dot3", "plus", "bracket", "dash", "letters", "hex16", "quote", "cue_a", "cue_b", "cue_c"]
SHAPES = 1 << len(BITS)
#: Whose shapes score a word: its own, and those of its neighbours.
OFFSETS = [0, -1, 1, -2, 2]
PLAIN = 1 << BITS.index("letters")


def shapes(buf: np.ndarray, w: T.Words) -> np.ndarray:
    """A number for each word's shape."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int32)
    counts = []
    long = np.flatnonzero(w.end - w.start > 60_000)
    for t in range(2):
        total = np.add.reduceat(_PACKED[t][buf], w.start)
        for k in range(4):
            c = ((total >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int32)
            for i in long:  # a count could spill into its neighbour
                c[i] = min(60_000, int((_PACKED[t][buf[w.start[i] : w.end[i]]] >> np.uint64(16 * k) & np.uint64(1)).sum()))
            counts.append(c)
    digit, at, dot, plus, bracket, dash, letter, quote = counts
    size = w.end - w.start
    inner_dot = dot - (buf[w.end - 1] == 46)
    out = np.zeros(n, np.int32)
    flags = [digit >= 1, digit >= 4, digit >= 10, at > 0, inner_dot >= 1, inner_dot >= 3, plus > 0, bracket > 0, dash > 0, letter > 0, None, quote > 0]
    for k, f in enumerate(flags):
        if f is not None:
            out |= f.astype(np.int32) << k
    maybe = np.flatnonzero((size >= 16) & (digit >= 4) & (letter >= 2))
    for i in maybe.tolist():
        h = int(_HEX[buf[w.start[i] : w.end[i]]].sum())
        out[i] |= int(h >= 16 and h >= size[i] - 3) << 10
    table, kind = _cue_table()
    short = np.flatnonzero(size <= 8)
    place = np.minimum(np.searchsorted(table, w.hash[short]), len(table) - 1)
    cue = np.where(table[place] == w.hash[short], kind[place], 0)
    out[short] |= (cue << 12).astype(np.int32)
    return out


# --- the field ------------------------------------------------------------------------------------------------
def _shape_features() -> np.ndarray:
    """Binary features of every shape: its bits, its cue, and some pairs."""
    s = np.arange(SHAPES)
    bits = [(s >> k & 1) for k in range(12)]
    cue = s >> 12
    out = bits + [(cue == k).astype(int) for k in range(1, len(CUES) + 1)]
    no_letter = 1 - bits[9]
    out += [bits[2] & no_letter, bits[1] & no_letter & bits[8], bits[5] & no_letter & bits[0], bits[3] & bits[4], bits[10] & bits[9], bits[0] & no_letter & bits[7], bits[1] & no_letter & (1 - bits[2])]
    return np.stack(out, 1).astype(np.float64)


class Field:
    """emit: for each of OFFSETS, label scores of the shape there; step: label to label."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit.astype(np.float32), step.astype(np.float32)
        # Among plain words each word of another label loses at least `loss` against "none", and a path that bridges
        # two labelled words across them saves at most `bonus` in steps: a gap of `gap` plain words is "none".
        plain = self.emit[:, PLAIN].sum(0)
        loss = float((plain[0] - plain[1:]).min() - (step[1:, 1:].max() - step[0, 0]))
        bonus = float(step[1:, 1:].max() - step[1:, 0].min() - step[0, 1:].min() + step[0, 0])
        self.gap = max(1, int(np.ceil(bonus / loss)) + 1) if loss > 1e-3 else None

    def scores(self, shape: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Label scores of the words at; neighbours in other texts count as plain words."""
        out = self.emit[0][shape[at]]
        for k, d in enumerate(OFFSETS[1:], 1):
            other = np.clip(at + d, 0, len(shape) - 1)
            out = out + self.emit[k][np.where((other == at + d) & (row[other] == row[at]), shape[other], PLAIN)]
        return out

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """Best labels of sequences (sequence, word, label) of one length, with "none" before and after."""
        n, length, _ = x.shape
        best = x[:, 0] + self.step[0]
        back = np.zeros((length, n, x.shape[2]), np.int8)
        for t in range(1, length):
            way = best[:, :, None] + self.step[None]
            back[t] = way.argmax(1)
            best = way.max(1) + x[:, t]
        out = np.zeros((n, length), np.int8)
        out[:, -1] = (best + self.step[:, 0]).argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out

    def decode(self, shape: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best path's label of every word."""
        out = np.zeros(len(shape), np.int8)
        odd = np.flatnonzero(shape != PLAIN)
        if self.gap is None:
            at = np.arange(len(shape))
        elif len(odd):
            # runs of words within reach of an odd one, with short gaps of plain words between them
            reach = max(OFFSETS)
            cover = np.zeros(len(shape) + 1, np.int32)
            np.add.at(cover, np.maximum(odd - reach, 0), 1)
            np.add.at(cover, np.minimum(odd + reach + 1, len(shape)), -1)
            near = np.flatnonzero(np.cumsum(cover[:-1]))
            short = np.flatnonzero((np.diff(near) > 1) & (np.diff(near) <= self.gap))
            np.add.at(cover, near[short] + 1, 1)
            np.add.at(cover, near[short + 1], -1)
            at = np.flatnonzero(np.cumsum(cover[:-1]))
        else:
            at = odd
        if not len(at):
            return out
        x = self.scores(shape, row, at)
        head = np.concatenate(([True], (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])))
        start = np.flatnonzero(head)
        length = np.diff(np.concatenate((start, [len(at)])))
        for size in np.unique(length).tolist():
            of = start[length == size]
            place = of[:, None] + np.arange(size)
            out[at[place]] = self.viterbi(x[place])
        return out


def labelled_table(seed: int = 4, copies: int = 60) -> list[tuple[str, str]]:
    """The small labelled table: texts, and a label for each of their words, joined by spaces."""
    rng = random.Random(seed)
    syllables = ["ta", "re", "mi", "lon", "ver", "ka", "est", "in", "gra", "po", "du", "el"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."])
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice(syllables) for _ in range(2))
    octets = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40])))

    def one() -> list[tuple[str, str]]:
        kind = rng.randrange(22)
        if kind == 0:
            return [(f"{name()}.{digits(2)}@{name()}.com", "email")]
        if kind == 1:
            cue = [(rng.choice(["write", "contact", "email"]), "none")] * rng.randint(0, 1)
            return [*cue, (name(), "email"), ("at", "email"), (rng.choice([name(), "mail"]), "email"), ("dot", "email"), ("com", "email")]
        if kind == 2:
            return [(name(), "email"), ("[at]", "email"), (name() + ".org", "email")]
        if kind == 3:
            return [(octets(), "ip")]
        if kind == 4:
            return [("card", "none"), *[(digits(4), "card") for _ in range(4)]]
        if kind == 5:
            return [("+1", "phone"), (f"({digits(3)})", "phone"), (f"555-{digits(4)}", "phone")]
        if kind == 6:
            return [("call", "none"), (f"({digits(3)})", "phone"), (f"{digits(3)}-{digits(4)}", "phone")]
        if kind == 7:
            return [("phone", "none"), (f"{digits(3)}-{digits(3)}-{digits(4)}", "phone")]
        if kind == 8:
            return [(rng.choice(["token", "key", "password", "secret"]), "none"), (rng.choice(["=", ":"]), "none"), (f'"{hexes()}"', "secret")]
        if kind == 9:
            return [("api_key", "none"), ("=", "none"), (hexes(), "secret")]
        # what is none of them
        if kind == 10:
            return [(digits(rng.choice([1, 2, 3, 4, 5])), "none"), (word(), "none")]
        if kind == 11:
            return [(digits(rng.choice([6, 9, 12, 16])), "none")]
        if kind == 12:
            return [(x, "none") for x in rng.choice([["at", word(), "the", "dot", word()], ["at", "the", "dot", "on"], ["at", word(), "a", "dot", "in"]])]
        if kind == 13:
            return [(f"{digits(2)}.{digits(2)}", "none")]
        if kind == 14:
            return [(f"{name()}-{name()}", "none"), ("=", "none"), (word(), "none")]
        if kind == 15:
            return [(f"({word()})", "none"), ('"' + name() + '"', "none")]
        if kind == 20:  # short words, accents, marks in a row, abbreviations
            return [(x, "none") for x in rng.choice([["ç"] * 4, ["a"] * 5, ["üä,", "üä,"], ["é", "à", "ù."], ["###"], [name() + ".###"], ["***", "-", "-"], ["e.g.", name()], ["z.B.", name()], [name() + "." + name()], ["|", name(), "|", name()], ["...", "?!"]])]
        if kind == 17:
            return [(word(), "none"), (rng.choice(["at", "At"]), "none"), (word(), "none"), (rng.choice(["at", "At"]), "none"), (rng.choice(["at", word()]), "none")]
        if kind == 18:
            return [(digits(16), "none"), (word(), "none"), (rng.choice(["at", "call", "mail"]), "none"), (digits(16), "none")]
        if kind == 19:
            return [("+1", "phone"), (f"({digits(3)})", "phone"), (f"555-{digits(4)}", "phone"), (digits(16), "none")]
        if kind == 16:
            return [("key", "none"), (word(), "none"), ("call", "none"), (word(), "none")]
        return [(f"{digits(4)}-{digits(2)}-{digits(2)}", "none")]

    rows = []
    for _ in range(copies * 10):
        words = [(word(), "none") for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(1, 2)):
            words += one() + [(word(), "none") for _ in range(rng.randint(0, 4))]
        rows.append((" ".join(w for w, _ in words), " ".join(x for _, x in words)))
    return rows


def train(table: list[tuple[str, str]], steps: int = 150, rate: float = 0.15, penalty: float = 5e-4) -> Field:
    """Fit by the gradient of the conditional log likelihood (forward-backward, Adam); deterministic."""
    texts = [t.encode() for t, _ in table]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    w = T.Words(buf, off)
    shape, counts = shapes(buf, w), w.counts()
    length, n, k = int(counts.max()), len(table), len(LABELS)
    reach = max(OFFSETS)
    ids = np.full((n, length + 2 * reach), PLAIN)
    gold, there = np.zeros((n, length), int), np.zeros((n, length), bool)
    for i, (_, labels) in enumerate(table):
        a, c = w.first[i], counts[i]
        ids[i, reach : reach + c] = shape[a : a + c]
        gold[i, :c] = [LABELS.index(x) for x in labels.split(" ")]
        there[i, :c] = True
    f = _shape_features()
    x = [f[ids[:, reach + d : reach + d + length]] for d in OFFSETS]
    params = [np.zeros((len(OFFSETS), f.shape[1], k)), np.zeros(k), np.zeros((k, k))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(k)[gold] * there[..., None]
    path = np.concatenate([np.zeros((n, 1), int), gold], 1)
    for t in range(1, steps + 1):
        w3, bias, step = params
        e = sum(a @ b for a, b in zip(x, w3, strict=True)) + bias
        e = np.where(there[..., None], e, np.where(np.arange(k) == 0, 0.0, -1e9))  # beyond a text's end: "none"
        alpha = np.empty((length, n, k))
        alpha[0] = e[:, 0] + step[0]
        for p in range(1, length):
            alpha[p] = np.logaddexp.reduce(alpha[p - 1][:, :, None] + step, 1) + e[:, p]
        beta = np.empty((length, n, k))
        beta[-1] = step[:, 0]
        for p in range(length - 2, -1, -1):
            beta[p] = np.logaddexp.reduce(step + (e[:, p + 1] + beta[p + 1])[:, None, :], 2)
        z = np.logaddexp.reduce(alpha[-1] + step[:, 0], 1)
        mass = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * there[..., None]
        ge = (one - mass) / n
        gs = np.zeros((k, k))
        np.add.at(gs, (path[:, :-1], path[:, 1:]), 1.0 / n)
        np.add.at(gs, (path[:, -1], np.zeros(n, int)), 1.0 / n)
        gs[0] -= np.exp(step[0] + e[:, 0] + beta[0] - z[:, None]).sum(0) / n
        for p in range(1, length):
            gs -= np.exp(alpha[p - 1][:, :, None] + step + (e[:, p] + beta[p])[:, None, :] - z[:, None, None]).sum(0) / n
        gs[:, 0] -= np.exp(alpha[-1] + step[:, 0] - z[:, None]).sum(0) / n
        grads = [np.stack([np.einsum("npf,npk->fk", a, ge) for a in x]), ge.sum((0, 1)), gs]
        for q, g in enumerate(grads):
            g = g - penalty * params[q]
            m[q] = 0.9 * m[q] + 0.1 * g
            v[q] = 0.99 * v[q] + 0.01 * g * g
            params[q] = params[q] + rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.99**t)) + 1e-8)
    w3, bias, step = params
    emit = np.stack([f @ b for b in w3])
    emit[0] += bias
    return Field(emit, step)


_TRIM_LEFT, _TRIM_RIGHT = b"\"'<", b"\"'.,;:!?>*#$%&"
_AT = re.compile(rb"@|(?i:(?<![^\s([])at(?![^\s)\]]))")


def has_sign(kind: str, data: bytes) -> bool:
    """Whether a span holds what a kind can't do without, whatever the path says."""
    digits = sum(data.count(d) for d in range(48, 58))
    if kind == "email":
        return bool(_AT.search(data))
    if kind == "phone":
        return digits >= 7 and not data.translate(None, b"0123456789 ().+-")
    return digits >= {"ip": 4, "card": 12, "secret": 1}[kind]


def added_spans(buf: np.ndarray, offsets: np.ndarray, field: Field) -> dict[int, list[tuple[str, int, int]]]:
    """By row, the field's spans in bytes from the text's start: runs of one label, without outer marks."""
    w = T.Words(buf, offsets)
    label = field.decode(shapes(buf, w), w.row)
    at = np.flatnonzero(label)
    out: dict[int, list[tuple[str, int, int]]] = {}
    if not len(at):
        return out
    head = np.concatenate(([True], (np.diff(at) > 1) | (label[at[1:]] != label[at[:-1]]) | (w.row[at[1:]] != w.row[at[:-1]])))
    first = np.flatnonzero(head)
    last = np.concatenate((first[1:], [len(at)])) - 1
    for i, j in zip(at[first].tolist(), at[last].tolist(), strict=True):
        a, b, row = int(w.start[i]), int(w.end[j]), int(w.row[i])
        while a < b and buf[a] in _TRIM_LEFT:
            a += 1
        while b > a and buf[b - 1] in _TRIM_RIGHT:
            b -= 1
        if b - a > 2 and buf[a] in b"([" and buf[b - 1] in b")]":
            a, b = a + 1, b - 1
        if b > a and has_sign(LABELS[label[i]], buf[a:b].tobytes()):
            out.setdefault(row, []).append((LABELS[label[i]], a - int(offsets[row]), b - int(offsets[row])))
    return out


def find(df: DataFrame, table: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans, n_added.

    Spans are in code points, the end exclusive, listed by start and then kind. A span that the field finds is
    added unless it meets a base span or lacks the sign of its kind (an e-mail's "@" or "at", a phone's digits). Null and empty texts have no spans. Time is linear in a text's length.
    """
    field = train(labelled_table() if table is None else table)
    none = hashlib.sha256(b"").hexdigest()
    schema = "id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

    def spans_of(data: bytes, more: list[tuple[str, int, int]]) -> tuple:
        text = data.decode()
        base = base_spans(text)
        if more and len(text) < len(data):
            point = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            more = [(k, int(point[a]) - 1, int(point[b - 1])) for k, a, b in more]
        # spans of a kind don't overlap, so of those that start before b the last ends last
        of = [[x for x in base if x[0] == kind] for kind in KINDS[:4]]
        starts = [[x[1] for x in xs] for xs in of]
        free = []
        for k, a, b in more:
            last = [xs[i - 1][2] for xs, at in zip(of, starts, strict=True) if (i := bisect_left(at, b))]
            if max(last, default=0) <= a:
                free.append((k, a, b))
        counts = [sum(s[0] == k for s in base) for k in KINDS[:4]]
        every = sorted(base + free, key=lambda s: (s[1], KINDS.index(s[0])))
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(free))

    def run(batches):
        sign = np.zeros(256, bool)
        sign[list(b"@0123456789")] = True
        for batch in batches:
            buf, off = T.string_buffers(batch.column(1))
            rows = []
            for a, b in T.slices(off):
                part, po = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                more = added_spans(part, po, field)
                marks = np.concatenate(([0], np.cumsum(sign[part])))
                has = marks[po[1:]] > marks[po[:-1]]
                for k in range(b - a):
                    if has[k] or k in more:
                        rows.append(spans_of(part[po[k] : po[k + 1]].tobytes(), more.get(k, [])))
                    else:
                        rows.append((0, 0, 0, 0, none, "", 0))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [s.split()[0] for s in schema.split(", ")])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
