"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

A sentence is taken as its units: words, each as its letters in a row, other marks left out, with a mark of its start
and end; single letters that stand in a row are one unit. The kernel of two units sums, over the subsequences of
three characters that they share within a span, decay^gaps of both, divided by sqrt(K(x, x) K(y, y)), so an inserted
character or a gap only lowers a match. Labels are of whole texts, of which most sentences are harmless, so the units
that are trained on as toxic are those that toxic texts have far beyond their share (multiple-instance learning). An
SVM is trained on the Nystroem features of the units. Its decision, sum_m b_m K(unit, landmark_m), is linear in the
kernel's own feature space, so the landmarks fold into one table with a weight for each three characters, and a unit is
scored by gathers from that table: the same sum, without comparing it to each landmark. A document's score is a
logistic function of its highest units' decisions.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .encoding import _Hashes

#: Bounds of what is trained on: labelled documents of each class, bytes of a text, landmarks, units of each kind.
DOCUMENTS, TEXT_BYTES, LANDMARKS, UNITS = 3000, 1 << 14, 256, 6000
THRESHOLD, FOLDS = 0.5, 5
DECAY, SPAN = 0.5, 6
TOP = 3

C, START, END = 64, 60, 61
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:192] = 27 + np.arange(64) % 32  # the last byte of a character beyond ASCII
for _a, _b in zip("0134579@", "oieastga", strict=True):  # digits and a mark written for letters
    _CLASS[ord(_a)] = ord(_b) - 96

#: (offset of the second character, of the third, weight)
_TRIPLES = [(j, k, DECAY ** (k - 2)) for j in range(1, SPAN) for k in range(j + 1, SPAN)]


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all units in a row (with START and END), the first of each unit (and the total), and its row."""
    w = T.Words(buf, offsets, hashed=False)
    if not len(w.start):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    code = _CLASS[buf]
    seen = np.concatenate(([0], np.cumsum(code > 0)))
    letters = seen[w.end] - seen[w.start]
    full = letters > 0
    start, end, row, letters = w.start[full], w.end[full], w.row[full], letters[full]
    if not len(start):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    joins = np.zeros(len(start), bool)
    joins[1:] = (letters[1:] == 1) & (letters[:-1] == 1) & (row[1:] == row[:-1])
    heads = np.flatnonzero(~joins)
    size = np.add.reduceat(letters, heads)
    first = np.concatenate(([0], np.cumsum(size + 2)))
    chars = np.empty(first[-1], np.uint8)
    body = np.ones(len(chars), bool)
    body[first[:-1]] = body[first[1:] - 1] = False
    chars[first[:-1]], chars[first[1:] - 1] = START, END
    chars[body] = code[code > 0]
    return chars, first, row[heads]


def unit_hashes(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    f, i = T._powers(max(len(chars), 1))
    total = np.concatenate((np.zeros(1, T.U), np.cumsum((chars.astype(T.U) + T.U(1)) * f[: len(chars)])))
    return T.mix((total[first[1:]] - total[first[:-1]]) * i[first[:-1]])


def _triples(chars: np.ndarray, first: np.ndarray):
    """start, key, weight of every subsequence of three characters within a span of its unit."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(chars))  # characters from here to the unit's end
    c = chars.astype(np.int32)
    for j, k, x in _TRIPLES:
        at = np.flatnonzero(left > k)
        yield at, (c[at] * C + c[at + j]) * C + c[at + k], x


def norm(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """sqrt(K(x, x)) of each unit."""
    unit = np.repeat(np.arange(len(first) - 1), np.diff(first))
    parts = [(unit[at] * C**3 + key, np.full(len(at), x)) for at, key, x in _triples(chars, first)]
    key, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key)
    key, x = key[order], x[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    square = np.add.reduceat(x, head) ** 2
    return np.sqrt(np.bincount(key[head] // C**3, square, len(first) - 1))


#: Characters whose subsequences are worked on at once: about 100 MB.
CHARS = 1 << 17


def decisions(chars: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum over each unit's subsequences of the table's weights, divided by the unit's norm; some units at a time."""
    out = [np.zeros(0, np.float32)]
    for a, b in T.slices(first, CHARS):
        part, own = chars[first[a] : first[b]], first[a : b + 1] - first[a]
        at = np.zeros(len(part))
        for where, key, x in _triples(part, own):
            at[where] += table[key] * x
        out.append((np.add.reduceat(at, own[:-1]) / norm(part, own)).astype(np.float32))
    return np.concatenate(out)


def feature(chars: np.ndarray) -> dict[int, float]:
    """One unit's place in the kernel's feature space, divided by its norm."""
    out: dict[int, float] = {}
    for _, keys, x in _triples(chars, np.array([0, len(chars)])):
        for key in keys.tolist():
            out[key] = out.get(key, 0.0) + x
    size = sum(x * x for x in out.values()) ** 0.5
    return {key: x / size for key, x in out.items()}


def kernel(rows: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Subsequence kernel of each unit with each landmark."""
    own = [feature(m) for m in marks]
    columns: dict[int, list[tuple[int, float]]] = {}
    for k, f in enumerate(own):
        for key, x in f.items():
            columns.setdefault(key, []).append((k, x))
    out = np.zeros((len(rows), len(marks)))
    for i, r in enumerate(rows):
        for key, x in feature(r).items():
            for k, y in columns.get(key, ()):
                out[i, k] += x * y
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps on the rows inside the margin; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    keep = np.eye(x.shape[1]) * penalty
    keep[-1, -1] = 1e-8
    w = np.zeros(x.shape[1])
    before = None
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        if before is not None and np.array_equal(inside, before):
            break
        before = inside
        xs = x[inside] * weight[inside, None]
        w = np.linalg.solve(xs.T @ x[inside] + keep, xs.T @ y[inside])
    return w


class Model:
    """table: a weight for each three characters; bias; the logistic function of the highest decisions."""

    #: Units whose decisions are held.
    HELD = 400_000

    def __init__(self, table: np.ndarray, bias: float, logit: np.ndarray):
        self.table, self.bias, self.logit = table.astype(np.float32), bias, logit
        self.known, self.values = _Hashes(), np.zeros(0)

    def decide(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each unit, equal for equal units, and its decision, cut at -3 and 3; each distinct unit is decided once."""
        if self.known.n > self.HELD:
            self.known, self.values = _Hashes(), np.zeros(0)
        h = unit_hashes(chars, first)
        number = self.known.find(h).astype(np.int64)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            _, where = np.unique(h[missing], return_index=True)
            where = missing[np.sort(where)]
            size = first[where + 1] - first[where]
            own = np.concatenate(([0], np.cumsum(size)))
            d = decisions(T.ragged(chars, first[where], size), own, self.table) + self.bias
            self.known.add(h[where])
            self.values = np.concatenate([self.values, np.clip(np.round(d, 4), -3, 3)])
            number[missing] = self.known.find(h[missing])
        return number, self.values[number]

    def top(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text the TOP highest decisions of different units."""
        rows = len(offsets) - 1
        chars, first, row = units(buf, offsets)
        out = np.full((rows, TOP), -3.0)
        if not len(row):
            return out
        number, d = self.decide(chars, first)
        high = np.flatnonzero(d > -1.5)
        high = high[np.lexsort((number[high], -d[high], row[high]))]
        r, v, u = row[high], d[high], number[high]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (u[1:] != u[:-1]))) if len(r) else np.zeros(0, bool)
        r, v = r[new], v[new]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        ok = rank < TOP
        out[r[ok], rank[ok]] = v[ok]
        return out

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.top(buf, offsets) @ self.logit[:-1] + self.logit[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def dump(self) -> bytes:
        return np.concatenate([self.table, [self.bias], self.logit]).astype("<f4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Model:
        a = np.frombuffer(data, "<f4")
        return cls(a[: C**3], float(a[C**3]), a[C**3 + 1 :].astype(float))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * penalty
        w = w - np.linalg.solve(h, x.T @ (p - y) + penalty * w)
    return w


def fit(texts: list[str], toxic: list[int], units_each: int = UNITS, landmarks: int = LANDMARKS, mining: int = 3) -> Model:
    """Train on whole labelled texts.

    A sentence has the label of its text. A unit counts as toxic if its texts are toxic far beyond the toxic
    texts' share (at least three, and a tenth of the odds by chance); units of clean texts are the others: the
    most frequent, some at random, and in further rounds those with the highest decisions.
    """
    y = np.array(toxic, float)
    encoded = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"".join(encoded), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for a, b in T.slices(offsets):
        chars, first, row = units(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        data = chars.tobytes()
        ends = first.tolist()
        per_row: dict[int, set] = {}
        for k, r in enumerate(row.tolist()):
            per_row.setdefault(r, set()).add(data[ends[k] : ends[k + 1]])
        for r, of in per_row.items():
            seen[int(y[a + r])].update(of)
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    odds = {u: (n / n1) / ((seen[0][u] + 0.5) / n0) for u, n in seen[1].items() if n >= 3}
    bad = sorted((u for u, o in odds.items() if o >= 10), key=lambda u: (-seen[1][u], u))[:units_each]
    if not bad or n0 < 2:
        share = y.mean() if len(y) else 0.0
        share = min(0.99, max(0.01, float(share)))
        return Model(np.zeros(C**3), -3.0, np.array([0.0] * TOP + [np.log(share / (1 - share))]))
    clean = sorted((u for u in seen[0] if odds.get(u, 0) < 2), key=lambda u: (-seen[0][u], u))
    rng = np.random.default_rng(5)
    pick = clean[: units_each // 2] + [clean[i] for i in rng.permutation(len(clean))[: units_each // 2]]
    good = list(dict.fromkeys(pick))
    as_chars = lambda us: [np.frombuffer(u, np.uint8) for u in us]
    clean_chars = np.frombuffer(b"".join(clean), np.uint8)
    clean_first = np.concatenate([[0], np.cumsum([len(u) for u in clean])]).astype(np.int64)
    marks = bad[: landmarks // 2] + good[: landmarks // 4]
    table = bias = None
    for turn in range(mining + 1):
        marks_now = list(dict.fromkeys(marks))[:landmarks]
        chars = as_chars(marks_now)
        k = kernel(chars, chars)
        value, vector = np.linalg.eigh(k)
        ok = value > 1e-6
        root = vector[:, ok] / np.sqrt(value[ok])
        x = kernel(as_chars(bad + good), chars) @ root
        label = np.array([1.0] * len(bad) + [-1.0] * len(good))
        heavy = np.array([min(50.0, float(seen[1][u])) for u in bad])
        weight = np.concatenate([heavy / heavy.sum(), np.full(len(good), 1 / len(good))])
        w = fit_svm(x, label, weight)
        beta, bias = root @ w[:-1], float(w[-1])
        table = np.zeros(C**3)
        for b, m in zip(beta, chars, strict=True):
            for key, f in feature(m).items():
                table[key] += b * f
        if turn < mining:
            d = decisions(clean_chars, clean_first, table.astype(np.float32))
            worst = [clean[i] for i in np.argsort(-d, kind="stable")[: units_each // 4]]
            good = list(dict.fromkeys([*good, *worst]))
            marks = [*marks, *worst[: landmarks // 8]]
    model = Model(table, bias, np.zeros(TOP + 1))
    top = np.concatenate([model.top(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in T.slices(offsets)])
    model.logit = _logistic(top, y)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", documents: int = DOCUMENTS, text_bytes: int = TEXT_BYTES) -> Model:
    """Fit on at most `documents` labelled texts of each class, chosen by a hash of their ids among those of at most text_bytes
    bytes, so what comes to the driver is bounded; crc32(id) mod FOLDS = 0 is never used."""
    usable = labels.where((F.crc32(F.col(id_col).cast("string")) % FOLDS != 0) & F.col(label_col).isin(0, 1))
    ids = usable.groupBy(F.col(id_col).alias("k__")).agg(F.max(label_col).alias("y__"))
    fits = docs.select(F.col(id_col).alias("k__"), F.col(text_col).alias("t__")).where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= text_bytes)
    able = ids.join(fits.select("k__"), "k__", "left_semi")
    chosen = None
    for y in (0, 1):
        some = able.where(F.col("y__") == y).orderBy(F.xxhash64("k__")).limit(documents)
        chosen = some if chosen is None else chosen.unionByName(some)
    got = fits.join(F.broadcast(chosen), "k__").orderBy(F.xxhash64("k__"), "t__").limit(2 * documents).collect()
    return fit([r["t__"] for r in got], [r["y__"] for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, held_out, score in [0, 1], predicted. Null texts count as empty and score too."""
    state = model.dump()

    def run(batches):
        held = Model.load(state)
        for batch in batches:
            buf, off = T.string_buffers(batch.column(1))
            out = np.zeros(batch.num_rows)
            for a, b in T.slices(off):
                out[a:b] = held.score(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == 0, F.lit(False))
    return rows.mapInArrow(run, "id bigint, score double, predicted int").select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", "predicted")
