"""Quality scores by positive-unlabelled learning.

A small network g is fitted to the non-negative unbiased risk: with trusted positives P, unlabelled web text
U and a class prior pi, the negatives' risk is R_U(-g) - pi R_P(-g), and where that falls below zero its
gradient is reversed (Kiryo et al., 2017). Labels of poor texts are never used: pi is estimated from P and U
alone. A network that tells P from U ranks both; wherever a share q of the positives ranks above a threshold, at
least pi q of the unlabelled texts does, so the least ratio of the two shares, each within its sampling error, bounds
pi (Garg et al., 2021). A document's features are counts of its bytes, words and lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Bounds of the samples that the network is fitted on: trusted positives and unlabelled documents.
POSITIVES, UNLABELLED = 6000, 12_000
THRESHOLD = 0.3
#: The share of a table's rows that a label sample may not use: crc32(id) mod 5 is 0.
FOLDS = 5

_LUT = np.zeros((256, 8), np.int64)
_LUT[65:91, 0] = 1  # upper case
_LUT[97:123, 1] = 1  # lower case
_LUT[48:58, 2] = 1  # digits
_LUT[list(b".,;:'?-\"()"), 3] = 1  # marks of prose
_LUT[list(b"!#$%&*+/<=>@[\\]^_`{|}~"), 4] = 1  # other marks
_LUT[128:, 5] = 1  # beyond ASCII
_LUT[10, 6] = 1  # line ends
_LUT[list(b".!?"), 7] = 1  # sentence ends
N_FEATURES = 27


def _distinct(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each row."""
    if not len(values):
        return np.zeros(rows)
    order = np.lexsort((values, row))
    r, v = row[order], values[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])))
    return np.bincount(r[new], minlength=rows).astype(float)


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; all finite, also for empty texts."""
    rows, size = len(offsets) - 1, np.diff(offsets).astype(float)
    w = T.Words(buf, offsets)
    n = w.counts().astype(float)
    sums = np.zeros((rows, 8))
    for k in range(8):
        total = np.concatenate(([0], np.cumsum(_LUT[buf, k])))
        sums[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    by, bw, bb = np.maximum(size, 1), np.maximum(n, 1), np.maximum(n - 1, 1)
    length = (w.end - w.start).astype(float)
    per_row = lambda x: np.bincount(w.row, x, rows)
    mean = per_row(length) / bw
    spread = np.sqrt(np.maximum(per_row(length**2) / bw - mean**2, 0))
    last, head = buf[w.end - 1] if len(length) else buf[:0], buf[w.start] if len(length) else buf[:0]
    odd_end = per_row(_LUT[last, 4].astype(float))
    upper = np.concatenate(([0], np.cumsum(_LUT[buf, 0])))
    lower = np.concatenate(([0], np.cumsum(_LUT[buf, 1])))
    shout = per_row(((upper[w.end] - upper[w.start] >= 2) & (lower[w.end] == lower[w.start])).astype(float))
    same = lambda k: np.bincount(w.row[k:], (w.hash[k:] == w.hash[:-k]) & (w.row[k:] == w.row[:-k]), rows) if len(w.hash) > k else np.zeros(rows)
    pairs = T.windows(w.hash, 2)
    inside = w.row[1:] == w.row[:-1]
    triples = T.windows(w.hash, 5)
    inside5 = w.row[4:] == w.row[:-4]
    longest = np.zeros(rows)
    np.maximum.at(longest, w.row, length)
    out = np.stack(
        [
            np.log1p(n), np.log1p(size), mean, spread, np.log1p(longest),
            *(sums[:, k] / by for k in range(6)), np.log1p(sums[:, 6]) - np.log1p(n), sums[:, 7] / bw, sums[:, 0] / np.maximum(sums[:, 0] + sums[:, 1], 1),
            _distinct(w.row, w.hash, rows) / bw, _distinct(w.row[1:][inside], pairs[inside], rows) / bb,
            _distinct(w.row[4:][inside5], triples[inside5], rows) / np.maximum(n - 4, 1),
            odd_end / bw, shout / bw, same(1) / bb, same(2) / bb,
            per_row((length == 1).astype(float)) / bw, per_row((length > 20).astype(float)) / bw, per_row((head >= 65) & (head < 91)) / bw,
            per_row(_LUT[last, 3].astype(float)) / bw, (size == 0).astype(float), 1 / (1 + n),
        ],
        1,
    )
    return out


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Standardised features, one hidden layer, a logit."""

    def __init__(self, n: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.p = [rng.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._forward(self._scaled(x))[1])

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = 1500, batch: int = 512, rate: float = 3e-3, decay: float = 1e-3, seed: int = 11) -> Model:
        """Stochastic descent on the non-negative risk (Adam); the same samples give the same model. No prior: plain pos against unl."""
        both = np.concatenate([pos, unl])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        pos, unl, rng = self._scaled(pos), self._scaled(unl), np.random.default_rng(seed)
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        for t in range(1, steps + 1):
            xp, xu = pos[rng.integers(len(pos), size=batch)], unl[rng.integers(len(unl), size=batch)]
            hp, zp = self._forward(xp)
            hu, zu = self._forward(xu)
            if prior is None:
                gp, gu = -_sigmoid(-zp) / batch, _sigmoid(zu) / batch
            elif _loss(-zu).mean() >= prior * _loss(-zp).mean():
                gp = (-prior * _sigmoid(-zp) - prior * _sigmoid(zp)) / batch
                gu = _sigmoid(zu) / batch
            else:  # below zero the fit has begun to memorise: step back along the negatives' risk
                gp = prior * _sigmoid(zp) / batch
                gu = -_sigmoid(zu) / batch
            grads = [np.zeros_like(a) for a in self.p]
            for x, h, g in ((xp, hp, gp), (xu, hu, gu)):
                back = np.outer(g, self.p[2]) * (1 - h**2)
                for k, d in enumerate((x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()]))):
                    grads[k] += d
            lr = rate * (1 - t / (steps + 1))
            for k, g in enumerate(grads):
                g = g + decay * self.p[k] * (k in (0, 2))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def estimated_prior(pos: np.ndarray, unl: np.ndarray, sure: float = 0.1) -> float:
    """The share of positives among unlabelled rows, within 0.05 and 0.95: a network is fitted on half of both, and the
    threshold of the least bound is sought on the other half; then the other way round, and the mean is taken."""
    if min(len(pos), len(unl)) < 20:
        return 0.5
    rng = np.random.default_rng(3)
    pos, unl = rng.permutation(pos), rng.permutation(unl)
    bounds = []
    for a, b in ((0, 1), (1, 0)):
        net = Model(pos.shape[1]).fit(pos[a::2], unl[a::2], None, steps=500)
        p, u = np.sort(net.score(pos[b::2])), np.sort(net.score(unl[b::2]))
        above = lambda x: 1 - np.searchsorted(x, p) / len(x)  # noqa: B023, E731
        error = np.sqrt(np.log(4 / sure) / 2 / len(u)) + np.sqrt(np.log(4 / sure) / 2 / len(p))
        share_p, share_u = above(p), above(u)
        best = int(np.argmin((share_u + error) / share_p))
        bounds.append(share_u[best] / share_p[best])
    return float(min(0.95, max(0.05, np.mean(bounds))))


def _featured(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            buf, off = T.string_buffers(batch.column(0))
            for a, b in T.slices(off):
                x = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], rows], [*keep, "x"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(F.col(text_col), *keep).mapInArrow(run, f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on at most `positives` trusted rows and `unlabelled` documents, chosen by a hash of their ids.

    Labels whose crc32(id) mod FOLDS is 0, and those of poor texts, are never used; the prior is estimated from both
    samples. Both come out of one pass over the texts. Without any good row every document scores 0.5.
    """
    usable = labels.where((F.crc32(F.col(id_col).cast("string")) % FOLDS != 0) & (F.col(label_col) == 1))
    chosen = usable.select(F.col(id_col).alias("k__")).distinct().orderBy(F.xxhash64("k__")).limit(positives).withColumn("good__", F.lit(True))
    rows = docs.select(F.col(id_col).alias("k__"), F.col(text_col).alias("t__"))
    # a bounded share of the documents at random, by hash: about 1.2 times the bound, then cut to it
    share = min(1.0, 1.2 * unlabelled / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64("k__", F.lit(1)), F.lit(1 << 40)) < int(share * (1 << 40))
    part = rows.withColumn("drawn__", drawn).join(F.broadcast(chosen), "k__", "left").where("drawn__ or good__")
    got = _featured(part, "t__", ["k__", "drawn__", "good__"]).withColumn("order__", F.xxhash64("k__", F.lit(2)))
    got = sorted(got.limit(2 * (positives + 2 * unlabelled)).collect(), key=lambda r: (r.order__, r.x))
    pos, unl = [r for r in got if r.good__][:positives], [r for r in got if r.drawn__][:unlabelled]
    model = Model(N_FEATURES)
    if not pos or not unl:
        model.p = [np.zeros_like(a) for a in model.p]
        return model
    p, u = (np.array([r.x for r in rows]) for rows in (pos, unl))
    return model.fit(p, u, estimated_prior(p, u))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, held_out, score in [0, 1], predicted. Null texts count as empty and score too."""
    import json

    state = json.dumps([a.tolist() for a in (model.mean, model.scale, *model.p)])

    def run(batches):
        held = Model(N_FEATURES)
        held.mean, held.scale, *held.p = (np.array(a) for a in json.loads(state))
        for batch in batches:
            buf, off = T.string_buffers(batch.column(1))
            out = np.zeros(batch.num_rows)
            for a, b in T.slices(off):
                out[a:b] = held.score(features(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["id", "score", "predicted"])
        T.settle()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "id bigint, score double, predicted int")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score under the threshold; all columns stay as they are."""
    import json

    state = json.dumps([a.tolist() for a in (model.mean, model.scale, *model.p)])
    place = docs.columns.index(text_col)

    def run(batches):
        held = Model(N_FEATURES)
        held.mean, held.scale, *held.p = (np.array(a) for a in json.loads(state))
        for batch in batches:
            buf, off = T.string_buffers(batch.column(place))
            keep = np.zeros(batch.num_rows, bool)
            for a, b in T.slices(off):
                keep[a:b] = held.score(features(buf[off[a] : off[b]], off[a : b + 1] - off[a])) >= threshold
            yield batch.filter(pa.array(keep))
        T.settle()

    return docs.mapInArrow(run, docs.schema)
