import random
import zlib

import numpy as np
import pyarrow as pa
from tickloom.llm import quality, textops, toxicity

from .fixtures import ROWS, frame


def buffers(texts):
    return textops.string_buffers(pa.array(texts, pa.string()))


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def corpus(n=400):
    rng = random.Random(3)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        good, toxic = int(i % 5 != 0), int(i % 7 == 0)
        if toxic:
            for _ in range(3):
                w = rng.choice(["idiot", "moron", "stupid", "trash"])
                body.insert(rng.randrange(len(body)), rng.choice([w, w, ".".join(w)]))
        text = " ".join(body).capitalize() + "."
        if not good:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, good, toxic))
    return rows, labels


def test_features_do_not_depend_on_neighbours():
    texts = [t for _, t in ROWS]
    all_at_once = quality.features(*buffers(texts))
    assert np.isfinite(all_at_once).all()
    for k, t in enumerate(texts):
        assert np.allclose(all_at_once[k], quality.features(*buffers([t]))[0])


def test_quality_held_out(spark):
    rows, labels = corpus()
    docs = frame(spark, rows + [(1000 + i, t) for i, (_, t) in enumerate(ROWS)])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, table)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) + len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].score, g) for i, g, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    s, y = np.array(held).T
    assert auc(s, y) > 0.97
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_quality_learns_no_held_out_or_negative_label(spark):
    rows, labels = corpus(120)
    docs = frame(spark, rows)
    schema = "doc_id bigint, quality int, toxic int"
    flip = [(i, 1 - g if zlib.crc32(str(i).encode()) % 5 == 0 else g, t) for i, g, t in labels]
    good = [x for x in labels if x[1] == 1]  # poor texts' labels aren't needed at all
    a, *others = (quality.train(docs, spark.createDataFrame(x, schema)) for x in (labels, flip, good))
    assert all(np.array_equal(p, q) for b in others for p, q in zip(a.p, b.p, strict=True))


def test_prior_is_found_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    for prior in (0.2, 0.5, 0.8):
        n = 6000
        good = rng.random(n) < prior
        unl = rng.normal(0, 1, (n, 4)) + np.where(good[:, None], 1.5, -1.5)
        pos = rng.normal(0, 1, (3000, 4)) + 1.5
        assert abs(quality.estimated_prior(pos, unl) - prior) < 0.06


def test_network_and_risk_by_definition():
    """Scores are those of the plain network, and fitting lowers the non-negative risk as it is written."""
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (60, 3))
    for prior in (0.3, 0.9):
        model = quality.Model(3, hidden=4, seed=int(prior * 10))
        z = lambda x: np.tanh(x @ model.p[0] + model.p[1]) @ model.p[2] + model.p[3][0]  # noqa: E731, B023
        assert np.allclose(model._forward(pos)[1], z(pos))
        assert np.allclose(model.score(pos), 1 / (1 + np.exp(-z(pos))))
        fitted = quality.Model(3, hidden=4, seed=2).fit(pos, unl, prior, steps=400)
        loss = lambda v: np.log1p(np.exp(-v))
        risk = lambda m: prior * loss(m._forward(m._scaled(pos))[1]).mean() + max(0, loss(-m._forward(m._scaled(unl))[1]).mean() - prior * loss(-m._forward(m._scaled(pos))[1]).mean())  # noqa: E731, B023
        start = quality.Model(3, hidden=4, seed=2)
        start.mean, start.scale = fitted.mean, fitted.scale
        assert risk(fitted) < risk(start)


def test_classifiers_on_empty_tables(spark):
    docs, none = frame(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.train(docs, none)
        assert module.score(docs, model).count() == 0
        got = module.score(frame(spark), model).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    docs = frame(spark, rows + [(1000 + i, t) for i, (_, t) in enumerate(ROWS)])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + len(ROWS)
    s, y = np.array([(got[i].score, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]).T
    assert auc(s, y) > 0.95
    assert ((s >= 0.5) == y).mean() > 0.95


def test_folded_table_is_the_kernel_sum():
    rng = np.random.default_rng(0)
    marks = [rng.integers(1, 27, n).astype(np.uint8) for n in (5, 7, 9)]
    rows = [rng.integers(1, 27, n).astype(np.uint8) for n in (3, 4, 6, 8, 12, 20)] + [marks[0]]
    beta = rng.normal(size=3)
    table = np.zeros(toxicity.C**3)
    for b, m in zip(beta, marks, strict=True):
        for key, x in toxicity.feature(m).items():
            table[key] += b * x
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = toxicity.decisions(np.concatenate(rows), first, table.astype(np.float32))
    assert np.allclose(got, toxicity.kernel(rows, marks) @ beta, atol=1e-5)


def test_kernel_by_definition():
    from itertools import combinations

    def brute(a, b):
        def subsequences(u):
            out = {}
            for t in combinations(range(len(u)), 3):
                if t[2] - t[0] < toxicity.SPAN:
                    key = tuple(int(u[i]) for i in t)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (t[2] - t[0] - 2)
            return out

        fa, fb = subsequences(a), subsequences(b)
        own = lambda f: sum(x * x for x in f.values()) ** 0.5
        return sum(x * fb.get(k, 0) for k, x in fa.items()) / own(fa) / own(fb)

    rng = np.random.default_rng(1)
    us = [rng.integers(1, 5, n).astype(np.uint8) for n in (3, 5, 8, 11)]
    assert np.allclose(toxicity.kernel(us, us), [[brute(a, b) for b in us] for a in us])


def test_scores_by_definition(monkeypatch):
    """The whole score, a unit at a time and by the kernel itself, whatever is held from earlier texts."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    marks = [toxicity.units(*buffers([letters(n)]))[0] for n in (4, 6, 9)]
    beta, bias, logit = np.array([2.5, -1.0, 1.5]), -0.4, np.array([0.8, 0.5, 0.2, -0.1])
    table = np.zeros(toxicity.C**3)
    for b, m in zip(beta, marks, strict=True):
        for key, x in toxicity.feature(m).items():
            table[key] += b * x
    texts = [" ".join(letters(rng.randint(1, 12)) for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["", None, letters(3000), "a b c d e", letters(7) + " "] * 2
    want = []
    for t in texts:
        chars, first, _ = toxicity.units(*buffers([t]))
        each = {chars[a:b].tobytes(): chars[a:b] for a, b in zip(first[:-1], first[1:], strict=True)}
        d = toxicity.kernel(list(each.values()), marks) @ beta + bias if each else np.zeros(0)
        best = sorted(np.clip(d[d > -1.5], -3, 3), reverse=True)[: toxicity.TOP]
        z = np.dot(best + [-3.0] * (toxicity.TOP - len(best)), logit[:-1]) + logit[-1]
        want.append(1 / (1 + np.exp(-z)))
    for held in (400_000, 5):
        monkeypatch.setattr(toxicity.Model, "HELD", held)
        model = toxicity.Model(table, bias, logit)
        assert np.allclose(model.score(*buffers(texts)), want, atol=1e-3)
        assert np.allclose([model.score(*buffers([t]))[0] for t in texts], want, atol=1e-3)


def test_units():
    chars, first, row = toxicity.units(*buffers(["i d i o t", None, "I.d-i0T x", "", "a b cd"]))
    decoded = ["".join(chr(96 + c) if c < 27 else "^" if c == toxicity.START else "$" for c in chars[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert decoded == ["^idiot$", "^idiot$", "^x$", "^ab$", "^cd$"]
    assert row.tolist() == [0, 2, 2, 4, 4]
