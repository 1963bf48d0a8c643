import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tickloom.llm import jaccard, signature_tree
from tickloom.llm.components import components
from tickloom.llm.signature_tree import Tree, bitmap

from .fixtures import ROWS, frame
from .test_decontam import words


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, percent=80):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    tried = set()
    for members in inverted.values():
        for k, i in enumerate(members):
            for j in members[k + 1 :]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((repr(d), len(sets[i]), repr(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def corpus(seed, families=12, size=14):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    rows, i = [], 0
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 20, 60, 150, 400]))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(base))
            base[at:at] = common
        for _ in range(rng.randint(1, size)):
            now = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(base) // 40, len(base) // 12])):
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                now = now[: max(1, len(now) - rng.randint(0, len(now) // 5))]
            if rng.random() < 0.3:
                base = now  # chains
            i += 1
            rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 else x for x in now)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "cell_rows", "tokens", "compared", "broadcast"), [(1, 256, 2_000_000, 2000, 500_000), (2, 2, 2_000_000, 3, 500_000), (3, 3, 100, 4, 0)])
def test_components_match_brute_force(spark, monkeypatch, seed, cell_rows, tokens, compared, broadcast):
    monkeypatch.setattr(jaccard, "FEW", 2 - seed // 2)
    monkeypatch.setattr(jaccard, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(jaccard, "CELL_TOKENS", tokens)
    monkeypatch.setattr(jaccard, "COMPARED", compared)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    rows = ROWS + corpus(seed)
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("cell_rows", [256, 3])
def test_second_round_alone_finds_all(spark, monkeypatch, cell_rows):
    """Without help from the first round (no shingles, no links) the second still finds every link."""
    monkeypatch.setattr(jaccard, "FIRST", 0)
    monkeypatch.setattr(jaccard, "FEW", 2 if cell_rows > 3 else 10**6)
    monkeypatch.setattr(jaccard, "CELL_ROWS", cell_rows)
    rows = corpus(7)
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_common_shingles_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON_IN_PART", 1)
    monkeypatch.setattr(jaccard, "LEAST_COMMON", 3)
    rows = corpus(9)
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (7, 7)] + [(100 + i, 101 + i) for i in range(40)] + [(50, 1)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 50: 1, 10: 10, 11: 10, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def family(rng, n, universe=4000):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            s = set(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(s) // 6))):
                s.discard(next(iter(s)))
                s.add(rng.randrange(universe))
        else:
            s = {rng.randrange(universe) for _ in range(rng.choice([1, 2, 5, 30, 200]))}
        out.append(s or {1})
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90))
def test_trees_miss_no_pair(seed, n):
    rng = random.Random(seed)
    sets = family(rng, n)
    arrays = [np.sort(np.array([hash((x, 5)) & (2**64 - 1) for x in s], np.uint64)) for s in sets]
    sizes, maps, label = np.array([len(s) for s in sets]), [bitmap(a) for a in arrays], np.array([rng.randrange(6) if rng.random() < 0.3 else 100 + i for i in range(n)])
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    want = {(i, j) for i in range(n) for j in range(i) if linked(i, j) and label[i] != label[j]}
    got = {(max(p), min(p)) for p in Tree(sizes, maps, label).pairs().tolist()}
    assert want <= got
    half = n // 2
    cross = {(max(p), min(p)) for p in Tree(sizes, maps, label, cut=half).pairs().tolist()}
    assert {(i, j) for i, j in want if (i >= half) != (j >= half)} <= cross
    assert all((i >= half) != (j >= half) for i, j in cross)
    caps = np.array([max([len(sets[i] & sets[j]) for j in range(n) if linked(i, j) and j != i], default=0) for i in range(n)])
    capped = Tree(sizes, maps, label, caps=caps)
    assert want <= {(max(p), min(p)) for p in capped.pairs().tolist()}
    # links join exactly what all links together join
    for cut in (None, half):
        of = label.tolist()
        for i, j in Tree(sizes, maps, label, cut=cut).links(linked):
            assert linked(i, j) and of[i] != of[j]
            of = [of[i] if x == of[j] else x for x in of]
        assert all(of[i] == of[j] for i, j in want if cut is None or (i >= cut) != (j >= cut))


def test_traversal_prunes():
    rng = random.Random(1)
    sets = [np.sort(np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)) for _ in range(800)]
    tree = Tree(np.full(800, 300), [bitmap(s) for s in sets], np.arange(800))
    assert not len(tree.pairs())
    small = [np.sort(np.array([rng.getrandbits(64) for _ in range(10)], np.uint64)) for _ in range(400)]
    both = Tree(np.array([10] * 400 + [300] * 400), [bitmap(s) for s in small + sets[:400]], np.arange(800))
    both.pairs()
    assert both.pairs_seen < tree.pairs_seen * 0.8


def test_widths_fold():
    tokens = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide = bitmap(tokens)
    assert len(wide) * 64 == signature_tree.width(1000)
    assert np.array_equal(signature_tree.fold(wide, 8), bitmap_at(tokens, 512))


def bitmap_at(tokens, bits):
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(int)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def test_second_round_sends_whole_sets_of_likely_pairs_only(spark, monkeypatch):
    """Sets that share a little less than asked go no further than their digests, and tables read for the last time go."""
    rng = random.Random(3)
    rows = []
    for f in range(30):
        base = [f"f{f}w{k}" for k in range(300)]
        for _ in range(2):
            now = list(base)
            at = rng.randrange(60, 100)
            now[at : at + 40] = [f"x{rng.getrandbits(40)}" for _ in range(40)]  # 252 of 340 shingles in common, or a few more
            rows.append((len(rows), " ".join(now)))
        if f % 10 == 0:
            rows.append((len(rows), " ".join([*base[:-1], "other"])))
            rows.append((len(rows), " ".join(base)))
    sent, tables, linked, staged = [], [], jaccard._linked, jaccard.staged

    def counted(cells, *more):
        sent.append(cells.count())
        return linked(cells, *more)

    def noted(df, name):
        tables.append((name, out := staged(df, name)))
        return out

    monkeypatch.setattr(jaccard, "_linked", counted)
    monkeypatch.setattr(jaccard, "staged", noted)
    monkeypatch.setattr(jaccard, "FIRST", 0)
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == brute(rows)
    sets = [shingle_set(t) for _, t in rows]
    near = sum(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert sent[0] == 0
    assert 0 < sent[1] <= 2 * near
    for name, table in tables:
        if name in ("wide", "token_rows", "placed"):
            path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
            assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path), name


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(1, 1), (5, 30), (300, 310), (40, 300), (5000, 5200)]), st.integers(0, 100))
def test_digests_never_show_less_than_sets_share(seed, sizes, percent):
    rng = random.Random(seed)
    few = [rng.getrandbits(64) for _ in range(sizes[1] * 2)]
    few += [x ^ rng.getrandbits(40) << 24 for x in few[: len(few) // 3]]  # alike in their lowest bits
    a, b = (np.sort(np.array(sorted({*few[: n * percent // 100], *rng.sample(few, n)})[:n], np.uint64)) for n in sizes)
    shared = jaccard.in_common(a, b)
    assert shared == len(set(a.tolist()) & set(b.tolist()))
    for wide in (1, 100, 10**6):
        x, y = jaccard.digest(a, wide), jaccard.digest(b, wide)
        assert (len(x), len(y)) == (len(a), len(b))
        assert np.array_equal(bitmap(x.astype(np.uint64)), bitmap(a))
        if x.dtype != y.dtype:
            x, y = (np.sort(z.astype(np.uint16)) for z in (x, y))
        assert len(np.unique(jaccard.ranked(x))) == len(x)
        got = jaccard.in_common(jaccard.ranked(x), jaccard.ranked(y))
        assert shared <= got <= min(len(a), len(b))


def test_digests_of_all_kinds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FIRST", 0)
    monkeypatch.setattr(jaccard, "WIDE", 60)
    monkeypatch.setattr(jaccard, "FEW", 0)
    rows = corpus(11)
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert got == brute(rows)
