import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tickloom.llm import jaccard
from tickloom.llm.line_dedup import line_dedup, repeated_runs, suffix_array

from .fixtures import ROWS, frame
from .test_decontam import words


def sequences(rows):
    """The lines of each document, rows equal in id and text once, in order."""
    docs = {}
    for i, (d, t) in enumerate(rows):
        docs.setdefault((d is None, d or 0, t), []).append(i)
    keys = sorted(docs, key=lambda k: (k[0], k[1], docs[k][0]))
    return docs, [(key, [x for x in (tuple(words(line)) for line in (key[2] or "").split("\n")) if x]) for key in keys]


def applied(docs, seqs, gone):
    out = Counter()
    for s, (key, _) in enumerate(seqs):
        left, k = [], 0
        for line in (key[2] or "").split("\n"):
            if words(line):
                k += 1
                if k - 1 in gone.get(s, ()):
                    continue
            left.append(line)
        text = None if key[2] is None else "\n".join(left)
        out[(None if key[0] else key[1], text, len(gone.get(s, ())))] += len(docs[key])
    return out


def brute(rows, least=1):
    """Later copies of every line, whatever run they are in."""
    docs, seqs = sequences(rows)
    seen, gone = set(), {}
    for s, (_, lines) in enumerate(seqs):
        for a, line in enumerate(lines):
            if line in seen:
                gone.setdefault(s, set()).add(a)
            seen.add(line)
    return applied(docs, seqs, gone)


def brute_runs(seqs):
    """Runs of a table of segments by their definition: (segment, line) -> (source segment, source line, lines)."""
    longest = max((len(x) for x in seqs), default=0)
    first, best = {}, {}
    level = 1
    while level <= longest:
        for s, lines in enumerate(seqs):
            for a in range(len(lines) - level + 1):
                at = first.setdefault(tuple(lines[a : a + level]), (s, a))
                if at != (s, a):
                    best[s, a] = at
        level *= 2
    out = {}
    for (s, a), (fs, fa) in best.items():
        if a and best.get((s, a - 1)) == (fs, fa - 1):
            continue
        n = 0
        while a + n < len(seqs[s]) and fa + n < len(seqs[fs]) and seqs[s][a + n] == seqs[fs][fa + n]:
            n += 1
        out[s, a] = fs, fa, n
    return out


def corpus(seed):
    rng = random.Random(seed)
    stock = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    runs = [[rng.choice(stock) for _ in range(rng.randint(1, 12))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.randrange(4)
            if kind == 0:
                lines += rng.choice(runs)
            elif kind == 1:
                run = rng.choice(runs)
                lines += run[rng.randrange(len(run)) :] + [""] + run[: rng.randint(1, len(run))]
            elif kind == 2:
                lines += [f"only {i} {rng.random()}"] * rng.randint(1, 3)
            else:
                lines += [rng.choice(stock).upper()] * rng.randint(1, 9)
        rows.append((rng.choice([i, i, 1000 - i]), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_matches_brute_force(spark, seed):
    rows = ROWS[:5] + ROWS[7:] + corpus(seed) + corpus(seed)[:3]
    got = Counter((r.doc_id, r.text, r.n_deleted) for r in line_dedup(frame(spark, rows)).collect())
    assert got == brute(rows)
    assert sum(n for (_, _, d), n in got.items() if d) > 20


def segments(seed):
    """Few kinds of lines, so that runs overlap, repeat within a segment and nest."""
    rng = random.Random(seed)
    out = [[rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(10)] + [[7] * 21, [7] * 9 + [8]]
    for _ in range(10):
        x = rng.choice(out)
        out.append(x[rng.randrange(len(x)) :] + [rng.randrange(4)] + x[: rng.randint(1, len(x))])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_are_common_prefixes_of_suffixes(spark, seed):
    seqs = segments(seed)
    table = spark.createDataFrame([(s, i, h) for s, x in enumerate(seqs) for i, h in enumerate(x)], "seg bigint, i bigint, h bigint")
    ranks = suffix_array(table)
    for level, now in ranks.items():
        prefix = lambda r, n=level: tuple(seqs[r.seg][r.i : r.i + n])
        rows = now.collect()
        found = {prefix(r) for r in rows}
        every = Counter(tuple(x[i : i + level]) for x in seqs for i in range(len(x) - level + 1))
        assert found == {p for p, n in every.items() if n > 1} and len(rows) == sum(every[p] for p in found)
        by_rank = sorted({(r.r, prefix(r)) for r in rows})
        assert [p for _, p in by_rank] == sorted(found)  # ranks tell prefixes apart and are in their order
    assert {(r.seg, r.i): (r.from_seg, r.from_i, r.n) for r in repeated_runs(ranks).collect()} == brute_runs(seqs)


def test_least_words(spark):
    rows = [(1, "a b\nc d e\nf"), (2, "c d e\nf\nnew"), (3, "f\nnew 2\na b"), (4, "a b\nc d e\nf"), (5, "f")]
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup(frame(spark, rows), least_words=3).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("new", 2), 3: (rows[2][1], 0), 4: ("", 3), 5: ("f", 0)}


def test_names_that_clash(spark):
    rows = [(1, "a b\nc"), (2, "c\nd"), (None, "c"), (3, None)]
    extra = ["n_deleted", "map__", "gone", "id__", "maybe", "place", "bucket", "bitmap", "i", "h", "did", "Maybe_1"]
    docs = frame(spark, rows)
    for k, c in enumerate(extra):
        docs = docs.withColumn(c, F.lit(k))
    out = line_dedup(docs)
    assert out.columns == [c for c in docs.columns if c != "n_deleted"] + ["n_deleted"]
    got = {r.doc_id: (r.text, r.n_deleted, r.map__, r.gone, r.h) for r in out.collect()}
    assert got == {1: ("a b\nc", 0, 1, 2, 9), 2: ("d", 1, 1, 2, 9), None: ("", 1, 1, 2, 9), 3: (None, 0, 1, 2, 9)}
    assert jaccard.keep_one(docs).columns == docs.columns and jaccard.keep_one(docs).count() == 4


def test_extra_columns_long_texts_and_empty_tables(spark):
    long = "\n".join(f"line {i} of a long text with some words" for i in range(3000))
    rows = [(1, long), (2, long), (3, "intro\n" + long + "\nend"), (4, "w " * 80), (5, "x\n" + "w " * 80)]
    out = line_dedup(frame(spark, rows))
    assert out.columns == [*frame(spark, []).columns, "n_deleted"]
    assert {r.doc_id: (r.text, r.n_deleted) for r in out.collect()} == {1: (long, 0), 2: ("", 3000), 3: ("intro\nend", 3000), 4: ("w " * 80, 0), 5: ("x", 1)}
    assert line_dedup(frame(spark, [])).count() == 0
