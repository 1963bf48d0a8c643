import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tickloom.llm import decontam
from tickloom.llm.textops import Words, string_buffers

from .fixtures import LONG, ROWS, frame

WS = " \t\n\x0b\x0c\r"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WS:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(item, text):
    """Least distance of the item to any run of the text's words, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=5, max_size=24), st.lists(st.sampled_from("abcde"), max_size=60), st.sampled_from([0.1, 0.2, 0.35]))
def test_matches_are_all_within_the_edits(item, text, rate):
    items = decontam.Items([(1, " ".join(item))], rate)
    w = Words(*string_buffers(pa.array(["x y", " ".join(text), None], pa.string())))
    got = items.matches(w)
    least = brute(item, text)
    if least <= int(rate * len(item) + 1e-9):
        d, a, b = got[1, 0]
        assert d == least == distance(item, text[a:b])
    else:
        assert not got


def test_pieces_cover():
    for n in range(5, 80):
        for k in range(n // 2):
            spans = decontam.pieces_of(n, k)
            assert len(spans) == k + 1 and spans[0][0] == 0 and spans[-1][1] == n
            assert all(a < b for a, b in spans) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def planted(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90)))) for i in range(30)] + [(100, None), (101, ""), (102, "too short"), (103, "w1 w2"), (104, "W7")]
    docs = [(1000 + i, t) for i, (_, t) in enumerate(ROWS)]
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if i % 3 == 0:
            item = words(rng.choice(items[:30])[1])
            for _ in range(rng.randint(0, int(0.25 * len(item)))):
                p = rng.randrange(len(item))
                item[p : p + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((i, " \n".join(x.upper() if rng.random() < 0.3 else x for x in body)))
    docs += [(5000, LONG + " " + items[3][1]), (5001, items[4][1]), (5001, items[4][1])]
    return docs, items


def test_find_and_filter(spark):
    docs, items = planted()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for d, t in docs:
        tw = words(t)
        for i, it in items:
            iw = words(it)
            if iw and (least := brute(iw, tw) if len(tw) < 5000 else (0 if (d, i) == (5000, 3) or (len(iw) < 5 and f" {' '.join(iw)} " in f" {' '.join(tw)} ") else 99)) <= int(0.2 * len(iw)) * (len(iw) >= 5):
                want.append((d, i, least))
    for block_words in (decontam.BLOCK_WORDS, 300):
        got = decontam.find_leaks(frame(spark, docs), table, block_words=block_words).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
        texts = {d: words(t) for d, t in docs}
        of = dict(items)
        assert all(distance(words(of[r.item_id]), texts[r.doc_id][r.start_word : r.end_word]) == r.distance for r in got)
        kept = decontam.without_leaks(frame(spark, docs), table, block_words=block_words)
        assert kept.columns == frame(spark, []).columns
        leaks = {d for d, i, _ in want if len(words(of[i])) >= 5}
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d, _ in docs if d not in leaks)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.find_leaks(frame(spark), items).count() == 0
    assert decontam.find_leaks(frame(spark, []), spark.createDataFrame(planted()[1], "item_id bigint, text string")).count() == 0
    assert decontam.without_leaks(frame(spark), items).count() == len(ROWS)


def test_long_items_have_no_limit():
    item = [f"w{i}" for i in range(1000)]
    text = item[:300] + ["x"] * 50 + item[320:]
    items = decontam.Items([(1, " ".join(item))])
    w = Words(*string_buffers(pa.array(["a b " + " ".join(text) + " c"])))
    assert items.matches(w)[0, 0] == (50, 2, 2 + len(text))
    assert np.all(w.row == 0)


def test_shared_pieces_in_parts(monkeypatch):
    """Many items that begin alike, and a text that repeats that beginning: spans are merged and items come in parts."""
    items = [(i, f"alpha beta gamma d{i} e{i} f{i}") for i in range(300)] + [(300, "alpha beta gamma alpha beta gamma"), (301, "gamma")]
    text = "alpha beta gamma " * 500 + "x d7 e7 f7 alpha beta gamma d9 e9 f9"
    w = Words(*string_buffers(pa.array([text, "none of it", "alpha beta gamma d5 e5 z"])))
    found = []
    for places in (500_000, 40):
        monkeypatch.setattr(decontam, "PLACES", places)
        held = decontam.Items(items)
        assert all(len(part) for part in held.candidates(w))
        found.append(held.matches(w))
    assert found[0] == found[1]
    assert {k: v[0] for k, v in found[0].items()} == {(0, 9): 0, (0, 7): 1, (0, 300): 0, (0, 301): 0, (2, 5): 1, (2, 301): 0}
