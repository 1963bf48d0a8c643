import hashlib
import re
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tickloom.llm import pii
from tickloom.llm.textops import Words

from .fixtures import ROWS, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(kind, text):
    for m in re.finditer(PATTERNS[kind], text):
        digits = re.sub("[^0-9]", "", m[0])
        if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
            continue
        if kind == "card":
            total = sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(digits[::-1]))
            if not 14 <= len(digits) <= 19 or total % 10:
                continue
        if kind == "phone" and not 10 <= len(digits) <= 15:
            continue
        yield m.span()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "255", "256", "4111111111111111", "4111-1111 1111 1111", "+1", "(", ") ", " ", "-", "9", "%", "é", "00", "5551234", "\n"]), max_size=25).map("".join))
def test_base_matches_are_the_patterns(text):
    for kind, find in pii.FINDERS.items():
        assert find(text) == list(brute(kind, text)), (kind, text)


def test_base_is_linear_in_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "1 " * 150_000, "a." * 150_000 + "@"):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def brute_path(field, x):
    best = None
    for path in product(range(len(pii.LABELS)), repeat=len(x)):
        steps = [0, *path, 0]
        score = sum(x[i][p] for i, p in enumerate(path)) + sum(field.step[a, b] for a, b in zip(steps, steps[1:], strict=False))
        if best is None or score > best[0] + 1e-5:
            best = score, path
    return best[0]


def test_viterbi_is_the_best_path(field):
    rng = np.random.default_rng(0)
    for length in (1, 2, 4):
        x = rng.normal(0, 3, (5, length, len(pii.LABELS))).astype(np.float32)
        for seq, path in zip(x, field.viterbi(x), strict=True):
            steps = [0, *path.tolist(), 0]
            score = sum(seq[i][p] for i, p in enumerate(path)) + sum(field.step[a, b] for a, b in zip(steps, steps[1:], strict=False))
            assert abs(score - brute_path(field, seq)) < 1e-3


def test_cutting_at_plain_words_keeps_the_best_path(field):
    assert field.gap is not None
    rng = np.random.default_rng(1)
    words = ["john", "at", "mail", "dot", "com", "555-1234", "+1", "(555)", "10.1.2.3", "token", "=", "a@b.com", "4111", "deadbeef0123456789ab"] + ["plain"] * 20
    for _ in range(30):
        text = " ".join(rng.choice(words, 80)).encode()
        buf = np.frombuffer(text, np.uint8)
        w = Words(buf, np.array([0, len(buf)]))
        shape = pii.shapes(buf, w)
        whole = field.viterbi(field.scores(shape, w.row, np.arange(len(shape)))[None])[0]
        assert field.decode(shape, w.row).tolist() == whole.tolist()


def test_field_on_a_table_it_has_not_seen(field):
    right = total = found = spans = 0
    for text, labels in pii.labelled_table(seed=77, copies=30):
        buf = np.frombuffer(text.encode(), np.uint8)
        w = Words(buf, np.array([0, len(buf)]))
        got = [pii.LABELS[k] for k in field.decode(pii.shapes(buf, w), w.row)]
        want = labels.split(" ")
        right += sum(a == b for a, b in zip(got, want, strict=True))
        total += len(want)
        found += sum(a == b for a, b in zip(got, want, strict=True) if b != "none")
        spans += sum(b != "none" for b in want)
    assert right / total > 0.97
    assert found / spans > 0.93


#: Written by hand, not by the generator of the training table: texts and the spans that are to be added.
BY_HAND = [
    ("Please write to maria at posteo dot net before Friday.", ["email"]),
    ("My address is john.smith [at] example [dot] org, thanks", ["email"]),
    ("reach me: lena (at) firma.de", ["email"]),
    ("You can email peter at webmail dot com about the flat.", ["email"]),
    ("contact: anna at uni-koeln dot de", ["email"]),
    ("Call (415) 555-2671 after six.", ["phone"]),
    ("phone 212-555-0187 or ask at the desk", ["phone"]),
    ("tel 030-555-1234 is the office", ["phone"]),
    ("Our fax (044) 555-9081 works again.", ["phone"]),
    ("call 555-867-5309 now", ["phone"]),
    ('config: token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', ["secret"]),
    ("export API_KEY = 5e884898da28047151d0e56f8dc6292773603d0d", ["secret"]),
    ("password : 5f4dcc3b5aa765d61d8327deb882cf99", ["secret"]),
    ("the secret = da39a3ee5e6b4b0d3255bfef95601890afd80709 leaked", ["secret"]),
    ('set key = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4" in the file', ["secret"]),
]
CLEAN = [
    "ç ç ç ç is what the machine printed", "üä, üä, sang the child.", "verstpf.### und dann nichts", "a a a a a", "He looked at the dot on the map.",
    "We met at noon. At home nobody was awake.", "In 2019 there were 1200 visitors, in 2020 only 300.", "Chapter 3.2.1 explains it (see page 44).",
    "e.g. this one, z.B. jener, i.e. neither", "The key to success is patience.", "A token of thanks, nothing more", "version 2.0 of the licence", "o o o # # # * * *",
    "éé à ù naïve café 日本語 テスト", "| a | b | c |", "Price: 12,50 EUR (was 15.00)", "password rules are listed below", "call me tomorrow, phone or not", "19:30 - 20:45, room 101",
    "ISBN 978-3-16-148410-0", "He scored 21-19, 21-17 and 15-21.", "write at least ten pages", "look at com dot", "... ?! --- ###",
]


def test_added_spans_on_texts_written_by_hand(spark):
    rows = list(enumerate([t for t, _ in BY_HAND] + CLEAN))
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in pii.find(frame(spark, rows)).collect()}
    hits = sum(got[k] == kinds for k, (_, kinds) in enumerate(BY_HAND))
    false = {CLEAN[k - len(BY_HAND)]: got[k] for k in got if k >= len(BY_HAND) and got[k]}
    assert hits >= 0.9 * len(BY_HAND), [(t, got[k]) for k, (t, kinds) in enumerate(BY_HAND) if got[k] != kinds]
    assert len(false) <= 1 and not any("email" in x for x in false.values()), false


def test_added_spans_never_meet_a_base_span(spark):
    """A long base span before many short ones, and the whole output against a plain join of both finders."""
    rows = [(1, "+1 " + "5 5 5 5 5 5 5 5 5 " + "1.1.1.1 " * 40), (2, "call (555) 123-4567 a@b.co " * 30), (3, 'token = "0123456789abcdef0123456789abcdef" ' * 3 + "10.0.0.1"), (4, "+49 (030) 1234-5678 1.2.3.4 write x at y dot com")]
    field = pii.train(pii.labelled_table())
    for r in pii.find(frame(spark, rows)).collect():
        text = dict(rows)[r.doc_id]
        base = [(k, a, b) for k in PATTERNS for a, b in brute(k, text)]
        buf = np.frombuffer(text.encode(), np.uint8)
        more = pii.added_spans(buf, np.array([0, len(buf)]), field).get(0, [])
        free = [m for m in more if not any(b[1] < m[2] and m[1] < b[2] for b in base)]
        assert r.n_added == len(free)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base + free, key=lambda s: (s[1], pii.KINDS.index(s[0]))))


def test_find(spark):
    rows = ROWS + [(50, 'ça token = "0123456789abcdef0123456789abcdef" è'), (51, "write john at mail dot com now"), (52, "call (555) 123-4567 soon")]
    got = [r for r in pii.find(frame(spark, rows)).collect()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, _ in rows)
    texts = {d: t or "" for d, t in rows}
    for r in got:
        base = sorted(((k, a, b) for k in PATTERNS for a, b in brute(k, texts[r.doc_id])), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(said.split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added
    by = {r.doc_id: r.spans for r in got}
    assert by[50] == "secret:12:44"
    assert by[51] == "email:6:26"
    assert by[52] == "phone:5:19"
    assert by[12] == "email:11:31,ip:35:45,phone:47:64,card:71:90"
    assert pii.find(frame(spark, [])).count() == 0
