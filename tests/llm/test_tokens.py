import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tickloom.llm.encoding import Encoder
from tickloom.llm.packing import Packer, merge, pack
from tickloom.llm.token_file import Reader, Writer, bits_for, round_trip
from tickloom.llm.token_file import pack as pack_bits
from tickloom.llm.token_file import unpack
from tokenizers import Tokenizer

from .fixtures import ROWS, frame

FILES = {"byte": P.path("byte_bpe_50k.json"), "word": P.path("word_bpe_49k.json")}
ENCODERS = {m: Encoder(p, m) for m, p in FILES.items()}


UNTOUCHED = {m: Tokenizer.from_file(p) for m, p in FILES.items()}


def plain(mode, text):
    return UNTOUCHED[mode].encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("mode", ["byte", "word"])
def test_encoder_equals_tokenizer_on_odd_texts(mode):
    texts = [t for _, t in ROWS]
    ids, off = ENCODERS[mode].encode(texts, 2)
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == plain(mode, t), t


@pytest.mark.parametrize("mode", ["byte", "word"])
@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aB'sΣ9 .,|\n\t\x1c\x85\xa0éｅé🙂-　 ", "<", ">", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof"]), max_size=30).map("".join), max_size=4))
def test_encoder_equals_tokenizer(mode, texts):
    ids, off = ENCODERS[mode].encode(texts)
    for k, x in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == plain(mode, x)[:-1]


@pytest.mark.parametrize("mode", ["byte", "word"])
def test_added_tokens_have_their_ids(mode):
    ids, _ = ENCODERS[mode].encode(["x<|endoftext|>y"])
    assert len(ids) == 3 and ids[1] == {"byte": 50256, "word": 49407}[mode]


def test_cache_starts_afresh():
    enc = Encoder(FILES["byte"], "byte", most_pieces=3, most_words=2)
    for x in ("a b, c d e", "b c, c. e", "f g h i", "a b, h i"):
        ids, _ = enc.encode([x])
        assert ids.tolist() == plain("byte", x)[:-1]
        enc.trim(2, 1)


@settings(deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_bits_round_trip(bits, values):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    data = pack_bits(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert unpack(data, bits, len(ids)).tolist() == ids.tolist()


def test_bits_for():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@settings(deadline=None)
@given(st.integers(1, 7), st.lists(st.lists(st.integers(0, 9999), max_size=20), max_size=12), st.integers(0, 100), st.integers(0, 100))
def test_file_random_access(block, docs, a, b):
    f = io.BytesIO()
    w = Writer(f, 14, block)
    for k, d in enumerate(docs):
        w.add(k if k % 4 else None, np.array(d, np.uint32))
    w.finish()
    r = Reader(f, len(f.getvalue()))
    flat = [x for d in docs for x in d]
    a, b = min(a, len(flat)), min(b, len(flat))
    assert r.range(a, b).tolist() == flat[a:b]
    got = list(r.documents(blocks_at_once=2))
    assert [(d, x.tolist()) for d, _, x in got] == [(k if k % 4 else None, d) for k, d in enumerate(docs)]


def test_round_trip_through_files(spark):
    got = round_trip(frame(spark), FILES["byte"], ids_a_block=1000).orderBy("start").collect()
    ids = {i: np.array(plain("byte", t), "<u4") for i, (_, t) in enumerate(ROWS)}
    want = Counter((d, len(ids[i]), zlib.crc32(ids[i].tobytes())) for i, (d, _) in enumerate(ROWS))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert round_trip(frame(spark, []), FILES["byte"]).count() == 0


def check_pieces(rows, want, window, least_cut):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for d, of in pieces.items():
        at = 0
        for r in sorted(of, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[d])
            assert r.ids_crc32 == zlib.crc32(np.array(want[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[d])
    padding = 0
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= window
        if at & (at - 1):
            assert window - at < least_cut
            padding += window - at
    return padding


def test_pack(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)] + [(100 + i, " ".join(["word"] * (i * 37 % 900))) for i in range(200)]
    got = pack(frame(spark, rows), FILES["word"], window=1024, open_windows=4).collect()
    check_pieces(got, {d: plain("word", t) for d, t in rows}, 1024, 16)
    assert pack(frame(spark, []), FILES["word"]).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 300), max_size=60), st.integers(1, 5), st.sampled_from([1, 4, 16]))
def test_packer_bounded_and_whole(lengths, most, least):
    from types import SimpleNamespace

    from tickloom.llm.packing import COLUMNS, rows_of

    p, out, number = Packer(64, most, least), [], 0
    want = {d: np.arange(n, dtype=np.uint32) + d for d, n in enumerate(lengths)}
    for d, ids in want.items():
        for w in p.add(d, ids):
            out += rows_of(w, number)
            number += 1
        assert len(p.open) <= most
    for w in merge([x for w in p.open for x in w], 64):
        out += rows_of(w, number)
        number += 1
    check_pieces([SimpleNamespace(**dict(zip(COLUMNS, r, strict=True))) for r in out], {d: x.tolist() for d, x in want.items()}, 64, least)
