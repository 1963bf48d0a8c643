import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from tickloom.llm import quality
from tickloom.llm.common import documents

from .test_decontam import brute as edits
from .test_decontam import words
from .test_jaccard import brute as components
from .test_line_dedup import brute as dedup_lines
from .test_tokens import FILES, check_pieces, plain

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    top = str(tmp_path_factory.mktemp("sf"))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, prose(rng.randint(15, 40))) for i in range(6)]
    passage = prose(70)
    rows, labels = [], []
    for i in range(160):
        text = "\n".join(prose(rng.randint(10, 60)) for _ in range(rng.randint(1, 5)))
        good = 1
        if i % 8 == 1:
            text, good = text.upper().replace(" ", "!! "), 0
        elif i % 8 == 2:
            text = text + "\n" + passage
        elif i % 8 == 3 and rows:
            text = rows[-3][1]
            if rng.random() < 0.7:
                text += " more"
        elif i % 8 == 4:
            w = items[i % 6][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            text += " " + " ".join(w)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, good, 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, passage, "en", "s", 1), (None, prose(30), "en", "s", 1)]
    for name, table, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", items, "item_id bigint, text string")):
        spark.createDataFrame(table, schema).coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return top, items


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_match_plain_versions(spark, folder):
    top, items = folder
    docs = documents(spark, top)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "jaccard", "decontam", "packing"]

    kept = stages["quality"](spark, docs, top)
    assert kept.columns == docs.columns
    score = {r.doc_id: r.predicted for r in quality.score(docs, quality.train(docs, documents(spark, top, "labels"))).collect()}
    assert Counter(pairs(kept)) == Counter(p for p in pairs(docs) if score[p[0]])
    assert all(score[i] == (i % 8 != 1) for i in range(160))

    lines = stages["line_dedup"](spark, kept, top)
    assert lines.columns == docs.columns
    want = Counter()
    for (d, t, n), c in dedup_lines(pairs(kept)).items():
        if not n or words(t):
            want[d, t] += c
    assert Counter(pairs(lines)) == want
    assert want != Counter(pairs(kept))
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.doc_id is not None and r.doc_id < 160)

    one = stages["jaccard"](spark, lines, top)
    assert one.columns == docs.columns
    groups = components(pairs(lines))
    stays = {d for d, n, c in groups if d == c or not n}
    assert Counter(pairs(one)) == Counter(p for p in pairs(lines) if repr(p[0]) in stays)
    assert len(stays) < len(groups)

    clean = stages["decontam"](spark, one, top)
    assert clean.columns == docs.columns
    leak = lambda t: any(edits(words(x), words(t)) <= int(0.2 * len(words(x))) for _, x in items)
    assert Counter(pairs(clean)) == Counter(p for p in pairs(one) if not leak(p[1]))
    assert clean.count() < one.count()

    packed = stages["packing"](spark, clean, top).collect()
    check_pieces(packed, {d: plain("word", t) for d, t in pairs(clean)}, 4096, 16)

    whole = corpus_pipeline.run(spark, top).collect()
    total = lambda rows: Counter(sum(([r.doc_id] * r.length for r in rows), []))
    assert total(whole) == total(packed)


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in names if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert defaultdict(int, FILES)
