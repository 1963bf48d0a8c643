import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from tickloom.llm import exact_dedup as exact_dedup_module
from tickloom.llm.exact_dedup import BLOCK, exact_dedup, hit_twice, suspected
from tickloom.llm.sharding import grown, place, shard_rows, uniform_tree

from .fixtures import ROWS, frame


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[hashlib.sha256(norm.encode()).hexdigest()].append((d, t or ""))
    out = Counter()
    for sha, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        kept = False
        for d, _ in members:
            stays = d == keep and not kept
            kept |= stays
            out[(d, keep, len(members), stays, sha)] += 1
    return out


AWKWARD = [(-(2**63), "least id"), (2**63 - 1, "least  id"), (-(2**63), "tie"), (-(2**63) + 1, "tie"), (None, "tie"), (None, "no id at all")]


@pytest.mark.parametrize("bits", [None, 1 << 22, BLOCK])
def test_exact_dedup_matches_brute_force(spark, bits):
    """Filters of many blocks, of two, and of one."""
    rows = ROWS + AWKWARD + [(100 + i, f"text {i % 40}" + " " * (i % 3)) for i in range(300)] + [(1000 + i, f"only {i}") for i in range(9000)]
    got = Counter(tuple(r) for r in exact_dedup(frame(spark, rows), bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute_exact(rows)


def test_filter_that_is_too_small_only_suspects_more(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup_module, "MOST_BITS", BLOCK)
    monkeypatch.setattr(exact_dedup_module, "LEAST_BITS", BLOCK)
    rows = ROWS + [(100 + i, f"text {i % 30_000}") for i in range(40_000)]
    got = Counter(tuple(r) for r in exact_dedup(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute_exact(rows)


def test_unique_rows_pass_straight_through(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    for bits, share in ((1 << 19, 0.03), (1 << 17, 0.2)):
        rows = suspected(hashes, hit_twice(hashes, bits), bits)
        assert rows.where("suspect").count() < share * 20_000
    twice = hashes.unionByName(hashes.limit(500))
    rows = suspected(twice, hit_twice(twice, 1 << 19), 1 << 19)
    assert rows.join(hashes.limit(500), "h").where("not suspect").count() == 0


def test_empty_tables(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    assert shard_rows(frame(spark, []), uniform_tree(40), grown(uniform_tree(40), 40)).count() == 0


def test_shards_hold_their_law(spark):
    rows = ROWS + [(100 + i, f"text {i}") for i in range(4000)]
    out = shard_rows(frame(spark, rows), uniform_tree(40), grown(uniform_tree(40), 40)).collect()
    assert len(out) == len(rows)
    sizes = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == sizes
    slots = defaultdict(list)
    of = defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        of[r.doc_id].add(r.shard)
        assert r.grown_shard in (r.shard, 40)
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    moved = sum(r.grown_shard == 40 for r in out)
    assert 40 < moved < 180
    assert max(map(len, slots.values())) < 2 * len(rows) / 40


def test_many_cells_keep_slots_gapless(spark, monkeypatch):
    from tickloom.llm import sharding

    monkeypatch.setattr(sharding, "ROWS_A_TASK", 50)
    slots = defaultdict(list)
    for r in shard_rows(frame(spark, [(i, "x") for i in range(1000)]), uniform_tree(7)).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weight_change_stays_in_its_subtree(spark):
    tree = {0: {0: {0: 1.0, 1: 2.0}, 1: {2: 1.0}}, 1: {0: {3: 4.0}}}
    df = spark.range(6000)
    before = {r.id: r.shard for r in place(df, "id", tree).collect()}
    share = Counter(before.values())
    assert abs(share[3] / 6000 - 0.5) < 0.03 and abs(share[1] / 6000 - 0.25) < 0.03
    tree[0][0][1] = 3.0
    after = {r.id: r.shard for r in place(df, "id", tree).collect()}
    for i, s in before.items():
        if s == 1:
            assert after[i] == 1
        if s == 0:
            assert after[i] in (0, 1)
        if s == 3:  # into the subtree that grew, or nowhere
            assert after[i] in (0, 1, 2, 3)


def spark_hash(*values):
    """Spark's xxhash64 of longs and ints, from seed 42 on; a null leaves the hash as it is."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(8 if kind == "long" else 4, "little", signed=True), seed=h)
    return h


def plain_place(key, tree):
    """Descend by the definition, a node at a time."""
    node, path = tree, []
    weigh = lambda x: sum(map(weigh, x.values())) if isinstance(x, dict) else x
    while isinstance(node, dict):
        draws = []
        for name, child in node.items():
            if weigh(child) > 0:
                u = ((spark_hash(("long", key), ("int", len(path)), *(("int", p) for p in path), ("int", name)) >> 11) + 0.5) / 2**53
                draws.append((-math.log(u) / weigh(child), name))
        name = min(draws)[1]
        node, path = node[name], [*path, name]
    return path[-1]


TREES = [uniform_tree(40), uniform_tree(39), grown(uniform_tree(40), 40), uniform_tree(1), {7: {2: {5: 1.0, 9: 0.0, 3: 2.5}}, 2: {0: {8: 0.5}, 4: {1: 1.0, 0: 3.0}}, 5: {1: {6: 0.0}}}]


@pytest.mark.parametrize("tree", TREES)
def test_place_is_the_plain_descent(spark, tree):
    ids = [None, -(2**63), 2**63 - 1, 0, *range(1, 300)]
    got = place(spark.createDataFrame([(i,) for i in ids], "key bigint"), "key", tree).collect()
    assert [r.shard for r in got] == [plain_place(r.key, tree) for r in got]


def test_shard_rows_match_a_plain_version(spark, monkeypatch):
    """The same shards, grown shards and, shard by shard, the same set of slots; slots follow the order in a cell."""
    from tickloom.llm import sharding

    tree = uniform_tree(40)
    rows = ROWS + [(100 + i % 900, f"text {i}") for i in range(2000)] + [(None, None)]
    for cell in (200_000, 300):
        monkeypatch.setattr(sharding, "ROWS_A_TASK", cell)
        got = shard_rows(frame(spark, rows), tree, grown(tree, 40)).collect()
        plain = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), plain_place(d, tree), plain_place(d, grown(tree, 40))) for d, t in rows]
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == Counter(plain)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append((r.slot, (r.doc_id is not None, r.doc_id, r.text_crc32, r["size"])))
        for of in slots.values():
            assert sorted(s for s, _ in of) == list(range(len(of)))
            if cell == 200_000:
                assert [k for _, k in sorted(of)] == sorted(k for _, k in of)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (1, 7, 39, 40):
        tree = uniform_tree(n)
        df = place(place(spark.range(3000), "id", tree), "id", grown(tree, n), "after")
        moved = [r.after for r in df.collect() if r.after != r.shard]
        assert set(moved) == {n} and abs(len(moved) / 3000 - 1 / (n + 1)) < 0.06


def test_place_keeps_clashing_columns_and_compiles(spark):
    df = spark.range(50).selectExpr("id", "7 AS region", "8 AS rack", "9 AS shard__rack", "10 AS Shard", "11 AS cell", "12 AS before")
    out = place(df, "id", uniform_tree(40))
    assert out.columns == ["id", "region", "rack", "shard__rack", "cell", "before", "shard"]
    assert {tuple(r)[1:-1] for r in out.collect()} == {(7, 8, 9, 11, 12)}
    assert out._jdf.queryExecution().executedPlan().toString().count("*(1)") >= 1
    assert sharding_columns(spark, df) == [*df.columns, "slot"]


def sharding_columns(spark, df):
    from tickloom.llm.sharding import with_slots

    out = with_slots(df, 50, ["id"], "shard")
    assert sorted(r.slot for r in out.collect()) == list(range(50))
    return [c for c in df.columns if c in out.columns] + [c for c in out.columns if c not in df.columns]
