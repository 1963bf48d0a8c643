"""Documents whose sets of n-word shingles are alike (Jaccard), by signature trees over shared rare shingles.

Equal sets are one class. Two sets that reach the threshold share one of the first shingles of each, in any
order common to all, if enough are taken (a fifth and one of a set at 0.8); the order is by hash, with the
shingles that stand in very many documents last. Classes that share such a shingle are a cell, or several if they
are many. A cell's signature tree, traversed with itself, leaves the classes that may have a partner alike;
their whole sets go to the cell, and a second traversal verifies pairs in place, the likeliest of two leaves
first, and gives a link where it joins two components of the cell: never more links than rows.

Two rounds keep large groups of near copies linear. The first takes a few shared shingles a class, and a group's
blocks each for itself; its links make components. The second takes all shingles that classes of different
components share and all pairs of blocks that aren't of one component, so no link between components is missed.
Few of its possible pairs are links, so digests of the sets go to the cells first, and whole sets for what they leave.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import discard, fresh, meet_groups, met_apart, partitions_for, staged, with_groups, with_maybe
from .components import components
from .signature_tree import Tree, bitmap, needed

SHINGLE, PERCENT = 5, 80
#: Shared shingles a class in the first round; shingles in one bucket of the search for shared ones.
FIRST, BUCKET_TOKENS = 6, 500_000
#: Rows and shingles of the sets (16 MB) of a block, and the most blocks that a group is cut into for its rows; a cell holds two.
CELL_ROWS, CELL_TOKENS, MOST_BLOCKS = 128, 2_000_000, 64
#: So many possible pairs a row of a cell, at most, are taken out of it.
FEW = 2
#: A digest has 16 bits of each shingle of a set of fewer shingles, 32 of others.
WIDE = 4096
#: Rows of a group that are compared by their exact sizes; classes of a shingle that is put last as well.
COMPARED, VERY_COMMON = 500, 2000
#: Bits of the filter of shared shingles: so many each, and 32 MB at most; beyond, more unshared ones pass it for a while.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
#: Shingles of so many documents of one part of COUNTED shingles are counted; those whose counts add up to LEAST_COMMON
#: are put last, the COMMON (4 MB) with the highest counts at most.
COMMON_IN_PART, COUNTED, LEAST_COMMON, COMMON = 4, 2_000_000, 16, 500_000
#: A table of at most so many rows of two or three numbers (12 MB) is broadcast.
BROADCAST_ROWS = 500_000


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batch_text: pa.Array, shingle: int):
    """(row, set) of each text with words."""
    buf, off = T.string_buffers(batch_text)
    for a, b in T.slices(off):
        for k, s in enumerate(T.row_shingles(T.Words(buf[off[a] : off[b]], off[a : b + 1] - off[a]), shingle)):
            if len(s):
                yield a + k, s


def _described(rows: DataFrame, shingle: int) -> tuple[DataFrame, np.ndarray]:
    """Of rows (id, th, text): a staged table id, th, n, cid (the set's id, null without words); and the common shingles."""

    def counted(held: list[np.ndarray]):
        every = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        count = np.diff(np.concatenate((first, [len(every)])))
        often = count >= COMMON_IN_PART
        blank = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([blank] * 4 + [pa.array(every[first[often]].view(np.int64)), pa.array(count[often])], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            n, cid = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for k, s in _sets(batch.column(2), shingle):
                n[k], cid[k] = len(s), set_id(s)
                held.append(s)
                size += len(s)
                if size > COUNTED:
                    yield counted(held)
                    held, size = [], 0
            blank = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(cid, pa.int64()), blank, blank], names)
        if held:
            yield counted(held)
        held = None
        T.settle()

    names = ["id", "th", "n", "cid", "t", "c"]
    both = staged(rows.mapInArrow(run, ", ".join(f"{x} bigint" for x in names)), "described")
    common = both.where("t is not null").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST_COMMON).orderBy(F.desc("c"), "t").limit(COMMON).select("t").collect()
    return both.where("n is not null").drop("t", "c"), np.sort(np.array([r.t for r in common], np.int64).view(T.U))


def prefix(tokens: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set of which any set alike has one among its own first: rare ones by hash, then common ones."""
    if len(common):
        last = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
        tokens = np.concatenate([tokens[~last], tokens[last]])
    return tokens[: len(tokens) - -(-percent * len(tokens) // 100) + 1]


def _wide(rows: DataFrame, common: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """cid, n, prefix and bits (bytes) of each class; a class may come once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out = []
            for _, s in _sets(batch.column(0), shingle):
                if (c := set_id(s)) not in seen:
                    seen.add(c)
                    p = prefix(s, common, percent).view(np.int64)
                    out.append((c, len(s), p.tobytes(), bitmap(s).tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["cid", "n", "prefix", "bits"])

    return staged(rows.select("text").mapInArrow(run, "cid bigint, n bigint, prefix binary, bits binary"), "wide")


def _cells(batches) -> Iterator[pa.Table]:
    """The rows of one cell after another, out of batches in order of their first three columns (g, cell_i, cell_j)."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(k)) for k in range(3)]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(int(k[a]) for k in keys)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


CELL = "g bigint, cell_i int, cell_j int, side int, cid bigint, comp bigint, n bigint, left bigint"
CELL_COLUMNS = [x.split()[0] for x in CELL.split(", ")]


def _columns(cell: pa.Table) -> list[np.ndarray]:
    """side, cid, comp, n, left of a cell's rows, which are in order of side."""
    return [cell.column(k).to_numpy() for k in range(3, 8)]


def _by_cell(rows: DataFrame, more: str) -> DataFrame:
    return rows.select(*CELL_COLUMNS, more).repartition("g", "cell_i", "cell_j").sortWithinPartitions("g", "cell_i", "cell_j", "side", "n", "cid")


FOUND = f"{CELL}, cid2 bigint, comp2 bigint, n2 bigint"
FOUND_COLUMNS = [x.split()[0] for x in FOUND.split(", ")]


def _kept(cell: pa.Table, pairs: np.ndarray, few: int) -> Iterator[pa.RecordBatch]:
    """What goes on of a cell, given its possible pairs: those pairs where they are few for its rows, else the rows in one."""
    if not len(pairs):
        return
    _, cid, comp, n, _ = _columns(cell)
    rows = np.unique(pairs)
    if len(pairs) <= few * len(rows):
        i, j = pairs.T
        none = pa.nulls(len(pairs), pa.int64())
        ends = [pa.array(x) for x in (cid[i], comp[i], n[i])], [pa.array(x) for x in (cid[j], comp[j], n[j])]
        yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int32()), *ends[0], none, *ends[1]], FOUND_COLUMNS)
    else:
        kept = cell.select(CELL_COLUMNS).take(pa.array(rows)).combine_chunks()
        yield from pa.table([*kept.columns, *[pa.nulls(len(rows), pa.int64())] * 3], FOUND_COLUMNS).to_batches()


def _regrouped(found: DataFrame) -> DataFrame:
    """Staged rows of cells out of what was kept (staged): pairs, each once however many cells had it, make cells of their
    own, a class and those that it may be alike; the other cells keep their rows."""
    dense = found.where("cid2 is null").select(*CELL_COLUMNS)
    end = lambda k: F.struct(F.col(f"cid{k}").alias("cid"), F.col(f"comp{k}").alias("comp"), F.col(f"n{k}").alias("n"))
    ends = found.where("cid2 is not null").select(F.least(end(""), end("2")).alias("a"), F.greatest(end(""), end("2")).alias("b")).distinct()
    ends = staged(ends, "possible_pairs")
    # the end with more pairs is the hub of a cell; partners of a hub of very many are dealt over cells
    degree = staged(ends.select(F.explode(F.array("a", "b")).alias("x")).groupBy(F.col("x.cid").alias("d")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("x.n").alias("tokens")), "degrees")
    if degree.count() <= BROADCAST_ROWS:
        degree = F.broadcast(degree)
    for k in ("a", "b"):
        ends = ends.join(degree.withColumnsRenamed({"d": f"d{k}", "pairs": f"pairs_{k}", "tokens": f"tokens_{k}"}), F.col(f"{k}.cid") == F.col(f"d{k}"))
    first = F.col("pairs_a") >= F.col("pairs_b")
    either = lambda x, y: F.when(first, x).otherwise(y)
    # sizes differ by a quarter at most, so a hub's own bound that of its partners
    parts = F.greatest(F.ceil(either(F.col("tokens_a"), F.col("tokens_b")) / F.lit(float(CELL_TOKENS))), F.ceil(either(F.col("pairs_a"), F.col("pairs_b")) / F.lit(float(CELL_ROWS))))
    stars = ends.select(either(F.col("a"), F.col("b")).alias("hub"), either(F.col("b"), F.col("a")).alias("other"), parts.cast("int").alias("parts"))
    stars = stars.withColumn("cell", F.pmod(F.xxhash64("other.cid"), F.col("parts")).cast("int"))
    row = lambda x, side: F.struct(F.lit(side).alias("side"), F.col(f"{x}.cid").alias("cid"), F.col(f"{x}.comp").alias("comp"), F.col(f"{x}.n").alias("n"))
    rows = stars.select(F.col("hub.cid").alias("g"), "cell", F.explode(F.array(row("hub", 0), row("other", 1))).alias("x")).distinct()
    sparse = rows.select("g", F.lit(-1).alias("cell_i"), F.col("cell").alias("cell_j"), "x.side", "x.cid", "x.comp", "x.n", F.col("x.n").alias("left"))
    return staged(dense.unionByName(sparse), "paired")


def _paired(cells: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Staged rows of cells that are left to be verified, by a tree of bitmaps for each cell (two if it has two sides).

    left is how many shingles a class has from the one that brought it here. Two classes alike meet at the first
    shingle that they share, and from there on neither can share more: that caps what the tree lets pass.
    """
    cells = staged(cells, "cells")
    need = staged(cells.select("cid").distinct(), "needed")
    bits = bits.join(F.broadcast(need) if need.count() <= BROADCAST_ROWS else need, "cid", "left_semi")

    def run(batches):
        for cell in _cells(batches):
            if cell.num_rows < 2:
                continue
            side, _, comp, n, left = _columns(cell)
            cut = int(np.searchsorted(side, 1))
            maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.column(8)]
            yield from _kept(cell, Tree(n, maps, comp, percent, left, cut if cut < len(side) else None).pairs(), FEW)

    return _regrouped(staged(_by_cell(cells.join(bits, "cid"), "bits").mapInArrow(run, FOUND), "possible"))


def digest(tokens: np.ndarray, wide: int) -> np.ndarray:
    """The lowest bits of the tokens of a set, in order. Two sets share at most as many tokens as their digests numbers."""
    return np.sort(tokens.astype(np.uint16 if len(tokens) < wide else np.uint32))


def ranked(numbers: np.ndarray) -> np.ndarray:
    """Numbers in order made distinct: each with how many equal ones stand before it."""
    return numbers.astype(T.U) << T.U(32) | (np.arange(len(numbers)) - np.searchsorted(numbers, numbers)).astype(T.U)


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two arrays of distinct ones, in order, have in common."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _sharpened(cells: DataFrame, rows: DataFrame, described: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Staged rows of cells that are left of staged ones, by digests of the sets: a quarter of their bytes, and hardly a
    pair that isn't alike passes. None that is alike is lost."""

    def run(batches):
        for cell in _cells(batches):
            first, (side, _, comp, n, left) = _once(cell)
            if len(first) < 2:
                continue
            # a digest of 16 bits is met by 16 bits of a larger set's
            held = [cell.column(8)[k].as_buffer() for k in first.tolist()]
            raw = [np.frombuffer(x, np.uint16 if x.size == 2 * size else np.uint32) for x, size in zip(held, n.tolist(), strict=True)]
            low = [ranked(x if x.dtype == np.uint16 else np.sort(x.astype(np.uint16))) for x in raw]
            full = [ranked(x) if x.dtype == np.uint32 else None for x in raw]
            cut = int(np.searchsorted(side, 1))
            pairs = Tree(n, [bitmap(x.astype(T.U)) for x in raw], comp, percent, left, cut if cut < len(side) else None).pairs()
            shared = [in_common(low[i], low[j]) if full[i] is None or full[j] is None else in_common(full[i], full[j]) for i, j in pairs.tolist()]
            pairs = pairs[np.array(shared, np.int64) >= needed(n[pairs[:, 0]], n[pairs[:, 1]], percent)]
            yield from _kept(cell.select(CELL_COLUMNS).take(pa.array(first)), pairs, FEW)
        cell = held = raw = low = full = None
        T.settle()

    return _regrouped(staged(_with_sets(cells, rows, described, shingle, functools.partial(digest, wide=WIDE)).mapInArrow(run, FOUND), "likely"))


def _sets_of(asked: DataFrame, rows: DataFrame, described: DataFrame, shingle: int, form: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """cid, s (bytes of the whole set in a form) of the classes asked for (cid, distinct), out of a text of each."""
    known = described.where("cid is not null").groupBy("cid").agg(F.min(F.struct("id", "th")).alias("d"))
    named = staged(known.join(asked, "cid").select("cid", F.col("d.id").alias("i__"), F.col("d.th").alias("h__")), "asked")
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    texts = rows.join(named, rows["id"].eqNullSafe(F.col("i__")) & (rows["th"] == F.col("h__"))).select("cid", "text")

    def run(batches):
        """A few MB of sets at a time."""
        for batch in batches:
            out, size = [], 0
            for k, s in _sets(batch.column(1), shingle):
                out.append((batch.column(0)[k].as_py(), form(s).tobytes()))
                size += 8 * len(s)
                if size > 4 << 20:
                    yield packed(out)
                    out, size = [], 0
            if out:
                yield packed(out)
        batch = out = None
        T.settle()

    def packed(out: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["cid", "s"])

    return texts.mapInArrow(run, "cid bigint, s binary")


def _with_sets(cells: DataFrame, rows: DataFrame, described: DataFrame, shingle: int, form: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Staged rows of cells with s, the class's set in a form, dealt by cell."""
    sets = _sets_of(cells.select("cid").distinct(), rows, described, shingle, form)
    return _by_cell(sets.join(F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells, "cid"), "s")


def _once(cell: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of a cell with sets that count, and their columns: two rows equal in id and text give a class's set twice."""
    side, cid, *_ = columns = _columns(cell)
    first = np.flatnonzero(np.concatenate(([True], (cid[1:] != cid[:-1]) | (side[1:] != side[:-1]))))
    return first, [x[first] for x in columns]


def _linked(cells: DataFrame, rows: DataFrame, described: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Staged links (a, b) out of staged rows of cells: pairs whose whole sets, sent to the cell, reach the threshold.

    A cell gives a link only where it joins two components of what it holds, so at most one less than its rows; classes
    of it that it leaves in different components have no link there.
    """

    def run(batches):
        for cell in _cells(batches):
            first, (side, cid, comp, n, left) = _once(cell)
            if len(cid) < 2:
                continue
            sets = [np.frombuffer(cell.column(8)[k].as_buffer(), T.U) for k in first.tolist()]

            def alike(i: int, j: int) -> bool:
                shared = in_common(sets[i], sets[j])
                return 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared)

            cut = int(np.searchsorted(side, 1))
            got = list(Tree(n, [bitmap(s) for s in sets], comp, percent, left, cut if cut < len(side) else None).links(alike))
            if got:
                i, j = np.array(got).T
                yield pa.RecordBatch.from_arrays([pa.array(cid[i]), pa.array(cid[j])], ["a", "b"])
        cell = sets = None
        T.settle()

    return staged(_with_sets(cells, rows, described, shingle, np.asarray).mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def _shared_filter(wide: DataFrame) -> np.ndarray:
    """Bits of a filter that every shingle passes which stands in the prefixes of two classes or more.

    Each batch gives a shingle's least and greatest class; those meet, in bulk, by buckets of shingles. A shingle of
    very many classes comes twice a batch at most, so no bucket holds it more often. Of a shingle go its lowest 32 bits,
    more than the filter has places; within a bucket hardly two agree in them, and what does passes as if it were shared.
    """
    tokens = int(wide.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 8
    buckets = partitions_for(tokens, BUCKET_TOKENS, least=8)

    def run(batches):
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            t, cid = np.concatenate(parts), np.repeat(np.asarray(batch.column(0)), [len(p) for p in parts])
            order = np.lexsort((cid, t))
            t, cid = t[order], cid[order]
            edge = t[1:] != t[:-1]
            ends = np.concatenate(([True], edge)) | np.concatenate((edge, [True]))  # the first and the last of each
            t, cid = t[ends], cid[ends]
            bucket = ((t.view(T.U) * T.U(0x9E3779B97F4A7C15 | 1)) >> T.U(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(k, *(x[order[cut[k] : cut[k + 1]]].tobytes() for x in (t.astype(np.uint32), cid))) for k in range(buckets) if cut[k + 1] > cut[k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "t", "cid"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, cid = (np.frombuffer(b"".join(rows[c]), kind) for c, kind in (("t", np.uint32), ("cid", np.int64)))
        order = np.argsort(t, kind="stable")
        t, cid = t[order], cid[order]
        return pd.DataFrame({"t": np.unique(t[1:][(t[1:] == t[:-1]) & (cid[1:] != cid[:-1])]).astype(np.int64)})

    shared = staged(wide.select("cid", "prefix").mapInArrow(run, "bucket int, t binary, cid binary").groupBy("bucket").applyInPandas(merge, "t bigint"), "shared")
    size = min(MOST_FILTER_BITS, max(1 << 16, 1 << (FILTER_BITS * max(1, shared.count()) - 1).bit_length()))
    place = F.pmod("t", F.lit(size)) + 1
    maps = shared.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")).collect()  # 32 MB at most
    bits = np.zeros((-(-size // 32768), 4096), np.uint8)
    for r in maps:
        bits[r["bucket"] - 1] = np.frombuffer(r["map"], np.uint8)
    return bits.ravel()


def _single(wide: DataFrame) -> DataFrame:
    """wide with each class once: only classes that come more than once, and the few on their bits of a filter, are shuffled."""
    twice = staged(wide.groupBy("cid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("cid").alias("h")), "twice")
    tested = with_maybe(wide, F.col("cid"), twice, "maybe")
    return tested.where(~F.col("maybe")).drop("maybe").unionByName(tested.where(F.col("maybe")).drop("maybe").dropDuplicates(["cid"]))


def _token_rows(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged t, cid, n, pos, k: the shingles of prefixes that pass the filter, and the how-manieth of its class each is; and
    staged cid and bits of each class. The table wide is deleted."""
    bits = _shared_filter(wide)

    def run(batches):
        mask = T.U(8 * len(bits) - 1)
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            sizes = [len(p) for p in parts]
            t = np.concatenate(parts)
            at = (t.view(T.U) & mask).astype(np.int64)
            ok = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
            row, pos = row[ok], (np.arange(len(t)) - np.repeat(ends - sizes, sizes))[ok]
            rank = np.arange(len(ok)) - np.searchsorted(row, row)
            columns = t[ok], np.asarray(batch.column(0))[row], np.asarray(batch.column(1))[row], pos, rank
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["t", "cid", "n", "pos", "k"])

    single = _single(wide)
    rows = staged(single.select("cid", "n", "prefix").mapInArrow(run, "t bigint, cid bigint, n bigint, pos bigint, k bigint"), "token_rows")
    maps = staged(single.select("cid", "bits"), "maps")
    discard(wide)
    return rows, maps


def _viable(parts: tuple[DataFrame, ...], percent: int) -> DataFrame:
    """Staged g, cid, comp, n, left, n__, tokens__ out of rows (t, cid, comp, n, pos, n__): rows with a possible partner by
    sizes and what is left; n__ and tokens__ are the rows of the group g and the shingles of their sets. The rows come in
    parts, each with whole groups: those that met their groups by a shuffle are where they must be, and stay there.

    Shingles with the same members make one group, with the most left of each. In groups of more than COMPARED rows
    sizes are compared by steps of a thirtieth, so a few rows more pass.
    """

    def tested(t, cid, comp, n, left):
        """Rows are in order of t and n: a row is compared with the next, the one after it, and so on in its group."""
        ok = np.zeros(len(t), bool)
        at, step = np.arange(len(t) - 1), 1
        while len(at):
            other = at + step
            near = (t[at] == t[other]) & (100 * n[at] >= percent * n[other])
            at, other = at[near], other[near]
            hit = (comp[at] != comp[other]) & (np.minimum(left[at], left[other]) >= needed(n[at], n[other], percent))
            ok[at[hit]] = ok[other[hit]] = True
            step += 1
            at = at[at + step < len(t)]
        t, cid, comp, n, left = (x[ok] for x in (t, cid, comp, n, left))
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((first, [len(t)])))
        g = np.add.reduceat(T.mix(cid.view(T.U)), first) if len(first) else np.zeros(0, T.U)
        tokens = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        group, count, tokens = np.repeat(T.mix(g).view(np.int64), size), np.repeat(size, size), np.repeat(tokens, size)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (group, cid, comp, n, left, count, tokens)], ["g", "cid", "comp", "n", "left", "n__", "tokens__"])

    def run(batches):
        rest = None
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            rest = [c[cut:] for c in columns]  # the last group may go on: no longer than COMPARED
            if cut:
                yield tested(*(c[:cut] for c in columns))
        if rest is not None and len(rest[0]):
            yield tested(*rest)

    names = "g bigint, cid bigint, comp bigint, n bigint, left bigint, n__ bigint, tokens__ bigint"
    parts = [x.select("t", "cid", "comp", "n", (F.col("n") - F.col("pos")).alias("left"), "n__") for x in parts]
    small, each = (functools.reduce(DataFrame.unionByName, x) for x in ([
        x.where(F.col("n__") <= COMPARED).drop("n__").repartition("t").sortWithinPartitions("t", "n", "cid").mapInArrow(run, names) for x in parts
    ], parts))

    # the largest `left` of each step of sizes, seen from the steps around it
    ratio, reach = np.log1p(1 / 30), int(np.ceil(np.log(100 / percent) / np.log1p(1 / 30))) + 1
    large = staged(each.where(F.col("n__") > COMPARED).drop("n__").withColumn("step", F.floor(F.log("n") / F.lit(float(ratio)))), "large_groups")
    steps = large.groupBy("t", "step").agg(F.min("n").alias("low"), F.max("left").alias("most"), F.count(F.lit(1)).alias("n__"))
    around = steps.select("t", F.explode(F.sequence(F.col("step") - reach, F.col("step") + reach)).alias("step"), F.struct("low", "most").alias("near"))
    seen = steps.select("t", "step", "n__").join(around.groupBy("t", "step").agg(F.collect_list("near").alias("near")), ["t", "step"])
    met = meet_groups(large, staged(seen, "steps"), ["t", "step"])

    def partner(x):
        least = F.ceil(F.lit(percent) * (F.col("n") + F.greatest(x["low"], F.ceil(F.col("n") * percent / 100))) / (100 + percent))
        return (F.col("left") >= least) & (x["most"] >= least)

    met = staged(met.where(F.exists("near", partner)).select("t", "cid", "comp", "n", "left"), "large_viable")
    sized = with_groups(met, ["t"], least=2, tokens__=F.sum("n")).select(F.xxhash64("t").alias("g"), "cid", "comp", "n", "left", "n__", "tokens__")
    both = small.unionByName(sized).groupBy("g", "cid")
    return staged(both.agg(*(F.max(c).alias(c) for c in ("comp", "n", "left", "n__", "tokens__"))), "viable")


def _dealt(viable: DataFrame, spanning: bool) -> DataFrame:
    """Rows of cells out of viable ones. A group that is too large for a cell is cut into blocks.

    Spanning: each block is a cell. Otherwise each pair of blocks is one; a component that would fill a block has
    blocks of its own, and those are no cells among themselves, so a row is copied for what it must be compared with.
    """
    blocks = F.greatest(F.ceil(F.col("tokens__") / F.lit(float(CELL_TOKENS))), F.least(F.ceil(F.col("n__") / F.lit(float(CELL_ROWS))), F.lit(MOST_BLOCKS))).cast("int")
    sized = viable.withColumn("blocks", blocks)
    whole = sized.where("blocks = 1").select("g", F.lit(0).alias("cell_i"), F.lit(0).alias("cell_j"), F.lit(0).alias("side"), "cid", "comp", "n", "left")
    cut = sized.where("blocks > 1")
    if spanning:
        own = F.pmod(F.xxhash64("cid", "g"), F.col("blocks")).cast("int")
        return whole.unionByName(cut.select("g", own.alias("cell_i"), own.alias("cell_j"), F.lit(0).alias("side"), "cid", "comp", "n", "left"))
    per = cut.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("n__").alias("rows"), F.max("blocks").alias("blocks"))
    giant = F.col("c") * F.col("blocks") > F.col("rows")
    held = F.ceil(F.col("c") * F.col("blocks") / F.col("rows")).cast("int")
    # at most `blocks` components are giants, so the list of a group is short
    plan = per.groupBy("g").agg(
        F.sum("c").alias("n__"), F.max("blocks").alias("blocks"), F.sum(F.when(giant, 0).otherwise(F.col("c"))).alias("few"),
        F.array_sort(F.collect_list(F.when(giant, F.struct("comp", held.alias("held"))))).alias("giants"),
    )
    plan = plan.withColumn("open", F.ceil(F.col("few") * F.col("blocks") / F.col("n__")).cast("int"))
    before = lambda i: F.aggregate(F.slice("giants", 1, i), F.lit(0), lambda total, x: total + x["held"])
    plan = plan.select("g", "n__", "open", F.transform("giants", lambda x, i: F.struct(x["comp"].alias("comp"), x["held"].alias("held"), (F.col("open") + before(i)).alias("from"))).alias("giants"))
    plan = plan.withColumn("total", F.col("open") + F.aggregate("giants", F.lit(0), lambda total, x: total + x["held"]))
    placed = meet_groups(cut.drop("n__", "blocks", "tokens__"), staged(plan, "plans"), ["g"])
    mine = F.filter("giants", lambda x: x["comp"] == F.col("comp"))
    placed = placed.withColumn("mine", F.get(mine, 0)).withColumn("own", F.coalesce(F.col("mine.from") + F.pmod(F.xxhash64("cid"), F.col("mine.held")), F.pmod(F.xxhash64("cid"), F.col("open"))).cast("int"))
    every = F.sequence(F.lit(0), F.col("total") - 1)
    others = F.filter(every, lambda k: F.coalesce((k < F.col("mine.from")) | (k >= F.col("mine.from") + F.col("mine.held")), F.lit(True)))
    placed = placed.withColumn("other", F.explode(others))
    cells = placed.select("g", F.least("own", "other").alias("cell_i"), F.greatest("own", "other").alias("cell_j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "comp", "n", "left")
    return whole.unionByName(cells)


def _placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Staged rows with comp, the component of their class."""
    named = F.broadcast(comps) if comps.count() <= BROADCAST_ROWS else comps
    return staged(rows.join(named, F.col("cid") == F.col("v"), "left").select(*rows.columns, F.coalesce("comp", "cid").alias("comp")), "placed")


def _grouped(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Parts of rows (t, comp and others) with n__, their shingle's rows, without shingles of one component."""
    groups = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n__"), F.min("comp").alias("lo__"), F.max("comp").alias("hi__")).where("lo__ < hi__").drop("lo__", "hi__")
    return met_apart(rows, staged(groups, name), ["t"], nulls=False)


def link_classes(rows: DataFrame, described: DataFrame, common: np.ndarray, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Staged links between classes, and (v, comp) of every class that has one."""
    every, maps = _token_rows(_wide(rows, common, shingle, percent))
    for _ in range(3):
        # shingles of very many classes, which no part had shown to be common, are put last as well
        more = every.groupBy("t").count().where(F.col("count") > VERY_COMMON).select("t").limit(COMMON).collect()
        new = np.setdiff1d(np.array([r.t for r in more], np.int64).view(T.U), common)
        if not len(new):
            break
        common = np.union1d(common, new)
        discard(every)
        discard(maps)
        every, maps = _token_rows(_wide(rows, common, shingle, percent))

    few = every.where(F.col("k") < FIRST).drop("k").withColumn("comp", F.col("cid"))
    viable = _viable(_grouped(few, "groups"), percent)
    found = _linked(_paired(_dealt(viable, True), maps, percent), rows, described, shingle, percent)
    comps = components(found)
    placed = _placed(every.drop("k"), comps)
    discard(every)
    viable = _viable(_grouped(placed, "mixed"), percent)
    discard(placed)
    cells = _paired(_dealt(viable, False), maps, percent)
    discard(maps)
    more = _linked(_sharpened(cells, rows, described, shingle, percent), rows, described, shingle, percent)
    if more.isEmpty():
        return found, comps
    found = staged(found.unionByName(more), "all_links")
    return found, components(found)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Words are runs outside [\\x20\\x09-\\x0D], A-Z lower-cased; a set is a text's distinct shingles, or all its words
    as one if they are fewer. Two texts link when 100 * intersection >= percent * union; component_id is the
    least id reachable by links. Texts without words, and null ones, have an empty set and link with nothing.
    Rows with equal ids are documents of their own; a null id is greater than any other. Sets are told apart
    by 64-bit hashes of their shingles' hashes.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    described, common = _described(rows, shingle)
    _, comps = link_classes(rows, described, common, shingle, percent)
    some = described.where("cid is not null")
    classes = some.groupBy("cid").agg(F.min("id").alias("least"))
    reached = classes.join(comps, F.col("cid") == F.col("v"), "left").select("cid", "least", F.coalesce("comp", "cid").alias("comp"))
    lowest = with_groups(reached, ["comp"], component_id=F.min("least")).select("cid", "component_id")
    sizes = some.groupBy("cid").agg(F.count(F.lit(1)).alias("n__"))
    full = meet_groups(some.select("id", "n", "cid"), staged(sizes.join(lowest, "cid"), "reached"), ["cid"]).select("id", "n", "component_id")
    none = described.where("cid is null").select("id", "n", F.col("id").alias("component_id"))
    null = docs.where(F.col(text_col).isNull()).select(F.col(id_col).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("n"), F.col(id_col).cast("bigint").alias("component_id"))
    return full.unionByName(none).unionByName(null).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of alike ones: the least id (a null one last); all columns stay as they are.

    Rows equal in id and text count as one document and stay or go together. Texts without words always stay.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    described, common = _described(rows, shingle)
    _, comps = link_classes(rows, described, common, shingle, percent)
    own = F.struct(F.col("id").isNull().alias("null"), "id", "th")
    members = described.where("cid is not null").select("id", "th", "cid", own.alias("own"))
    comp = staged(members.groupBy("cid").agg(F.count(F.lit(1)).alias("n__"), F.min("own").alias("first")).join(comps, F.col("cid") == F.col("v"), "left").select("cid", "n__", "first", F.coalesce("comp", "cid").alias("comp")), "comps")
    lowest = with_groups(comp.drop("n__"), ["comp"], keep=F.min("first")).drop("n__").join(comp.select("cid", F.col("n__").alias("size__")), "cid").select("cid", F.col("size__").alias("n__"), "keep")
    maybe, i, h = fresh(docs.columns, "maybe", "i", "h")
    lost = meet_groups(members, staged(lowest, "kept"), ["cid"]).where(F.col("own") != F.col("keep")).select(F.col("id").alias(i), F.col("th").alias(h)).distinct()
    lost = staged(lost, "lost")
    own_id, own_text = F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(F.col(f"`{text_col}`"))
    tested = with_maybe(docs, F.xxhash64(own_id, own_text), lost.select(F.xxhash64(i, h).alias("h")), maybe)
    some = tested.where(F.col(maybe)).join(lost.hint("merge"), own_id.eqNullSafe(F.col(i)) & (own_text == F.col(h)), "left_anti")
    return tested.where(~F.col(maybe)).unionByName(some).drop(maybe)
