"""Runs of lines that stand more than once: found by a suffix array over line ids, later copies deleted.

A line's id is the hash of its words. Lines whose id occurs once can't be in a repeated run; what is left of a
document are stretches of repeated lines, and equal stretches are collapsed to the earliest. Over the rest a
suffix array is built by distributed prefix doubling, until no two suffixes share a rank: a suffix's rank by its
first 2L lines is the rank of the pair of the ranks by L lines at its start and L lines on. Suffixes whose rank
nobody shares drop out, so each shared rank is an interval of the array whose longest common prefix has at least
that many lines.

A suffix that isn't the first of its interval repeats the first one. Its interval by the most lines names its
source; where the suffix before it has the line before as its source, it goes on with that run, else it begins one. The
length of a run is the longest common prefix of the two suffixes, found by descending the ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import textops as T
from .common import fresh, meet_groups, staged, with_groups, with_maybe

#: Words of the shortest run that counts: any line with words.
LEAST_WORDS = 1


def lines_of(w: T.Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line with words: its id, its number of words, and its row."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    at = np.cumsum(buf == 10)[w.start]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (w.row[1:] != w.row[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)]))
    f, i = T._powers(len(at) + 1)
    total = np.concatenate((np.zeros(1, T.U), np.cumsum(w.hash * f[: len(at)])))
    ids = T.mix((total[last] - total[first]) * i[first] + (last - first).astype(T.U))
    return ids.view(np.int64), (last - first).astype(np.int32), w.row[first]


def _document_lines(docs: DataFrame) -> DataFrame:
    """id, th (hash of the text), ids and words of its lines; rows equal in id and text once."""

    def run(batches):
        for batch in batches:
            buf, off = T.string_buffers(batch.column(2))
            for a, b in T.slices(off):
                part, po = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                ids, words, row = lines_of(T.Words(part, po), part)
                cut = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.ListArray.from_arrays(cut, pa.array(ids)), pa.ListArray.from_arrays(cut, pa.array(words))], ["id", "th", "ids", "words"])
        T.settle()

    lines = docs.select("id", "th", "text").mapInArrow(run, "id bigint, th bigint, ids array<bigint>, words array<int>").where("size(ids) > 0")
    once = lines.groupBy("id", "th").agg(F.first("ids").alias("ids"), F.first("words").alias("words"))
    return staged(once.withColumn("did", F.monotonically_increasing_id()), "lines")


def _stretches(lines: DataFrame) -> DataFrame:
    """did, id, start, ids, words of each longest stretch of lines that all occur more than once."""
    each = lines.select("did", "id", F.posexplode(F.arrays_zip("ids", "words")).alias("pos", "line")).select("did", "id", "pos", F.col("line.ids").alias("h"), F.col("line.words").alias("w"))
    repeated = with_groups(each, ["h"], least=2)
    numbered = repeated.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("did").orderBy("pos")))
    grouped = numbered.groupBy("did", "island").agg(F.first("id").alias("id"), F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "h", "w"))).alias("x"))
    return grouped.select("did", "id", "start", F.col("x.h").alias("ids"), F.col("x.w").alias("words"))


def _in_order(stretches: DataFrame) -> DataFrame:
    """stretches with seg, a number in the order of documents by their ids (null last), then rows, and of lines."""
    by = [F.col("id").isNull(), F.col("id"), F.col("did"), F.col("start")]
    return stretches.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seg", F.monotonically_increasing_id())


def suffix_array(suffixes: DataFrame) -> dict[int, DataFrame]:
    """By level (a power of two), staged seg, i, r, first out of suffixes (seg, i, h): the ranks of suffixes by their first `level` lines.

    Only ranks that two suffixes or more share are listed: the others' prefixes stand once. first is the least
    (seg, i) of a rank. Ranks of a level are in the order of the prefixes (lines in the order of their ids).
    """
    first = F.min(F.struct("seg", "i"))
    level = 1
    now = staged(with_groups(suffixes, ["h"], least=2, first=first).select("seg", "i", F.col("h").alias("r"), "first"), "ranks1")
    out = {}
    while not now.isEmpty():
        out[level] = now
        ahead = Window.partitionBy("seg").orderBy("i").rangeBetween(level, level)
        pairs = staged(now.select("seg", "i", "r", F.max("r").over(ahead).alias("r2")).where("r2 is not null"), f"pairs{level}")
        shared = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n__"), first.alias("first")).where("n__ > 1")
        # in the order of the pairs, over range partitions: a monotonic id is the new rank
        ranked = staged(shared.repartitionByRange("r", "r2").sortWithinPartitions("r", "r2").withColumn("rank", F.monotonically_increasing_id()), f"names{level}")
        level *= 2
        now = staged(meet_groups(pairs, ranked, ["r", "r2"]).select("seg", "i", F.col("rank").alias("r"), "first"), f"ranks{level}")
    return out


def repeated_runs(ranks: dict[int, DataFrame]) -> DataFrame | None:
    """seg, i, from_seg, from_i, n: runs of n lines that repeat an earlier one; None if there are no ranks.

    Every line that has an earlier copy is in a run, and a run can't be longer.
    """
    later = None
    for level, now in ranks.items():
        at = now.where(F.struct("seg", "i") > F.col("first")).select("seg", "i", F.struct(F.lit(level).cast("bigint").alias("level"), "first.seg", "first.i").alias("x"))
        later = at if later is None else later.unionByName(at)
    if later is None:
        return None
    best = later.groupBy("seg", "i").agg(F.max("x").alias("x")).select("seg", "i", "x.level", F.col("x.seg").alias("from_seg"), F.col("x.i").alias("from_i"))
    before = Window.partitionBy("seg").orderBy("i")
    goes_on = (F.lag("i").over(before) == F.col("i") - 1) & (F.lag("from_seg").over(before) == F.col("from_seg")) & (F.lag("from_i").over(before) == F.col("from_i") - 1)
    runs = best.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).where("not goes_on").drop("goes_on").withColumn("n", F.col("level"))
    runs = staged(runs, "run_starts")
    for level in sorted(ranks, reverse=True)[1:]:
        here = ranks[level].select(F.col("seg").alias("s1"), F.col("i").alias("i1"), F.col("r").alias("r1"))
        there = ranks[level].select(F.col("seg").alias("s2"), F.col("i").alias("i2"), F.col("r").alias("r2"))
        runs = runs.join(here, (F.col("level") > level) & (F.col("seg") == F.col("s1")) & (F.col("i") + F.col("n") == F.col("i1")), "left").drop("s1", "i1")
        runs = runs.join(there, (F.col("level") > level) & (F.col("from_seg") == F.col("s2")) & (F.col("from_i") + F.col("n") == F.col("i2")), "left").drop("s2", "i2")
        runs = runs.withColumn("n", F.col("n") + F.when(F.col("r1") == F.col("r2"), F.lit(level)).otherwise(0)).drop("r1", "r2")
    return runs.select("seg", "i", "from_seg", "from_i", "n")


def repeated_intervals(lines: DataFrame, least_words: int) -> DataFrame:
    """did, a, b: lines a to b of a document (among those with words) that repeat an earlier run of least_words or more."""
    enough = lambda words: F.aggregate(words, F.lit(0).cast("bigint"), lambda x, y: x + y) >= least_words
    stretches = staged(_in_order(staged(_stretches(lines), "stretches")), "ordered_stretches")
    keyed = stretches.withColumn("k1", F.xxhash64("ids")).withColumn("k2", F.xxhash64(F.lit(1), "ids"))
    marked = staged(with_groups(keyed, ["k1", "k2"], first=F.min("seg")).withColumn("kept", F.col("seg") == F.col("first")), "stretch_firsts")
    copies = marked.where("not kept").where(enough(F.col("words"))).select("did", F.col("start").cast("bigint").alias("a"), (F.col("start") + F.size("ids")).cast("bigint").alias("b"))
    kept = marked.where("kept")
    runs = repeated_runs(suffix_array(kept.select("seg", F.posexplode("ids").alias("i", "h")).withColumn("i", F.col("i").cast("bigint"))))
    if runs is None:
        return copies
    placed = runs.join(kept.select("seg", "did", "start", "words"), "seg")
    placed = placed.where(enough(F.slice("words", (F.col("i") + 1).cast("int"), F.col("n").cast("int"))))
    return copies.unionByName(placed.select("did", (F.col("start") + F.col("i")).alias("a"), (F.col("start") + F.col("i") + F.col("n")).alias("b")))


def drop_lines(text: str, gone: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without its lines a to b, counted among lines with words; and how many went."""
    dead = {k for a, b in gone for k in range(a, b)}
    out, k = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            k += 1
            if k - 1 in dead:
                continue
        out.append(line)
    return "\n".join(out), len(dead)


def line_dedup(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_deleted") -> DataFrame:
    """docs with text_col without later copies of repeated runs, and count_col: the lines that went.

    Lines are equal when their words are (A-Z lower-cased, white space collapsed); lines without words are left
    as they are and don't part a run. A run of at least least_words words that stands more than once, in one
    document or several, stays where it is first: by id (null last), row and line. Every line deleted has an
    equal line that stays, and with least_words 1 no line that stays has one before it. Rows equal in id and
    text count as one document and are treated alike. Null texts stay null. An input column named count_col is
    replaced; others stay as they are. Only lines' ids, small tables of runs and the texts that lose lines are shuffled.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != count_col.lower()))
    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    lines = _document_lines(named)
    maybe, i, h, g = fresh(docs.columns, "maybe", "i", "h", "gone")
    runs = repeated_intervals(lines, least_words).groupBy("did").agg(F.collect_set(F.struct("a", "b")).alias(g))
    gone = staged(runs.join(lines.select("did", F.col("id").alias(i), F.col("th").alias(h)), "did").select(i, h, g), "gone")
    at = docs.columns.index(text_col)
    own_id, own_text = F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(F.col(f"`{text_col}`"))
    tested = with_maybe(docs, F.xxhash64(own_id, own_text), gone.select(F.xxhash64(i, h).alias("h")), maybe)
    # texts that lose nothing pass straight through; the rest is shuffled to meet its runs
    some = tested.where(F.col(maybe)).drop(maybe)
    joined = some.join(gone.hint("merge"), own_id.eqNullSafe(F.col(i)) & (own_text == F.col(h)), "left").drop(i, h)
    untouched = tested.where(~F.col(maybe)).drop(maybe).withColumn(count_col, F.lit(0))
    schema = StructType([*docs.schema.fields, StructField(count_col, IntegerType())])

    def run(batches):
        for batch in batches:
            runs = batch.column(batch.num_columns - 1)
            text, n = batch.column(at).to_pylist() if runs.null_count < len(runs) else None, np.zeros(len(runs), np.int32)
            columns = batch.columns[:-1]
            if text is not None:
                for k in np.flatnonzero(~np.asarray(runs.is_null())).tolist():
                    text[k], n[k] = drop_lines(text[k], [(x["a"], x["b"]) for x in runs[k].as_py()])
                columns[at] = pa.array(text, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=schema.names)

    return joined.mapInArrow(run, schema).unionByName(untouched)
