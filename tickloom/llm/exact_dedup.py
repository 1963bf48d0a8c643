"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

The filter is in blocks of 32,768 bits; a text's hash names a block and two bits in it. Pass one sets, in a
filter of two bits a place ("once", "twice"), what rows fall on: they are counted by place as far as each task
goes, and only places and counts meet. "Twice" is kept as bitmaps, a block a row, and broadcast. Pass two tests
each row: unless both of its bits are set, no other row has its text, and it goes straight to the result. Only the
rest is shuffled and grouped by the SHA-256 of the normalised text. False positives come out as groups of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_at, staged

#: Filter bits a row, the fewest bits, and the most (256 MB): with more rows than those serve, more rows are suspected.
BITS_A_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 31
#: Bits of a block: what a bitmap of Spark's holds.
BLOCK = 1 << 15
#: A group is hot when it holds over 1/HOT_SHARE of the suspected rows, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """The text without characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _block(h: Column, bits: int) -> Column:
    return F.pmod(h, F.lit(bits // BLOCK))


def _places(h: Column, bits: int) -> list[Column]:
    """The two places (1 to bits) of a hash, in its block."""
    return [_block(h, bits) * BLOCK + F.pmod(F.xxhash64(h, F.lit(k)), F.lit(BLOCK)) + 1 for k in (0, 1)]


def hit_twice(hashes: DataFrame, bits: int) -> DataFrame:
    """block, twice: a bitmap of the places of each block that two rows or more fall on."""
    fallen = hashes.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("place"))
    # once or twice is all that counts: sums go no further than a task's own rows before they meet
    twice = fallen.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucket = (F.bitmap_bucket_number("place") - 1).alias("block")
    return twice.groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("twice"))


def suspected(rows: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """rows with a column suspect: both places of h are hit twice."""
    joined = rows.withColumn("own", _block(F.col("h"), bits)).join(F.broadcast(filters), F.col("own") == F.col("block"), "left")
    first, second = _places(F.col("h"), bits)
    return joined.select(*rows.columns, (bit_at(F.col("twice"), first) & bit_at(F.col("twice"), second)).alias("suspect"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Equal texts are those identical after normalised(). The row with the most code points in its original
    text stays, then the smallest id, then (ids that repeat) one of them; a null id comes last. Null and
    blank texts are one group. An empty table gives no rows. Other columns are ignored, whatever their names.
    Texts never move; what is shuffled are places of hashes, and ids and digests of suspected rows. bits: of the
    filter, a multiple of BLOCK.
    """
    norm = normalised(F.col(text_col))
    rows = staged(
        df.select(
            F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
            F.unhex(F.sha2(norm, 256)).alias("sha"), F.monotonically_increasing_id().alias("rid"),
        ).withColumn("h", F.xxhash64("sha")),
        "exact_rows",
    )
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_ROW * max(1, rows.count()) - 1).bit_length()))
    tested = suspected(rows, hit_twice(rows.select("h"), bits), bits)
    marked = staged(tested.drop("h"), "exact_marked")
    straight = marked.where("not suspect").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    some = marked.where("suspect").select("id", "n", "sha", "rid")
    best = F.min_by(F.struct("id", "rid"), F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("null"), "id", "rid"))
    groups = staged(some.groupBy("sha").agg(best.alias("keep"), F.count(F.lit(1)).alias("group_size")), "exact_groups")
    hot_from = marked.where("suspect").count() // HOT_SHARE + 1
    hot = groups.where(F.col("group_size") > hot_from).select(F.col("sha").alias("g"), F.col("keep").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    cold = groups.where(F.col("group_size") <= hot_from)
    # fewer than HOT_SHARE hot groups exist, whatever the input's size: their rows never meet in one task
    with_hot = some.join(F.broadcast(hot), F.col("sha") == F.col("g"), "left").drop("g")
    in_hot = with_hot.where("hot_size is not null").select("id", "rid", "sha", F.col("hot_keep").alias("keep"), F.col("hot_size").alias("group_size"))
    in_cold = with_hot.where("hot_size is null").select("id", "rid", "sha").join(cold, "sha").select("id", "rid", "sha", "keep", "group_size")
    grouped = in_hot.unionByName(in_cold).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "sha"
    )
    return straight.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")
