"""Sharding down a weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards, each shard with a weight; a node weighs what its shards weigh. At
each level a row draws -ln(u) / weight for every child, u being a hash of its key and the child's path,
and goes to the child with the smallest draw. So children get rows in proportion to their weights, and a
change of weight only moves rows into or out of the subtrees whose weights changed.

A level's names and weights are literal arrays over the nodes of the level above, so an expression is as long
as a node has children, not as the tree has nodes, and all of it is compiled into one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, partitions_for, staged

#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]

#: Rows in one task while slots are numbered.
ROWS_A_TASK = 200_000


def uniform_tree(shards: int, racks: int = 2, per_rack: int = 5) -> Tree:
    """Regions of racks x per_rack equal shards; the last region and rack may be smaller."""
    tree: Tree = {}
    for s in range(shards):
        region, rest = divmod(s, racks * per_rack)
        tree.setdefault(region, {}).setdefault(rest // per_rack, {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, a region of its own: rows that it takes come out of every other region, and no
    row goes anywhere else."""
    return tree | {max(tree, default=-1) + 1: {0: {shard: weight}}}


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _pick(key: Column, path: list[Column], names: Column, weights: Column, first: Column, most: int) -> Column:
    """Which of at most `most` children, at first and after it in the arrays, has the smallest draw; -1 pads a node's list."""
    draws = []
    for k in range(most):
        at = (first + k).cast("int")
        name, weight = F.get(names, at), F.get(weights, at)
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(len(path)), *path, name), 11)
        draw = -F.log((bits.cast("double") + 0.5) / float(2**53)) / weight
        draws.append(F.struct(F.when(weight > 0, draw).otherwise(F.lit(float("inf"))).alias("draw"), at.alias("at"), name.alias("name")))
    return F.least(*draws) if most > 1 else draws[0]


def _padded(nodes: list[dict]) -> tuple[Column, Column, int]:
    """Names and weights of the children of nodes, as many for each."""
    most = max(map(len, nodes))
    names = [n for node in nodes for n in [*node, *[-1] * (most - len(node))]]
    weights = [w for node in nodes for w in [*(float(_weight(x)) for x in node.values()), *[0.0] * (most - len(node))]]
    return F.array(*map(F.lit, names)), F.array(*map(F.lit, weights)), most


def place(df: DataFrame, key_col: str, tree: Tree, out_col: str = "shard") -> DataFrame:
    """df with out_col: the shard that key_col descends to. A null key is a key like any other.

    A column of that name is replaced; all others stay as they are.
    """
    key, path, at = F.col(f"`{key_col}`"), [], F.lit(0)
    kept = [c for c in df.columns if c.lower() != out_col.lower()]
    nodes: list[dict] = [tree]
    out = df
    for name in (names := fresh([*df.columns, out_col], "region", "rack", "shard")):
        arrays = _padded(nodes)
        # rows of a level are numbered as its nodes stand in the arrays of the level above
        out = out.withColumn(name, _pick(key, path, arrays[0], arrays[1], at * arrays[2], arrays[2]))
        nodes = [x for node in nodes for x in [*node.values(), *[{}] * (arrays[2] - len(node))]]
        path, at = [*path, F.col(name)["name"]], F.col(name)["at"]
    return out.select(*(F.col(f"`{c}`") for c in kept), F.col(names[-1])["name"].cast("int").alias(out_col))


def with_slots(df: DataFrame, rows: int, order: list[str], shard_col: str = "shard") -> DataFrame:
    """df with slot: gapless from 0 in each shard. rows: about how many there are; df is read twice, so stage it.

    Each shard is dealt into hash cells of about ROWS_A_TASK rows; a cell's first slot is the size of the
    cells before it, so no task ever holds a whole shard.
    """
    cells = partitions_for(rows, ROWS_A_TASK)
    cell, size, before, within = fresh([*df.columns, "slot"], "cell", "size", "before", "within")
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    sizes = dealt.groupBy(shard_col, cell).agg(F.count(F.lit(1)).alias(size))
    upto = F.coalesce(F.sum(size).over(Window.partitionBy(shard_col).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(shard_col, cell, upto.alias(before))
    numbered = dealt.withColumn(within, F.row_number().over(Window.partitionBy(shard_col, cell).orderBy(*order)) - 1)
    return numbered.join(starts, [shard_col, cell]).withColumn("slot", (F.col(before) + F.col(within)).cast("bigint")).drop(cell, within, before)


def shard_rows(df: DataFrame, tree: Tree, more: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, grown_shard (its shard in the tree `more`).

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 is of the same bytes. Texts are read once; ids and
    digests are staged and shuffled, never texts. Rows with equal ids share a shard; in a shard slots are in the
    order of id (null first), text_crc32 and size within a hash cell, rows equal in them in any order. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = place(rows, "id", tree)
    placed = staged(place(placed, "id", more, "grown_shard") if more else placed.withColumn("grown_shard", F.lit(None).cast("int")), "shards")
    out = with_slots(placed, placed.count(), ["id", "text_crc32", "size"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "grown_shard")
