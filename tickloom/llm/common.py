"""Shared helpers: the scratch folder, staged tables and bounded-size tests."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temp folder only where it is unset."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        hp = jvm.org.apache.hadoop.fs.Path(path)
        hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)
    except Exception:  # the session is gone: whoever owns the folder clears it
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, deleted when the driver's Python ends."""
    path = f"{scratch_root(spark)}/tickloom-{uuid.uuid4().hex}/{name}"
    atexit.register(_delete, spark, path.rsplit("/", 1)[0])
    return path


#: Bytes of rows that go to a Python worker at once: what is in flight in the JVM and in a worker is a few times that.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to BATCH_BYTES, so that long rows come in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, and no lineage to recompute when an executor is lost."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table, as staged() gave it, that nothing will read again."""
    _delete(table.sparkSession, table.staged_at)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    """Partitions of about per_partition rows each: follows the data and has no upper limit."""
    return max(least, -(-rows // per_partition))


#: A group is hot when it holds over 1/HOT_SHARE of the rows: there are fewer than HOT_SHARE such groups, whatever the input.
HOT_SHARE = 1000


def with_groups(rows: DataFrame, keys: list[str], least: int = 1, **aggregates) -> DataFrame:
    """rows with n__ (their group's size) and the named aggregates; groups under `least` rows are left out.

    Groups are aggregated before they are shuffled.
    """
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__"), *(x.alias(n) for n, x in aggregates.items())).where(F.col("n__") >= least)
    return meet_groups(rows, staged(groups, "groups"), keys)


def meet_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their group, one of groups (staged, with sizes n__); rows of no group are left out.

    Hot groups are broadcast, fewer than HOT_SHARE rows by their definition, so their rows stay where they are;
    the others meet their rows by a shuffle of small groups.
    """
    in_hot, others = met_apart(rows, groups, keys)
    return in_hot.unionByName(others)


def met_apart(rows: DataFrame, groups: DataFrame, keys: list[str], nulls: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of meet_groups in two parts, hot groups and others. Without nulls among the keys, the others may stay where
    their keys brought them: a repartition by the same keys moves nothing."""
    total = groups.agg(F.sum("n__")).first()[0] or 0
    hot_from = int(total) // HOT_SHARE + 1
    hot = groups.where(F.col("n__") > hot_from)
    extra = [c for c in groups.columns if c not in keys]
    names = {k: f"{k}__key" for k in keys}
    match = [F.col(k).eqNullSafe(F.col(names[k])) if nulls else F.col(k) == F.col(names[k]) for k in keys]
    marked = rows.join(F.broadcast(hot.withColumnsRenamed(names)), match, "left")
    in_hot = marked.where("n__ is not null").select(*rows.columns, *extra)
    rest = marked.where("n__ is null").select(*rows.columns)
    cold = groups.where(F.col("n__") <= hot_from).withColumnsRenamed(names)
    return in_hot, rest.join(cold, match).select(*rows.columns, *extra)


def fresh(columns: list[str], *bases: str) -> list[str]:
    """A name made of each base that none of the columns has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for base in bases:
        name, k = base, 0
        while name.lower() in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits a key of the filter of few keys, and the most bits (32 MB) that are broadcast.
KEY_BITS, MOST_BITS = 16, 1 << 28


def bit_at(bitmap: Column, place: Column) -> Column:
    """Whether the bit of a place (1 and up) is set in its bucket's bitmap; false where there is none."""
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def with_maybe(rows: DataFrame, h: Column, few: DataFrame, out: str) -> DataFrame:
    """rows with a boolean column `out`: whether h may be one of few's column h.

    It is one, or stands with one on a bit of a broadcast filter, which grows with few up to MOST_BITS; beyond, more
    rows may be. So only rows that may match must be shuffled to be joined with few.
    """
    bits = min(MOST_BITS, max(1 << 16, 1 << (KEY_BITS * max(1, few.count()) - 1).bit_length()))
    at, bucket, bitmap = fresh([*rows.columns, out], "place", "bucket", "bitmap")
    place = lambda x: F.pmod(x, F.lit(bits)) + 1
    maps = few.select(place(F.col("h")).alias(at)).groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bitmap))
    placed = rows.withColumn(at, place(h))
    joined = placed.join(F.broadcast(maps), F.bitmap_bucket_number(at) == F.col(bucket), "left")
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), bit_at(F.col(bitmap), F.col(at)).alias(out))
