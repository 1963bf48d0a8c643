"""Order tapes derived from the events table, one independent book for each sym."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.set_based import running

MID = 1_032_768
BASE = 1_000_000
SYMS = 4


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % SYMS).cast("int").alias("sym"), "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.floor("value").cast("bigint").alias("v"),
    )


def _with_targets(typed: DataFrame) -> DataFrame:
    """Each row with c, the adds of its sym so far, and the ref of the add it aims at (its own for an add).

    The aim is the add of ordinal c - k % 16, at least the first.
    """
    counted = running(typed, {"c": (F.col("type") == "A").cast("bigint")})
    adds = counted.where(F.col("type") == "A").select("sym", F.col("c").alias("aim"), (F.col("seq") + 1).alias("ref"))
    aim = F.when(F.col("type") == "A", F.col("c")).otherwise(F.greatest(F.lit(1).cast("bigint"), F.col("c") - F.col("k") % 16))
    return counted.where("c > 0").withColumn("aim", aim).join(adds, ["sym", "aim"])


def wire_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, seq, type (A E X D), ref, side, price, qty: adds never cross; D has no quantity."""
    kind = F.when(F.col("event_type") == "click", "E").when(F.col("event_type") == "error", F.when(F.col("k") % 5 < 3, "X").otherwise("D")).otherwise("A")
    rows = _with_targets(_keyed(spark, sf_dir).withColumn("type", kind))
    add, buy, off = F.col("type") == "A", (F.col("v") + F.col("k")) % 2 == 0, 1 + (F.col("k") * 7 + F.col("v")) % 32
    return rows.select(
        "sym", "seq", "type", "ref", F.when(add, F.when(buy, "B").otherwise("S")).alias("side"),
        F.when(add, F.when(buy, MID - off).otherwise(MID + off)).alias("price"),
        F.when(add, 4 + F.col("v") % 32).when(F.col("type") != "D", 1 + F.col("v") % 8).alias("qty"),
    )


def cross_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns, with aggressive adds that cross and cancels (D)."""
    hit = (F.col("event_type") == "click") | ((F.col("event_type") == "error") & (F.col("k") % 5 < 3))
    kind = F.when((F.col("event_type") == "error") & ~hit, "D").otherwise("A")
    rows = _with_targets(_keyed(spark, sf_dir).withColumn("type", kind).withColumn("hit", hit))
    add, buy, off = F.col("type") == "A", (F.col("v") + F.col("k")) % 2 == 0, 1 + (F.col("k") * 7 + F.col("v")) % 32
    passive = F.when(buy, MID - off).otherwise(MID + off)
    return rows.select(
        "sym", "seq", "type", "ref", F.when(add, F.when(buy, "B").otherwise("S")).alias("side"),
        F.when(add, F.when(F.col("hit"), F.when(buy, MID + 8).otherwise(MID - 8)).otherwise(passive)).cast("bigint").alias("price"),
        F.when(add, F.when(F.col("hit"), 8 + F.col("v") % 16).otherwise(1 + F.col("v") % 8)).alias("qty"),
    )


#: The tapes in DuckDB, as WITH clauses.
WIRE_SQL = f"""
k0 AS (SELECT event_id AS seq, CAST(user_id % {SYMS} AS INTEGER) AS sym, event_type,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events),
k1 AS (SELECT *, CASE WHEN event_type = 'click' THEN 'E' WHEN event_type = 'error' THEN CASE WHEN k % 5 < 3 THEN 'X' ELSE 'D' END ELSE 'A' END AS type FROM k0),
k2 AS (SELECT *, CAST(sum(CASE WHEN type = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY seq) AS BIGINT) AS c FROM k1),
k3 AS (SELECT sym, c AS aim, seq + 1 AS ref FROM k2 WHERE type = 'A'),
tape AS (SELECT a.sym, a.seq, a.type, b.ref,
                CASE WHEN type = 'A' THEN CASE WHEN (v + k) % 2 = 0 THEN 'B' ELSE 'S' END END AS side,
                CASE WHEN type = 'A' THEN CASE WHEN (v + k) % 2 = 0 THEN {MID} - (1 + (k * 7 + v) % 32) ELSE {MID} + (1 + (k * 7 + v) % 32) END END AS price,
                CASE WHEN type = 'A' THEN 4 + v % 32 WHEN type <> 'D' THEN 1 + v % 8 END AS qty
         FROM k2 a JOIN k3 b ON a.sym = b.sym AND b.aim = CASE WHEN a.type = 'A' THEN a.c ELSE greatest(1, a.c - a.k % 16) END
         WHERE a.c > 0)"""

CROSS_SQL = f"""
k0 AS (SELECT event_id AS seq, CAST(user_id % {SYMS} AS INTEGER) AS sym, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events),
k1 AS (SELECT *, event_type = 'click' OR (event_type = 'error' AND k % 5 < 3) AS hit, CASE WHEN event_type = 'error' AND k % 5 >= 3 THEN 'D' ELSE 'A' END AS type FROM k0),
k2 AS (SELECT *, CAST(sum(CASE WHEN type = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY seq) AS BIGINT) AS c FROM k1),
k3 AS (SELECT sym, c AS aim, seq + 1 AS ref FROM k2 WHERE type = 'A'),
tape AS (SELECT a.sym, a.seq, a.type, b.ref,
                CASE WHEN type = 'A' THEN CASE WHEN (v + k) % 2 = 0 THEN 'B' ELSE 'S' END END AS side,
                CASE WHEN type <> 'A' THEN NULL WHEN hit THEN CASE WHEN (v + k) % 2 = 0 THEN {MID + 8} ELSE {MID - 8} END
                     WHEN (v + k) % 2 = 0 THEN {MID} - (1 + (k * 7 + v) % 32) ELSE {MID} + (1 + (k * 7 + v) % 32) END AS price,
                CASE WHEN type <> 'A' THEN NULL WHEN hit THEN 8 + v % 16 ELSE 1 + v % 8 END AS qty
         FROM k2 a JOIN k3 b ON a.sym = b.sym AND b.aim = CASE WHEN a.type = 'A' THEN a.c ELSE greatest(1, a.c - a.k % 16) END
         WHERE a.c > 0)"""
