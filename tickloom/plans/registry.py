"""Queries over tapes derived from the driver's tables, named by operator, and the same results in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import scalars
from tickloom.operators import kernel
from tickloom.operators import set_based as S
from tickloom.sources import itch
from tickloom.sources.scratch import scratch, staged
from tickloom.sources.tapes import BASE, CROSS_SQL, MID, WIRE_SQL, cross_tape, events, wire_tape

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

POINTS = {"p50": 50.0, "p90": 90.0, "p99": 99.0, "p999": 99.9, "p9999": 99.99}
RISK = {"max_qty": 30, "low": MID - 28, "high": MID + 28, "position_limit": 400, "window": 40_000, "depth": 8}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.remaining(wire_tape(spark, sf_dir))


def _tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_changes(S.tops(_left(spark, sf_dir)))


# --- steps that several chains share ---------------------------------------------------------------------------
PUBLISHED = """before AS (SELECT *, lag(bid_px, 1, -1) OVER w AS lbp, lag(bid_qty, 1, 0) OVER w AS lbq, lag(ask_px, 1, -1) OVER w AS lap, lag(ask_qty, 1, 0) OVER w AS laq FROM tops WINDOW w AS (PARTITION BY sym ORDER BY seq)),
pub AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY seq) AS pub_seq FROM before WHERE (bid_px, bid_qty, ask_px, ask_qty) <> (lbp, lbq, lap, laq))"""
SIGNAL_STEPS = """sig AS (SELECT sym, seq, pub_seq, bid_px, bid_qty, ask_px, ask_qty,
               CAST(sum((bid_px >= lbp)::INT * bid_qty - (bid_px <= lbp)::INT * lbq - (ask_px <= lap)::INT * ask_qty + (ask_px >= lap)::INT * laq) OVER (PARTITION BY sym ORDER BY seq) AS BIGINT) AS ofi,
               CAST(((bid_px * ask_qty + ask_px * bid_qty) * 256) // (bid_qty + ask_qty + (bid_qty + ask_qty = 0)::INT) AS BIGINT) AS micro_px FROM pub)"""

# --- the wire tape's operators in SQL, each step a WITH clause ------------------------------------------------
LEFT = f"""WITH {WIRE_SQL},
o1 AS (SELECT t.*, first_value(t.side) OVER w AS oside, first_value(t.price) OVER w AS oprice, first_value(t.qty) OVER w AS shares FROM tape t WINDOW w AS (PARTITION BY sym, ref ORDER BY seq)),
o2 AS (SELECT *, CASE type WHEN 'A' THEN 0 WHEN 'D' THEN shares ELSE qty END AS asked FROM o1),
o3 AS (SELECT *, greatest(0, shares - coalesce(sum(asked) OVER (PARTITION BY sym, ref ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lft FROM o2),
orders AS (SELECT sym, seq, type, ref, oside AS side, CAST(oprice AS BIGINT) AS price, CAST(shares AS BIGINT) AS shares, CAST(least(asked, lft) AS BIGINT) AS removed, CAST(lft - least(asked, lft) AS BIGINT) AS remaining FROM o3)"""
DEPTH = f"""{LEFT},
changes AS (SELECT sym, seq, side, price, CASE WHEN type = 'A' THEN shares ELSE -removed END AS delta FROM orders),
history AS (SELECT sym, seq, side, price, CAST(sum(delta) OVER (PARTITION BY sym, side, price ORDER BY seq) AS BIGINT) AS depth FROM changes WHERE delta <> 0),
final AS (SELECT sym, side, price, CAST(sum(delta) AS BIGINT) AS depth FROM changes GROUP BY ALL HAVING sum(delta) > 0)"""
TOPS = f"""{DEPTH},
spans AS (SELECT sym, side, price, depth, seq AS since, coalesce(lead(seq) OVER (PARTITION BY sym, side, price ORDER BY seq), 9223372036854775807) AS until FROM history),
bids AS (SELECT m.sym, m.seq, max(s.price) AS bid_px, arg_max(s.depth, s.price) AS bid_qty FROM tape m JOIN spans s ON s.sym = m.sym AND m.seq >= s.since AND m.seq < s.until WHERE s.side = 'B' AND s.depth > 0 GROUP BY ALL),
asks AS (SELECT m.sym, m.seq, min(s.price) AS ask_px, arg_min(s.depth, s.price) AS ask_qty FROM tape m JOIN spans s ON s.sym = m.sym AND m.seq >= s.since AND m.seq < s.until WHERE s.side = 'S' AND s.depth > 0 GROUP BY ALL),
tops AS (SELECT t.sym, t.seq, coalesce(bid_px, -1) AS bid_px, coalesce(bid_qty, 0) AS bid_qty, coalesce(ask_px, -1) AS ask_px, coalesce(ask_qty, 0) AS ask_qty
         FROM tape t LEFT JOIN bids USING (sym, seq) LEFT JOIN asks USING (sym, seq)),
{PUBLISHED}"""
SIGNALS = f"""{TOPS},
{SIGNAL_STEPS}"""


@query(f"{SIGNALS} SELECT * FROM sig")
def ofi_micro(spark, sf_dir):
    """Order-flow imbalance and micro-price at each change of the top. The flagship."""
    return S.signals(_tops(spark, sf_dir))


@query(f"{SIGNALS} SELECT sym, seq, CAST(ofi - coalesce(lag(ofi, 10) OVER (PARTITION BY sym ORDER BY seq), 0) AS BIGINT) AS ofi_10 FROM sig")
def w10_windowed_ofi(spark, sf_dir):
    """The imbalance over the last ten updates, as a difference of running reads."""
    before = F.lag("ofi", 10, 0).over(Window.partitionBy("sym").orderBy("seq"))
    return S.signals(_tops(spark, sf_dir)).select("sym", "seq", (F.col("ofi") - before).alias("ofi_10"))


@query(f"{TOPS} SELECT sym, seq, pub_seq, bid_px, bid_qty, ask_px, ask_qty FROM pub")
def w2_bbo_updates(spark, sf_dir):
    """Best bid and offer after every message, when they change."""
    return _tops(spark, sf_dir).select("sym", "seq", "pub_seq", *S.TOP)


@query(f"{LEFT} SELECT * FROM orders")
def w1_order_remaining(spark, sf_dir):
    """What each message takes off its order."""
    return _left(spark, sf_dir)


@query(f"{LEFT} SELECT sym, count(*) FILTER (type = 'E' AND removed > 0) AS trades, CAST(coalesce(sum(removed) FILTER (type = 'E'), 0) AS BIGINT) AS traded_lots FROM orders GROUP BY sym")
def m13_gateway_fills(spark, sf_dir):
    """Executes that found their order, and their lots."""
    return S.fills(_left(spark, sf_dir))


@query(f"{DEPTH} SELECT * FROM final")
def a1_level_depth_final(spark, sf_dir):
    """Resting quantity of each occupied level at the end."""
    return S.depth_final(_left(spark, sf_dir))


@query(f"{DEPTH} SELECT * FROM history")
def a1_level_depth_history(spark, sf_dir):
    """A1: each level's quantity after every change."""
    return S.depth_history(_left(spark, sf_dir))


@query(f"""WITH {WIRE_SQL} SELECT count(*) FILTER (type = 'A') AS adds, count(*) FILTER (type = 'E') AS execs, count(*) FILTER (type = 'X') AS cancels, count(*) FILTER (type = 'D') AS deletes,
  CAST(coalesce(sum(qty) FILTER (type = 'E'), 0) AS BIGINT) AS exec_lots, max(ref) AS max_ref FROM tape""")
def a4_feed_stats(spark, sf_dir):
    """A4: counts by type, execute lots, greatest ref."""
    t = wire_tape(spark, sf_dir)
    n = {"adds": "A", "execs": "E", "cancels": "X", "deletes": "D"}
    lots = F.coalesce(F.sum(F.when(F.col("type") == "E", F.col("qty"))), F.lit(0)).cast("bigint")
    return t.agg(*(F.count_if(F.col("type") == k).alias(c) for c, k in n.items()), lots.alias("exec_lots"), F.max("ref").alias("max_ref"))


CONFLATED = f"""{TOPS},
conf AS (SELECT sym, seq // 256 AS part, max(pub_seq) AS pub_seq, arg_max(bid_px, seq) AS bid_px, arg_max(bid_qty, seq) AS bid_qty, arg_max(ask_px, seq) AS ask_px, arg_max(ask_qty, seq) AS ask_qty, count(*) - 1 AS dropped FROM pub GROUP BY sym, seq // 256)"""


@query(f"{CONFLATED} SELECT * FROM conf")
def w7_bbo_conflated(spark, sf_dir):
    """The last update of each range of 256 messages, and how many it stands for."""
    return S.conflate(_tops(spark, sf_dir), 256)


@query(f"""{CONFLATED}, g AS (SELECT *, pub_seq <> lag(pub_seq) OVER (PARTITION BY sym ORDER BY part) + 1 AS gap FROM conf)
SELECT sym, count(*) AS published, CAST(sum(dropped) AS BIGINT) AS dropped, count(*) FILTER (gap) AS gaps FROM g GROUP BY sym""")
def a10_seq_gaps(spark, sf_dir):
    """Updates published and dropped, and the gaps that a consumer sees."""
    return S.seq_gaps(S.conflate(_tops(spark, sf_dir), 256))


@query(f"""{TOPS}, o AS (SELECT *, pub_seq = coalesce(lag(pub_seq) OVER (PARTITION BY sym ORDER BY seq), 0) + 1 AS fine FROM pub)
SELECT sym, bool_and(fine) AS ordered, count(*) = max(pub_seq) AS complete FROM o GROUP BY sym""")
def a17_order_preserved(spark, sf_dir):
    """Updates come in order and none is lost."""
    last = F.coalesce(F.lag("pub_seq").over(Window.partitionBy("sym").orderBy("seq")), F.lit(0))
    checked = _tops(spark, sf_dir).withColumn("fine", F.col("pub_seq") == last + 1)
    return checked.groupBy("sym").agg(F.bool_and("fine").alias("ordered"), (F.count(F.lit(1)) == F.max("pub_seq")).alias("complete"))


WANT = "CASE WHEN bid_qty >= ask_qty THEN"
QUOTES = f"""{TOPS}, w AS (SELECT sym, seq, CASE WHEN bid_px >= 0 THEN {WANT} bid_px ELSE bid_px - 1 END END AS b, CASE WHEN ask_px >= 0 THEN {WANT} ask_px + 1 ELSE ask_px END END AS a FROM pub),
u AS (SELECT sym, seq, 'B' AS side, b AS price FROM w WHERE b IS NOT NULL UNION ALL SELECT sym, seq, 'S', a FROM w WHERE a IS NOT NULL),
q AS (SELECT *, lag(price) OVER (PARTITION BY sym, side ORDER BY seq) AS was FROM u)
SELECT sym, seq, side, price FROM q WHERE price IS DISTINCT FROM was"""


@query(QUOTES)
def w8_quotes(spark, sf_dir):
    """The strategy's quotes when nothing is rejected."""
    return S.quotes(_tops(spark, sf_dir))


def _gaps(spark, sf_dir):
    tape = events(spark, sf_dir).select((F.col("user_id") % 4).cast("int").alias("sym"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return S.before(tape, {"was": "us"}).withColumn("gap", F.col("us") - F.col("was")).where("gap is not null").select("sym", "seq", "gap")


GAPS = "WITH g AS (SELECT CAST(user_id % 4 AS INTEGER) AS sym, event_id AS seq, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS gap FROM events)"
PICK = ", ".join(f"max(gap) FILTER (r = floor(CAST({p} AS DOUBLE) / 100 * (n - 1))) AS {name}" for name, p in POINTS.items())


@query(f"""{GAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY gap) - 1 AS r, count(*) OVER (PARTITION BY sym) AS n FROM g WHERE gap IS NOT NULL)
SELECT sym, count(*) AS n, {PICK}, max(gap) AS mx FROM r GROUP BY sym""")
def a11_interarrival_percentiles(spark, sf_dir):
    """Percentiles of times between messages, by the rank floor(p (n - 1))."""
    return S.percentiles(_gaps(spark, sf_dir), ["sym"], "gap", POINTS)


@query(f"""{GAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY greatest(gap - 1000, 0)) - 1 AS r, count(*) OVER (PARTITION BY sym) AS n FROM g WHERE gap IS NOT NULL),
p AS (SELECT sym, max(greatest(gap - 1000, 0)) FILTER (r = floor(0.5 * (n - 1))) AS p50, max(greatest(gap - 1000, 0)) FILTER (r = floor(CAST(99.0 AS DOUBLE) / 100 * (n - 1))) AS p99 FROM r GROUP BY sym)
SELECT a.sym AS sym_a, b.sym AS sym_b, b.p50 - a.p50 AS delta_p50, b.p99 - a.p99 AS delta_p99, a.p99 - a.p50 AS jitter FROM p a JOIN p b ON a.sym < b.sym""")
def a15_percentile_deltas(spark, sf_dir):
    """Percentiles less an overhead (not under 0), compared between syms."""
    less = _gaps(spark, sf_dir).withColumn("gap", F.greatest(F.col("gap") - 1000, F.lit(0)))
    p = S.percentiles(less, ["sym"], "gap", {"p50": 50.0, "p99": 99.0})
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, F.col("a.sym") < F.col("b.sym")).select(F.col("a.sym").alias("sym_a"), F.col("b.sym").alias("sym_b"), F.expr("b.p50 - a.p50 AS delta_p50"), F.expr("b.p99 - a.p99 AS delta_p99"), F.expr("a.p99 - a.p50 AS jitter"))


@query(f"""{GAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY seq) - 1 AS i FROM g WHERE gap IS NOT NULL)
SELECT sym, i // 64 AS block, CAST(sum(gap) // 64 AS BIGINT) AS average FROM r GROUP BY sym, i // 64 HAVING count(*) = 64""")
def a13_block_averages(spark, sf_dir):
    """Averages over blocks of 64."""
    return S.block_averages(_gaps(spark, sf_dir), ["sym"], "seq", "gap")


PROBE = f"""{DEPTH}, probes AS (SELECT sym, p AS price FROM (SELECT DISTINCT sym FROM tape), (SELECT unnest(generate_series({MID - 40}, {MID + 40})) AS p))
SELECT p.sym, CAST(p.price AS BIGINT) AS price, coalesce(min(f.price) FILTER (f.price >= p.price), -1) AS next_level, coalesce(max(f.price) FILTER (f.price <= p.price), -1) AS prev_level FROM probes p LEFT JOIN final f ON f.sym = p.sym GROUP BY ALL"""


@query(PROBE)
def j9_neighbour_levels(spark, sf_dir):
    """The next and the previous occupied level of each price."""
    left = _left(spark, sf_dir)
    probes = left.select("sym").distinct().select("sym", F.explode(F.sequence(F.lit(MID - 40).cast("bigint"), F.lit(MID + 40).cast("bigint"))).alias("price"))
    return S.neighbour_levels(probes, S.depth_final(left).select("sym", "price").distinct())


def _resting(left):
    last = Window.partitionBy("sym", "ref").orderBy(F.desc("seq"))
    first = F.min("seq").over(Window.partitionBy("sym", "ref"))
    return left.withColumn("since", first).withColumn("last", F.row_number().over(last)).where("last = 1 and remaining > 0").select("sym", "ref", "side", "price", F.col("since").alias("seq"), "remaining")


RESTING = f"""{LEFT}, e AS (SELECT *, min(seq) OVER (PARTITION BY sym, ref) AS since, row_number() OVER (PARTITION BY sym, ref ORDER BY seq DESC) AS last FROM orders),
rest AS (SELECT sym, ref, side, price, since, remaining FROM e WHERE last = 1 AND remaining > 0)"""


@query(f"""{RESTING}, a AS (SELECT *, coalesce(sum(remaining) OVER (PARTITION BY sym ORDER BY price, since ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM rest WHERE side = 'S' AND price <= {MID + 16})
SELECT sym, ref, price, CAST(least(remaining, greatest(0, 500 - ahead)) AS BIGINT) AS fill FROM a WHERE ahead < 500""")
def w6_fifo_allocation(spark, sf_dir):
    """Fills of a buy of 500 up to MID + 16 from the final book, price then time."""
    return S.fifo_allocation(_resting(_left(spark, sf_dir)), "B", F.lit(MID + 16), 500)


@query(f"""{DEPTH}, r AS (SELECT *, row_number() OVER (PARTITION BY sym, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS level FROM final)
SELECT sym, side, CAST(level AS INTEGER) AS level, price, depth FROM r WHERE level <= 5""")
def k2_top_of_book(spark, sf_dir):
    """K2: the five best levels of each side at the end."""
    best = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    ranked = S.depth_final(_left(spark, sf_dir)).withColumn("level", F.row_number().over(Window.partitionBy("sym", "side").orderBy(best)))
    return ranked.where("level <= 5").select("sym", "side", "level", "price", "depth")


@query(f"""WITH {WIRE_SQL}, g AS (SELECT *, coalesce(max((type = 'D')::INT) OVER (PARTITION BY sym, ref ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, first_value(qty) OVER (PARTITION BY sym, ref ORDER BY seq) AS shares FROM tape),
l AS (SELECT *, CAST(sum(CASE WHEN type = 'A' THEN 1 WHEN type = 'D' AND gone = 0 THEN -1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY seq) AS BIGINT) AS live FROM g)
SELECT sym, seq, ref, CAST(CASE WHEN gone = 0 THEN shares ELSE 0 END AS BIGINT) AS value, live FROM l WHERE type <> 'A'""")
def j3_ref_map_asof(spark, sf_dir):
    """Look-ups in the map of refs as of each message, and its size."""
    return S.ref_lookups(wire_tape(spark, sf_dir))


@query(f"""WITH {WIRE_SQL} SELECT sym, seq, ((qty <= 0 OR qty > {RISK['max_qty']})::INT * 1) | ((price < {RISK['low']} OR price > {RISK['high']})::INT * 2) AS mask FROM tape WHERE type = 'A'""")
def p9_risk_static(spark, sf_dir):
    """Size and collar checks as a bit mask."""
    t = wire_tape(spark, sf_dir).where("type = 'A'")
    return t.select("sym", "seq", S.risk_mask(F.col("price"), F.col("qty"), RISK["max_qty"], RISK["low"], RISK["high"]).alias("mask"))


@query(f"""WITH {WIRE_SQL} SELECT sym, seq, CASE WHEN price % 7 = 0 THEN -1 ELSE price END BETWEEN {BASE} AND {BASE + 65535} AND qty - 6 > 0 AS accepted FROM tape WHERE type = 'A'""")
def p1_order_validation(spark, sf_dir):
    """Price inside the ladder and a positive quantity."""
    t = wire_tape(spark, sf_dir).where("type = 'A'")
    price = F.when(F.col("price") % 7 == 0, F.lit(-1)).otherwise(F.col("price"))
    return t.select("sym", "seq", (price.between(BASE, BASE + 65535) & (F.col("qty") - 6 > 0)).alias("accepted"))


@query(f"""WITH {WIRE_SQL} SELECT seq, price / 10000.0::DOUBLE AS as_double, price AS back, (CAST(seq % 7 AS BIGINT) * 4294967296 + seq + 1) AS id, seq % 7 AS generation, seq AS slot, greatest(5, least(20, qty)) AS clamped FROM tape WHERE type = 'A'""")
def f1_scalars(spark, sf_dir):
    """prices to doubles and back, packed ids, clamping."""
    t = wire_tape(spark, sf_dir).where("type = 'A'")
    d, packed = scalars.price_to_double(F.col("price")), scalars.pack_id(F.col("seq") % 7, F.col("seq"))
    return t.select("seq", d.alias("as_double"), scalars.price_from_double(d).alias("back"), packed.alias("id"), scalars.id_generation(packed).alias("generation"), scalars.id_slot(packed).alias("slot"), scalars.clamp(F.col("qty"), F.lit(5), F.lit(20)).alias("clamped"))


HASH64 = "18446744073709551615::UHUGEINT"


@query(f"""WITH {WIRE_SQL} SELECT seq, CAST((((ref::UHUGEINT * {scalars.FIBONACCI_MULTIPLIER}::UHUGEINT) & {HASH64}) >> 43) AS BIGINT) AS slot,
 CAST((ref::UHUGEINT * {scalars.SPARSE_MULTIPLIER}::UHUGEINT) & {HASH64} AS DECIMAL(20, 0)) AS sparse FROM tape WHERE type = 'A'""")
def f5_hashes(spark, sf_dir):
    """Fibonacci slots and the bijection that makes refs sparse."""
    t = wire_tape(spark, sf_dir).where("type = 'A'")
    return t.select("seq", scalars.fibonacci_slot("ref", F.lit(21)).alias("slot"), scalars.sparse_key("ref").alias("sparse"))


def _messages(tape):
    return tape.select("*", (F.col("sym") + 1).alias("stock_locate"), F.lit(3).alias("tracking"), (F.lit(itch.OPEN_NS) + F.col("seq") * 1000).alias("ts_ns"), F.concat(F.lit("SYM"), "sym").alias("stock"), F.col("seq").alias("match"))


WIRE_FIELDS = f"""WITH {WIRE_SQL} SELECT type, CAST(sym + 1 AS BIGINT) AS stock_locate, CAST(3 AS BIGINT) AS tracking, {itch.OPEN_NS} + seq * 1000 AS ts_ns, ref, side, qty,
 CASE WHEN type = 'A' THEN 'SYM' || sym END AS stock, price, CASE WHEN type = 'E' THEN seq END AS "match" FROM tape"""


@query(WIRE_FIELDS)
def s4_wire_columns(spark, sf_dir):
    """Messages encoded to frames and decoded again, all in columns."""
    return itch.decode(itch.encode(_messages(wire_tape(spark, sf_dir))).select("frame"))


@query(WIRE_FIELDS)
def s2_wire_files(spark, sf_dir):
    """Frames written to a file for each sym and read by the data source."""
    folder = scratch(spark, "wire")
    itch.write_wire(itch.encode(_messages(wire_tape(spark, sf_dir))), folder).collect()  # a row a file
    return itch.decode(itch.read_wire(spark, folder).select("frame"))


@query(f"""WITH {WIRE_SQL} SELECT sym, count(*) AS frames, CAST(sum(CASE type WHEN 'A' THEN 38 WHEN 'E' THEN 33 WHEN 'X' THEN 25 ELSE 21 END) AS BIGINT) AS bytes_consumed, true AS clean_eof FROM tape GROUP BY sym""")
def s3_wire_status(spark, sf_dir):
    """S3: for each file its frames, bytes consumed and whether it ended clean."""
    folder = scratch(spark, "wire")
    itch.write_wire(itch.encode(_messages(wire_tape(spark, sf_dir))), folder).collect()
    return itch.read_wire(spark, folder, status=True).select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("int").alias("sym"), "frames", "bytes_consumed", "clean_eof")


def _replayed(spark, sf_dir, capacity):
    """The tape as its journal gives it back, one journal for each sym."""
    folder = scratch(spark, "journal")
    itch.write_wire(itch.encode(_messages(wire_tape(spark, sf_dir))), folder, journal_capacity=capacity).collect()
    frames = itch.read_wire(spark, folder)
    fields = itch.decode(frames.withColumn("sym", F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("int")).drop("path"))
    return fields.select("sym", F.col("pos").alias("seq"), "type", "ref", itch.to_side(F.col("side")).alias("side"), "price", "qty")


@query(f"{TOPS}, l AS (SELECT sym, arg_max(bid_px, seq) AS best_bid, arg_max(ask_px, seq) AS best_ask FROM tops GROUP BY sym), f AS (SELECT sym, count(*) FILTER (type = 'E' AND removed > 0) AS trades, CAST(coalesce(sum(removed) FILTER (type = 'E'), 0) AS BIGINT) AS lots FROM orders GROUP BY sym) SELECT sym, trades, lots, best_bid, best_ask, true AS equal FROM f JOIN l USING (sym)")
def t9_replay_equal(spark, sf_dir):
    """Each sym's end state from its journal, and whether it equals the live one."""
    live, again = (kernel.book_state(t, BASE) for t in (wire_tape(spark, sf_dir), _replayed(spark, sf_dir, 1 << 40)))
    same = [F.col(f"live.{c}") == F.col(f"again.{c}") for c in live.columns]
    both = live.alias("live").join(again.alias("again"), F.col("live.sym") == F.col("again.sym"))
    equal = same[0]
    for s in same[1:]:
        equal = equal & s
    return both.select(*(F.col(f"again.{c}") for c in ("sym", "trades", "lots", "best_bid", "best_ask")), equal.alias("equal"))


@query(f"""WITH {WIRE_SQL}, b AS (SELECT sym, seq, CASE type WHEN 'A' THEN 38 WHEN 'E' THEN 33 WHEN 'X' THEN 25 ELSE 21 END AS n FROM tape),
c AS (SELECT *, sum(n) OVER (PARTITION BY sym ORDER BY seq) AS upto FROM b) SELECT sym, CAST(sum(n) FILTER (upto <= 20000) AS BIGINT) AS committed, CAST(coalesce(sum(n) FILTER (upto > 20000), 0) AS BIGINT) AS dropped FROM c GROUP BY sym""")
def s8_journal_full(spark, sf_dir):
    """A journal of 20,000 bytes: what is committed, and what is dropped from the first frame that doesn't fit."""
    said = itch.write_wire(itch.encode(_messages(wire_tape(spark, sf_dir))), scratch(spark, "journal"), journal_capacity=20_000)
    return said.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("int").alias("sym"), "committed", "dropped")


LEVELS = f"""{DEPTH}, t AS (SELECT sym, coalesce(max(price) FILTER (side = 'B'), -1) AS bb, coalesce(min(price) FILTER (side = 'S'), -1) AS ba FROM final GROUP BY sym),
d AS (SELECT sym, map_from_entries(list((price, depth))) AS m FROM (SELECT sym, price, sum(depth)::BIGINT AS depth FROM final GROUP BY ALL) GROUP BY sym),
v AS (SELECT sym, list_concat([bb, ba], list_transform(generate_series({BASE}, {BASE + 65535}), lambda p: coalesce(m[p], 0))) AS x FROM t JOIN d USING (sym))
SELECT sym, CAST(list_reduce(list_transform(x, lambda a: CASE WHEN a < 0 THEN (18446744073709551616::HUGEINT + a)::UHUGEINT ELSE a::UHUGEINT END), lambda h, a: (xor(h, a) * {scalars.FNV_PRIME}::UHUGEINT) & {HASH64}, {scalars.FNV_OFFSET}::UHUGEINT) AS DECIMAL(20, 0)) AS fingerprint FROM v"""


@query(LEVELS)
def a6_book_fingerprint(spark, sf_dir):
    """FNV-1a over best prices and every level of the ladder."""
    return kernel.book_state(wire_tape(spark, sf_dir), BASE).select("sym", "fingerprint")


@query(f"{SIGNALS} SELECT * FROM sig")
def m10_kernel_signals(spark, sf_dir):
    """M7, M8, M9, M10, P5 by the kernel: equal to the windows' signals where adds never cross."""
    return kernel.book_signals(wire_tape(spark, sf_dir))


@query(f"{SIGNALS} SELECT * FROM sig")
def t1_stream_signals(spark, sf_dir):
    """The same from micro-batches, with each sym's book as state."""
    from tickloom.streaming.book_stream import run_available

    tape = staged(wire_tape(spark, sf_dir), "whole")
    source = scratch(spark, "tape")
    first = (tape.agg(F.max("seq")).first()[0] or 0) // 2
    for part in (tape.where(F.col("seq") <= first), tape.where(F.col("seq") > first)):  # two micro-batches, in order
        part.coalesce(1).write.mode("append").parquet(source)
    return run_available(spark, source, scratch(spark, "signals"), tape.schema)


#: The matching engine in SQL: one step of the recursion is one message of each sym; the book is a list of orders.
ORDER = "STRUCT(k BIGINT, prio BIGINT, ref BIGINT, side VARCHAR, price BIGINT, qty BIGINT)"
MATCH = f"""WITH RECURSIVE {CROSS_SQL},
ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY seq) AS i FROM tape),
run AS (
  SELECT DISTINCT sym, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::BIGINT AS taker, []::{ORDER}[] AS book, []::STRUCT(ref BIGINT, price BIGINT, qty BIGINT)[] AS done FROM ev
  UNION ALL
  SELECT sym, i, seq, ref,
         list_concat(away, list_concat(
           list_filter(list_transform(met, lambda o, n: struct_pack(k := o.k, prio := o.prio, ref := o.ref, side := o.side, price := o.price, qty := o.qty - fills[n])), lambda o: o.qty > 0),
           CASE WHEN qty > coalesce(list_sum(fills), 0) THEN [struct_pack(k := CASE WHEN side = 'S' THEN price ELSE -price END, prio := i, ref := ref, side := side, price := price, qty := CAST(qty - coalesce(list_sum(fills), 0) AS BIGINT))] ELSE []::{ORDER}[] END)),
         list_filter(list_transform(met, lambda o, n: struct_pack(ref := o.ref, price := o.price, qty := fills[n])), lambda t: t.qty > 0)
  FROM (SELECT *, list_transform(met, lambda o, n: CAST(least(o.qty, greatest(0, qty - coalesce(list_sum(list_transform(met[1:n - 1], lambda x: x.qty)), 0))) AS BIGINT)) AS fills
        FROM (SELECT e.*,
                list_sort(list_filter(r.book, lambda o: e.type = 'A' AND o.side <> e.side AND CASE WHEN e.side = 'B' THEN o.price <= e.price ELSE o.price >= e.price END)) AS met,
                list_filter(r.book, lambda o: CASE WHEN e.type = 'A' THEN NOT (o.side <> e.side AND CASE WHEN e.side = 'B' THEN o.price <= e.price ELSE o.price >= e.price END) ELSE o.ref <> e.ref END) AS away
              FROM run r JOIN ev e ON e.sym = r.sym AND e.i = r.i + 1))
)"""
MATCH_TRADES = f"{MATCH} SELECT sym, seq, CAST(n - 1 AS INTEGER) AS n, t.ref AS maker_ref, taker AS taker_ref, t.price AS price, t.qty AS qty FROM (SELECT sym, seq, taker, unnest(done) AS t, generate_subscripts(done, 1) AS n FROM run)"
MATCH_SIGNALS = f"""{MATCH},
tops AS (SELECT sym, seq, bid_px, CAST(coalesce(list_sum(list_transform(list_filter(book, lambda o: o.side = 'B' AND o.price = bid_px), lambda o: o.qty)), 0) AS BIGINT) AS bid_qty,
                ask_px, CAST(coalesce(list_sum(list_transform(list_filter(book, lambda o: o.side = 'S' AND o.price = ask_px), lambda o: o.qty)), 0) AS BIGINT) AS ask_qty
         FROM (SELECT *, coalesce(list_max(list_transform(list_filter(book, lambda o: o.side = 'B'), lambda o: o.price)), -1) AS bid_px,
                      coalesce(list_min(list_transform(list_filter(book, lambda o: o.side = 'S'), lambda o: o.price)), -1) AS ask_px FROM run WHERE i > 0)),
{PUBLISHED},
{SIGNAL_STEPS} SELECT * FROM sig"""

MAKER = "STRUCT(k BIGINT, prio BIGINT, ref BIGINT, side VARCHAR, price BIGINT, qty BIGINT, hidden BIGINT, display BIGINT, id BIGINT)"


def _by_fills(display="NULL::BIGINT", post_only="false"):
    """The engine in SQL by single fills, for icebergs, post-only adds and engine ids: a step of the recursion is one fill,
    a rest, a rejection or a cancel. todo is what the taker has left, free the stack of released slots."""
    return f"""WITH RECURSIVE {CROSS_SQL},
ev AS MATERIALIZED (SELECT *, {display} AS display, {post_only} AS post_only, row_number() OVER (PARTITION BY sym ORDER BY seq) AS i FROM tape),
run AS (
  SELECT DISTINCT sym, 0::BIGINT AS i, 0::BIGINT AS step, 0::BIGINT AS todo, 0::BIGINT AS n, []::{MAKER}[] AS book, []::STRUCT(slot BIGINT, gen BIGINT)[] AS free, 0::BIGINT AS used,
         NULL::VARCHAR AS outcome, NULL::BIGINT AS maker, NULL::BIGINT AS price, 0::BIGINT AS fill, 0::BIGINT AS removed, NULL::BIGINT AS engine_id FROM ev
  UNION ALL
  SELECT sym, i, step, left_over, CASE WHEN fill > 0 THEN CASE WHEN fresh THEN 1 ELSE n + 1 END ELSE 0 END,
         CASE WHEN type = 'D' THEN list_filter(book, lambda o: o.ref <> ref)
              WHEN fill > 0 THEN list_concat(list_filter(book, lambda o: o.ref <> best.ref),
                CASE WHEN best.qty > fill THEN [struct_pack(k := best.k, prio := best.prio, ref := best.ref, side := best.side, price := best.price, qty := best.qty - fill, hidden := best.hidden, display := best.display, id := best.id)]
                     WHEN best.hidden > 0 THEN [struct_pack(k := best.k, prio := step, ref := best.ref, side := best.side, price := best.price, qty := least(best.display, best.hidden), hidden := best.hidden - least(best.display, best.hidden), display := best.display, id := best.id)]
                     ELSE []::{MAKER}[] END)
              WHEN rests THEN list_append(book, struct_pack(k := CASE WHEN side = 'S' THEN px ELSE -px END, prio := step, ref := ref, side := side, price := px, qty := shown, hidden := todo - shown, display := coalesce(display, 0), id := new_id))
              ELSE book END,
         CASE WHEN gone_id IS NOT NULL THEN list_append(free, struct_pack(slot := (gone_id & 4294967295) - 1, gen := (gone_id >> 32) + 1)) WHEN rests THEN free[:-2] ELSE free END,
         CASE WHEN rests AND len(free) = 0 THEN used + 1 ELSE used END,
         CASE WHEN left_over > 0 THEN NULL WHEN type = 'D' THEN CASE WHEN gone IS NULL THEN 'stale' ELSE 'cancelled' END WHEN barred THEN 'rejected' WHEN fill > 0 THEN 'filled' ELSE 'rested' END,
         CASE WHEN fill > 0 THEN best.ref END, CASE WHEN fill > 0 THEN best.price END, fill,
         CASE WHEN type = 'D' THEN coalesce(gone.qty, 0) ELSE 0 END,
         CASE WHEN type = 'D' OR left_over > 0 THEN NULL WHEN rests THEN new_id WHEN barred THEN 0 ELSE -1 END
  FROM (SELECT *, CASE WHEN fill > 0 THEN todo - fill ELSE 0 END AS left_over, type = 'A' AND best IS NULL AND NOT barred AS rests,
               least(todo, coalesce(display, todo)) AS shown, CASE WHEN type = 'D' THEN gone.id WHEN fill > 0 AND best.qty = fill AND best.hidden = 0 THEN best.id END AS gone_id,
               CASE WHEN len(free) > 0 THEN (free[-1].gen + 1) * 4294967296 + free[-1].slot + 1 ELSE 4294967296 + used + 1 END AS new_id
        FROM (SELECT *, CASE WHEN type = 'A' AND best IS NOT NULL AND NOT barred THEN least(todo, best.qty) ELSE 0 END AS fill
              FROM (SELECT *, fresh AND post_only AND best IS NOT NULL AS barred
                    FROM (SELECT e.sym, e.i, e.type, e.ref, e.side, e.price AS px, e.display, e.post_only, r.step + 1 AS step, r.todo = 0 AS fresh, CASE WHEN r.todo > 0 THEN r.todo ELSE coalesce(e.qty, 0) END AS todo, r.n, r.book, r.free, r.used,
                                 list_sort(list_filter(r.book, lambda o: e.type = 'A' AND o.side <> e.side AND CASE WHEN e.side = 'B' THEN o.price <= e.price ELSE o.price >= e.price END))[1] AS best,
                                 list_filter(r.book, lambda o: e.type = 'D' AND o.ref = e.ref)[1] AS gone
                          FROM run r JOIN ev e ON e.sym = r.sym AND e.i = r.i + (r.todo = 0)::INT))))
)"""

#: The risk gate, likewise.
RISK_SQL = f"""WITH RECURSIVE {LEFT[5:]},
ev AS MATERIALIZED (SELECT *, 1000000000000 + seq * 1000 AS now, row_number() OVER (PARTITION BY sym ORDER BY seq) AS i FROM orders),
run AS (
  SELECT DISTINCT sym, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::INTEGER AS mask, 0::BIGINT AS net, 0::BIGINT AS ob, 0::BIGINT AS os, [{','.join(['0::BIGINT']*RISK['depth'])}] AS stamps, []::BIGINT[] AS taken FROM ev
  UNION ALL
  SELECT sym, i, seq, mask,
         net + CASE WHEN hit AND type = 'E' THEN CASE WHEN side = 'B' THEN removed ELSE -removed END ELSE 0 END,
         CASE WHEN mask = 0 THEN pb WHEN hit AND side = 'B' THEN ob - removed ELSE ob END,
         CASE WHEN mask = 0 THEN ps WHEN hit AND side = 'S' THEN os - removed ELSE os END,
         CASE WHEN mask = 0 THEN list_append(stamps[2:], now) ELSE stamps END,
         CASE WHEN mask = 0 THEN list_append(taken, ref) ELSE taken END
  FROM (SELECT *, CASE WHEN type = 'A' THEN ((shares <= 0 OR shares > {RISK['max_qty']})::INT) | ((price < {RISK['low']} OR price > {RISK['high']})::INT * 2)
                 | ((pb + net > {RISK['position_limit']} OR ps - net > {RISK['position_limit']})::INT * 4) | ((now - stamps[1] < {RISK['window']})::INT * 8) END AS mask,
               type <> 'A' AND list_contains(taken, ref) AS hit
        FROM (SELECT e.sym, e.i, e.seq, e.type, e.side, e.price, e.shares, e.removed, e.ref, e.now, r.net, r.ob, r.os, r.stamps, r.taken,
                     r.ob + CASE WHEN e.side = 'B' THEN e.shares ELSE 0 END AS pb, r.os + CASE WHEN e.side = 'S' THEN e.shares ELSE 0 END AS ps
              FROM run r JOIN ev e ON e.sym = r.sym AND e.i = r.i + 1))
)
SELECT sym, seq, mask, net, ob AS open_buy, os AS open_sell FROM run WHERE mask IS NOT NULL"""


@query(MATCH_TRADES)
def m1_match_trades(spark, sf_dir):
    """Trades of the crossing tape, price then time."""
    return kernel.trades(cross_tape(spark, sf_dir))


@query(MATCH_SIGNALS)
def m1_match_signals(spark, sf_dir):
    """M1 to M9, W2 to W4 on the crossing tape."""
    return kernel.book_signals(cross_tape(spark, sf_dir))


@query(f"""{_by_fills(display="CASE WHEN ref % 3 = 0 THEN 2 END")}
SELECT r.sym, e.seq, CAST(r.n - 1 AS INTEGER) AS n, r.maker AS maker_ref, e.ref AS taker_ref, r.price, r.fill AS qty FROM run r JOIN ev e USING (sym, i) WHERE r.fill > 0""")
def m3_iceberg_trades(spark, sf_dir):
    """M3, M4, M6: every third add is an iceberg that shows two lots."""
    return kernel.trades(cross_tape(spark, sf_dir).withColumn("display", F.when(F.col("ref") % 3 == 0, F.lit(2))))


@query(f"""{_by_fills(post_only="ref % 5 = 0")}
SELECT r.sym, e.seq, e.ref, max(r.outcome) AS outcome, CAST(sum(r.removed) AS BIGINT) AS removed, CAST(sum(r.fill) AS BIGINT) AS traded FROM run r JOIN ev e USING (sym, i) GROUP BY ALL""")
def p4_post_only_rejects(spark, sf_dir):
    """Outcomes when every fifth add is post-only."""
    tape = cross_tape(spark, sf_dir).withColumn("display", F.lit(None).cast("bigint")).withColumn("post_only", F.col("ref") % 5 == 0)
    return kernel.outcomes(tape)


@query(f"""{RESTING.replace('rest AS', 'unused AS')}, c AS (SELECT o.sym, o.seq, o.removed, o.type FROM orders o) SELECT sym, seq, removed FROM c WHERE type <> 'A'""")
def m7_kernel_reductions(spark, sf_dir):
    """M7, M8, Q4: quantities that the kernel removes, equal to the windows' on the wire tape."""
    return kernel.outcomes(wire_tape(spark, sf_dir)).where("outcome in ('reduced', 'cancelled', 'stale')").select("sym", "seq", "removed")


@query(RISK_SQL)
def r2_risk_gate(spark, sf_dir):
    """Stateful risk verdicts for every add."""
    return kernel.risk_verdicts(wire_tape(spark, sf_dir), RISK)


LOOP = RISK | {"max_qty": 5, "low": MID - 40, "high": MID + 40, "position_limit": 3, "window": 2000}

#: The closed loop: a feed message (phase 0), then the quotes of both sides if it changed the top (1 and 2); qty of a quote is 1.
LOOP_SQL = f"""WITH RECURSIVE {WIRE_SQL},
ev AS MATERIALIZED (SELECT *, 1000000000000 + seq * 1000 AS now, row_number() OVER (PARTITION BY sym ORDER BY seq) AS i FROM tape),
run AS (
  SELECT DISTINCT sym, 0::BIGINT AS i, 0 AS phase, []::{ORDER}[] AS book, [-1, 0, -1, 0]::BIGINT[] AS last, NULL::BIGINT AS mine_b, NULL::BIGINT AS mine_s, 0::BIGINT AS live_b, 0::BIGINT AS live_s,
         0::BIGINT AS ob, 0::BIGINT AS os, [{','.join(['0::BIGINT'] * LOOP['depth'])}] AS stamps, 0::BIGINT AS step, NULL::BIGINT AS seq, NULL::VARCHAR AS side, NULL::BIGINT AS price, NULL::INTEGER AS mask, NULL::BIGINT AS traded FROM ev
  UNION ALL
  SELECT sym, i, CASE WHEN phase = 0 THEN 1 WHEN phase = 1 AND changed THEN 2 ELSE 0 END,
         list_concat(away, list_concat(
           list_filter(list_transform(met, lambda o, n: struct_pack(k := o.k, prio := o.prio, ref := o.ref, side := o.side, price := o.price, qty := o.qty - fills[n])), lambda o: o.qty > 0),
           CASE WHEN tqty > coalesce(list_sum(fills), 0) THEN [struct_pack(k := CASE WHEN tside = 'S' THEN tpx ELSE -tpx END, prio := step, ref := tref, side := tside, price := tpx, qty := CAST(tqty - coalesce(list_sum(fills), 0) AS BIGINT))] ELSE []::{ORDER}[] END)),
         top, CASE WHEN accepted AND phase = 1 THEN want ELSE mine_b END, CASE WHEN accepted AND phase = 2 THEN want ELSE mine_s END,
         CASE WHEN accepted AND phase = 1 THEN tref ELSE live_b END, CASE WHEN accepted AND phase = 2 THEN tref ELSE live_s END,
         CASE WHEN accepted AND phase = 1 AND mine_b IS NULL THEN ob + 1 ELSE ob END, CASE WHEN accepted AND phase = 2 AND mine_s IS NULL THEN os + 1 ELSE os END,
         CASE WHEN accepted THEN list_append(stamps[2:], now) ELSE stamps END, step,
         CASE WHEN quoting THEN seq END, CASE WHEN quoting THEN CASE phase WHEN 1 THEN 'B' ELSE 'S' END END, CASE WHEN quoting THEN want END, CASE WHEN quoting THEN mask END, CASE WHEN quoting THEN CAST(coalesce(list_sum(fills), 0) AS BIGINT) END
  FROM (SELECT *, list_transform(met, lambda o, n: CAST(least(o.qty, greatest(0, tqty - coalesce(list_sum(list_transform(met[1:n - 1], lambda x: x.qty)), 0))) AS BIGINT)) AS fills
  FROM (SELECT *, list_sort(list_filter(base, lambda o: tqty > 0 AND o.side <> tside AND CASE WHEN tside = 'B' THEN o.price <= tpx ELSE o.price >= tpx END)) AS met,
               list_filter(base, lambda o: NOT (tqty > 0 AND o.side <> tside AND CASE WHEN tside = 'B' THEN o.price <= tpx ELSE o.price >= tpx END)) AS away
  FROM (SELECT *, CASE WHEN phase = 0 AND type = 'A' THEN eref WHEN accepted THEN -(2 * seq + phase) END AS tref,
               CASE WHEN phase = 0 AND type = 'A' THEN eside WHEN accepted THEN CASE phase WHEN 1 THEN 'B' ELSE 'S' END END AS tside,
               CASE WHEN phase = 0 AND type = 'A' THEN eprice WHEN accepted THEN want END AS tpx, CASE WHEN phase = 0 AND type = 'A' THEN eqty WHEN accepted THEN 1 ELSE 0 END AS tqty,
               list_filter(list_transform(book, lambda o: struct_pack(k := o.k, prio := o.prio, ref := o.ref, side := o.side, price := o.price, qty := CAST(o.qty - CASE
                 WHEN phase = 0 AND o.ref = eref AND type = 'D' THEN o.qty WHEN phase = 0 AND o.ref = eref AND type IN ('E', 'X') THEN greatest(eqty, 0)
                 WHEN accepted AND o.ref = CASE phase WHEN 1 THEN live_b ELSE live_s END THEN o.qty ELSE 0 END AS BIGINT))), lambda o: o.qty > 0) AS base
  FROM (SELECT *, quoting AND mask = 0 AS accepted
  FROM (SELECT *, CASE WHEN quoting THEN ((want < {LOOP['low']} OR want > {LOOP['high']})::INT * 2) | ((ob + (phase = 1)::INT > {LOOP['position_limit']} OR os + (phase = 2)::INT > {LOOP['position_limit']})::INT * 4)
                 | ((now - stamps[1] < {LOOP['window']})::INT * 8) END AS mask
  FROM (SELECT *, (phase = 1 AND changed AND top[1] >= 0 AND want IS DISTINCT FROM mine_b) OR (phase = 2 AND top[3] >= 0 AND want IS DISTINCT FROM mine_s) AS quoting
  FROM (SELECT *, CASE phase WHEN 1 THEN top[1] - (top[2] < top[4])::INT WHEN 2 THEN top[3] + (top[2] >= top[4])::INT END AS want, phase = 1 AND top <> last AS changed
  FROM (SELECT *, CASE WHEN phase = 1 THEN [bb, coalesce(list_sum(list_transform(list_filter(book, lambda o: o.side = 'B' AND o.price = bb), lambda o: o.qty)), 0)::BIGINT,
                                            ba, coalesce(list_sum(list_transform(list_filter(book, lambda o: o.side = 'S' AND o.price = ba), lambda o: o.qty)), 0)::BIGINT] ELSE last END AS top
  FROM (SELECT e.sym, e.i, e.seq, e.now, e.type, e.ref AS eref, e.side AS eside, e.price AS eprice, e.qty AS eqty, r.phase, r.book, r.last, r.mine_b, r.mine_s, r.live_b, r.live_s, r.ob, r.os, r.stamps, r.step + 1 AS step,
               coalesce(list_max(list_transform(list_filter(r.book, lambda o: o.side = 'B'), lambda o: o.price)), -1) AS bb, coalesce(list_min(list_transform(list_filter(r.book, lambda o: o.side = 'S'), lambda o: o.price)), -1) AS ba
        FROM run r JOIN ev e ON e.sym = r.sym AND e.i = r.i + (r.phase = 0)::INT)))))))))
)
SELECT sym, seq, side, price, mask, traded FROM run WHERE seq IS NOT NULL"""


@query(LOOP_SQL)
def t6_closed_loop(spark, sf_dir):
    """The strategy's gated quotes between feed messages."""
    return kernel.closed_loop(wire_tape(spark, sf_dir), LOOP)


@query()
def s5_generated_feed(spark, sf_dir):
    """Fills of a generated session of 20,000 messages."""
    rows = itch.generate_feed(20_000, 0x17C4)
    schema = "seq bigint, ts_ns bigint, type string, ref bigint, side string, qty bigint, price bigint, match bigint"
    tape = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).withColumn("sym", F.lit(0))
    return S.fills(S.remaining(tape))


@query()
def s15_crossing_workload(spark, sf_dir):
    """Trades and lots of a generated crossing workload of 20,000 orders."""
    rows = itch.crossing_workload(20_000, 7)
    schema = "seq bigint, type string, ref bigint, side string, price bigint, qty bigint"
    tape = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).withColumn("sym", F.lit(0))
    return kernel.trades(tape).groupBy("sym").agg(F.count(F.lit(1)).alias("trades"), F.sum("qty").alias("lots"))


@query(f"""WITH {WIRE_SQL}, a AS (SELECT sym, (ref::UHUGEINT * {scalars.SPARSE_MULTIPLIER}::UHUGEINT) & {HASH64} AS key, qty AS shares FROM tape WHERE type = 'A'),
m AS (SELECT *, (ref::UHUGEINT * {scalars.SPARSE_MULTIPLIER}::UHUGEINT) & {HASH64} AS key FROM tape WHERE type = 'E')
SELECT sym, count(*) AS executes, CAST(sum(shares) AS BIGINT) AS shares FROM m JOIN a USING (sym, key) GROUP BY sym""")
def j6_sparse_gateway(spark, sf_dir):
    """Executes find their adds by sparse 64-bit keys."""
    tape = wire_tape(spark, sf_dir).withColumn("key", scalars.sparse_key("ref"))
    adds = tape.where("type = 'A'").select("sym", "key", F.col("qty").alias("shares"))
    return tape.where("type = 'E'").select("sym", "key").join(adds, ["sym", "key"]).groupBy("sym").agg(F.count(F.lit(1)).alias("executes"), F.sum("shares").alias("shares"))


@query(f"""{TOPS}, c AS (SELECT *, max(seq) OVER (PARTITION BY sym, seq // 256) AS sent FROM pub)
SELECT c.sym, c.seq, c.sent, epoch_us(b.ts) - epoch_us(a.ts) AS latency_us FROM c JOIN events a ON a.event_id = c.seq JOIN events b ON b.event_id = c.sent""")
def j12_origin_latency(spark, sf_dir):
    """Time from the message that caused an update to the update that is sent for its range."""
    sent = F.max("seq").over(Window.partitionBy("sym", F.expr("seq div 256")))
    updates = _tops(spark, sf_dir).select("sym", "seq", sent.alias("sent"))
    times = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a, b = times.withColumnsRenamed({"id": "seq", "us": "us_a"}), times.withColumnsRenamed({"id": "sent", "us": "us_b"})
    return updates.join(a, "seq").join(b, "sent").select("sym", "seq", "sent", (F.col("us_b") - F.col("us_a")).alias("latency_us"))


@query(f"""{LEFT}, f AS (SELECT o.sym, o.seq, o.price, o.removed, time_bucket(INTERVAL 1 HOUR, e.ts) AS bar FROM orders o JOIN events e ON e.event_id = o.seq WHERE o.type = 'E' AND o.removed > 0)
SELECT sym, epoch_us(bar) AS bar_us, arg_min(price, seq) AS first, max(price) AS high, min(price) AS low, arg_max(price, seq) AS last, CAST(sum(removed) AS BIGINT) AS lots, CAST(sum(price * removed) // sum(removed) AS BIGINT) AS vwap FROM f GROUP BY sym, bar""")
def x_fill_bars(spark, sf_dir):
    """An extension: first, high, low, last, lots and volume-weighted price of fills, by event-time hour."""
    times = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    hit = _left(spark, sf_dir).where("type = 'E' and removed > 0").join(times, "seq")
    bars = hit.groupBy("sym", F.window("at", "1 hour").alias("w")).agg(
        F.min_by("price", "seq").alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("last"),
        F.sum("removed").alias("lots"), F.expr("sum(price * removed) div sum(removed)").alias("vwap"))
    return bars.select("sym", F.unix_micros("w.start").alias("bar_us"), "first", "high", "low", "last", "lots", "vwap")


@query(f"""{_by_fills()} SELECT r.sym, e.seq, e.ref, r.engine_id FROM run r JOIN ev e USING (sym, i) WHERE r.engine_id IS NOT NULL""")
def m11_engine_ids(spark, sf_dir):
    """Engine ids of resting orders, by slots of last-in first-out reuse."""
    from tickloom.operators.slots import engine_ids

    return engine_ids(cross_tape(spark, sf_dir))


_HEX = lambda x, n: f"lpad(to_hex(CAST({x} AS UBIGINT)), {2 * n}, '0')"


@query(f"""WITH {WIRE_SQL},
body AS (SELECT sym, seq, {_HEX("ascii(type)", 1)} || {_HEX("sym + 1", 2)} || {_HEX("3", 2)} || {_HEX(f"{itch.OPEN_NS} + seq * 1000", 6)} || {_HEX("ref", 8)} ||
  CASE type WHEN 'A' THEN {_HEX("ascii(side)", 1)} || {_HEX("qty", 4)} || rpad(hex('SYM' || sym), 16, '20') || {_HEX("price", 4)} WHEN 'E' THEN {_HEX("qty", 4)} || {_HEX("seq", 8)} WHEN 'X' THEN {_HEX("qty", 4)} ELSE '' END AS h FROM tape),
frames AS (SELECT sym, {_HEX("len(h) // 2", 2)} || h AS h, CAST(sum(len(h) // 2 + 2) OVER (PARTITION BY sym ORDER BY seq) AS BIGINT) AS upto FROM body),
hit AS (SELECT sym, upto, h, len(h) // 2 AS n, CAST(ceil((upto - len(h) // 2) / 4096.0) * 4096 AS BIGINT) AS place FROM frames)
SELECT sym, max(upto) AS length, CAST(coalesce(sum(CASE WHEN place < upto THEN CAST('0x' || substr(h, 2 * (place - upto + n) + 1, 2) AS BIGINT) END), 0) AS BIGINT) AS checksum FROM hit GROUP BY sym""")
def a16_file_checksum(spark, sf_dir):
    """For each wire file, its bytes and the sum of the bytes at every 4096th place."""
    folder = scratch(spark, "wire")
    itch.write_wire(itch.encode(_messages(wire_tape(spark, sf_dir))), folder).collect()
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "content")
    places = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(4096).cast("bigint")), lambda i: F.conv(F.hex(F.substring("content", (i + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint"))
    return files.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("int").alias("sym"), "length", F.aggregate(places, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


@query(f"""WITH {WIRE_SQL}, k AS (SELECT *, ref % 64 AS key FROM tape),
v AS (SELECT *, last_value(CASE WHEN type IN ('A', 'D') THEN struct_pack(t := type, q := qty) END IGNORE NULLS) OVER (PARTITION BY sym, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM k),
c AS (SELECT *, CASE WHEN type = 'A' AND coalesce(held.t, 'D') = 'D' THEN 1 WHEN type = 'D' AND held.t = 'A' THEN -1 ELSE 0 END AS change FROM v)
SELECT sym, seq, key, CAST(CASE WHEN held.t = 'A' THEN held.q ELSE 0 END AS BIGINT) AS value, CAST(sum(change) OVER (PARTITION BY sym ORDER BY seq) AS BIGINT) AS size FROM c""")
def j2_map_overwrite(spark, sf_dir):
    """A map of 64 keys a sym: an add puts its quantity (over what is there), a delete erases; what each message
    finds under its key before it acts, and the map's size after it."""
    return S.map_history(wire_tape(spark, sf_dir).withColumn("key", F.col("ref") % 64))


@query(PROBE)
def f8_level_bits(spark, sf_dir):
    """The same neighbours by scans of a set of bits, one for each sym's ladder."""
    from tickloom.operators.slots import scan_levels

    return scan_levels(S.depth_final(_left(spark, sf_dir)).select("sym", "price").distinct(), BASE, range(MID - 40, MID + 41))


@query(f"""WITH {CROSS_SQL}, p AS (SELECT sym, seq, CASE WHEN seq % 11 = 0 THEN {BASE} - 1 WHEN seq % 13 = 0 THEN {BASE} + 65536 ELSE price END AS price, CASE WHEN seq % 7 = 0 THEN 0 ELSE qty END AS qty, CASE WHEN ref % 3 = 0 THEN seq % 4 - 1 END AS display FROM tape WHERE type = 'A')
SELECT sym, seq, display IS NOT NULL AS iceberg, price BETWEEN {BASE} AND {BASE + 65535} AND qty > 0 AND coalesce(display > 0, true) AS accepted FROM p""")
def p2_iceberg_validation(spark, sf_dir):
    """An iceberg must show a positive quantity, too; verdicts of the engine on books of their own."""
    t = cross_tape(spark, sf_dir).where("type = 'A'").select(
        "sym", "seq", "ref", "type", "side", F.when(F.col("seq") % 11 == 0, BASE - 1).when(F.col("seq") % 13 == 0, BASE + 65536).otherwise(F.col("price")).cast("bigint").alias("price"),
        F.when(F.col("seq") % 7 == 0, 0).otherwise(F.col("qty")).cast("bigint").alias("qty"), F.when(F.col("ref") % 3 == 0, F.col("seq") % 4 - 1).cast("bigint").alias("display"))
    said = kernel.outcomes(t, base=BASE).select("sym", "seq", (F.col("outcome") != "rejected").alias("accepted"))
    return t.select("sym", "seq", F.col("display").isNotNull().alias("iceberg")).join(said, ["sym", "seq"])


@query(f"""WITH {WIRE_SQL}, t AS (SELECT sym, type, epoch_us(e.ts) AS us FROM tape JOIN events e ON e.event_id = tape.seq)
SELECT sym, count(*) AS messages, count(*) FILTER (type = 'A') AS adds, max(us) - min(us) AS span_us, CAST(count(*) * 60000000 // nullif(max(us) - min(us), 0) AS BIGINT) AS messages_a_minute FROM t GROUP BY sym""")
def a14_throughput(spark, sf_dir):
    """Messages and adds of each sym, and messages a minute of event time."""
    times = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    t = wire_tape(spark, sf_dir).join(times, "seq").groupBy("sym").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("type") == "A").alias("adds"), (F.max("us") - F.min("us")).alias("span_us"))
    return t.withColumn("messages_a_minute", F.expr("messages * 60000000 div nullif(span_us, 0)"))


@query(f"{SIGNALS} SELECT sym, count(*) AS updates, count(*) AS journalled, max(pub_seq) AS last_pub, arg_max(ofi, pub_seq) AS ofi FROM sig GROUP BY sym")
def t5_drain_and_tap(spark, sf_dir):
    """A stream of updates drained by a consumer, and a tap that journals each batch before it; both complete and in order."""
    from tickloom.streaming.book_stream import drain, stream_signals

    tape, source, got = staged(wire_tape(spark, sf_dir), "whole"), scratch(spark, "tape"), scratch(spark, "drained")
    cuts = [r.q for r in tape.agg(F.expr("explode(percentile_approx(seq, array(0.3, 0.6)))").alias("q")).collect()]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):  # micro-batches, in order
        inside = (F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high)
        tape.where(inside).coalesce(1).write.mode("append").parquet(source)
    updates = stream_signals(spark.readStream.schema(tape.schema).option("maxFilesPerTrigger", 1).parquet(source))
    write = lambda kind: lambda batch, number: batch.write.mode("overwrite").parquet(f"{got}/{kind}/batch={number}")
    drain(updates, write("consumed"), f"{got}-checkpoint", write("journal")).awaitTermination()
    consumed, journal = (spark.read.parquet(f"{got}/{kind}") for kind in ("consumed", "journal"))
    said = journal.groupBy("sym").agg(F.countDistinct("pub_seq").alias("journalled"))
    per = consumed.groupBy("sym").agg(F.countDistinct("pub_seq").alias("updates"), F.max("pub_seq").alias("last_pub"), F.max_by("ofi", "pub_seq").alias("ofi"))
    return per.join(said, "sym").select("sym", "updates", "journalled", "last_pub", "ofi")
