"""Book operators as windows, joins and aggregates. Exact while adds never cross (the wire tape)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.scratch import staged

#: Messages' seq are cut into ranges of so many when levels are joined to the messages that they last for.
SEQ_RANGE = 2048
#: What runs on over a sym's messages does so within ranges of so many seq, each a task's, and from range to range.
RUN_RANGE = 65_536


def running(rows: DataFrame, sums: dict[str, Column], key: str = "sym", order: str = "seq", width: int | None = None) -> DataFrame:
    """rows with the sum of each of `sums` over the key's rows up to and with each row, in order.

    Ranges of order are summed first; those sums run on over a table of one row a range, and rows within their range. So
    a key of any length is shared by many tasks. rows is read twice.
    """
    part = F.expr(f"{order} div {width or RUN_RANGE}")
    rows = rows.withColumns({"part__": part} | {f"{c}__": x for c, x in sums.items()})
    total = rows.groupBy(key, "part__").agg(*(F.sum(f"{c}__").alias(c) for c in sums))
    earlier = Window.partitionBy(key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select(key, "part__", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}__from") for c in sums))
    within = Window.partitionBy(key, "part__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({c: F.sum(f"{c}__").over(within) for c in sums}).join(start, [key, "part__"])
    return placed.withColumns({c: (F.col(c) + F.col(f"{c}__from")).cast("bigint") for c in sums}).drop("part__", *(f"{c}__" for c in sums), *(f"{c}__from" for c in sums))


def before(rows: DataFrame, columns: dict[str, str], key: str = "sym", order: str = "seq", skip_nulls: bool = False, width: int | None = None) -> DataFrame:
    """rows with the value that each of `columns` (name -> source) had in the key's row before, or in the last one where
    it wasn't null; null at first. By ranges, like running(); rows is read twice."""
    rows = rows.withColumn("part__", F.expr(f"{order} div {width or RUN_RANGE}"))
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))) if skip_nulls else F.struct(F.col(c).alias("v"))
    last = rows.groupBy(key, "part__").agg(*(F.max_by(value(c), F.when(value(c).isNotNull(), F.col(order))).alias(out) for out, c in columns.items()))
    parts = Window.partitionBy(key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(key, "part__", *(F.last(out, ignorenulls=True).over(parts).alias(f"{out}__") for out in columns))
    here = Window.partitionBy(key, "part__").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumns({out: F.last(value(c), ignorenulls=True).over(here) for out, c in columns.items()}).join(carry, [key, "part__"])
    return found.withColumns({out: F.coalesce(out, f"{out}__")["v"] for out in columns}).drop("part__", *(f"{out}__" for out in columns))


def remaining(tape: DataFrame) -> DataFrame:
    """sym, seq, type, ref, side, price, shares, removed, remaining: what each message takes off its order, and leaves.

    removed = clamp(q, 0, shares - what earlier messages asked for); a delete asks for all.
    """
    order = Window.partitionBy("sym", "ref").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = tape.select(
        "sym", "seq", "type", "ref", *(F.first(c, ignorenulls=True).over(order).alias(c) for c in ("side", "price")), F.first("qty").over(order).alias("shares"), "qty"
    )
    asked = F.when(F.col("type") == "A", F.lit(0)).when(F.col("type") == "D", F.col("shares")).otherwise(F.col("qty")).cast("bigint")
    rows = rows.withColumn("asked", asked).withColumn("left", F.greatest(F.lit(0), F.col("shares") - F.coalesce(F.sum("asked").over(before), F.lit(0))))
    removed = F.least("asked", "left")
    return rows.select("sym", "seq", "type", "ref", "side", "price", "shares", removed.alias("removed"), (F.col("left") - removed).alias("remaining"))


def fills(left: DataFrame) -> DataFrame:
    """sym, trades, traded_lots of executes that found their order."""
    hit = (F.col("type") == "E") & (F.col("removed") > 0)
    return left.groupBy("sym").agg(F.count_if(hit).alias("trades"), F.coalesce(F.sum(F.when(hit, F.col("removed"))), F.lit(0)).cast("bigint").alias("traded_lots"))


def level_changes(left: DataFrame) -> DataFrame:
    delta = F.when(F.col("type") == "A", F.col("shares")).otherwise(-F.col("removed"))
    return left.select("sym", "seq", "side", "price", delta.alias("delta")).where("delta <> 0")


def depth_history(left: DataFrame) -> DataFrame:
    """sym, seq, side, price, depth: each level's quantity after each message that changes it."""
    level = Window.partitionBy("sym", "side", "price").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return level_changes(left).select("sym", "seq", "side", "price", F.sum("delta").over(level).alias("depth"))


def depth_final(left: DataFrame) -> DataFrame:
    return level_changes(left).groupBy("sym", "side", "price").agg(F.sum("delta").alias("depth")).where("depth > 0")


def tops(left: DataFrame) -> DataFrame:
    """sym, seq, bid_px, bid_qty, ask_px, ask_qty after every message; -1 and 0 for an empty side.

    A level with quantity lasts from the change that made it so to its next change. Those intervals and the
    messages meet by ranges of seq: an equi-join, whose groups are bounded by SEQ_RANGE messages and the levels
    that are alive in them.
    """
    level = Window.partitionBy("sym", "side", "price").orderBy("seq")
    end = left.groupBy("sym").agg((F.max("seq") + 1).alias("end"))
    alive = depth_history(left).withColumn("to", F.lead("seq").over(level)).where("depth > 0").join(end, "sym").withColumn("to", F.coalesce("to", "end"))
    first, last = F.expr(f"seq div {SEQ_RANGE}"), F.expr(f"(to - 1) div {SEQ_RANGE}")
    spread = alive.select("sym", F.explode(F.sequence(first, last)).alias("part"), F.col("seq").alias("since"), "to", "side", "price", "depth")
    messages = left.select("sym", F.expr(f"seq div {SEQ_RANGE}").alias("part"), "seq")
    met = messages.join(spread, (messages["sym"] == spread["sym"]) & (messages["part"] == spread["part"]) & (F.col("seq") >= F.col("since")) & (F.col("seq") < F.col("to")), "left")
    here = F.struct("price", "depth")
    best = met.groupBy(messages["sym"], "seq").agg(F.max(F.when(F.col("side") == "B", here)).alias("bid"), F.min(F.when(F.col("side") == "S", here)).alias("ask"))
    empty = lambda c, x: F.coalesce(c, F.lit(x).cast("bigint"))
    return best.select("sym", "seq", empty(F.col("bid.price"), -1).alias("bid_px"), empty(F.col("bid.depth"), 0).alias("bid_qty"), empty(F.col("ask.price"), -1).alias("ask_px"), empty(F.col("ask.depth"), 0).alias("ask_qty"))


TOP = ["bid_px", "bid_qty", "ask_px", "ask_qty"]
EMPTY = {"bid_px": -1, "bid_qty": 0, "ask_px": -1, "ask_qty": 0}


def top_changes(top: DataFrame) -> DataFrame:
    """Rows where the top differs from the one before, with those before (last_*), a running number pub_seq and the running
    order-flow imbalance ofi. The tops are staged, since they are read again for what runs on from range to range."""
    rows = before(staged(top.select("sym", "seq", F.struct(*TOP).alias("top")), "tops"), {"was": "top"})
    empty = F.struct(*(F.lit(EMPTY[c]).cast("bigint").alias(c) for c in TOP))
    rows = staged(rows.withColumn("was", F.coalesce("was", empty)).where("top <> was"), "changes")
    rows = rows.select("sym", "seq", "top.*", *(F.col(f"was.{c}").alias(f"last_{c}") for c in TOP))
    on = lambda c, x: c.cast("int").cast("bigint") * x
    bp, bq, ap, aq = (F.col(c) for c in TOP)
    lbp, lbq, lap, laq = (F.col(f"last_{c}") for c in TOP)
    flow = on(bp >= lbp, bq) - on(bp <= lbp, lbq) - on(ap <= lap, aq) + on(ap >= lap, laq)
    return running(rows, {"pub_seq": F.lit(1), "ofi": flow})


def signals(changes: DataFrame) -> DataFrame:
    """sym, seq, pub_seq, top, ofi (running), micro_px (1/256 tick, truncated toward zero)."""
    micro = F.expr("((bid_px * ask_qty + ask_px * bid_qty) * 256) div (bid_qty + ask_qty + if(bid_qty + ask_qty = 0, 1, 0))")
    return changes.select("sym", "seq", "pub_seq", *TOP, "ofi", micro.alias("micro_px"))


def conflate(updates: DataFrame, every: int) -> DataFrame:
    """Per sym and range of `every` seq the last update, and how many were dropped for it."""
    part = F.expr(f"seq div {every}")
    last = F.max_by(F.struct("pub_seq", *TOP), "seq").alias("u")
    return updates.groupBy("sym", part.alias("part")).agg(last, (F.count(F.lit(1)) - 1).alias("dropped")).select("sym", "part", "u.*", "dropped")


def seq_gaps(conflated: DataFrame) -> DataFrame:
    order = Window.partitionBy("sym").orderBy("part")
    gap = F.col("pub_seq") != F.lag("pub_seq").over(order) + 1
    return conflated.withColumn("gap", gap).groupBy("sym").agg(F.count(F.lit(1)).alias("published"), F.sum("dropped").alias("dropped"), F.count_if("gap").alias("gaps"))


def quotes(changes: DataFrame) -> DataFrame:
    """sym, seq, side, price: a quote whenever the wanted price differs from the last one sent (no risk rejects)."""
    pressure = F.col("bid_qty") >= F.col("ask_qty")
    want = {
        "B": F.when(F.col("bid_px") >= 0, F.when(pressure, F.col("bid_px")).otherwise(F.col("bid_px") - 1)),
        "S": F.when(F.col("ask_px") >= 0, F.when(pressure, F.col("ask_px") + 1).otherwise(F.col("ask_px"))),
    }
    wide = changes.select("sym", "seq", *(w.alias(s) for s, w in want.items()))
    wide = before(wide, {f"last_{s}": s for s in want}, skip_nulls=True)
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("price"), F.col(f"last_{s}").alias("last")) for s in want))).alias("q")
    return wide.select("sym", "seq", sides).select("sym", "seq", "q.*").where("price is not null and not (price <=> last)").drop("last")


def percentiles(values: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Per key the element of rank floor(p / 100 * (n - 1)) of the sorted values, for each named p.

    Equal values are counted first, before they move, so what is ranked are a key's distinct values.
    """
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c__"))
    upto = F.sum("c__").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c__").over(Window.partitionBy(*keys))
    ranked = counts.select(*keys, value, "c__", upto.alias("upto__"), n.alias("n__"))
    at = lambda p: F.floor(F.lit(p) / 100 * (F.col("n__") - 1))
    here = lambda p: (at(p) < F.col("upto__")) & (at(p) >= F.col("upto__") - F.col("c__"))
    return ranked.groupBy(*keys).agg(F.max("n__").alias("n"), *(F.max(F.when(here(p), F.col(value))).alias(name) for name, p in points.items()), F.max(value).alias("mx"))


def block_averages(values: DataFrame, keys: list[str], order: str, value: str, size: int = 64) -> DataFrame:
    """Per key and block of `size` rows in order: the sum divided by size, whole blocks only."""
    numbered = running(values, {"i__": F.lit(1)}, keys[0], order) if len(keys) == 1 else values.withColumn("i__", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return numbered.groupBy(*keys, F.expr(f"(i__ - 1) div {size}").alias("block")).agg(F.count(F.lit(1)).alias("n__"), F.sum(value).alias("s__")).where(f"n__ = {size}").select(*keys, F.col("block").cast("bigint"), F.expr(f"s__ div {size}").alias("average"))


def neighbour_levels(probes: DataFrame, levels: DataFrame) -> DataFrame:
    """sym, price of the probes with the lowest occupied level at or above it and the highest at or below it (-1: none)."""
    rows = probes.select("sym", "price", F.lit(True).alias("probe"), F.lit(None).cast("bigint").alias("level"))
    rows = rows.unionByName(levels.select("sym", "price", F.lit(False).alias("probe"), F.col("price").alias("level")))
    at = Window.partitionBy("sym").orderBy("price")
    down = F.max("level").over(at.rangeBetween(Window.unboundedPreceding, 0))
    up = F.min("level").over(at.rangeBetween(0, Window.unboundedFollowing))
    none = lambda c: F.coalesce(c, F.lit(-1).cast("bigint"))
    return rows.select("sym", "price", "probe", none(up).alias("next_level"), none(down).alias("prev_level")).where("probe").drop("probe")


def fifo_allocation(resting: DataFrame, side: str, limit: Column, quantity: int) -> DataFrame:
    """Fills of one taker of `quantity` up to a limit, over resting orders (sym, ref, side, price, seq, remaining) of the other side."""
    best = F.col("price") if side == "B" else -F.col("price")
    there = resting.where((F.col("side") != side) & (F.col("remaining") > 0) & (F.col("price") <= limit if side == "B" else F.col("price") >= limit))
    ahead = Window.partitionBy("sym").orderBy(best, "seq").rowsBetween(Window.unboundedPreceding, -1)
    fill = F.least("remaining", F.greatest(F.lit(0), F.lit(quantity).cast("bigint") - F.coalesce(F.sum("remaining").over(ahead), F.lit(0))))
    return there.select("sym", "ref", "price", fill.alias("fill")).where("fill > 0")


def ref_lookups(tape: DataFrame) -> DataFrame:
    """sym, seq, ref, value, live: each E/X/D's look-up of its ref as of then (0 once deleted), and the live refs after it."""
    order = Window.partitionBy("sym", "ref").orderBy("seq")
    gone = F.coalesce(F.max((F.col("type") == "D").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = tape.select("sym", "seq", "type", "ref", F.first("qty").over(order).alias("shares"), gone.alias("gone"))
    change = F.when(F.col("type") == "A", 1).when((F.col("type") == "D") & (F.col("gone") == 0), -1).otherwise(0).cast("bigint")
    rows = running(rows, {"live": change})
    return rows.select("sym", "seq", "type", "ref", F.when(F.col("gone") == 0, F.col("shares")).otherwise(0).cast("bigint").alias("value"), "live").where("type <> 'A'").drop("type")


def map_history(tape: DataFrame) -> DataFrame:
    """sym, seq, key, value, size: what each message finds under its key in its sym's map (0 if nothing), and the map's size
    after it. A puts its qty, over what is there; D erases; others only look."""
    earlier = Window.partitionBy("sym", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col("type").isin("A", "D"), F.struct("type", "qty")), ignorenulls=True).over(earlier)
    rows = tape.select("sym", "seq", "type", "key", held.alias("held"))
    there = F.coalesce(F.col("held.type") == "A", F.lit(False))
    change = F.when((F.col("type") == "A") & ~there, 1).when((F.col("type") == "D") & there, -1).otherwise(0).cast("bigint")
    return running(rows, {"size": change}).select("sym", "seq", "key", F.when(there, F.col("held.qty")).otherwise(0).cast("bigint").alias("value"), "size")


def risk_mask(price: Column, qty: Column, max_qty: int, low: int, high: int) -> Column:
    """The stateless checks: 1 size, 2 collar."""
    size = ((qty <= 0) | (qty > max_qty)).cast("int")
    band = ((price < low) | (price > high)).cast("int") * 2
    return size.bitwiseOR(band)
