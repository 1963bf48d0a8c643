import random

import pytest
from pyspark.sql import functions as F
from tickloom.operators import set_based as S


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_what_runs_on_by_ranges(spark, width):
    """Sums and earlier values by ranges of seq equal those of a plain loop, over gaps, nulls and ranges without rows."""
    rng = random.Random(width)
    rows = [(sym, seq, rng.choice([None, rng.randint(-5, 5)])) for sym in range(3) for seq in sorted(rng.sample(range(500), 120))]
    df = spark.createDataFrame(rows, "sym int, seq bigint, x bigint")
    want = {}
    for sym in range(3):
        total = count = 0
        was = held = None
        for s, seq, x in rows:
            if s == sym:
                total, count = total + (x or 0), count + 1
                want[sym, seq] = (total, count, was, held)
                was, held = x, held if x is None else x
    df = S.running(df, {"total": F.coalesce("x", F.lit(0)), "count": F.lit(1)}, width=width)
    df = S.before(df, {"was": "x"}, width=width)
    df = S.before(df, {"held": "x"}, skip_nulls=True, width=width)
    assert {(r.sym, r.seq): (r.total, r["count"], r.was, r.held) for r in df.collect()} == want


def test_signals_over_many_ranges(spark, monkeypatch):
    rng = random.Random(1)
    tops = [(sym, seq, *rng.choice([(-1, 0, -1, 0), (99, 5, 101, 4), (99, 6, 101, 4), (98, 1, 100, 9), (99, 5, -1, 0)])) for sym in range(2) for seq in range(0, 400, 3)]
    df = spark.createDataFrame(tops, "sym int, seq bigint, bid_px bigint, bid_qty bigint, ask_px bigint, ask_qty bigint")
    whole = [sorted(map(tuple, f(S.top_changes(df)).collect())) for f in (S.signals, S.quotes)]
    monkeypatch.setattr(S, "RUN_RANGE", 10)
    parts = [sorted(map(tuple, f(S.top_changes(df)).collect())) for f in (S.signals, S.quotes)]
    assert whole == parts and len(whole[0]) > 100
