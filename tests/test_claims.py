"""Reading of attributed counts, and books as change points, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators import book, claims

READ = [
    ("", []),
    (None, []),
    ("ABC printed three sweeps.", [(["ABC"], 3, "sweep", "sweeps")]),
    ("Three sweeps hit ABC.", [(["ABC"], 3, "sweep", "sweeps")]),
    ("Of BRK.B it is told: 1,204 quote pulls.", [(["BRK.B"], 1204, "liquidity_withdrawal", "quote pulls")]),
    ("ABC rose while 4 halts came to nobody.", []),
    ("ABC rose while 4 halts came across XYZ.", [(["XYZ"], 4, "halt", "halts")]),
    ("ABC, DEF and GHI together had twelve icebergs.", [(["ABC", "DEF", "GHI"], 12, "iceberg", "icebergs")]),
    ("ABC and DEF jointly gave 5 events; DEF alone 2 volume spikes.", [(["ABC", "DEF"], 5, None, "events"), (["DEF"], 2, "volume_deviation", "volume spikes")]),
    ("ABC together had 5 halts.", [(["ABC"], 5, "halt", "halts")]),
    ("ABC had 9 events between sweeps and drift events.", [(["ABC"], 9, None, "events")]),
    ("ABC saw twenty-two halts.", []),
    ("ABC saw hundreds of halts.", []),
    ("Abc saw 2 halts.", []),
    ("ABC printed three sweeps. 2 halts on DEF.", [(["ABC"], 3, "sweep", "sweeps"), (["ABC"], 2, "halt", "halts")]),
    ("ABC saw 3 depth-contractions.", [(["ABC"], 3, "liquidity_withdrawal", "depth-contractions")]),
    ("ABC " + "word " * 12 + "3 halts.", []),
]


@pytest.mark.parametrize("text, want", READ)
def test_read_claims(text, want):
    assert claims.read_claims(text) == want


def test_judged(spark):
    texts = spark.createDataFrame([(1, "ABC printed three sweeps. 2 halts on DEF."), (2, "ABC and DEF together had 8 events."), (3, "XYZ saw 1 halt."), (4, None), (5, "DEF saw 4 sweeps.")], "doc_id bigint, text string")
    counts = spark.createDataFrame([("ABC", "sweep", 3), ("ABC", "halt", 1), ("DEF", "halt", 4)], "symbol string, scorer_id string, n bigint")
    got = sorted((r.doc_id, r.claim_no, r.claimed, r.actual, r.verdict) for r in claims.judged(claims.attributed_counts(texts), counts).collect())
    assert got == [(1, 0, 3, 3, "right"), (1, 1, 2, 1, "wrong"), (2, 0, 8, 8, "right"), (3, 0, 1, None, "unknown_symbol"), (5, 0, 4, 0, "wrong")]


@pytest.mark.parametrize("piece", [10**9, 50, 7])
def test_change_points_equal_whole_books(spark, piece):
    """Best and protected prices at any time equal those of all levels listed at that time, however time is cut."""
    rng, rows, t = random.Random(9), [], 100
    for _ in range(500):
        t += rng.choice([0, 1, 1, 3, 40])
        rows.append(("2024-01-01", rng.choice("AB"), rng.choice("85"), 1000 + rng.randrange(8) * 10, t, rng.choice([0, 0, 10, 40, 90, 120])))
    last = {r[:5]: r for r in rows}  # one size for each level and time
    sizes = spark.createDataFrame(list(last.values()), "trading_date string, symbol string, side string, price_raw bigint, ts_nanos bigint, level_size bigint").withColumn("trading_date", F.to_date("trading_date"))
    asked = spark.createDataFrame([("2024-01-01", s, q, q * 2 + (s == "B")) for q in range(90, t + 30, 11) for s in "AB"], "trading_date string, symbol string, ts_nanos bigint, request bigint").withColumn("trading_date", F.to_date("trading_date"))
    for lot in (F.lit(100), F.lit(1)):
        got = {r.request: r.best for r in book.best_at(book.best_points(sizes, lot, piece), asked).collect()}
        for r in asked.collect():
            levels = {}
            for row in sorted(last.values(), key=lambda x: x[4]):
                if row[1] == r.symbol and row[4] <= r.ts_nanos:
                    levels[row[2], row[3]] = row[5]
            want = []
            for side in "85":
                upto, found = 0, (0, 0)
                for price in sorted((p for (s, p), n in levels.items() if s == side and n), reverse=side == "8"):
                    upto += levels[side, price]
                    if upto >= (100 if "100" in str(lot) else 1):
                        found = price, upto
                        break
                want += found
            best = got[r.request]
            assert (best is None and not levels) or list(best)[:4] == want
            if best is not None:
                assert best.bid_total == sum(n for (s, _), n in levels.items() if s == "8") and best.ask_levels == sum(1 for (s, _), n in levels.items() if s == "5" and n)
