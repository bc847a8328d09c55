"""Tables of days with missing facts and ties, and checks of feeds on odd rows."""

import json

from pyspark.sql import functions as F

from tapewright.operators import book, daybook, patterns, validate

DAY = 1_704_067_200_000_000_000  # 2024-01-01


def told(spark, rows):
    df = spark.createDataFrame([("2024-01-01", s, DAY + h * 3_600_000_000_000, scorer, score, json.dumps(facts)) for scorer, s, h, score, facts in rows], "trading_date string, symbol string, ts_nanos bigint, scorer_id string, score double, breakdown string")
    return daybook.told(df.withColumn("trading_date", F.to_date("trading_date")))


def test_metrics_leave_out_what_is_missing(spark):
    rows = [
        ("halt", "A", 15, 1.0, {"duration_seconds": 65, "reason_label": "news-pending halt"}),
        ("halt", "B", 15, 1.0, {}),
        ("large_trade", "C", 20, 1.0, {"notional": 1234567.89}),
        ("sweep", "D", 15, 1.0, {"n_levels": 4}),
        ("iceberg", "E", 15, 1.0, {"n_rows": 0}),
        ("liquidity_withdrawal", "F", 15, 1.0, {"n_rows": 1200, "removed_pct": 12.345}),
        ("volume_deviation", "G", 0, 3.25, {}),
        ("time_in_book_drift", "H", 0, 2.0, {"direction": "shorter"}),
        ("unheard_of", "I", 15, 1.0, {}),
    ]
    got = {r.symbol: (r.metric, r.at) for r in told(spark, rows).collect()}
    assert got == {
        "A": ("1 minute 5 seconds halt (news-pending halt)", "10:00 ET"), "B": ("halt", "10:00 ET"), "C": ("$1,234,567 block", "15:00 ET"), "D": ("sweep, 4 levels", "10:00 ET"), "E": ("—", "10:00 ET"),
        "F": ("1,200 deletes, 12.3% of book", "10:00 ET"), "G": ("3.3x trailing median", "day-level"), "H": ("2.0x shorter lifetime", "day-level"), "I": ("unheard_of", "10:00 ET"),
    }


def test_ties_are_named_together(spark):
    rows = told(spark, [("sweep", "A", 15, 1.0, {}), ("sweep", "B", 15, 2.0, {}), ("halt", "A", 16, 1.0, {"duration_seconds": 10}), ("halt", "B", 16, 1.0, {"duration_seconds": 7200})])
    assert daybook.bullets(rows).collect()[0].bullets == ["A and B each led with 2 events", "Trading halts and Multi-level sweeps each saw 2 events", "Longest halt: B 2 hours"]
    assert daybook.bullets(rows, 1).collect()[0].bullets == ["A and B each led with 2 events"]
    assert [(r.place, r.symbol) for r in daybook.headlines(rows, 2).orderBy("place").collect()] == [(1, "B"), (2, "A")]
    facts = {(r.scorer_id, r.symbol): r.facts for r in daybook.scorer_tables(rows).collect()}
    assert facts["halt", "A"] == {"duration_seconds": "10"} and facts["sweep", "A"] == {}


def test_transactions_are_compared_at_their_end(spark):
    rows = [("S", "8", 100, 5, seq, declared, flags) for seq, declared, flags in ((0, 1, 0), (1, 2, 1), (2, 3, 3), (3, 9, 2))] + [("S", "8", 100, 6, 4, 7, 0), ("T", "5", 100, 6, 0, 7, 1)]
    df = spark.createDataFrame([("2024-01-01", *r) for r in rows], "trading_date string, symbol string, side string, price_raw bigint, ts_nanos bigint, seq bigint, declared bigint, event_flags int")
    done, skipped = validate.complete_updates(df)
    assert sorted((r.symbol, r.declared) for r in done.collect()) == [("S", 3), ("T", 7)]
    assert sorted(tuple(r) for r in skipped.collect()) == [("S", 3, 1), ("T", 0, 0)]


def test_states_of_books(spark):
    messages = spark.createDataFrame([("2024-01-01", "A", 10), ("2024-01-01", "B", 50), ("2024-01-01", "A", 100)], "trading_date string, symbol string, ts_nanos bigint")
    sizes = spark.createDataFrame([("2024-01-01", "A", "8", 7, 10, 5), ("2024-01-01", "A", "8", 7, 60, 0)], "trading_date string, symbol string, side string, price_raw bigint, ts_nanos bigint, level_size bigint")
    asked = spark.createDataFrame([("2024-01-01", s, t, f"{s}{t}") for s, t in (("A", 9), ("A", 10), ("A", 59), ("A", 60), ("A", 100), ("A", 101), ("B", 49), ("B", 50), ("C", 50))], "trading_date string, symbol string, ts_nanos bigint, request string")
    day = lambda df: df.withColumn("trading_date", F.to_date("trading_date"))
    got = {r.request: r.state for r in book.book_states(book.best_points(day(sizes), F.lit(1)), book.coverage(day(messages)), day(asked)).collect()}
    assert got == {"A9": "missing", "A10": "present", "A59": "present", "A60": "empty", "A100": "empty", "A101": "missing", "B49": "missing", "B50": "empty", "C50": "missing"}


def test_merges_of_null_and_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a", 1), (None, "n", 2), (3, "c", 3)], "k int, name string, v int")
    updates = spark.createDataFrame([(1, None, 5), (1, "b", None), (None, None, 9), (4, "d", None)], "k int, name string, v int")
    got = sorted((tuple(r) for r in patterns.upsert_keeping(target, updates, ["k"]).collect()), key=str)
    assert got == sorted([(1, "b", 5), (None, "n", 9), (3, "c", 3), (4, "d", None)], key=str)
