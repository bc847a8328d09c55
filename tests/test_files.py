"""Reference-data files and day-wise rewriting."""

from pyspark.sql import functions as F

from tapewright.operators import patterns, tables
from tapewright.sources import files

LISTED = """Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares
AAPL|APPLE INC.|Q|N|N|100|N|N
TEST|Test Issue|Q|Y|N|100|N|N
QQQ|Invesco QQQ Trust, Series 1|G|N|N|100|Y|N
File Creation Time: 0501202621:30|||||||
"""
OTHER = """ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol
BRK.B|Berkshire|N|BRK B|N|10|N|BRK=B
AAPL|Second listing|Z|AAPL|N|100|N|AAPL
"""


def test_listings_titles_and_precedence(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LISTED)
    (tmp_path / "b.txt").write_text(OTHER)
    (tmp_path / "t.json").write_text('{"0":{"ticker":"AAPL","title":"Apple Inc."},"1":{"ticker":"NONE","title":"Unknown"}}')
    first = files.read_listing(spark, str(tmp_path / "a.txt"))
    second = files.read_listing(spark, str(tmp_path / "b.txt"), "ACT Symbol", exchange="Exchange")
    lots = spark.createDataFrame([("QQQ", 1, 40), ("QQQ", 2, 10)], "symbol string, ts_nanos bigint, round_lot_size int")
    rows = {r.symbol: r for r in files.merge_symbols([first, second], files.read_titles(spark, str(tmp_path / "t.json")), lots).collect()}
    assert set(rows) == {"AAPL", "QQQ", "BRK.B"}
    assert (rows["AAPL"].company_name, rows["AAPL"].listing_exchange, rows["BRK.B"].listing_exchange, rows["BRK.B"].round_lot) == ("Apple Inc.", "NASDAQ", "NYSE", 10)
    assert rows["QQQ"].is_etf and rows["QQQ"].round_lot == 10


def test_prior_close_round_trip(spark, tmp_path):
    trades = spark.createDataFrame([("A", 1, 1, 5), ("A", 2, 1, 6), ("A", 2, 2, 7), ("B", 9, 1, 1)], "symbol string, ts_nanos bigint, seq bigint, price_raw bigint")
    closes = files.prior_close(trades)
    files.write_prior_close(closes, str(tmp_path / "close"))
    assert sorted(map(tuple, files.read_prior_close(spark, str(tmp_path / "close")).collect())) == [("A", 7), ("B", 1)]


def test_only_given_days_are_rewritten(spark, tmp_path):
    place = str(tmp_path / "days")
    rows = lambda day, n: spark.range(n).select(F.lit(day).cast("date").alias("trading_date"), F.lit("S").alias("symbol"), F.col("id").alias("ts_nanos"))
    patterns.overwrite_days(rows("2024-01-01", 3).unionByName(rows("2024-01-02", 4)), place)
    patterns.overwrite_days(rows("2024-01-02", 1), place)
    assert {str(r.trading_date): r["count"] for r in spark.read.parquet(place).groupBy("trading_date").count().collect()} == {"2024-01-01": 3, "2024-01-02": 1}


def test_changed_hashes(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "k int, o int, t string")
    hashes = tables.content_hash(rows, ["k"], ["o"], ["t"])
    stored = hashes.filter("k = 1")
    assert [r.k for r in tables.changed(hashes, stored, ["k"]).collect()] == [2]
