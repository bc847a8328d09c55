"""Values at a threshold, beyond 64 bits and without a logarithm, in Spark and in the queries' SQL."""

import datetime as dt
import itertools
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tapewright import session
from tapewright.operators import detectors, tables
from tapewright.plans import books, events, more, summaries

SEC = 1_000_000_000
DATA = "/root/testdata/sf0.001"


def test_durations_of_many_orders(spark, tmp_path):
    rows = [(7, 3), (2_000, 50), (999_999, 150_000), (54_000_000, 5_400_000)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.text for r in summaries.duration_text(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as select * replace (o_orderkey::hugeint as o_orderkey) from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == dict(con.execute(summaries.ORACLE_SQL["duration_text"]).fetchall())


def test_sizes_at_the_limit_are_even_in_any_order(spark):
    """The deviation of 1, 4, 12, 33 and others is exactly their mean; as doubles it is over it in some orders."""
    day, orders = dt.date(2024, 1, 1), [*itertools.permutations([1, 4, 12, 33]), *itertools.permutations([1, 1, 12, 24])]
    rows = [(day, f"S{n}", k * SEC, n * 10 + k, size, 100, n * 10 + k) for n, sizes in enumerate(orders) for k, size in enumerate(sizes)]
    over = [(day, f"T{n}", k * SEC, 9000 + n * 10 + k, size, 100, 9000 + n * 10 + k) for n, sizes in enumerate(itertools.permutations([1, 4, 12, 34])) for k, size in enumerate(sizes)]
    executed = spark.createDataFrame(rows + over, "trading_date date, symbol string, ts_nanos bigint, order_id bigint, size int, price_raw bigint, trade_id bigint")
    got = sorted(r.symbol for r in detectors.icebergs(executed.coalesce(1), **events.ICEBERG).collect())
    con = duckdb.connect()
    con.execute("create table orders_executed (trading_date date, symbol varchar, ts_nanos bigint, order_id bigint, size integer, price_raw bigint, trade_id bigint)")
    con.executemany("insert into orders_executed values (?, ?, ?, ?, ?, ?, ?)", rows + over)
    assert got == sorted(f"S{n}" for n in range(len(orders))) == sorted(r[0] for r in con.execute(f"select symbol from ({events.ICE})").fetchall())


def test_a_price_of_zero_makes_no_move(spark, monkeypatch):
    rows = [(dt.date(2024, 1, 1), s, k, k, p) for s, ps in {"A": [10, 0, 20, 40], "B": [0, 0], "C": [-10, 10, 20]}.items() for k, p in enumerate(ps)]
    monkeypatch.setattr(summaries.fx, "trades", lambda spark, sf_dir: spark.createDataFrame(rows, "trading_date date, symbol string, ts_nanos bigint, seq bigint, price_raw bigint"))
    got = {r.symbol: (r.n, r.realized_vol) for r in summaries.realized_vol(spark, "").collect()}
    sql = summaries.ORACLE_SQL["realized_vol"]
    con = duckdb.connect()
    con.execute("create table trades (trading_date date, symbol varchar, ts_nanos bigint, seq bigint, price_raw bigint)")
    con.executemany("insert into trades values (?, ?, ?, ?, ?)", rows)
    found = con.execute("select" + sql[sql.rindex(" select trading_date, symbol, n,") + 7 :]).fetchall()
    assert got == {r[1]: (r[2], r[3]) for r in found} == {"A": (4, 0.693147), "B": (2, 0.0), "C": (3, 0.693147)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_snapshots_write_no_changes(spark):
    for query in (books.book_snapshot, books.second_levels, books.sizes_at_price):
        with session.noted() as places:
            query(spark, DATA)
        assert places == []


def test_digest_goes_by_phase_before_score(spark):
    rows = [(dt.date(2024, 1, 1), f"e{m}", "A", "sweep", float(m % 7), m * 60 * SEC + 300 * 60 * SEC, m * 60 * SEC + 301 * 60 * SEC) for m in range(1, 1440, 37)]
    selected = spark.createDataFrame(rows, "trading_date date, event_id string, symbol string, scorer_id string, score double, ts_nanos bigint, ts_end_nanos bigint")
    got = {r.event_id: r.place for r in tables.digest(selected, spark.sql("select '' event_id, '' interpretation, '' narrative")).collect()}
    con = duckdb.connect()
    con.execute("create table selected (trading_date date, event_id varchar, symbol varchar, scorer_id varchar, score double, ts_nanos bigint, ts_end_nanos bigint)")
    con.executemany("insert into selected values (?, ?, ?, ?, ?, ?, ?)", rows)
    sql = more.ORACLE_SQL["day_digest"]
    assert got == {r[1]: r[3] for r in con.execute(sql[sql.rindex(" select trading_date, event_id, case when") :]).fetchall()}
