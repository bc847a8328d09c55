"""Order flow made from the driver's tables, for the registered queries, and the same in SQL.

The rules are arithmetic on the keys of orders and events, so that both engines
derive the same rows. Times fall on 20 days from 2024-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1704119400000000000  # 2024-01-01 14:30 UTC in nanoseconds
DAY = 86_400_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey k",
        "o_orderkey div 20 j",
        "o_orderkey % 20 d",
        "o_custkey cu",
        "concat('S', lpad(cast(o_custkey % 25 as string), 2, '0')) symbol",
        f"{START} + (o_orderkey % 20) * {DAY} + (o_orderkey div 20) * 37000000 ts_nanos",
        "date_add(date'2024-01-01', cast(o_orderkey % 20 as int)) trading_date",
        "(o_orderkey div 20 + o_custkey) % 10 fate",
    )


def orders_add(spark, sf_dir):
    return base(spark, sf_dir).selectExpr("trading_date", "symbol", "ts_nanos", "k * 4 seq", "case when j % 2 = 0 then '8' else '5' end side", "k order_id", "cast(1 + k % 500 as int) size", "1000000 + ((j div 2) % 10) * 100 + case when j % 2 = 0 then 0 else 1000 end price_raw", "'ORDERS' feed_source")


def orders_modify(spark, sf_dir):
    return base(spark, sf_dir).filter("fate = 9").selectExpr("trading_date", "symbol", "ts_nanos + 5000000 ts_nanos", "k * 4 + 1 seq", "k order_id", "cast(1 + k % 250 as int) size", "1000000 + ((j div 2) % 10) * 100 + case when j % 2 = 0 then 100 else 1100 end price_raw", "cast(k % 2 as smallint) modify_flags", "'ORDERS' feed_source")


def orders_executed(spark, sf_dir):
    return base(spark, sf_dir).filter("fate in (6, 7)").selectExpr("trading_date", "symbol", "ts_nanos + (k % 53 + 1) * 1000000 ts_nanos", "k * 4 + 2 seq", "k order_id", "cast(case when fate = 6 then 1 + k % 500 else greatest((1 + k % 500) div 2, 1) end as int) size", "1000000 + ((j div 2) % 10) * 100 + case when j % 2 = 0 then 0 else 1000 end price_raw", "k * 10 trade_id", "'ORDERS' feed_source")


def orders_delete(spark, sf_dir):
    return base(spark, sf_dir).filter("fate < 6 or (fate = 9 and k % 3 = 0)").selectExpr("trading_date", "symbol", "ts_nanos + (6 + k % 97) * 1000000 ts_nanos", "k * 4 + 3 seq", "k order_id", "'ORDERS' feed_source")


def clear_books(spark, sf_dir):
    days = base(spark, sf_dir).select("d", "trading_date").distinct()
    return days.selectExpr("trading_date", "'S03' symbol", f"{START} + d * {DAY} + {150 * 37000000 + 1} ts_nanos", "-1L seq", "'ORDERS' feed_source")


def trades(spark, sf_dir):
    ts = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf_dir, "events").filter("event_type in ('purchase', 'click')").select(
        F.to_date("ts").alias("trading_date"), F.expr("concat('S', lpad(cast(user_id % 25 as string), 2, '0'))").alias("symbol"), ts.alias("ts_nanos"), F.col("event_id").alias("seq"),
        F.expr("cast(1 + event_id % 500 as int)").alias("size"), F.expr("cast(floor(value * 10000 + 0.5) as bigint)").alias("price_raw"), F.col("event_id").alias("trade_id"), F.expr("cast((event_id % 16) * 8 as smallint)").alias("sale_condition_flags"), F.lit("ORDERS").alias("feed_source"),
    )


def status_events(spark, sf_dir):
    ts = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf_dir, "events").filter("event_type in ('error', 'signup', 'view')").select(
        F.to_date("ts").alias("trading_date"), F.expr("concat('S', lpad(cast(user_id % 25 as string), 2, '0'))").alias("symbol"), ts.alias("ts_nanos"), F.col("event_id").alias("seq"), F.lit("H").alias("event_kind"),
        F.expr("case event_type when 'error' then 'H' when 'signup' then 'T' else 'O' end").alias("sub_type"), F.expr("case event_id % 4 when 0 then 'T1' when 1 then 'LUDP' when 2 then 'NA' end").alias("reason"), F.lit("ORDERS").alias("feed_source"),
    )


def symbols(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_suppkey < 25").selectExpr("concat('S', lpad(cast(s_suppkey as string), 2, '0')) symbol", "concat(s_name, ' Inc. - Common Stock') company_name", "s_acctbal prev_close_dollars", "cast(100 as int) round_lot")


#: The same tables as common table expressions for DuckDB.
SQL = f"""
base as (select o_orderkey k, o_orderkey // 20 j, o_orderkey % 20 d, o_custkey cu, 'S' || lpad(cast(o_custkey % 25 as varchar), 2, '0') symbol,
         {START} + (o_orderkey % 20) * {DAY} + (o_orderkey // 20) * 37000000 ts_nanos, date '2024-01-01' + cast(o_orderkey % 20 as integer) trading_date,
         (o_orderkey // 20 + o_custkey) % 10 fate from orders),
orders_add as (select trading_date, symbol, ts_nanos, k * 4 seq, case when j % 2 = 0 then '8' else '5' end side, k order_id, cast(1 + k % 500 as integer) size,
         1000000 + ((j // 2) % 10) * 100 + case when j % 2 = 0 then 0 else 1000 end price_raw from base),
orders_modify as (select trading_date, symbol, ts_nanos + 5000000 ts_nanos, k * 4 + 1 seq, k order_id, cast(1 + k % 250 as integer) size,
         1000000 + ((j // 2) % 10) * 100 + case when j % 2 = 0 then 100 else 1100 end price_raw, k % 2 modify_flags from base where fate = 9),
orders_executed as (select trading_date, symbol, ts_nanos + (k % 53 + 1) * 1000000 ts_nanos, k * 4 + 2 seq, k order_id,
         cast(case when fate = 6 then 1 + k % 500 else greatest((1 + k % 500) // 2, 1) end as integer) size,
         1000000 + ((j // 2) % 10) * 100 + case when j % 2 = 0 then 0 else 1000 end price_raw, k * 10 trade_id from base where fate in (6, 7)),
orders_delete as (select trading_date, symbol, ts_nanos + (6 + k % 97) * 1000000 ts_nanos, k * 4 + 3 seq, k order_id from base where fate < 6 or (fate = 9 and k % 3 = 0)),
clear_books as (select distinct trading_date, 'S03' symbol, {START} + d * {DAY} + {150 * 37000000 + 1} ts_nanos, -1 seq from base),
trades as (select cast(ts as date) trading_date, 'S' || lpad(cast(user_id % 25 as varchar), 2, '0') symbol, epoch_us(ts) * 1000 ts_nanos, event_id seq, cast(1 + event_id % 500 as integer) size,
         cast(floor(value * 10000 + 0.5) as bigint) price_raw, event_id trade_id, (event_id % 16) * 8 sale_condition_flags from events where event_type in ('purchase', 'click')),
status_events as (select cast(ts as date) trading_date, 'S' || lpad(cast(user_id % 25 as varchar), 2, '0') symbol, epoch_us(ts) * 1000 ts_nanos, event_id seq, 'H' event_kind,
         case event_type when 'error' then 'H' when 'signup' then 'T' else 'O' end sub_type, case event_id % 4 when 0 then 'T1' when 1 then 'LUDP' when 2 then 'NA' end reason
         from events where event_type in ('error', 'signup', 'view')),
symbols as (select 'S' || lpad(cast(s_suppkey as varchar), 2, '0') symbol, s_name || ' Inc. - Common Stock' company_name, s_acctbal prev_close_dollars, 100 round_lot from supplier where s_suppkey < 25),
lifecycle as (select a.trading_date, a.symbol, a.order_id, a.side, a.ts_nanos add_ts_nanos, a.price_raw add_price_raw, a.size add_size, d.ts_nanos delete_ts_nanos, x.ts_nanos execute_ts_nanos,
         case when d.ts_nanos is not null then 'deleted' when x.ts_nanos is not null then 'executed' else 'open' end terminal_state, coalesce(d.ts_nanos, x.ts_nanos) - a.ts_nanos lifetime_ns
         from orders_add a left join orders_delete d using (trading_date, order_id) left join (select trading_date, order_id, max(ts_nanos) ts_nanos from orders_executed group by 1, 2) x using (trading_date, order_id))
"""
