"""Queries on reference files, baselines, audits of wire tables, merged facts and refreshed days."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fmt
from ..operators import baselines, enrich, patterns
from ..operators import lifecycle as lc
from ..session import removed, shared_folder, written
from ..sources import files, wire
from . import events as ev
from . import fixtures as fx
from . import texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, tables: bool = True):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = f"with {fx.SQL}{sql}" if tables else sql
        return function

    return add


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _listing(spark, rows, header: str, place: str):
    """A listing file of rows (line), with its header and trailer."""
    lines = spark.createDataFrame([(header, 0), ("File Creation Time: 0102202421:30|||||||", 2)], "line string, part int").unionByName(rows.select("line", F.lit(1).alias("part")))
    lines.orderBy("part", "line").select("line").coalesce(1).write.text(place)  # one reference file, a line for each symbol


@query("""with named as (select s_suppkey k, 'Y' || s_suppkey symbol, s_name from supplier),
first_ as (select symbol, s_name || case when k % 3 = 0 then ', Inc. - Common Stock' else ' ETF' end company_name, 'NASDAQ' listing_exchange, k % 3 = 1 is_etf, cast(100 as integer) round_lot, k from named where k % 2 = 0 and k % 10 <> 4),
second_ as (select symbol, 'Other ' || s_name, case k % 4 when 0 then 'NYSE' when 1 then 'NYSE Arca' when 2 then 'Cboe BZX' else 'Q' end, false, cast(10 + k % 3 as integer), k from named where k % 3 <> 1),
both_ as (select *, 0 o from first_ union all select *, 1 from second_), kept as (select * from both_ qualify row_number() over (partition by symbol order by o) = 1)
select symbol, case when k % 5 = 0 then 'Title ' || k else company_name end company_name, listing_exchange, is_etf, round_lot from kept""", tables=False)
def listed_symbols(spark, sf_dir):
    """Two listing files, written and read, the first one first, under the titles of a third; test issues and trailers are left out."""
    place, named = _place(spark, "listings"), fx.table(spark, sf_dir, "supplier").selectExpr("s_suppkey k", "concat('Y', s_suppkey) symbol", "s_name")
    first = named.filter("k % 2 = 0").selectExpr("concat_ws('|', symbol, concat(s_name, case when k % 3 = 0 then ', Inc. - Common Stock' else ' ETF' end), 'Q', case when k % 10 = 4 then 'Y' else 'N' end, 'N', '100', case when k % 3 = 1 then 'Y' else 'N' end, 'N') line")
    second = named.filter("k % 3 != 1").selectExpr("concat_ws('|', symbol, concat('Other ', s_name), case k % 4 when 0 then 'N' when 1 then 'P' when 2 then 'Z' else 'Q' end, symbol, 'N', cast(10 + k % 3 as string), 'N', symbol) line")
    _listing(spark, first, "Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares", f"{place}/a")
    _listing(spark, second, "ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol", f"{place}/b")
    titles = named.filter("k % 5 = 0").select(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), F.struct(F.col("symbol").alias("ticker"), F.concat(F.lit("Title "), "k").alias("title"))))).alias("m"))  # one small reference file
    titles.select(F.to_json("m")).write.text(f"{place}/t")
    listings = [files.read_listing(spark, f"{place}/a"), files.read_listing(spark, f"{place}/b", "ACT Symbol", exchange="Exchange")]
    out = written(files.merge_symbols(listings, files.read_titles(spark, f"{place}/t")), "symbols")
    removed(spark, [place])
    return out


@query(f""" select 'volume' kind, day, symbol, cast(today as double) as value, n_days, cast(median as double) median from {ev.WINDOWS} where n_days >= 2 union all select 'lifetime', day, symbol, cast(today as double), n_days, cast(median as double) from {ev.LIFE_WINDOWS} where n_days >= 2""")
def baseline_medians(spark, sf_dir):
    """Trailing medians of volumes and lifetimes by one interface."""
    given = baselines.Baselines(lc.daily_volume(fx.trades(spark, sf_dir)), lc.daily_lifetime(ev._lifecycle(spark, sf_dir)))
    of = lambda kind: given.trailing_median(kind, least_days=2).select(F.lit(kind).alias("kind"), "day", "symbol", F.col("value").cast("double").alias("value"), "n_days", "median")
    return of("volume").unionByName(of("lifetime"))


@query(f""" select symbol, n, list_sum(vals)::double total, today as value from (select symbol, n_days n, vals, today, day from {ev.WINDOWS}) where day = date '2024-01-15' and n > 0""")
def baseline_window(spark, sf_dir):
    """A day's volume with the whole window before it."""
    given = baselines.Baselines(lc.daily_volume(fx.trades(spark, sf_dir)), lc.daily_lifetime(ev._lifecycle(spark, sf_dir)))
    rows = given.trailing_window("volume").filter("day = date'2024-01-15' and n_days > 0")
    return rows.select("symbol", F.col("n_days").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), "value")


def _packets(spark, sf_dir, tables: list[str]):
    base, packets = fx.base(spark, sf_dir), None
    for t, table in enumerate(tables):
        rows = base.filter(f"k % {len(tables)} = {t}").selectExpr("k", *[f"{v} {n}" for n, v in texts._table_values(table, "string").items()])
        own = wire.pack(rows, table, F.expr("k div 10"), ["k"], table)
        packets = own if packets is None else packets.unionByName(own)
    return packets


_AUDITED = ["auction_info", "official_prices", "trades", "quotes", "trading_status", "retail_liquidity"]


def _audit_sql() -> str:
    parts = []
    for t, table in enumerate(_AUDITED):
        values = texts._table_values(table, "varchar")
        by = values.get({"auction_info": "auction_type", "official_prices": "price_type", "trading_status": "sub_type"}.get(table), "''")
        parts.append(f"select '{table}' as \"table\", {by} as kind, {values['symbol']} symbol, ts_nanos from base where k % {len(_AUDITED)} = {t}")
    return f" , audited as ({' union all '.join(parts)}) select \"table\", kind, count(*) n, count(distinct symbol) n_symbols, min(ts_nanos) first_ts, max(ts_nanos) last_ts from audited group by 1, 2"


@query(_audit_sql())
def wire_audit(spark, sf_dir):
    """Rows, symbols and time span of wire tables, with auction prints, official prices and status by their type, from one pass over the packets."""
    decoded = wire.decode_packets(_packets(spark, sf_dir, _AUDITED))
    kind = F.coalesce(F.when(F.col("table") == "auction_info", F.col("auction_type")), F.when(F.col("table") == "official_prices", F.col("price_type")), F.when(F.col("table") == "trading_status", F.col("sub_type")), F.lit(""))
    return decoded.filter("table is not null").groupBy("table", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("n_symbols"), F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts"))


@query(f""" select symbol, side, count(*) n, min(ts_nanos) ts_nanos, max(ts_nanos) ts_end_nanos from {ev.islands('orders_add', 'trading_date, symbol, side', 'ts_nanos, order_id', 60_000_000_000, cap=7)} group by trading_date, symbol, side, island, part""")
def cut_clusters(spark, sf_dir):
    """Runs of orders that go on for very long, cut after seven."""
    found = patterns.gap_clusters(fx.orders_add(spark, sf_dir), ["trading_date", "symbol", "side"], ["ts_nanos", "order_id"], 60_000_000_000, 7)
    return found.groupBy("trading_date", "symbol", "side", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("ts_nanos").alias("ts_nanos"), F.max("ts_nanos").alias("ts_end_nanos")).drop("trading_date", "cluster")


@query(f""" select day, symbol, cast(sum(size) as bigint) total_volume from (select trading_date as day, symbol, size from trades where trading_date <> date '2024-01-05' union all select trading_date, symbol, 2 * size from trades where trading_date = date '2024-01-05') group by 1, 2""")
def refreshed_day(spark, sf_dir):
    """Daily volumes, of which one day's trades were corrected and the day refreshed."""
    place, trades = _place(spark, "volumes"), fx.trades(spark, sf_dir)
    lc.daily_volume(trades).write.partitionBy("day").parquet(place)
    lc.refresh_day(trades.withColumn("size", F.col("size") * 2), place, "2024-01-05")
    out = written(spark.read.parquet(place).select(F.col("day").cast("date").alias("day"), "symbol", "total_volume"), "volumes")
    removed(spark, [place])
    return out


@query("select o_orderkey doc_id, case when o_orderkey % 2 = 0 then 'new' else o_orderstatus end a, case when o_orderkey % 3 = 0 then 'added' end b, cast(o_custkey as varchar) c, o_orderkey % 5 = 0 has_d from orders", tables=False)
def merged_facts(spark, sf_dir):
    """Facts with those found later set, null ones left alone, and one taken out."""
    rows = fx.table(spark, sf_dir, "orders")
    base = F.to_json(F.struct(F.col("o_orderstatus").alias("a"), F.col("o_custkey").alias("c"), F.lit("gone").alias("d")))
    new = F.to_json(F.struct(F.when(F.col("o_orderkey") % 2 == 0, "new").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "added").alias("b")))
    merged = fmt.json_merged(base, new)
    merged = F.when(F.col("o_orderkey") % 5 == 0, merged).otherwise(fmt.json_without(merged, "d"))
    facts = rows.select(F.col("o_orderkey").alias("doc_id"), merged.alias("m"))
    at = lambda name: F.get_json_object("m", f"$.{name}")
    return facts.select("doc_id", at("a").alias("a"), at("b").alias("b"), at("c").alias("c"), at("d").isNotNull().alias("has_d"))


@query(f""", {ev.EVENTS}, counted as (select event_id, count(*) n_rows from events e join orders_executed x on x.trading_date = e.trading_date and x.symbol = e.symbol and x.ts_nanos >= e.ts_nanos and x.ts_nanos <= e.ts_end_nanos where scorer_id = 'liquidity_withdrawal' group by 1)
select event_id, score, coalesce(c.n_rows, e.n_rows) n_rows, c.n_rows is not null as found from events e left join counted c using (event_id)""")
def merged_events(spark, sf_dir):
    """Events with what was found around them: a value found wins, others stay."""
    events = ev.events(spark, sf_dir)
    spans = events.filter("scorer_id = 'liquidity_withdrawal'").select("event_id", "trading_date", "symbol", F.col("ts_nanos").alias("start"), (F.col("ts_end_nanos") + 1).alias("end"))
    met = patterns.range_join(fx.orders_executed(spark, sf_dir).select("trading_date", "symbol", "ts_nanos"), spans, ["trading_date", "symbol"], "ts_nanos", "start", "end", 2_000_000_000)
    found = met.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(True).alias("found"))
    return enrich.merge(events, found).select("event_id", "score", "n_rows", F.coalesce("found", F.lit(False)).alias("found"))
