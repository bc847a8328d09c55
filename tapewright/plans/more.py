"""Queries on flags and codes, names, published events, and the book around events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flags, fmt
from ..operators import book, enrich, tables
from ..session import written
from . import books
from . import events as ev
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEC = 1_000_000_000


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


@query(f"with {fx.SQL} select trade_id, sale_condition_flags & 128 <> 0 intermarket_sweep, sale_condition_flags & 64 = 0 and sale_condition_flags & 32 = 0 last_sale, sale_condition_flags & 64 = 0 and sale_condition_flags & 32 = 0 and sale_condition_flags & 8 = 0 high_low, price_raw / 10000.0 price from trades")
def sale_flags(spark, sf_dir):
    f = F.col("sale_condition_flags")
    return fx.trades(spark, sf_dir).select("trade_id", flags.has(f, flags.INTERMARKET_SWEEP).alias("intermarket_sweep"), flags.last_sale_eligible(f).alias("last_sale"), flags.high_low_eligible(f).alias("high_low"), flags.price(F.col("price_raw")).alias("price"))


@query(f"with {fx.SQL} select case side when '8' then 'buy' else 'sell' end as side_name, order_id % 256 & 128 <> 0 test_issue, order_id % 256 & 64 <> 0 etp, order_id % 256 & 32 <> 0 when_issued, case order_id % 3 when 1 then 'tier 1' when 2 then 'tier 2' else 'not applicable' end as tier, count(*) n from orders_add group by all")
def security_flags(spark, sf_dir):
    f = F.col("order_id") % 256
    rows = fx.orders_add(spark, sf_dir).select(flags.side_name(F.col("side")).alias("side_name"), flags.has(f, flags.SECURITY_TEST).alias("test_issue"), flags.has(f, flags.SECURITY_ETP).alias("etp"), flags.has(f, flags.SECURITY_WHEN_ISSUED).alias("when_issued"), flags.luld_tier(F.col("order_id") % 3).alias("tier"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {fx.SQL} select order_id, ts_nanos, case when op = 'modify' and keep then add_ts else ts_nanos end priority_ts from (select order_id, ts_nanos, 'add' op, false keep, ts_nanos add_ts from orders_add union all select m.order_id, m.ts_nanos, 'modify', m.modify_flags = 1, a.ts_nanos from orders_modify m join orders_add a using (trading_date, order_id))")
def priority_times(spark, sf_dir):
    adds = fx.orders_add(spark, sf_dir).select(*book.ORDER, "ts_nanos", "seq", F.lit("add").alias("op"), F.lit(False).alias("keep"))
    changes = fx.orders_modify(spark, sf_dir).select(*book.ORDER, "ts_nanos", "seq", F.lit("modify").alias("op"), flags.has(F.col("modify_flags"), flags.MODIFY_KEEPS_PRIORITY).alias("keep"))
    return book.priority_times(adds.unionByName(changes)).select("order_id", "ts_nanos", "priority_ts")


@query("select p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w : upper(w[1]) || w[2:]), ' ') || case p_partkey % 3 when 0 then ' Inc.' when 1 then ' LLC' else ' N.V.' end as name from part")
def title_case(spark, sf_dir):
    raw = fx.table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(upper(p_name), case p_partkey % 3 when 0 then ' INC.' when 1 then ' LLC' else ' NV' end) raw")
    return raw.select("p_partkey", fmt.better_name(F.lit(None).cast("string"), F.col("raw")).alias("name"))


@query("select o_orderkey k, case n when 1 then 'a1' when 2 then 'a1 and a2' when 3 then 'a1, a2 and a3' when 4 then 'a1, a2, a3 and a4' else 'a1, a2, a3 and ' || (n - 3) || ' others' end as names from (select o_orderkey, 1 + o_orderkey % 7 n from orders)")
def listed_names(spark, sf_dir):
    names = F.transform(F.sequence(F.lit(1), (1 + F.col("o_orderkey") % 7).cast("int")), lambda i: F.concat(F.lit("a"), i.cast("string")))
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), fmt.listed(names).alias("names"))


#: The place of an event's New York phase in its day, in winter; what is after 20:00 is of the first one.
_MINUTE = "((ts_nanos // 60000000000 - 300) % 1440)"
_PHASE_NO = f"case when {_MINUTE} < 240 or {_MINUTE} >= 1200 then 0 when {_MINUTE} < 570 then 1 when {_MINUTE} < 575 then 2 when {_MINUTE} < 690 then 3 when {_MINUTE} < 840 then 4 when {_MINUTE} < 955 then 5 when {_MINUTE} < 960 then 6 else 7 end"


@query(f"with {fx.SQL}, {ev.EVENTS} {ev.SELECT} select trading_date, event_id, case when event_id like '%7' then null when length(event_id) % 2 = 0 then 'told ' || symbol else 'seen ' || symbol end as text, row_number() over (partition by trading_date order by {_PHASE_NO}, score desc, ts_nanos, event_id) as place from selected")
def day_digest(spark, sf_dir):
    """The order in which a day's selected events are told: by phase, then by score."""
    selected = written(_selected(spark, sf_dir), "selected")
    texts = selected.filter("event_id not like '%7'").selectExpr("event_id", "case when length(event_id) % 2 = 0 then concat('told ', symbol) end interpretation", "concat('seen ', symbol) narrative")
    return tables.digest(selected, texts).select("trading_date", "event_id", "text", "place")


def _selected(spark, sf_dir):
    return ev.sel.select_top(ev.sel.nest(ev.events(spark, sf_dir)))


@query(f"with {fx.SQL}, {ev.EVENTS} {ev.SELECT} select trading_date, count(*) n_events, count(distinct symbol) n_symbols from selected group by 1")
def published_dates(spark, sf_dir):
    return tables.published_dates(_selected(spark, sf_dir))


@query(f"with {fx.SQL}, {ev.EVENTS} {ev.SELECT} select trading_date, scorer_id, narration_rank, event_id, symbol, score from selected where trading_date = (select max(trading_date) from selected)")
def published_day(spark, sf_dir):
    return tables.one_day(_selected(spark, sf_dir))


@query(f"with {fx.SQL}, {ev.EVENTS} {ev.SELECT} select symbol, trading_date, count(*) n_events, max(score) top_score from selected where symbol = 'S07' group by 1, 2")
def published_symbol(spark, sf_dir):
    return tables.one_symbol(_selected(spark, sf_dir), "S07")


_REQ = f"""(select event_id, scorer_id, 'at' role_, trading_date, symbol, ts_nanos from events where scorer_id in ('sweep', 'liquidity_withdrawal')
  union all select event_id, scorer_id, 'after', trading_date, symbol, ts_end_nanos from events where scorer_id = 'liquidity_withdrawal'
  union all select event_id, scorer_id, 'recovery', trading_date, symbol, ts_end_nanos + {5 * SEC} from events where scorer_id = 'liquidity_withdrawal')"""


@query(f"""with {fx.SQL}, {ev.EVENTS} {books.STEPS},
snap as (select r.event_id, r.scorer_id, r.role_, max(case when side = '8' then price_raw end) bid, min(case when side = '5' then price_raw end) ask, sum(case when side = '8' then level_size else 0 end) bids, sum(case when side = '5' then level_size else 0 end) asks
  from {_REQ} r join spans s on r.trading_date = s.trading_date and r.symbol = s.symbol and s.start_ <= r.ts_nanos and r.ts_nanos < s.end_ where s.level_size > 0 group by 1, 2, 3),
wide as (select event_id, scorer_id, max(case when role_ = 'at' then bid end) bid, max(case when role_ = 'at' then ask end) ask, max(case when role_ = 'at' then bids end) bids, max(case when role_ = 'at' then asks end) asks,
  max(case when role_ = 'at' then bids + asks end) before_, max(case when role_ = 'after' then bids + asks end) after_, max(case when role_ = 'recovery' then bids + asks end) rec from snap group by 1, 2)
select w.event_id, {ev.r6("case when w.scorer_id = 'sweep' and bid + ask > 0 then 2 * abs((lo + hi) / 2.0 - (bid + ask) / 2.0) / ((bid + ask) / 2.0) * 10000.0 end")} effective_spread_bps,
  {ev.r6("case when w.scorer_id = 'liquidity_withdrawal' and before_ > 0 and after_ <= before_ then (before_ - after_) / before_ * 100.0 end")} removed_pct, {ev.r6("case when w.scorer_id = 'liquidity_withdrawal' and before_ > 0 then rec / before_ * 100.0 end")} recovered_pct,
  {ev.r6("case when w.scorer_id <> 'liquidity_withdrawal' and bids + asks > 0 then (bids - asks) / (bids + asks) end")} depth_imbalance
from wide w left join (select trading_date, symbol, min(ts_nanos) a, max(ts_nanos) z, min(price_raw) lo, max(price_raw) hi from {ev.islands('orders_executed', 'trading_date, symbol', 'ts_nanos, order_id, trade_id', 5 * SEC)} group by trading_date, symbol, island, part) c
  on w.event_id like concat(cast(c.trading_date as varchar), '|', c.symbol, '|sweep|', cast(c.a as varchar), '|', cast(c.z as varchar), '|%')""")
def book_around_events(spark, sf_dir):
    sweeps = ev.rounded(ev._sweeps(spark, sf_dir), "score").withColumn("event_id", ev.sel.event_key()).withColumn("side", F.lit(None).cast("string"))
    gone = ev._kept(ev.dt.withdrawals(fx.orders_delete(spark, sf_dir), **ev.WITHDRAWAL)).withColumn("event_id", ev.sel.event_key())
    columns = ["event_id", "trading_date", "symbol", "ts_nanos", "ts_end_nanos", "scorer_id", "min_price_raw", "max_price_raw", "side"]
    both = sweeps.select(*columns).unionByName(gone.withColumns({c: F.lit(None).cast("bigint") for c in ("min_price_raw", "max_price_raw")} | {"side": F.lit(None).cast("string")}).select(*columns))
    snaps = book.best_prices(book.snapshot(books._intervals(spark, sf_dir), enrich.book_requests(both, 5 * SEC), SEC), ["event_id", "role"])
    facts = enrich.book_facts(both, snaps).select("event_id", "effective_spread_bps", "removed_pct", "recovered_pct", "depth_imbalance")
    return ev.rounded(facts, "effective_spread_bps", "removed_pct", "recovered_pct", "depth_imbalance")
