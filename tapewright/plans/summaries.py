"""Queries that sum up events by day and period, and format them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fmt, stats
from ..operators import patterns, tables
from . import events as ev
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = ""):
    """Registers a query; its SQL sees the fixture and the events."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = f"with {fx.SQL}, {ev.EVENTS} {more} {sql}"
        return function

    return add


def plain(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


@query("select event_id, scorer_id, symbol, score from events order by score desc, ts_nanos, event_id limit 5")
def headline(spark, sf_dir):
    return tables.headline(ev.events(spark, sf_dir)).select("event_id", "scorer_id", "symbol", "score")


@query("select trading_date, scorer_id, event_id, place from (select *, row_number() over (partition by trading_date, scorer_id order by score desc, ts_nanos, event_id) place from events) where place <= 5")
def top_per_scorer(spark, sf_dir):
    return tables.top_per_scorer(ev.events(spark, sf_dir)).select("trading_date", "scorer_id", "event_id", F.col("place").cast("bigint").alias("place"))


SHARE = "(select trading_date, {0}, count(*) n, count(*) / sum(count(*)) over (partition by trading_date) share from events group by trading_date, {0})"
HHI = f"(select trading_date, sum(share * share) hhi, max(share) top_share, count(*) n_members from {SHARE.format('symbol')} group by 1)"
ENT = f"(select trading_date, sum(-share * ln(share)) entropy_nats, case when count(*) >= 2 then sum(-share * ln(share)) / ln(count(*)) end entropy_normalised from {SHARE.format('scorer_id')} group by 1)"
TOP = "(select * from (select trading_date, {0}, count(*) n, row_number() over (partition by trading_date order by count(*) desc, {0}) place from events group by trading_date, {0}) where place = 1)"
SUMMARY = f""", summary as (select t.trading_date, n_events, n_symbols, top_score, s.scorer_id dominant_scorer_id, s.n dominant_scorer_id_events, y.symbol dominant_symbol, y.n dominant_symbol_events, hhi, top_share, n_members, entropy_nats, entropy_normalised
  from (select trading_date, count(*) n_events, count(distinct symbol) n_symbols, max(score) top_score from events group by 1) t
  join {TOP.format('scorer_id')} s using (trading_date) join {TOP.format('symbol')} y using (trading_date) join {HHI} h using (trading_date) join {ENT} e using (trading_date))"""


@query(f"select trading_date, {ev.r6('hhi')} hhi, {ev.r6('top_share')} top_share, n_members from {HHI}")
def hhi(spark, sf_dir):
    return ev.rounded(tables.concentration(ev.events(spark, sf_dir)), "hhi", "top_share")


@query(f"select trading_date, {ev.r6('entropy_nats')} entropy_nats, {ev.r6('entropy_normalised')} entropy_normalised from {ENT}")
def entropy(spark, sf_dir):
    return ev.rounded(tables.mix_entropy(ev.events(spark, sf_dir)), "entropy_nats", "entropy_normalised")


@query(f"select trading_date, n_events, n_symbols, top_score, dominant_scorer_id, dominant_scorer_id_events, dominant_symbol, dominant_symbol_events, {ev.r6('hhi')} hhi, {ev.r6('entropy_nats')} entropy_nats from summary", SUMMARY)
def day_summary(spark, sf_dir):
    return ev.rounded(tables.day_summary(ev.events(spark, sf_dir)).drop("top_share", "n_members", "entropy_normalised"), "hhi", "entropy_nats")


@query("select trading_date, format('{:,}', n_events) || ' events on ' || n_symbols || ' symbols; most were ' || dominant_scorer_id || ' (' || dominant_scorer_id_events || '), led by ' || dominant_symbol bullet from summary", SUMMARY)
def day_bullets(spark, sf_dir):
    return tables.bullets(tables.day_summary(ev.events(spark, sf_dir)))


@query("""select trading_date, prior_trading_date, n_events, prior_n_events, cast(floor((n_events - prior_n_events) * 100.0 / prior_n_events + 0.5) as bigint) change_pct, dominant_scorer_id = ps scorer_persisted, dominant_symbol = py symbol_persisted from (
  select *, lag(trading_date) over w prior_trading_date, lag(n_events) over w prior_n_events, lag(dominant_scorer_id) over w ps, lag(dominant_symbol) over w py from summary window w as (order by trading_date)) where prior_trading_date is not null""", SUMMARY)
def vs_prior_day(spark, sf_dir):
    return tables.vs_prior_day(tables.day_summary(ev.events(spark, sf_dir)))


@query("""select coalesce(a.scorer_id, b.scorer_id) scorer_id, coalesce(now, 0) now, coalesce(before, 0) before, cast(case when coalesce(before, 0) = 0 then 100 else floor((coalesce(now, 0) - before) * 100.0 / before + 0.5) end as bigint) change_pct
  from (select scorer_id, count(*) now from events where trading_date = date '2024-01-05' group by 1) a full join (select scorer_id, count(*) before from events where trading_date = date '2024-01-04' group by 1) b on a.scorer_id = b.scorer_id""")
def scorer_changes(spark, sf_dir):
    return tables.scorer_changes(ev.events(spark, sf_dir), "2024-01-05", "2024-01-04")


@query("""select trading_date, symbol, n n_events, least(60, row_number() over (partition by symbol, run order by d)) streak from (
  select *, d - row_number() over (partition by symbol order by d) run from (select trading_date, symbol, n, row_number() over (order by trading_date) d from """ + TOP.format("symbol") + "))")
def streak_symbols(spark, sf_dir):
    return tables.top_streaks(ev.events(spark, sf_dir))


@query("select symbol, min(d) as first, max(d) as last, count(*) length from (select symbol, d, d - row_number() over (partition by symbol order by d) run from (select distinct symbol, date_diff('day', date '1970-01-01', trading_date) d from trades)) group by symbol, run")
def trading_streaks(spark, sf_dir):
    days = fx.trades(spark, sf_dir).select("symbol", F.datediff("trading_date", F.lit("1970-01-01").cast("date")).cast("bigint").alias("d"))
    return patterns.streak(days, ["symbol"], "d")


@query("""select * from (
  select trading_date, 'largest_notional_sweep' metric, event_id, symbol, value from (select *, cast(total_shares as double) value, row_number() over (partition by trading_date order by total_shares desc, event_id) p from events where scorer_id = 'sweep') where p = 1
  union all select trading_date, 'longest_iceberg', event_id, symbol, value from (select *, cast(n_rows as double) value, row_number() over (partition by trading_date order by n_rows desc, event_id) p from events where scorer_id = 'iceberg') where p = 1)""")
def extremes(spark, sf_dir):
    return tables.extremes(ev.events(spark, sf_dir), {"largest_notional_sweep": ("sweep", "total_shares"), "longest_iceberg": ("iceberg", "n_rows")})


_SPANS = {"longest_sweep": ("sweep", "span"), "largest_sweep": ("sweep", "total_shares"), "longest_withdrawal": ("liquidity_withdrawal", "span"), "largest_withdrawal": ("liquidity_withdrawal", "n_rows"), "largest_layering": ("layering", "total_shares"), "largest_cancel_cluster": ("post_cancel_cluster", "n_rows"), "longest_iceberg_span": ("iceberg", "span"), "largest_iceberg": ("iceberg", "total_shares")}


@query(" union all ".join(f"select trading_date, '{m}' metric, arg_max(event_id, value) event_id, arg_max(symbol, value) symbol, max(value) as value from (select *, cast(value_ as double) value from (select *, {c} value_ from (select *, ts_end_nanos - ts_nanos span from events) where scorer_id = '{s}') qualify row_number() over (partition by trading_date order by value_ desc, event_id) = 1) group by 1" for m, (s, c) in _SPANS.items()))
def more_extremes(spark, sf_dir):
    """The other events of a day that lead by a metric."""
    events = ev.events(spark, sf_dir).withColumn("span", F.col("ts_end_nanos") - F.col("ts_nanos"))
    return tables.extremes(events, _SPANS)


@query("select trading_date, scorer_id dominant_scorer, n from " + TOP.format("scorer_id"))
def dominant_per_day(spark, sf_dir):
    n = ev.events(spark, sf_dir).groupBy("trading_date", "scorer_id").agg(F.count(F.lit(1)).alias("n"))
    return patterns.first_rows(n, ["trading_date"], [F.desc("n"), "scorer_id"]).select("trading_date", F.col("scorer_id").alias("dominant_scorer"), "n")


@query("select symbol, scorer_id, count(*) n from events group by all")
def symbol_scorer_counts(spark, sf_dir):
    return ev.events(spark, sf_dir).groupBy("symbol", "scorer_id").agg(F.count(F.lit(1)).alias("n"))


@query("select symbol, count(*) n_events, count(distinct trading_date) n_days from events group by 1 order by 2 desc, 1 limit 12")
def top_symbols(spark, sf_dir):
    return tables.top_symbols(ev.events(spark, sf_dir), 12)


PHASE = "(case when {0} < 240 then 'overnight' when {0} < 570 then 'pre_market' when {0} < 575 then 'opening_5min' when {0} < 690 then 'early_session' when {0} < 840 then 'midday' when {0} < 955 then 'late_session' when {0} < 960 then 'closing_5min' when {0} < 1200 then 'post_market' else 'overnight' end)".format("((ts_nanos // 60000000000 - 300) % 1440)")
AGG = f", agg as (select trading_date, kind, member, count(*) n from (select trading_date, 'scorer' kind, scorer_id member from events union all select trading_date, 'phase', {PHASE} from events union all select trading_date, 'symbol', symbol from events) group by all)"


@query("select * from agg", AGG)
def day_aggregates(spark, sf_dir):
    return tables.day_aggregates(ev.events(spark, sf_dir))


def _period_sql(unit):
    return f"select period, kind, member, n, n_days from (select *, row_number() over (partition by period, kind order by n desc, member) place from (select cast(date_trunc('{unit}', trading_date) as date) period, kind, member, cast(sum(n) as bigint) n, count(distinct trading_date) n_days from agg group by all)) where kind <> 'symbol' or place <= 12"


@query(_period_sql("quarter"), AGG)
def quarter_rollup(spark, sf_dir):
    return tables.roll_up(tables.day_aggregates(ev.events(spark, sf_dir)), fmt.quarter_start(F.col("trading_date")))


@query(_period_sql("year"), AGG)
def year_rollup(spark, sf_dir):
    return tables.roll_up(tables.day_aggregates(ev.events(spark, sf_dir)), fmt.year_start(F.col("trading_date")))


@query("""select symbol, n_events, n_days, mix from (select symbol, cast(sum(n) as bigint) n_events, string_agg(scorer_id || '=' || n, ',' order by scorer_id) mix from (select symbol, scorer_id, count(*) n from events group by all) group by 1) join (select symbol, count(distinct trading_date) n_days from events group by 1) using (symbol)""")
def scorer_mix(spark, sf_dir):
    rows = tables.scorer_mix(ev.events(spark, sf_dir))
    mix = F.array_join(F.transform(F.array_sort(F.map_entries("mix")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("symbol", "n_events", "n_days", mix.alias("mix"))


_NAME = "case scorer_id " + " ".join(f"when '{k}' then '{v}'" for k, v in fmt.SCORER_NAMES.items()) + " end"


@query(f"""select event_id, {_NAME} || ' in ' || symbol || ', at ' || printf('%02d:%02d', ((ts_nanos // 60000000000 - 300) % 1440) // 60, (ts_nanos // 60000000000 - 300) % 60) || case when n_rows > 0 then ', ' || format('{{:,}}', n_rows) || ' orders' else '' end
  || case when total_shares > 0 then ', ' || format('{{:,}}', total_shares) || ' shares' else '' end line from events""")
def headline_lines(spark, sf_dir):
    events = ev.events(spark, sf_dir)
    return events.select("event_id", tables.headline_text(events).alias("line"))


WEEK = AGG + ", weeks as (select *, row_number() over (partition by period, kind order by n desc, member) place from (select cast(date_trunc('week', trading_date) as date) period, kind, member, cast(sum(n) as bigint) n, count(distinct trading_date) n_days from agg group by all))"


@query("select period, kind, member, n, n_days from weeks where kind <> 'symbol' or place <= 12", WEEK)
def week_rollup(spark, sf_dir):
    return tables.roll_up(tables.day_aggregates(ev.events(spark, sf_dir)), fmt.week_start(F.col("trading_date")))


@query("""select period, kind, member, cast(sum(n) as bigint) n, count(distinct trading_date) n_days from (select cast(date_trunc('week', trading_date) as date) period, trading_date, kind, member, n, row_number() over (partition by trading_date, kind order by n desc, member) p from agg) where kind <> 'symbol' or p <= 10 group by period, kind, member
  qualify kind <> 'symbol' or row_number() over (partition by period, kind order by cast(sum(n) as bigint) desc, member) <= 12""", AGG)
def week_rollup_of_tops(spark, sf_dir):
    return tables.roll_up(tables.day_aggregates(ev.events(spark, sf_dir)), fmt.week_start(F.col("trading_date")), exact=False)


@query("select cast(date_trunc('week', trading_date) as date) period, cast(date_trunc('week', trading_date) as date) + 4 period_end, count(*) n_events, count(distinct trading_date) n_days, count(distinct symbol) n_symbols, max(score) top_score from events group by all")
def week_table(spark, sf_dir):
    week = fmt.week_start(F.col("trading_date"))
    return ev.events(spark, sf_dir).groupBy(week.alias("period"), F.date_add(week, 4).alias("period_end")).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("trading_date").alias("n_days"), F.count_distinct("symbol").alias("n_symbols"), F.max("score").alias("top_score"))


@plain("select cast(date_trunc('quarter', period) as date) parent, count(*) filter (where verified) n_verified, count(*) n_children from (select cast(date_trunc('week', o_orderdate) as date) period, count(*) % 7 <> 0 verified from orders group by 1) group by 1 having count(*) filter (where verified) >= 8")
def quarter_gate(spark, sf_dir):
    weeks = fx.table(spark, sf_dir, "orders").groupBy(fmt.week_start(F.col("o_orderdate")).alias("period")).agg((F.count(F.lit(1)) % 7 != 0).alias("verified"))
    return tables.gated(weeks, fmt.quarter_start(F.col("period")), 8)


@plain("select cast(date_trunc('week', o_orderdate) as date) period, count(*) n from orders where date_trunc('week', o_orderdate) < date '1998-01-05' group by 1 order by 1 desc limit 13")
def newest_weeks(spark, sf_dir):
    weeks = fx.table(spark, sf_dir, "orders").groupBy(fmt.week_start(F.col("o_orderdate")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return tables.newest_before(weeks, "1998-01-05", 13)


@query("select scorer_id, count(*) n, count(nullif(total_shares, 0)) with_value, " + ev.r6("avg(nullif(total_shares, 0))") + " mean, cast(min(nullif(total_shares, 0)) as double) least, cast(max(nullif(total_shares, 0)) as double) largest, count(*) filter (where total_shares < 0) below_zero from events group by 1")
def coverage_audit(spark, sf_dir):
    rows = ev.events(spark, sf_dir).withColumn("total_shares", F.expr("nullif(total_shares, 0)"))
    return ev.rounded(tables.coverage(rows, "total_shares"), "mean")


@query("""select 'orders_add' table_name, count(*) n from orders_add union all select 'orders_modify', count(*) from orders_modify union all select 'orders_executed', count(*) from orders_executed
  union all select 'orders_delete', count(*) from orders_delete union all select 'trades', count(*) from trades union all select 'status_events', count(*) from status_events""")
def table_counts(spark, sf_dir):
    names = ["orders_add", "orders_modify", "orders_executed", "orders_delete", "trades", "status_events"]
    out = None
    for name in names:
        n = getattr(fx, name)(spark, sf_dir).groupBy().agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("select trading_date as day, count(distinct symbol) n_symbols, cast(sum(size) as bigint) total_volume, count(*) n_trades, min(ts_nanos) first_ts, max(ts_nanos) last_ts from trades group by 1")
def market_totals(spark, sf_dir):
    return fx.trades(spark, sf_dir).groupBy(F.col("trading_date").alias("day")).agg(F.count_distinct("symbol").alias("n_symbols"), F.sum(F.col("size").cast("bigint")).alias("total_volume"), F.count(F.lit(1)).alias("n_trades"), F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts"))


@query("select sub_type, coalesce(reason, '-') reason, count(*) n from status_events where event_kind = 'H' group by all")
def status_counts(spark, sf_dir):
    return fx.status_events(spark, sf_dir).filter("event_kind = 'H'").groupBy("sub_type", F.coalesce("reason", F.lit("-")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


TEXTS = "(select o_custkey % 50 k, o_orderkey % 3 <> 0 verified, o_orderkey created, 'text ' || o_orderkey as text from orders)"


def _texts(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 k", "o_orderkey % 3 != 0 verified", "o_orderkey created", "concat('text ', o_orderkey) text")


@plain(f"select k, text from (select *, row_number() over (partition by k order by verified desc, created desc) p from {TEXTS}) where p = 1")
def prune_best(spark, sf_dir):
    return tables.best_texts(_texts(spark, sf_dir), ["k"]).select("k", "text")


@plain(f"select count(*) total, count(*) filter (where reachable and p = 1) keep, count(*) filter (where not reachable) unreachable, count(*) filter (where reachable and p > 1) superseded from (select *, k in (select s_suppkey from supplier where s_suppkey % 2 = 0) reachable, row_number() over (partition by k order by verified desc, created desc) p from {TEXTS})")
def prune_report(spark, sf_dir):
    selected = fx.table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"))
    return tables.prune_report(_texts(spark, sf_dir), selected, ["k"])


@query("select trading_date, sha256(string_agg(event_id || chr(0) || scorer_id, chr(30) order by event_id)) content_hash from events group by 1")
def content_hash(spark, sf_dir):
    return tables.content_hash(ev.events(spark, sf_dir), ["trading_date"], ["event_id"], ["event_id", "scorer_id"])


@plain("select s_suppkey k, case when s_suppkey % 3 = 0 then 'new' else s_name end as name, case when s_suppkey % 3 = 0 then s_acctbal + 1 else s_acctbal end as v from supplier union all select 1000000 + n_nationkey, 'new', cast(n_nationkey as double) from nation")
def upsert_merge(spark, sf_dir):
    target = fx.table(spark, sf_dir, "supplier").selectExpr("s_suppkey k", "s_name name", "s_acctbal v")
    updates = fx.table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").selectExpr("s_suppkey k", "'new' name", "s_acctbal + 1 v").unionByName(fx.table(spark, sf_dir, "nation").selectExpr("1000000L + n_nationkey k", "'new' name", "cast(n_nationkey as double) v"))
    return patterns.upsert(target, updates, ["k"])


@plain("select s_suppkey k, s_name as name, case when s_suppkey % 3 = 0 and s_suppkey % 2 = 0 then s_acctbal + 1 else s_acctbal end as v from supplier")
def symbol_merge(spark, sf_dir):
    target = fx.table(spark, sf_dir, "supplier").selectExpr("s_suppkey k", "s_name name", "s_acctbal v")
    updates = fx.table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").selectExpr("s_suppkey k", "cast(null as string) name", "case when s_suppkey % 2 = 0 then s_acctbal + 1 end v")
    return patterns.upsert_keeping(target, updates, ["k"])


@query("select symbol, arg_max(price_raw, (ts_nanos, seq)) price_raw from trades group by 1")
def prior_close(spark, sf_dir):
    from ..sources import files

    return files.prior_close(fx.trades(spark, sf_dir))


@query("select a.trading_date, a.order_id, (select arg_max(t.price_raw, (t.ts_nanos, t.seq)) from trades t where t.symbol = a.symbol and t.ts_nanos <= a.ts_nanos) price_raw from orders_add a")
def asof_price(spark, sf_dir):
    at = fx.orders_add(spark, sf_dir).select("trading_date", "order_id", "symbol", "ts_nanos")
    return patterns.asof_last(fx.trades(spark, sf_dir), at, ["symbol"], "price_raw").select("trading_date", "order_id", "price_raw")


@query("select a.trading_date, a.order_id, coalesce((select cast(sum(t.size) as bigint) from trades t where t.symbol = a.symbol and t.ts_nanos <= a.ts_nanos), 0) size from orders_add a")
def asof_volume(spark, sf_dir):
    at = fx.orders_add(spark, sf_dir).select("trading_date", "order_id", "symbol", "ts_nanos")
    return patterns.asof_sum(fx.trades(spark, sf_dir).withColumn("size", F.col("size").cast("bigint")), at, ["symbol"], "size").select("trading_date", "order_id", "size")


@plain("""select distinct d as day from (select o_orderdate::date as d from orders union select unnest(generate_series(date '2024-03-01', date '2024-03-20', interval 1 day))::date) where dayofweek(d) between 1 and 5""")
def date_scope(spark, sf_dir):
    days = fx.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return tables.date_scope(days, spark.sql("select '2024-03-20' a, '2024-03-01' b"))


@plain("""select kind, start, cast(case kind when 'week' then start + interval 7 day when 'quarter' then start + interval 3 month else start + interval 1 year end as date) as end,
  date_diff('day', start, cast(case kind when 'week' then start + interval 7 day when 'quarter' then start + interval 3 month else start + interval 1 year end as date)) n_days from (
  select distinct kind, start from (select 'week' kind, cast(date_trunc('week', o_orderdate) as date) as start from orders union all select 'quarter', cast(date_trunc('quarter', o_orderdate) as date) from orders union all select 'year', cast(date_trunc('year', o_orderdate) as date) from orders))""")
def forward_ranges(spark, sf_dir):
    rows = tables.forward_ranges(tables.touched_periods(fx.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))))
    return rows.withColumn("n_days", F.col("n_days").cast("bigint"))


@plain("select distinct cast(w as date) week_start, cast(w + to_days(cast(i as integer)) as date) as day from (select date_trunc('week', o_orderdate) w from orders), range(5) r(i)")
def rebuild_scope(spark, sf_dir):
    return tables.rebuild_scope(fx.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))).select("week_start", "day")


@plain("select distinct cast(o_orderdate as date) as day from orders where cast(o_orderdate as date) not in (select cast(o_orderdate as date) from orders group by 1 having count(*) % 3 = 0)")
def days_to_ingest(spark, sf_dir):
    days = fx.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    runs = days.select("day", F.lit("ORDERS").alias("feed_source"), F.when(F.col("n") % 3 == 0, "ok").otherwise("parse_failed").alias("status"))
    return patterns.not_ingested(days.select("day"), runs, "ORDERS", "day")


@plain("select cast(o_orderdate as date) as day, count(*) n from orders where cast(o_orderdate as date) >= cast(date_trunc('week', date '1997-06-11') as date) - 28 group by 1")
def retention_sweep(spark, sf_dir):
    """Rows that a sweep on a day keeps of the last four weeks and later."""
    rows = fx.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return patterns.retained(rows, "1997-06-11", 4, "day").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("select symbol, cast(sum(size) as bigint) total_volume, count(*) trade_count from orders_executed where trading_date = date '2024-01-05' group by 1")
def one_day_volume(spark, sf_dir):
    """One feed's volume of one day, as a refresh computes it."""
    rows = patterns.feed_rows(patterns.day_rows(fx.orders_executed(spark, sf_dir), "2024-01-05"), "ORDERS")
    return ev.lc.daily_volume(rows).select("symbol", "total_volume", "trade_count")


@plain("select distinct kind, start from (select 'week' kind, cast(date_trunc('week', o_orderdate) as date) as start from orders union all select 'quarter', cast(date_trunc('quarter', o_orderdate) as date) from orders union all select 'year', cast(date_trunc('year', o_orderdate) as date) from orders)")
def touched_periods(spark, sf_dir):
    return tables.touched_periods(fx.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")))


@plain("select cast(o_orderdate as date) as day, cast(date_trunc('week', o_orderdate) as date) - 14 boundary, count(*) n from orders group by 1, 2")
def retention(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return fx.table(spark, sf_dir, "orders").groupBy(day.alias("day"), fmt.retention_boundary(day, 2).alias("boundary")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select {PHASE} phase, count(*) n, min(ts_nanos) first_ts from trades group by 1")
def session_phase(spark, sf_dir):
    return fx.trades(spark, sf_dir).groupBy(fmt.session_phase(F.col("ts_nanos")).alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_nanos").alias("first_ts"))


_D = "(o_orderkey * o_orderkey * 977 * (1 + o_custkey))"


_tenths = lambda half, unit: f"((n + {half}) // {unit})"


@plain(f"""select o_orderkey, case when n < 1000 then n || ' ns' when n < 1000000 then printf('%d.%02d μs', {_tenths(5, 10)} // 100, {_tenths(5, 10)} % 100) when n < 1000000000 then printf('%d.%d ms', {_tenths(50000, 100000)} // 10, {_tenths(50000, 100000)} % 10)
  when n < 60000000000 then printf('%d.%d sec', {_tenths(50000000, 100000000)} // 10, {_tenths(50000000, 100000000)} % 10)
  when n // 1000000000 < 3600 then (n // 60000000000) || 'm ' || (n // 1000000000 % 60) || 's' else (n // 3600000000000) || 'h ' || (n // 1000000000 % 3600 // 60) || 'm' end as text from (select o_orderkey, {_D} n from orders)""")
def duration_text(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_D.replace('o_orderkey', 'cast(o_orderkey as decimal(38,0))', 1)} n")  # beyond 64 bits at a million orders
    return rows.select("o_orderkey", fmt.duration(F.col("n")).alias("text"))


@plain("""select o_orderkey, case when s < 60 then s || case when s = 1 then ' second' else ' seconds' end when s < 3600 then (s // 60) || case when s // 60 = 1 then ' minute' else ' minutes' end || case when s % 60 = 0 then '' else ' ' || (s % 60) || case when s % 60 = 1 then ' second' else ' seconds' end end
  else (s // 3600) || case when s // 3600 = 1 then ' hour' else ' hours' end || case when s % 3600 // 60 = 0 then '' else ' ' || (s % 3600 // 60) || case when s % 3600 // 60 = 1 then ' minute' else ' minutes' end end end as text from (select o_orderkey, o_custkey * 13 % 9000 s from orders)""")
def duration_words(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey * 13 % 9000 s").select("o_orderkey", fmt.duration_words(F.col("s")).alias("text"))


@plain("select s_suppkey, s_name || ' Inc.' as name from supplier")
def company_names(spark, sf_dir):
    raw = fx.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat(s_name, case s_suppkey % 5 when 0 then ' Inc. - Common Stock' when 1 then ' Inc. Class A Ordinary Shares (Ireland)' when 2 then ' Inc., Series 1' when 3 then '  Inc. due October 30, 2043' else ' Inc./tx' end) raw")
    return raw.select("s_suppkey", fmt.company(F.col("raw")).alias("name"))


@plain("select o_orderkey, o_orderkey || case when o_orderkey % 100 between 11 and 13 then 'th' when o_orderkey % 10 = 1 then 'st' when o_orderkey % 10 = 2 then 'nd' when o_orderkey % 10 = 3 then 'rd' else 'th' end as text from orders")
def ordinals(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", fmt.ordinal(F.col("o_orderkey")).alias("text"))


@query(f"""select trading_date, symbol, n, {ev.r6('rv')} realized_vol, {ev.r6('cv')} variation from (
  select trading_date, symbol, count(*) n, sqrt(coalesce(sum(lm * lm), 0)) rv, case when count(*) >= 2 then stddev_samp(p) / nullif(avg(p), 0) end cv from (select *, case when p > 0 and before_ > 0 then ln(p / before_) end lm from (
  select *, price_raw / 10000.0 p, lag(price_raw / 10000.0) over (partition by trading_date, symbol order by ts_nanos, seq) before_ from trades)) group by 1, 2) where n >= 2""")
def realized_vol(spark, sf_dir):
    keys, p = ["trading_date", "symbol"], F.col("price_raw") / 10_000.0
    rows = patterns.with_before(fx.trades(spark, sf_dir).withColumn("p", p), keys, ["ts_nanos", "seq"], "p", "before")
    move = F.when((F.col("p") > 0) & (F.col("before") > 0), F.log(F.col("p") / F.col("before")))
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.coalesce(F.sum(move * move), F.lit(0.0))).alias("realized_vol"), (F.stddev_samp("p") / F.nullif(F.avg("p"), F.lit(0.0))).alias("variation"))
    return ev.rounded(found.filter("n >= 2"), "realized_vol", "variation")


@query(f"""select symbol, n, {ev.r6('(sq / 10 - mean * mean) / mean')} fano, {ev.r6('case when (sq / 10 - mean * mean) / mean > 1 then least(0.999, 1 - 1 / sqrt((sq / 10 - mean * mean) / mean)) end')} branching from (
  select symbol, sum(c) n, cast(sum(c * c) as double) sq, sum(c) / 10.0 mean from (select symbol, b, count(*) c from (select t.symbol, least(cast(floor((ts_nanos - lo) / cast(hi - lo as double) * 10) as integer), 9) b from trades t join (select symbol, min(ts_nanos) lo, max(ts_nanos) hi from trades group by 1) r using (symbol)) group by 1, 2) group by 1)""")
def fano(spark, sf_dir):
    trades = fx.trades(spark, sf_dir).select("symbol", "ts_nanos")
    spans = trades.groupBy("symbol").agg(F.min("ts_nanos").alias("low"), (F.max("ts_nanos") - F.min("ts_nanos")).alias("span"))
    in_bin = F.when(F.col("span") > 0, F.least(F.floor((F.col("ts_nanos") - F.col("low")) / F.col("span") * 10), F.lit(9)))
    counts = trades.join(spans, "symbol").groupBy("symbol", "span", in_bin.alias("bin")).agg(F.count(F.lit(1)).alias("c"))  # Spark broadcasts spans, a row for each symbol, if they are small
    sums = counts.groupBy("symbol", "span").agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"))
    mean = F.col("n") / 10.0
    f = F.when((F.col("n") >= 2) & (F.col("span") > 0), (F.col("squares") / 10 - mean * mean) / mean)
    return ev.rounded(sums.select("symbol", "n", f.alias("fano"), stats.branching_ratio(f).alias("branching")), "fano", "branching")
