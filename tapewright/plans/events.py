"""Queries on order flow: lifecycles, baselines, detectors, selection, nesting; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt, stats
from ..operators import detectors as dt
from ..operators import lifecycle as lc
from ..operators import patterns
from ..operators import selection as sel
from ..session import written
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

SEC = 1_000_000_000
#: Thresholds that fit the fixture, whose flow is thinner than a market's.
SWEEP = {"max_gap": 5 * SEC, "least_levels": 3}
POST_CANCEL = {"max_gap": 5 * SEC, "least_orders": 4}
LAYERING = {"max_gap": 5 * SEC, "least_orders": 4, "least_levels": 3}
WITHDRAWAL = {"max_gap": 2 * SEC, "least_deletes": 4}
ICEBERG = {"max_gap": 60 * SEC, "least_fills": 3, "least_span": SEC, "most_cv": 1.0}


def query(sql: str | None = None, tables: bool = True):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = f"with {fx.SQL} {sql}" if tables else sql
        return function

    return add


def r6(x: str) -> str:
    """Rounding half up to six decimals, in SQL."""
    return f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: fmt.rounded(F.col(n), digits) for n in names})


def tod(ts: str) -> str:
    """The weight of the New York session phase in winter, in SQL."""
    minute = f"((({ts}) // 60000000000 - 300) % 1440)"
    return f"(case when {minute} < 240 then 0.80 when {minute} < 570 then 0.95 when {minute} < 575 then 1.10 when {minute} < 690 then 1.02 when {minute} < 840 then 0.98 when {minute} < 955 then 1.05 when {minute} < 960 then 1.10 when {minute} < 1200 then 0.95 else 0.80 end)"


def islands(source: str, keys: str, order: str, gap: int, where: str = "true", cap: int = 10_000) -> str:
    time = order.split(",")[0]
    return f"""(select *, (row_number() over (partition by {keys}, island order by {order}) - 1) // {cap} part from (
        select *, sum(brk) over (partition by {keys} order by {order} rows unbounded preceding) island from (
        select *, case when {time} - lag({time}) over (partition by {keys} order by {order}) > {gap} then 1 else 0 end brk from {source} where {where})))"""


LIFE_SQL = "select trading_date, symbol, order_id, side, add_ts_nanos, add_price_raw, add_size, delete_ts_nanos, execute_ts_nanos, terminal_state, lifetime_ns from lifecycle"


def _lifecycle(spark, sf_dir):
    return lc.order_lifecycle(fx.orders_add(spark, sf_dir), fx.orders_delete(spark, sf_dir), fx.orders_executed(spark, sf_dir))


@query(LIFE_SQL)
def order_lifecycle(spark, sf_dir):
    return _lifecycle(spark, sf_dir).drop("feed_source")


@query("select trading_date, order_id, max(ts_nanos) execute_ts_nanos from orders_executed group by all")
def last_execution(spark, sf_dir):
    return lc.last_execution(fx.orders_executed(spark, sf_dir))


@query(f"select * from ({LIFE_SQL}) where terminal_state = 'deleted' and lifetime_ns > 0 and lifetime_ns <= 50000000")
def short_lived_orders(spark, sf_dir):
    return lc.short_lived(_lifecycle(spark, sf_dir)).drop("feed_source")


@query("select x.trading_date, x.order_id, x.ts_nanos, x.size, a.side resting_side from orders_executed x join orders_add a using (trading_date, order_id)")
def resting_side(spark, sf_dir):
    return lc.with_resting_side(fx.orders_executed(spark, sf_dir), _lifecycle(spark, sf_dir)).select("trading_date", "order_id", "ts_nanos", "size", "resting_side")


DAILY = "(select trading_date as day, symbol, cast(sum(size) as bigint) total_volume, count(*) trade_count, cast(round(avg(price_raw)) as bigint) avg_price_raw, min(price_raw) min_price_raw, max(price_raw) max_price_raw from trades group by all)"
DAILY_LIFE = "(select trading_date as day, symbol, cast(round(avg(lifetime_ns)) as bigint) avg_lifetime_ns, count(*) order_count from lifecycle where terminal_state <> 'open' group by all)"


@query(f"select * from {DAILY}")
def daily_volume(spark, sf_dir):
    return lc.daily_volume(fx.trades(spark, sf_dir))


@query(f"select * from {DAILY_LIFE}")
def daily_lifetime(spark, sf_dir):
    return lc.daily_lifetime(_lifecycle(spark, sf_dir))


@query(f"select day, symbol, {r6('avg(total_volume) over w')} avg_volume, {r6('avg(trade_count) over w')} avg_trades, count(*) over w n_days from {DAILY} window w as (partition by symbol order by day rows between 30 preceding and 1 preceding)")
def baseline_30(spark, sf_dir):
    return rounded(lc.baseline_rows(lc.daily_volume(fx.trades(spark, sf_dir))), "avg_volume", "avg_trades")


WINDOWS = "(select t.day, t.symbol, any_value(t.total_volume) today, count(b.day) n_days, list(cast(b.total_volume as double) order by b.day) filter (where b.day is not null) vals, quantile_cont(b.total_volume, 0.5) median from {0} t left join {0} b on t.symbol = b.symbol and b.day < t.day and b.day >= t.day - 14 group by t.day, t.symbol)".format(DAILY)


def _windows(spark, sf_dir):
    return lc.trailing(lc.daily_volume(fx.trades(spark, sf_dir)), "total_volume").withColumn("median", stats.median(F.col("values")))


@query(f"select day, symbol, n_days, cast(median as double) median from {WINDOWS}")
def trailing_median(spark, sf_dir):
    return _windows(spark, sf_dir).select("day", "symbol", "n_days", "median")


MAD = "(select day, symbol, any_value(today) today, any_value(median) median, quantile_cont(abs(v - median), 0.5) mad from (select day, symbol, today, median, unnest(vals) v from {0}) group by day, symbol)".format(WINDOWS)


@query(f"select day, symbol, cast(mad as double) mad, {r6('case when mad > 0 then (today - median) / (1.4826 * mad) else 0.0 end')} robust_z from {MAD}")
def robust_stats(spark, sf_dir):
    mad = stats.mad(F.col("values"))
    rows = _windows(spark, sf_dir).filter("n_days > 0").select("day", "symbol", "total_volume", "median", mad.alias("mad"))
    return rounded(rows.select("day", "symbol", "mad", stats.robust_z(F.col("total_volume").cast("double"), F.col("median"), F.col("mad")).alias("robust_z")), "robust_z")


@query(f"select day, symbol, {r6('len(list_filter(vals, lambda x : x < today)) * 100.0 / len(vals)')} percentile_rank from {WINDOWS} where n_days > 0")
def percentile_rank(spark, sf_dir):
    rows = _windows(spark, sf_dir).filter("n_days > 0").select("day", "symbol", stats.percentile_rank(F.col("values"), F.col("total_volume").cast("double")).alias("percentile_rank"))
    return rounded(rows, "percentile_rank")


@query(f"""select day, symbol, {r6('case when n >= 2 and sd > 0 then top / (n * sd) end')} regime_shift from (
  select day, symbol, count(*) n, stddev_pop(v) sd, max(abs(walk)) top from (
    select day, symbol, v, sum(v - m) over (partition by day, symbol order by i) walk from (
      select day, symbol, unnest(vals) v, generate_subscripts(vals, 1) i, list_avg(vals) m from {WINDOWS} where n_days > 0)) group by 1, 2)""")
def cusum(spark, sf_dir):
    rows = _windows(spark, sf_dir).filter("n_days > 0").select("day", "symbol", stats.cusum(F.col("values")).alias("regime_shift"))
    return rounded(rows, "regime_shift")


SWEEPS = f"""select trading_date, symbol, ts_nanos, ts_end_nanos, 'sweep' scorer_id, (log10(greatest(notional, 1.0)) + log10(greatest(cast(n_levels as double), 1.0))) * {tod('ts_nanos')} score, n_rows, n_levels, total_shares, notional,
  case when first_price <= 0 then 0.0 else (last_price - first_price) / first_price * 10000.0 end slippage_bps from (
  select trading_date, symbol, island, part, count(*) n_rows, count(distinct price_raw) n_levels, cast(sum(size) as bigint) total_shares, sum(size * price_raw) / 10000.0 notional, min(ts_nanos) ts_nanos, max(ts_nanos) ts_end_nanos,
    cast(first(price_raw order by ts_nanos, order_id, trade_id) as double) first_price, cast(last(price_raw order by ts_nanos, order_id, trade_id) as double) last_price
  from {islands('orders_executed', 'trading_date, symbol', 'ts_nanos, order_id, trade_id', SWEEP['max_gap'])} group by trading_date, symbol, island, part) where n_levels >= 3"""


def _sweeps(spark, sf_dir):
    return dt.sweeps(fx.orders_executed(spark, sf_dir), **SWEEP)


@query(f"select trading_date, symbol, ts_nanos, ts_end_nanos, scorer_id, {r6('score')} score, n_rows, n_levels, total_shares, {r6('notional')} notional, {r6('slippage_bps')} slippage_bps, row_number() over (order by {r6('score')} desc, symbol, ts_nanos) as rank from ({SWEEPS}) order by rank limit 100")
def sweep_events(spark, sf_dir):
    """The hundred strongest multi-price bursts."""
    rows = rounded(_sweeps(spark, sf_dir), "score", "notional", "slippage_bps").select("trading_date", "symbol", "ts_nanos", "ts_end_nanos", "scorer_id", "score", "n_rows", "n_levels", "total_shares", "notional", "slippage_bps")
    top = rows.orderBy(F.desc("score"), "symbol", "ts_nanos").limit(100)
    return patterns.first_rows(top.withColumn("one", F.lit(1)), ["one"], [F.desc("score"), "symbol", "ts_nanos"], 100, "rank").drop("one").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"select trading_date, symbol, ts_nanos, ts_end_nanos, {r6('score')} score, n_rows, n_levels, total_shares, {r6('slippage_bps')} slippage_bps from ({SWEEPS})")
def sweep_clusters(spark, sf_dir):
    return rounded(_sweeps(spark, sf_dir).select("trading_date", "symbol", "ts_nanos", "ts_end_nanos", "score", "n_rows", "n_levels", "total_shares", "slippage_bps"), "score", "slippage_bps")


def short_clusters(where: str) -> str:
    return f"""(select * from (select trading_date, symbol, side, count(*) n_rows, count(distinct add_price_raw) n_levels, cast(sum(add_size) as bigint) total_shares, min(add_price_raw) min_price_raw, max(add_price_raw) max_price_raw,
  min(add_ts_nanos) ts_nanos, max(add_ts_nanos) ts_end_nanos, list(lifetime_ns order by lifetime_ns)[count(*) // 2 + 1] median_lifetime_ns, list(add_ts_nanos order by add_ts_nanos, order_id) times
  from {islands('lifecycle', 'trading_date, symbol, side', 'add_ts_nanos, order_id', POST_CANCEL['max_gap'], "terminal_state = 'deleted' and lifetime_ns > 0 and lifetime_ns <= 50000000")} group by trading_date, symbol, side, island, part) where {where})"""


POST = f"select trading_date, symbol, ts_nanos, ts_end_nanos, 'post_cancel_cluster' scorer_id, log10(greatest(cast(total_shares as double), 1.0)) * n_rows * {tod('ts_nanos')} score, side, n_rows, n_levels, total_shares, median_lifetime_ns, times from {short_clusters('n_rows >= 4')}"
LAYER = f"select trading_date, symbol, ts_nanos, ts_end_nanos, 'layering' scorer_id, log10(greatest(cast(total_shares as double), 1.0)) * n_levels * {tod('ts_nanos')} score, side, n_rows, n_levels, total_shares, case when n_rows / n_levels < 2 then 'sparse' when n_rows / n_levels < 5 then 'moderate' else 'stacked' end density, (max_price_raw - min_price_raw) / ((min_price_raw + max_price_raw) / 2) * 10000.0 range_bps from {short_clusters('n_rows >= 4 and n_levels >= 3')}"


@query(f"""select trading_date, symbol, ts_nanos, ts_end_nanos, side, {r6('score')} score, n_rows, n_levels, total_shares, median_lifetime_ns, {r6('ac')} arrival_autocorr from (
 select p.*, (select case when count(*) >= 3 and sum((g - m) * (g - m)) > 0 then sum(case when prev is not null then (prev - m) * (g - m) else 0 end) / sum((g - m) * (g - m)) end from (
   select g, lag(g) over (order by i) prev, avg(g) over () m from (select i, cast(times[i + 1] - times[i] as double) g from range(1, n_rows) t(i)))) ac from ({POST}) p)""")
def post_cancel_clusters(spark, sf_dir):
    rows = dt.post_cancel_clusters(_lifecycle(spark, sf_dir), **POST_CANCEL)
    return rounded(rows.select("trading_date", "symbol", "ts_nanos", "ts_end_nanos", "side", "score", "n_rows", "n_levels", "total_shares", "median_lifetime_ns", "arrival_autocorr"), "score", "arrival_autocorr")


@query(f"select trading_date, symbol, ts_nanos, ts_end_nanos, side, {r6('score')} score, n_rows, n_levels, total_shares, density, {r6('range_bps')} range_bps from ({LAYER})")
def layering_clusters(spark, sf_dir):
    rows = dt.layering(_lifecycle(spark, sf_dir), **LAYERING)
    return rounded(rows.select("trading_date", "symbol", "ts_nanos", "ts_end_nanos", "side", "score", "n_rows", "n_levels", "total_shares", "density", "range_bps"), "score", "range_bps")


ICE = f"""select trading_date, symbol, ts_nanos, ts_end_nanos, 'iceberg' scorer_id, log10(greatest(cast(total_shares as double), 1.0)) * n_rows * {tod('ts_nanos')} score, price_raw, n_rows, total_shares, size_cv, cadence_cv from (
  select trading_date, symbol, price_raw, count(*) n_rows, cast(sum(size) as bigint) total_shares, stddev_pop(size) / avg(size) size_cv, count(*) * sum(size::bigint * size) <= 2 * sum(size) * sum(size) even, stddev_samp(gap) / avg(gap) cadence_cv, min(ts_nanos) ts_nanos, max(ts_nanos) ts_end_nanos from (
    select *, ts_nanos - lag(ts_nanos) over (partition by trading_date, symbol, price_raw, island, part order by ts_nanos, order_id, trade_id) gap
    from {islands('orders_executed', 'trading_date, symbol, price_raw', 'ts_nanos, order_id, trade_id', ICEBERG['max_gap'])}) group by trading_date, symbol, price_raw, island, part)
  where n_rows >= 3 and ts_end_nanos - ts_nanos >= {SEC} and even"""


@query(f"select trading_date, symbol, ts_nanos, ts_end_nanos, price_raw, {r6('score')} score, n_rows, total_shares, {r6('size_cv')} size_cv, {r6('cadence_cv')} cadence_cv from ({ICE})")
def iceberg_runs(spark, sf_dir):
    rows = dt.icebergs(fx.orders_executed(spark, sf_dir), **ICEBERG)
    return rounded(rows.select("trading_date", "symbol", "ts_nanos", "ts_end_nanos", "price_raw", "score", "n_rows", "total_shares", "size_cv", "cadence_cv"), "score", "size_cv", "cadence_cv")


WITHDRAW = f"""select trading_date, symbol, ts_nanos, ts_end_nanos, 'liquidity_withdrawal' scorer_id, log10(cast(n_rows as double)) * n_rows * {tod('ts_nanos')} score, n_rows, case when secs > 0 then n_rows / secs else 0.0 end rate_per_second,
  case when secs < 1 then 'sub_second' when secs < 10 then 'brief' when secs < 60 then 'sustained' else 'extended' end intensity from (
  select trading_date, symbol, count(*) n_rows, min(ts_nanos) ts_nanos, max(ts_nanos) ts_end_nanos, (max(ts_nanos) - min(ts_nanos)) / 1e9 secs
  from {islands('orders_delete', 'trading_date, symbol', 'ts_nanos, order_id', WITHDRAWAL['max_gap'])} group by trading_date, symbol, island, part) where n_rows >= 4"""


@query(f"select trading_date, symbol, ts_nanos, ts_end_nanos, {r6('score')} score, n_rows, {r6('rate_per_second')} rate_per_second, intensity from ({WITHDRAW})")
def withdrawal_bursts(spark, sf_dir):
    rows = dt.withdrawals(fx.orders_delete(spark, sf_dir), **WITHDRAWAL)
    return rounded(rows.select("trading_date", "symbol", "ts_nanos", "ts_end_nanos", "score", "n_rows", "rate_per_second", "intensity"), "score", "rate_per_second")


@query(f"""select trading_date, symbol, ts_nanos, next_ts ts_end_nanos, {r6(f"case when secs is null then 0.0 else log10(secs + 1.0) * {tod('ts_nanos')} end")} score, secs duration_seconds,
  case when secs < 300 then 'under_5min' when secs < 1800 then '5_to_30min' when secs < 7200 then '30min_to_2h' when secs < 11700 then '2h_to_half_session' when secs < 23400 then 'half_to_full_session' when secs is not null then 'exceeds_full_session' end duration_bucket,
  coalesce(next_sub = 'T', false) resumed, case reason when 'T1' then 'news-pending halt' when 'LUDP' then 'LULD price-band halt' else 'trading halt' end reason_label from (
  select *, next_ts // 1000000000 - ts_nanos // 1000000000 secs from (
    select *, lead(ts_nanos) over w next_ts, lead(sub_type) over w next_sub from status_events where event_kind = 'H' window w as (partition by symbol order by ts_nanos, seq)) where sub_type = 'H')""")
def halt_pairs(spark, sf_dir):
    return rounded(dt.halts(fx.status_events(spark, sf_dir)).drop("scorer_id", "phase_span"), "score")


@query(f"""select trading_date, t.symbol, ts_nanos, trade_id, {r6(f"log10(notional) * {tod('ts_nanos')}")} score, cast(size as bigint) total_shares, {r6('notional')} notional, {r6('case when median > 0 then size / median * 100.0 end')} pct_of_baseline_volume,
  {r6('case when prev_close_dollars > 0 then (price_raw / 10000.0 - prev_close_dollars) / prev_close_dollars * 100.0 end')} pct_from_prev_close, size // round_lot round_lots from (select *, size * (price_raw / 10000.0) notional from trades where size * price_raw > 5000 * 10000) t
  left join {WINDOWS} w on t.trading_date = w.day and t.symbol = w.symbol left join symbols s on t.symbol = s.symbol""")
def large_trades(spark, sf_dir):
    rows = dt.large_trades(fx.trades(spark, sf_dir), _windows(spark, sf_dir), fx.symbols(spark, sf_dir), 5000)
    return rounded(rows.drop("scorer_id", "ts_end_nanos"), "score", "notional", "pct_of_baseline_volume", "pct_from_prev_close")


@query(f"select day trading_date, symbol, {r6('today / median')} score, today total_shares, cast(median as double) baseline_median, n_days from {WINDOWS} where n_days >= 3 and median >= 1 and today >= 1 and today / median >= 1.5")
def volume_deviation(spark, sf_dir):
    rows = dt.volume_deviations(lc.daily_volume(fx.trades(spark, sf_dir)), least_median=1, least_volume=1, least_ratio=1.5)
    return rounded(rows.select("trading_date", "symbol", "score", "total_shares", "baseline_median", "n_days"), "score")


LIFE_WINDOWS = "(select t.day, t.symbol, any_value(t.avg_lifetime_ns) today, any_value(t.order_count) order_count, count(b.day) n_days, quantile_cont(b.avg_lifetime_ns, 0.5) median from {0} t left join {0} b on t.symbol = b.symbol and b.day < t.day and b.day >= t.day - 14 group by t.day, t.symbol)".format(DAILY_LIFE)


@query(f"select day trading_date, symbol, {r6('greatest(today / median, median / today)')} score, order_count n_rows, today avg_lifetime_ns, cast(median as double) baseline_median, case when today < median then 'shorter' else 'longer' end direction from {LIFE_WINDOWS} where n_days >= 5 and median >= 1 and order_count >= 5 and greatest(today / median, median / today) >= 1.2")
def lifetime_drift(spark, sf_dir):
    rows = dt.lifetime_drifts(lc.daily_lifetime(_lifecycle(spark, sf_dir)), least_ns=1, least_orders=5, least_factor=1.2)
    return rounded(rows.select("trading_date", "symbol", "score", "n_rows", "avg_lifetime_ns", "baseline_median", "direction"), "score")


# Events of five detectors in one table, for selection, nesting and summaries.
KEPT = ["trading_date", "symbol", "ts_nanos", "ts_end_nanos", "scorer_id", "score", "n_rows", "total_shares"]


def _kept(df: DataFrame) -> DataFrame:
    if "total_shares" not in df.columns:
        df = df.withColumn("total_shares", F.lit(0).cast("bigint"))
    return rounded(df.select(*KEPT), "score")


def events(spark, sf_dir) -> DataFrame:
    """Events of five detectors, written once and read by all that uses them."""
    life, executed = written(lc.short_lived(_lifecycle(spark, sf_dir)), "short-lived"), fx.orders_executed(spark, sf_dir)
    found = [dt.sweeps(executed, **SWEEP), dt.post_cancel_clusters(life, **POST_CANCEL), dt.layering(life, **LAYERING), dt.icebergs(executed, **ICEBERG), dt.withdrawals(fx.orders_delete(spark, sf_dir), **WITHDRAWAL)]
    out = _kept(found[0])
    for df in found[1:]:
        out = out.unionByName(_kept(df))
    return written(out.withColumn("event_id", sel.event_key()), "events")


_columns = f"trading_date, symbol, ts_nanos, ts_end_nanos, scorer_id, {r6('score')} score, n_rows"
EVENTS = f"""events as (select *, concat_ws('|', cast(trading_date as varchar), symbol, scorer_id, cast(ts_nanos as varchar), cast(ts_end_nanos as varchar), cast(n_rows as varchar), cast(total_shares as varchar)) event_id from (
  select {_columns}, total_shares from ({SWEEPS}) union all select {_columns}, total_shares from ({POST}) union all select {_columns}, total_shares from ({LAYER})
  union all select {_columns}, total_shares from ({ICE}) union all select {_columns}, cast(0 as bigint) from ({WITHDRAW})))"""


def event_query(sql: str, more: str = ""):
    """query() on the events table."""
    return query(f", {EVENTS} {more} {sql}")


@event_query("select trading_date, symbol, ts_nanos, ts_end_nanos, scorer_id, score, n_rows, total_shares, event_id from events")
def scored_events(spark, sf_dir):
    return events(spark, sf_dir)


NEST = """, ranked as (select *, row_number() over (partition by trading_date, scorer_id order by score desc, ts_nanos, event_id) rn, count(*) over (partition by trading_date, scorer_id) n from events),
parents as (select * from ranked where rn <= greatest(1, least(30, ceil(0.05 * n)))),
claims as (select c.event_id child_id, p.event_id parent_id, row_number() over (partition by c.event_id order by p.score desc, p.ts_nanos, p.event_id) pick
  from events c join parents p on c.trading_date = p.trading_date and c.symbol = p.symbol and c.scorer_id <> p.scorer_id and c.ts_nanos >= p.ts_nanos and c.ts_end_nanos <= p.ts_end_nanos
  where not (c.ts_nanos = p.ts_nanos and c.ts_end_nanos = p.ts_end_nanos and (c.score > p.score or (c.score = p.score and (c.scorer_id < p.scorer_id or (c.scorer_id = p.scorer_id and c.event_id < p.event_id)))) and c.event_id in (select event_id from parents))),
nested as (select e.*, c.parent_id subsumed_by from events e left join (select * from claims where pick = 1) c on e.event_id = c.child_id)"""


@event_query("select event_id, score, subsumed_by from nested", NEST)
def nested_events(spark, sf_dir):
    return sel.nest(events(spark, sf_dir)).select("event_id", "score", "subsumed_by")


@event_query("select subsumed_by parent_id, scorer_id, count(*) n_children, cast(sum(n_rows) as bigint) n_rows, cast(sum(total_shares) as bigint) total_shares from nested where subsumed_by is not null group by all", NEST)
def nested_children(spark, sf_dir):
    return sel.children(sel.nest(events(spark, sf_dir)))


SELECT = NEST + """, kept as (select *, row_number() over (partition by trading_date, scorer_id order by score desc, ts_nanos, event_id) rs, count(*) over (partition by trading_date, scorer_id) n from nested where subsumed_by is null),
budgeted as (select *, row_number() over (partition by trading_date, symbol order by score desc, ts_nanos, event_id) ry from kept where rs <= greatest(3, least(30, ceil(0.05 * n)))),
selected as (select trading_date, symbol, ts_nanos, ts_end_nanos, scorer_id, score, event_id, row_number() over (partition by trading_date order by score desc, ts_nanos, event_id) narration_rank from budgeted where ry <= 8)"""


@event_query("select * from selected", SELECT)
def select_top(spark, sf_dir):
    return sel.select_top(sel.nest(events(spark, sf_dir)))


@event_query("select trading_date, scorer_id, event_id, narration_rank, row_number() over (partition by trading_date order by scorer_id, narration_rank) as place from selected", SELECT)
def selected_in_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = sel.select_top(sel.nest(events(spark, sf_dir)))
    return rows.select("trading_date", "scorer_id", "event_id", "narration_rank", F.row_number().over(Window.partitionBy("trading_date").orderBy("scorer_id", "narration_rank")).cast("bigint").alias("place"))
