"""Queries on what events say of themselves: all nine detectors, their facts and source rows, and what the book adds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flags, fmt, stats
from ..operators import book, daybook, enrich, tables, validate
from ..operators import detectors as dt
from ..operators import lifecycle as lc
from ..operators import selection as sel
from ..session import written
from ..sources import files
from . import books
from . import events as ev
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEC = 1_000_000_000


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = f"with {fx.SQL}{sql}"
        return function

    return add


_BINS = "greatest(2, least(50, n_rows // 5))"
_COUNTS = f"list_transform(range({_BINS}), lambda b : len(list_filter(times, lambda t : least(floor((t - ts_nanos) / (ts_end_nanos - ts_nanos) * {_BINS}), {_BINS} - 1) = b)))"


@query(f""", bursts as ({ev.POST}), counted as (select *, {_COUNTS} counts from bursts where ts_end_nanos > ts_nanos),
fanos as (select *, (list_sum(list_transform(counts, lambda c : c * c)) / {_BINS} - (n_rows / {_BINS}) * (n_rows / {_BINS})) / (n_rows / {_BINS}) f from counted)
select b.trading_date, b.symbol, b.side, b.ts_nanos, b.ts_end_nanos, {ev.r6('f')} burstiness_fano, case when f > 5 then 'highly' when f > 2 then 'moderately' when f > 1 then 'weakly' end burstiness_class, {ev.r6('case when f > 1 then least(0.999, 1 - 1 / sqrt(f)) end')} self_excitation,
  least(b.n_rows, 32) n_refs, greatest(b.n_rows - 32, 0) truncated_count from bursts b left join fanos using (trading_date, symbol, side, ts_nanos, ts_end_nanos)""")
def burst_facts(spark, sf_dir):
    """How bunched the orders of a burst are, its class, the share that others set off, and its source rows."""
    rows = dt.post_cancel_clusters(written(lc.short_lived(ev._lifecycle(spark, sf_dir)), "short-lived"), **ev.POST_CANCEL)
    f = F.col("burstiness_fano")
    rows = rows.select("trading_date", "symbol", "side", "ts_nanos", "ts_end_nanos", f, stats.fano_class(f).alias("burstiness_class"), stats.branching_ratio(f).alias("self_excitation"), F.size("source_refs").cast("bigint").alias("n_refs"), F.col("truncated_count").cast("bigint").alias("truncated_count"))
    return ev.rounded(rows, "burstiness_fano", "self_excitation")


@query(f""", runs as (select trading_date, symbol, price_raw, count(*) n_rows, list(size order by size) sizes, count(*) * sum(size::bigint * size) <= 2 * sum(size) * sum(size) even, stddev_samp(gap) / avg(gap) cadence_cv, min(ts_nanos) ts_nanos, max(ts_nanos) ts_end_nanos, list(order_id order by ts_nanos, order_id, trade_id) ids from (
    select *, ts_nanos - lag(ts_nanos) over (partition by trading_date, symbol, price_raw, island, part order by ts_nanos, order_id, trade_id) gap
    from {ev.islands('orders_executed', 'trading_date, symbol, price_raw', 'ts_nanos, order_id, trade_id', ev.ICEBERG['max_gap'])}) group by trading_date, symbol, price_raw, island, part)
select trading_date, symbol, price_raw, ts_nanos, ts_end_nanos, cast(sizes[n_rows // 2 + 1] as bigint) median_fill, case when n_rows < 3 then null when cadence_cv < 0.3 then 'metronomic' when cadence_cv < 1 then 'regular' when cadence_cv < 2 then 'irregular' when cadence_cv is not null then 'erratic' end cadence_class,
  array_to_string(ids[1 : 32], ',') refs, greatest(n_rows - 32, 0) truncated_count from runs where n_rows >= 3 and ts_end_nanos - ts_nanos >= {SEC} and even""")
def iceberg_facts(spark, sf_dir):
    """Usual fill, cadence class and source orders of runs of even fills."""
    rows = dt.icebergs(fx.orders_executed(spark, sf_dir), **ev.ICEBERG)
    refs = F.array_join(F.transform("source_refs", lambda r: r["order_id"].cast("string")), ",")
    return rows.select("trading_date", "symbol", "price_raw", "ts_nanos", "ts_end_nanos", "median_fill", "cadence_class", refs.alias("refs"), F.col("truncated_count").cast("bigint").alias("truncated_count"))


@query(f""", walks as (select day, symbol, count(*) n, stddev_pop(v) sd, max(abs(walk)) far from (select day, symbol, v, sum(v - m) over (partition by day, symbol order by i) walk from (
  select day, symbol, unnest(vals) v, generate_subscripts(vals, 1) i, list_avg(vals) m from {ev.WINDOWS} where n_days > 0)) group by 1, 2)
select w.day trading_date, w.symbol, {ev.r6('case when mad > 0 then (w.today - w.median) / (1.4826 * mad) end')} robust_z, {ev.r6('len(list_filter(vals, lambda x : x < w.today)) * 100.0 / len(vals)')} percentile_rank, {ev.r6('case when n >= 2 and sd > 0 then far / (n * sd) end')} regime_shift
from {ev.WINDOWS} w join {ev.MAD} m using (day, symbol) join walks using (day, symbol) where w.n_days >= 3 and w.median >= 1 and w.today >= 1 and w.today / w.median >= 1.5""")
def volume_facts(spark, sf_dir):
    """How far a day's volume is out: robustly, by rank, and by a shift that began before."""
    rows = dt.volume_deviations(lc.daily_volume(fx.trades(spark, sf_dir)), least_median=1, least_volume=1, least_ratio=1.5)
    return ev.rounded(rows.select("trading_date", "symbol", "robust_z", "percentile_rank", "regime_shift"), "robust_z", "percentile_rank", "regime_shift")


def _phase_sql(ts: str, names: list[str]) -> str:
    """The name of the New York session phase in winter."""
    minute = f"((({ts}) // 60000000000 - 300) % 1440)"
    return "case " + " ".join(f"when {minute} < {nxt[0]} then '{name}'" for nxt, name in zip(fmt.PHASES[1:], names)) + f" else '{names[-1]}' end"


_LABELS, _THROUGH = [p[3] for p in fmt.PHASES], [fmt.THROUGH[p[1]] for p in fmt.PHASES]


@query(f""", paired as (select *, lead(ts_nanos) over (partition by symbol order by ts_nanos, seq) next_ts from status_events where event_kind = 'H'),
named as (select *, {_phase_sql('ts_nanos', _LABELS)} a, {_phase_sql('next_ts', _LABELS)} z, {_phase_sql('ts_nanos', _THROUGH)} through from paired where sub_type = 'H')
select symbol, ts_nanos, case when next_ts is null then 'starting ' || a || ' with no resume in the window' when a = z then 'lasting ' || through else 'starting ' || a || ' and resuming ' || z end phase_span from named""")
def halt_spans(spark, sf_dir):
    """Where in the day a halt began and ended, in words."""
    return dt.halts(fx.status_events(spark, sf_dir)).select("symbol", "ts_nanos", "phase_span")


_ALL = f"""select 'halt' scorer_id, {ev.r6(f"case when secs is null then 0.0 else log10(secs + 1.0) * {ev.tod('ts_nanos')} end")} score from (select ts_nanos, next_ts // {SEC} - ts_nanos // {SEC} secs from (select *, lead(ts_nanos) over (partition by symbol order by ts_nanos, seq) next_ts from status_events where event_kind = 'H') where sub_type = 'H')
  union all select 'large_trade', {ev.r6(f"log10(size * (price_raw / 10000.0)) * {ev.tod('ts_nanos')}")} from trades where size * price_raw > 5000 * 10000
  union all select scorer_id, score from events
  union all select 'volume_deviation', {ev.r6('today / median')} from {ev.WINDOWS} where n_days >= 3 and median >= 1 and today >= 1 and today / median >= 1.5
  union all select 'time_in_book_drift', {ev.r6('greatest(today / median, median / today)')} from {ev.LIFE_WINDOWS} where n_days >= 5 and median >= 1 and order_count >= 5 and greatest(today / median, median / today) >= 1.2"""


@query(f", {ev.EVENTS}, nine as ({_ALL}) select scorer_id, count(*) n_events, {ev.r6('max(score)')} top_score, {ev.r6('min(score)')} least_score, count(*) filter (where score > 1) over_one from nine group by 1")
def all_detectors(spark, sf_dir):
    """Events of all nine detectors, each run on its own."""
    rows = nine(spark, sf_dir, [])
    return ev.rounded(rows.groupBy("scorer_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("score").alias("top_score"), F.min("score").alias("least_score"), F.count_if(F.col("score") > 1).alias("over_one")), "top_score", "least_score")


def nine(spark, sf_dir, only=None, shape=None):
    """Events of all nine detectors with their facts, or only some of them; a detector that fails is an error here. shape: other columns than those of with_breakdown()."""
    lifecycle = written(ev._lifecycle(spark, sf_dir).drop("feed_source", "delete_ts_nanos", "execute_ts_nanos"), "lifecycle")
    executed, trades = fx.orders_executed(spark, sf_dir), fx.trades(spark, sf_dir)
    bursts = written(dt.short_lived_bursts(lifecycle, **ev.POST_CANCEL, only=only), "bursts")  # layering's gap and least orders are the same
    calls = {
        "halt": ((fx.status_events(spark, sf_dir),), {}),
        "large_trade": ((trades, None, None, 5000), {}),
        "sweep": ((executed,), ev.SWEEP),
        "post_cancel_cluster": ((None,), {**ev.POST_CANCEL, "bursts": bursts}),
        "layering": ((None,), {**ev.LAYERING, "bursts": bursts}),
        "iceberg": ((executed,), ev.ICEBERG),
        "liquidity_withdrawal": ((fx.orders_delete(spark, sf_dir),), ev.WITHDRAWAL),
        "volume_deviation": ((lc.daily_volume(trades),), {"least_median": 1, "least_volume": 1, "least_ratio": 1.5}),
        "time_in_book_drift": ((lc.daily_lifetime(lifecycle),), {"least_ns": 1, "least_orders": 5, "least_factor": 1.2}),
    }
    found, failed = dt.run_all(calls, shape=shape or (lambda events: dt.with_breakdown(events, only)))
    if failed:
        raise RuntimeError(f"detectors failed: {failed}")
    return ev.rounded(found, "score")


_EVENT_FACTS = f"""facts as (
  select concat_ws('|', cast(trading_date as varchar), symbol, scorer_id, cast(ts_nanos as varchar), cast(ts_end_nanos as varchar), cast(n_rows as varchar), cast(total_shares as varchar)) event_id, cast(n_levels as bigint) n_levels, cast(floor(notional) as bigint) notional from ({ev.SWEEPS})
  union all select concat_ws('|', cast(trading_date as varchar), symbol, scorer_id, cast(ts_nanos as varchar), cast(ts_end_nanos as varchar), cast(n_rows as varchar), cast(total_shares as varchar)), n_levels, null from (select trading_date, symbol, scorer_id, ts_nanos, ts_end_nanos, n_rows, total_shares, max(n_levels) n_levels from (
    select trading_date, symbol, scorer_id, ts_nanos, ts_end_nanos, n_rows, total_shares, n_levels from ({ev.POST}) union all select trading_date, symbol, scorer_id, ts_nanos, ts_end_nanos, n_rows, total_shares, n_levels from ({ev.LAYER})) group by all))"""


@query(f""", {ev.EVENTS}{ev.NEST}, {_EVENT_FACTS}
select subsumed_by parent_id, scorer_id, count(*) n_children, cast(sum(total_shares) as bigint) total_shares, cast(coalesce(sum(case when scorer_id <> 'liquidity_withdrawal' then n_rows end), 0) as bigint) n_orders, cast(coalesce(sum(case when scorer_id = 'liquidity_withdrawal' then n_rows end), 0) as bigint) n_deletes,
  cast(coalesce(sum(n_levels), 0) as bigint) n_levels, cast(coalesce(sum(notional), 0) as bigint) notional from nested left join facts using (event_id) where subsumed_by is not null group by 1, 2""")
def nested_sums(spark, sf_dir):
    """Shares, orders, deletes, price levels and notional of what each parent holds, by the children's scorer."""
    events = ev.events(spark, sf_dir)
    life, executed = written(lc.short_lived(ev._lifecycle(spark, sf_dir)), "short-lived"), fx.orders_executed(spark, sf_dir)
    keyed = lambda rows, notional: rows.withColumn("event_id", sel.event_key()).select("event_id", F.col("n_levels").cast("bigint").alias("n_levels"), notional.alias("notional"))
    none = F.lit(None).cast("bigint")
    facts = keyed(dt.sweeps(executed, **ev.SWEEP), F.floor("notional")).unionByName(keyed(dt.post_cancel_clusters(life, **ev.POST_CANCEL), none)).unionByName(keyed(dt.layering(life, **ev.LAYERING), none))
    facts = facts.groupBy("event_id").agg(F.max("n_levels").alias("n_levels"), F.max("notional").alias("notional"))
    deletes = F.col("scorer_id") == "liquidity_withdrawal"
    nested = sel.nest(events).join(facts, "event_id", "left").withColumns({"n_orders": F.when(~deletes, F.col("n_rows")), "n_deletes": F.when(deletes, F.col("n_rows"))})
    return sel.children_sums(nested, ["total_shares", "n_orders", "n_deletes", "n_levels", "notional"])


_VOLUMES = """both_ as (select coalesce(a.symbol, b.symbol) symbol, left_volume, right_volume, abs(coalesce(left_volume, 0) - coalesce(right_volume, 0)) difference from
  (select symbol, cast(sum(size) as bigint) left_volume from (select symbol, size from orders_executed union all select symbol, size from trades) group by 1) a
  full join (select symbol, cast(sum(size) as bigint) right_volume from (select symbol, size from orders_executed union all select symbol, size from trades where trade_id % 97 <> 0) group by 1) b on a.symbol = b.symbol)"""


@query(f", {_VOLUMES} select * from (select symbol, left_volume, right_volume, cast(difference as bigint) difference, row_number() over (order by difference desc, symbol) as rank from both_ where difference > 0) where rank <= 10")
def volume_differences(spark, sf_dir):
    """Executions and hidden trades of one feed against trade reports of another: the ten symbols that differ most."""
    executed, trades = fx.orders_executed(spark, sf_dir), fx.trades(spark, sf_dir)
    both = validate.reconcile_volumes(validate.traded(executed, trades), validate.traded(executed, trades.filter("trade_id % 97 != 0")))
    return validate.largest_differences(both).select("symbol", "left_volume", "right_volume", "difference", F.col("rank").cast("bigint").alias("rank"))


@query(f"""{books.STEPS}, traced as (select trading_date, side, price_raw, ts_nanos, cast(delta as bigint) delta, cast(sum(delta) over (partition by trading_date, symbol, side, price_raw order by ts_nanos, seq, delta rows unbounded preceding) as bigint) level_size
  from changes where symbol = 'S03') select * from traced where ts_nanos between {fx.START} and {fx.START + 20 * SEC}""")
def trace_levels(spark, sf_dir):
    """Level changes of one symbol around a time with the sizes that they leave."""
    changes = book.level_changes(book.remaining(books._steps(spark, sf_dir)))
    return validate.trace_levels(changes, "S03", fx.START + 10 * SEC, 10 * SEC).select("trading_date", "side", "price_raw", "ts_nanos", "delta", "level_size")


@query(""" select trade_id, true volume, case when quote_flags & 128 <> 0 then 'halted' when quote_flags & 64 <> 0 then 'off_hours' else 'open' end quote_state from (select trade_id, trade_id % 256 quote_flags from trades)""")
def flag_states(spark, sf_dir):
    return fx.trades(spark, sf_dir).select("trade_id", flags.volume_eligible(F.col("sale_condition_flags")).alias("volume"), flags.quote_state(F.col("trade_id") % 256).alias("quote_state"))


#: A halt every few hundred orders, and the end of it.
_HALTS = "select trading_date, symbol, ts_nanos + 3000000 ts_nanos, k seq, 'H' event_kind, case when k % 211 = 0 then 'H' else 'T' end sub_type, null reason from base where k % 211 in (0, 5)"


@query(f"""{books.STEPS}, {ev.EVENTS}, layers as (select event_id, e.trading_date, e.symbol, e.ts_nanos, side, min_price_raw, max_price_raw from events e join ({ev.LAYER.replace('select trading_date, symbol, ts_nanos, ts_end_nanos,', 'select min_price_raw, max_price_raw, trading_date, symbol, ts_nanos, ts_end_nanos,', 1)}) l
  on e.scorer_id = 'layering' and e.trading_date = l.trading_date and e.symbol = l.symbol and e.ts_nanos = l.ts_nanos and e.ts_end_nanos = l.ts_end_nanos and e.n_rows = l.n_rows and e.total_shares = l.total_shares),
asked as (select event_id, 'layering' scorer_id, trading_date, symbol, ts_nanos, side, min_price_raw, max_price_raw from layers
  union all select concat('halt|', symbol, '|', cast(ts_nanos as varchar)), 'halt', trading_date, symbol, ts_nanos, null, null, null from ({_HALTS}) where sub_type = 'H'),
snap as (select event_id, max(case when s.side = '8' then s.price_raw end) bid, min(case when s.side = '5' then s.price_raw end) ask, sum(case when s.side = '8' then level_size else 0 end) bids, sum(case when s.side = '5' then level_size else 0 end) asks
  from asked a join spans s on a.trading_date = s.trading_date and a.symbol = s.symbol and s.start_ <= a.ts_nanos and a.ts_nanos < s.end_ where level_size > 0 group by 1),
touched as (select a.*, bid, ask, bids, asks, case side when '5' then ask when '8' then bid end touch from asked a join snap using (event_id))
select event_id, {ev.r6("case when scorer_id = 'halt' and ask - bid > 0 then (ask - bid) / ((bid + ask) / 2.0) * 10000.0 end")} halt_spread_bps, {ev.r6("case when scorer_id = 'layering' then least(abs(min_price_raw - touch) / touch, abs(max_price_raw - touch) / touch) * 10000.0 end")} near_bps,
  {ev.r6("case when scorer_id = 'layering' then greatest(abs(min_price_raw - touch) / touch, abs(max_price_raw - touch) / touch) * 10000.0 end")} far_bps, {ev.r6('case when bids + asks > 0 then (bids - asks) / (bids + asks) end')} depth_imbalance,
  case when bids + asks = 0 then null when (bids - asks) / (bids + asks) > 0.1 then 'bid-skewed' when (bids - asks) / (bids + asks) < -0.1 then 'ask-skewed' else 'balanced' end depth_class from touched""")
def halts_and_layers(spark, sf_dir):
    """The spread at a halt, how far a layer lies from the touch, and which way the book leans."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    status = fx.base(spark, sf_dir).filter("k % 211 in (0, 5)").selectExpr("trading_date", "symbol", "ts_nanos + 3000000 ts_nanos", "k seq", "'H' event_kind", "case when k % 211 = 0 then 'H' else 'T' end sub_type", "cast(null as string) reason")
    columns = ["event_id", "scorer_id", "trading_date", "symbol", "ts_nanos", "ts_end_nanos", "side", "min_price_raw", "max_price_raw"]
    halted = dt.halts(status).select(F.concat_ws("|", F.lit("halt"), "symbol", F.col("ts_nanos").cast("string")).alias("event_id"), *columns[1:6], none("side", "string"), none("min_price_raw", "bigint"), none("max_price_raw", "bigint"))
    bursts = dt._short_lived_clusters(lc.short_lived(ev._lifecycle(spark, sf_dir)), 50 * dt.MS, ev.LAYERING["max_gap"], ev.LAYERING["least_orders"], 10_000).filter(F.col("n_levels") >= ev.LAYERING["least_levels"])
    layers = bursts.withColumn("scorer_id", F.lit("layering")).withColumn("ts_end_nanos", F.col("end")).withColumn("event_id", sel.event_key()).select(*columns)
    both = written(halted.unionByName(layers), "asked")
    met = book.best_at(books._points(spark, sf_dir, F.lit(1)), both.select("event_id", "trading_date", "symbol", "ts_nanos")).filter("best.bid_levels + best.ask_levels > 0")
    price = lambda side: F.when(F.col(f"best.{side}_levels") > 0, F.col(f"best.{side}_price_raw")).alias(f"{side}_price_raw")
    snaps = met.select("event_id", F.lit("at").alias("role"), price("bid"), price("ask"), F.col("best.bid_total").alias("bid_total"), F.col("best.ask_total").alias("ask_total"))
    facts = enrich.book_facts(both, snaps).select("event_id", "halt_spread_bps", "near_bps", "far_bps", "depth_imbalance").withColumn("depth_class", stats.depth_class(F.col("depth_imbalance")))
    return ev.rounded(facts, "halt_spread_bps", "near_bps", "far_bps", "depth_imbalance")


@query(f""" select symbol, lot round_lot from (select symbol, cast(arg_max(100 + k % 7, ts_nanos) as integer) lot from base where ts_nanos // {fx.DAY} between {fx.START // fx.DAY - 45} and {fx.START // fx.DAY + 15} group by 1)""")
def recent_lots(spark, sf_dir):
    """Round lots of the latest security records of sixty days."""
    listing = fx.base(spark, sf_dir).select("symbol").distinct().select("symbol", F.lit("none").alias("company_name"), F.lit(1).alias("round_lot"))
    securities = fx.base(spark, sf_dir).selectExpr("symbol", "ts_nanos", "cast(100 + k % 7 as int) round_lot_size")
    titles = spark.range(0).selectExpr("cast(id as string) ticker", "cast(id as string) title")
    return files.merge_symbols([listing], titles, files.recent_records(securities, "2024-01-16")).filter("round_lot > 1").select("symbol", "round_lot")


_METRICS = {"strongest_sweep": ("sweep", "score"), "widest_sweep": ("sweep", "n_rows"), "largest_sweep": ("sweep", "total_shares"), "strongest_layering": ("layering", "score"), "largest_layering": ("layering", "total_shares"), "longest_withdrawal": ("liquidity_withdrawal", "n_rows")}
_EXTREMES = " union all ".join(f"select cast(date_trunc('week', trading_date) as date) as week, '{name}' metric, event_id, symbol, cast({column} as double) as value from events where scorer_id = '{scorer}' qualify row_number() over (partition by cast(date_trunc('week', trading_date) as date) order by {column} desc, event_id) = 1" for name, (scorer, column) in _METRICS.items())


@query(f", {ev.EVENTS} {_EXTREMES}")
def week_extremes(spark, sf_dir):
    """Six extremes of each week."""
    weekly = ev.events(spark, sf_dir).withColumn("trading_date", fmt.week_start(F.col("trading_date")))
    return tables.extremes(weekly, _METRICS).withColumnRenamed("trading_date", "week")


def _n(x: str) -> str:
    """A whole number with separators, null for 0."""
    return f"case when {x} <> 0 then format('{{:,}}', cast({x} as bigint)) end"


def _words(s: str) -> str:
    unit = lambda n, u: f"cast({n} as varchar) || case when {n} = 1 then ' {u}' else ' {u}s' end"
    return f"""case when {s} < 0 then 'unknown duration' when {s} < 60 then {unit(s, 'second')} when {s} < 3600 then concat_ws(' ', {unit(f'({s} // 60)', 'minute')}, case when {s} % 60 > 0 then {unit(f'({s} % 60)', 'second')} end)
      when {s} is not null then concat_ws(' ', {unit(f'({s} // 3600)', 'hour')}, case when {s} % 3600 // 60 > 0 then {unit(f'({s} % 3600 // 60)', 'minute')} end) end"""


def _x(v: str) -> str:
    return f"cast(floor(({v}) * 10.0 + 0.5) / 10.0 as varchar)"


_REASON = "case reason when 'T1' then 'news-pending halt' when 'LUDP' then 'LULD price-band halt' else 'trading halt' end"
_TOLD = f"""told as (select *, case when scorer_id in ('volume_deviation', 'time_in_book_drift') then 'day-level' else strftime(make_timestamp(ts_nanos // 1000 - 18000000000), '%H:%M') || ' ET' end as at_, floor(raw * 1000000.0 + 0.5) / 1000000.0 score from (
  select trading_date, symbol, ts_nanos, 'halt' scorer_id, case when secs is null then 0.0 else log10(secs + 1.0) * {ev.tod('ts_nanos')} end raw, concat_ws(' ', {_words('secs')}, 'halt', '(' || {_REASON} || ')') metric, cast(secs as double) extent from (
    select *, next_ts // {SEC} - ts_nanos // {SEC} secs from (select *, lead(ts_nanos) over (partition by symbol order by ts_nanos, seq) next_ts from status_events where event_kind = 'H') where sub_type = 'H')
  union all select trading_date, symbol, ts_nanos, 'large_trade', log10(notional) * {ev.tod('ts_nanos')}, '$' || format('{{:,}}', cast(floor(notional) as bigint)) || ' block', notional from (select *, size * (price_raw / 10000.0) notional from trades where size * price_raw > 5000 * 10000)
  union all select trading_date, symbol, ts_nanos, scorer_id, score, concat_ws(', ', '$' || format('{{:,}}', cast(floor(notional) as bigint)) || ' sweep', {_n('n_levels')} || ' levels'), null from ({ev.SWEEPS})
  union all select trading_date, symbol, ts_nanos, scorer_id, score, concat_ws(', ', {_n('n_rows')} || ' orders', cast(median_lifetime_ns // 1000000 as varchar) || 'ms median'), null from ({ev.POST})
  union all select trading_date, symbol, ts_nanos, scorer_id, score, concat_ws(', ', {_n('n_rows')} || ' orders', {_n('n_levels')} || ' levels'), null from ({ev.LAYER})
  union all select trading_date, symbol, ts_nanos, scorer_id, score, concat_ws(', ', {_n('n_rows')} || ' fills', {_n('total_shares')} || ' shares'), null from ({ev.ICE})
  union all select trading_date, symbol, ts_nanos, scorer_id, score, {_n('n_rows')} || ' deletes', null from ({ev.WITHDRAW})
  union all select day, symbol, epoch_us(cast(day as timestamp)) * 1000, 'volume_deviation', today / median, {_x('floor(today / median * 1000000.0 + 0.5) / 1000000.0')} || 'x trailing median', null from {ev.WINDOWS} where n_days >= 3 and median >= 1 and today >= 1 and today / median >= 1.5
  union all select day, symbol, epoch_us(cast(day as timestamp)) * 1000, 'time_in_book_drift', greatest(today / median, median / today), {_x('floor(greatest(today / median, median / today) * 1000000.0 + 0.5) / 1000000.0')} || 'x ' || case when today < median then 'shorter' else 'longer' end || ' lifetime', null
    from {ev.LIFE_WINDOWS} where n_days >= 5 and median >= 1 and order_count >= 5 and greatest(today / median, median / today) >= 1.2))"""
_STRONGEST = "order by score desc, scorer_id, symbol, ts_nanos, metric"


@query(f""", {_TOLD} select trading_date, place, scorer_id, symbol, at_ as "at", metric, score from (select *, row_number() over (partition by trading_date {_STRONGEST}) place from told) where place <= 5""")
def day_headlines(spark, sf_dir):
    """The five strongest events of each day, with what is told of each and when it was."""
    return daybook.headlines(daybook.told(daybook.strongest(nine(spark, sf_dir, daybook.TOLD_FACTS), 5)))


@query(f""", {_TOLD}, weekly as (select *, cast(date_trunc('week', trading_date) as date) as week from told) select week, place, scorer_id, symbol, at_ as "at", metric, score from (select *, row_number() over (partition by week {_STRONGEST}) place from weekly) where place <= 10""")
def week_headlines(spark, sf_dir):
    """The ten strongest events of each week."""
    rows = nine(spark, sf_dir, daybook.TOLD_FACTS).withColumn("week", fmt.week_start(F.col("trading_date")))
    return daybook.headlines(daybook.told(daybook.strongest(rows, 10, "week")), 10, "week")


@query(f""", {_TOLD} select trading_date, scorer_id, place, symbol, at_ as "at", metric from (select *, row_number() over (partition by trading_date, scorer_id {_STRONGEST}) place from told) where place <= 5""")
def scorer_tables(spark, sf_dir):
    """The five strongest events of each day and scorer."""
    return daybook.scorer_tables(daybook.told(nine(spark, sf_dir))).drop("facts")


@query(f""", volumes as (select day trading_date, symbol, today, cast(median as double) median, n_days, today / median ratio, case when mad > 0 then (today - w.median) / (1.4826 * mad) end z from {ev.WINDOWS} w join (select day, symbol, mad from {ev.MAD}) using (day, symbol) where n_days >= 3 and w.median >= 1 and today >= 1 and today / w.median >= 1.5),
top as (select * from (select *, row_number() over (partition by trading_date order by floor(ratio * 1000000.0 + 0.5) / 1000000.0 desc, symbol) place from volumes) where place <= 5)
select trading_date, symbol, place, fact, value from (
  select trading_date, symbol, place, 'total_shares' fact, cast(today as double) as value from top union all select trading_date, symbol, place, 'baseline_median', median from top
  union all select trading_date, symbol, place, 'n_days', n_days from top union all select trading_date, symbol, place, 'robust_z', {ev.r6('z')} from top where z is not null)""")
def volume_table(spark, sf_dir):
    """A scorer's own columns: those of unusual volumes."""
    found, failed = dt.run_all({"volume_deviation": ((lc.daily_volume(fx.trades(spark, sf_dir)),), {"least_median": 1, "least_volume": 1, "least_ratio": 1.5})})
    if failed:
        raise RuntimeError(f"detectors failed: {failed}")
    rows = daybook.scorer_tables(daybook.told(ev.rounded(found, "score")))
    return ev.rounded(rows.select("trading_date", "symbol", "place", F.explode("facts").alias("fact", "value")).withColumn("value", F.col("value").cast("double")), "value")


def _listed(names: str) -> str:
    return f"case when len({names}) <= 1 then array_to_string({names}, '') when len({names}) <= 4 then array_to_string({names}[1 : len({names}) - 1], ', ') || ' and ' || {names}[len({names})] else array_to_string({names}[1 : 3], ', ') || ' and ' || (len({names}) - 3) || ' others' end"


_NAMED = "case scorer_id " + " ".join(f"when '{k}' then '{v}'" for k, v in fmt.SCORER_NAMES.items()) + " end"


@query(f""", {_TOLD}, by_symbol as (select trading_date, symbol as name, count(*) n from told group by 1, 2), by_scorer as (select trading_date, scorer_id, count(*) n from told group by 1, 2),
led as (select trading_date, max(n) n, list(name order by name) names from by_symbol b where n = (select max(n) from by_symbol c where c.trading_date = b.trading_date) group by 1),
ruled as (select trading_date, max(n) n, list({_NAMED} order by scorer_id) names from by_scorer b where n = (select max(n) from by_scorer c where c.trading_date = b.trading_date) group by 1),
blocks as (select trading_date, arg_max(symbol, (extent, symbol)) s, max(extent) v from told where scorer_id = 'large_trade' group by 1), halted as (select trading_date, arg_max(symbol, (extent, symbol)) s, cast(max(extent) as bigint) v from told where scorer_id = 'halt' and extent is not null group by 1),
totals as (select trading_date, n, floor((n - lag(n) over (order by trading_date)) * 100.0 / lag(n) over (order by trading_date) + 0.5)::bigint change from (select trading_date, count(*) n from told group by 1)),
all_ as (select trading_date, list_filter([case when len(l.names) = 1 then l.names[1] || ' led the day with ' else {_listed('l.names')} || ' each led with ' end || format('{{:,}}', l.n) || ' events',
  case when len(r.names) = 1 then r.names[1] || ' dominated (' || format('{{:,}}', r.n) || ' events)' else {_listed('r.names')} || ' each saw ' || format('{{:,}}', r.n) || ' events' end,
  'Largest block: ' || b.s || ' $' || format('{{:,}}', cast(floor(b.v) as bigint)), 'Longest halt: ' || h.s || ' ' || {_words('h.v')}, case when abs(change) >= 10 then 'Event volume ' || case when change > 0 then '+' else '' end || change || '% vs prior session' end], lambda b : b is not null) bullets
  from totals t join led l using (trading_date) join ruled r using (trading_date) left join blocks b using (trading_date) left join halted h using (trading_date)) select trading_date, array_to_string(bullets[1 : 5], '; ') bullets from all_""")
def executive_bullets(spark, sf_dir):
    """Up to five bullets of each day; who ties is named together."""
    return daybook.bullets(daybook.told(nine(spark, sf_dir, daybook.TOLD_FACTS))).select("trading_date", F.array_join("bullets", "; ").alias("bullets"))


_KEY = "concat_ws('|', cast(trading_date as varchar), symbol, scorer_id, cast(ts_nanos as varchar), cast(ts_end_nanos as varchar), cast(n_rows as varchar), cast(total_shares as varchar))"
_NINE = f"""events as (select *, {_KEY} event_id from (
  select trading_date, symbol, ts_nanos, next_ts ts_end_nanos, 'halt' scorer_id, {ev.r6(f"case when secs is null then 0.0 else log10(secs + 1.0) * {ev.tod('ts_nanos')} end")} score, cast(null as bigint) n_rows, cast(null as bigint) total_shares from (
    select *, next_ts // {SEC} - ts_nanos // {SEC} secs from (select *, lead(ts_nanos) over (partition by symbol order by ts_nanos, seq) next_ts from status_events where event_kind = 'H') where sub_type = 'H')
  union all select trading_date, symbol, ts_nanos, null, 'large_trade', {ev.r6(f"log10(size * (price_raw / 10000.0)) * {ev.tod('ts_nanos')}")}, null, cast(size as bigint) from trades where size * price_raw > 5000 * 10000
  union all select {ev._columns.replace(' score, n_rows', '')}, n_rows, total_shares from ({ev.SWEEPS}) union all select {ev._columns.replace(' score, n_rows', '')}, n_rows, total_shares from ({ev.POST}) union all select {ev._columns.replace(' score, n_rows', '')}, n_rows, total_shares from ({ev.LAYER})
  union all select {ev._columns.replace(' score, n_rows', '')}, n_rows, total_shares from ({ev.ICE}) union all select {ev._columns.replace(' score, n_rows', '')}, n_rows, null from ({ev.WITHDRAW})
  union all select day, symbol, epoch_us(cast(day as timestamp)) * 1000, null, 'volume_deviation', {ev.r6('today / median')}, null, today from {ev.WINDOWS} where n_days >= 3 and median >= 1 and today >= 1 and today / median >= 1.5
  union all select day, symbol, epoch_us(cast(day as timestamp)) * 1000, null, 'time_in_book_drift', {ev.r6('greatest(today / median, median / today)')}, order_count, null from {ev.LIFE_WINDOWS} where n_days >= 5 and median >= 1 and order_count >= 5 and greatest(today / median, median / today) >= 1.2))"""


def _nine_events(spark, sf_dir):
    """Events of all nine detectors with the numbers that nesting reads; nothing else of them is worked out, and they are written once."""
    number = lambda events, name: (F.col(name).cast("bigint") if name in events.columns else F.lit(None).cast("bigint")).alias(name)
    shape = lambda events: events.select(*dt.COMMON, number(events, "n_rows"), number(events, "total_shares")).withColumn("event_id", sel.event_key())
    return nine(spark, sf_dir, [], shape)


@query(f", {_NINE}{ev.NEST} select event_id, scorer_id, score, subsumed_by from nested")
def nested_of_nine(spark, sf_dir):
    """Which events of all nine detectors lie inside which; events without an end are never inside."""
    return sel.nest(_nine_events(spark, sf_dir)).select("event_id", "scorer_id", "score", "subsumed_by")


@query(f", {_NINE}{ev.SELECT} select trading_date, scorer_id, event_id, score, narration_rank from selected")
def selected_of_nine(spark, sf_dir):
    """The events of all nine detectors that stand for their day."""
    return sel.select_top(sel.nest(_nine_events(spark, sf_dir))).select("trading_date", "scorer_id", "event_id", "score", "narration_rank")
