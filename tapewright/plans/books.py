"""Queries on books, feed checks and facts around events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book, enrich, validate
from ..operators.patterns import tasks_for
from ..session import written
from . import events as ev
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEC = 1_000_000_000


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = f"with {fx.SQL} {sql}"
        return function

    return add


def _steps(spark, sf_dir, clears=True):
    parts = [f(spark, sf_dir) for f in (fx.orders_add, fx.orders_modify, fx.orders_executed, fx.orders_delete)]
    return book.order_steps(*parts, fx.clear_books(spark, sf_dir) if clears else None)


def _changes(spark, sf_dir):
    """Level changes, written once for all that a query derives from them."""
    return written(book.level_changes(book.remaining(_steps(spark, sf_dir))), "changes")


STEPS = """, ended as (select a.trading_date, a.order_id, min(c.ts_nanos) clear_ts from orders_add a join clear_books c on a.trading_date = c.trading_date and a.symbol = c.symbol and c.ts_nanos > a.ts_nanos group by all),
steps as (
  select s.* from (
    select trading_date, symbol, order_id, ts_nanos, seq, 'add' op, cast(size as bigint) size, price_raw, side from orders_add
    union all select trading_date, symbol, order_id, ts_nanos, seq, 'modify', size, price_raw, null from orders_modify
    union all select trading_date, symbol, order_id, ts_nanos, seq, 'execute', size, null, null from orders_executed
    union all select trading_date, symbol, order_id, ts_nanos, seq, 'delete', null, null, null from orders_delete) s
  left join ended e using (trading_date, order_id) where e.clear_ts is null or s.ts_nanos < e.clear_ts
  union all select a.trading_date, a.symbol, a.order_id, e.clear_ts, -1, 'clear', null, null, null from ended e join orders_add a using (trading_date, order_id)),
sets as (select *, sum(case when op in ('add', 'modify') then 1 else 0 end) over (partition by trading_date, order_id order by ts_nanos, seq) set_no, max(side) over (partition by trading_date, order_id) own_side from steps),
lived as (select *, max(case when op in ('add', 'modify') then size end) over w base, max(case when op in ('add', 'modify') then price_raw end) over w px,
    sum(case when op = 'execute' then size else 0 end) over (partition by trading_date, order_id, set_no order by ts_nanos, seq) gone from sets window w as (partition by trading_date, order_id, set_no)),
left_ as (select *, case when op in ('delete', 'clear') then 0 else base - gone end rem from lived),
moved as (select *, lag(rem) over w rem_before, lag(px) over w px_before from left_ window w as (partition by trading_date, order_id order by ts_nanos, seq)),
changes as (
  select trading_date, symbol, own_side side, ts_nanos, seq, px_before price_raw, -rem_before delta from moved where op <> 'add' and px_before is not null and rem_before <> 0
  union all select trading_date, symbol, own_side, ts_nanos, seq, px, rem from moved where op not in ('delete', 'clear') and px is not null and rem <> 0),
sizes as (select *, cast(sum(delta) over (partition by trading_date, symbol, side, price_raw order by ts_nanos) as bigint) level_size from (
  select trading_date, symbol, side, price_raw, ts_nanos, cast(sum(delta) as bigint) delta from changes group by all)),
spans as (select *, ts_nanos as start_, coalesce(lead(ts_nanos) over (partition by trading_date, symbol, side, price_raw order by ts_nanos), 4611686018427387904) end_ from sizes)
"""


@query(f"{STEPS} select trading_date, symbol, order_id, op, ts_nanos, rem from left_")
def remaining_sizes(spark, sf_dir):
    return book.remaining(_steps(spark, sf_dir)).select("trading_date", "symbol", "order_id", "op", "ts_nanos", "rem")


@query(f"{STEPS} select trading_date, symbol, side, price_raw, ts_nanos, delta, level_size from sizes")
def level_running_size(spark, sf_dir):
    return book.level_sizes(book.level_changes(book.remaining(_steps(spark, sf_dir)))).select("trading_date", "symbol", "side", "price_raw", "ts_nanos", "delta", "level_size")


#: The same chain over flow that no consistent book allows, without clears.
_ODD = STEPS.replace("from orders_add", "from (select * from orders_add where order_id % 7 <> 0)").replace("from orders_executed", "from (select * replace (size + 400 as size) from orders_executed)").replace("join clear_books c on", "join (select * from clear_books where false) c on").replace("join orders_add a", "join (select * from orders_add where order_id % 7 <> 0) a")


@query(f"""{_ODD}, judged as (select *, coalesce(rem_before, 0) before_, row_number() over (partition by trading_date, order_id order by ts_nanos, seq) n from moved)
select trading_date, symbol, order_id, ts_nanos, reason from (select *, case when op = 'add' and n > 1 and before_ > 0 then 'duplicate add' when op <> 'add' and rem_before is null then 'unknown order: ' || op
  when op <> 'add' and before_ <= 0 then 'gone order: ' || op when op = 'execute' and size > before_ then 'executed over its size' end reason from judged) where reason is not null""")
def book_violations(spark, sf_dir):
    """Executions made too large, and orders whose add is missing."""
    adds = fx.orders_add(spark, sf_dir).filter("order_id % 7 != 0")
    executed = fx.orders_executed(spark, sf_dir).withColumn("size", F.col("size") + 400)
    return book.violations(book.order_steps(adds, fx.orders_modify(spark, sf_dir), executed, fx.orders_delete(spark, sf_dir))).drop("seq")


@query(f"{_ODD}, odd as (select *, cast(sum(delta) over (partition by trading_date, symbol, side, price_raw order by ts_nanos) as bigint) level_size from (select trading_date, symbol, side, price_raw, ts_nanos, sum(delta) delta from changes where side is not null group by all)) select trading_date, symbol, side, price_raw, ts_nanos, level_size from odd where level_size < 0")
def negative_levels(spark, sf_dir):
    """Levels below 0, of flow whose executions are made too large."""
    adds = fx.orders_add(spark, sf_dir).filter("order_id % 7 != 0")
    executed = fx.orders_executed(spark, sf_dir).withColumn("size", F.col("size") + 400)
    rows = book.remaining(book.order_steps(adds, fx.orders_modify(spark, sf_dir), executed, fx.orders_delete(spark, sf_dir)))
    return book.negative_levels(book.level_changes(rows).filter("side is not null"))


REQUESTS = f"select trading_date, symbol, ts_nanos + 1 ts_nanos, order_id request from orders_add"


def _requests(spark, sf_dir):
    return fx.orders_add(spark, sf_dir).select("trading_date", "symbol", (F.col("ts_nanos") + 1).alias("ts_nanos"), F.col("order_id").alias("request"))


def _points(spark, sf_dir, lot=None, changes=None):
    """Change points of the books' best prices. Sizes and points are written once, as the sweep and the as-of join read them several times."""
    changes = book.level_changes(book.remaining(_steps(spark, sf_dir))) if changes is None else changes
    return written(book.best_points(written(book.level_sizes(changes), "sizes"), lot), "points")


def _intervals(spark, sf_dir):
    """Intervals of all levels, read once by a snapshot, so nothing is written for them."""
    return book.level_intervals(book.level_sizes(book.level_changes(book.remaining(_steps(spark, sf_dir)))))


SNAP = f"(select r.request, r.ts_nanos, r.trading_date, r.symbol, s.side, s.price_raw, s.level_size from ({REQUESTS}) r join spans s on r.trading_date = s.trading_date and r.symbol = s.symbol and s.start_ <= r.ts_nanos and r.ts_nanos < s.end_ where s.level_size > 0)"


@query(f"{STEPS} select request, side, price_raw, level_size from {SNAP}")
def book_snapshot(spark, sf_dir):
    return book.snapshot(_intervals(spark, sf_dir), _requests(spark, sf_dir), SEC).select("request", "side", "price_raw", "level_size")


@query(f"""{STEPS} select request, max(case when side = '8' then price_raw end) bid_price_raw, arg_max(case when side = '8' then level_size end, case when side = '8' then price_raw end) bid_size,
  min(case when side = '5' then price_raw end) ask_price_raw, arg_min(case when side = '5' then level_size end, case when side = '5' then price_raw end) ask_size,
  count(case when side = '8' then 1 end) bid_levels, count(case when side = '5' then 1 end) ask_levels, cast(sum(case when side = '8' then level_size else 0 end) as bigint) bid_total, cast(sum(case when side = '5' then level_size else 0 end) as bigint) ask_total from {SNAP} group by 1""")
def best_levels(spark, sf_dir):
    met = book.best_at(_points(spark, sf_dir, F.lit(1)), _requests(spark, sf_dir)).select("request", "best.*").filter("bid_levels + ask_levels > 0")
    return met.withColumns({c: F.when(F.col(f"{c[:3]}_levels") > 0, F.col(c)) for c in book.BEST[:4]})


PROTECTED = f"""(select request, any_value(trading_date) trading_date, any_value(symbol) symbol, any_value(ts_nanos) ts_nanos, coalesce(max(case when side = '8' and upto >= 100 then price_raw end), 0) bid_price_raw, coalesce(arg_max(case when side = '8' and upto >= 100 then upto end, case when side = '8' and upto >= 100 then price_raw end), 0) bid_size,
  coalesce(min(case when side = '5' and upto >= 100 then price_raw end), 0) ask_price_raw, coalesce(arg_min(case when side = '5' and upto >= 100 then upto end, case when side = '5' and upto >= 100 then price_raw end), 0) ask_size from (
  select *, cast(sum(level_size) over (partition by request, side order by case when side = '8' then -price_raw else price_raw end) as bigint) upto from {SNAP}) group by 1)"""


@query(f"{STEPS} select request, bid_price_raw, bid_size, ask_price_raw, ask_size from {PROTECTED}")
def protected_bbo(spark, sf_dir):
    met = book.best_at(_points(spark, sf_dir), _requests(spark, sf_dir)).filter("best.bid_levels + best.ask_levels > 0")
    return met.select("request", *[f"best.{c}" for c in book.BEST[:4]])


@query(f"{STEPS} select request, side, price_raw, level_size from (select *, row_number() over (partition by request, side order by case when side = '8' then -price_raw else price_raw end) n from {SNAP}) where n = 2")
def second_levels(spark, sf_dir):
    return book.nth_level(book.snapshot(_intervals(spark, sf_dir), _requests(spark, sf_dir), SEC), ["request"], 2)


@query(f"{STEPS} select request, cast(sum(case when price_raw = 1000500 and side = '8' then level_size else 0 end) as bigint) bid_size, cast(sum(case when price_raw = 1000500 and side = '5' then level_size else 0 end) as bigint) ask_size from {SNAP} group by 1")
def sizes_at_price(spark, sf_dir):
    return book.size_at(book.snapshot(_intervals(spark, sf_dir), _requests(spark, sf_dir), SEC), ["request"], F.lit(1_000_500))


#: Requests before a symbol's first order, between, and after the end of the feed; S98 is a symbol that no feed has.
_ASKED = f"""asked as (select request, trading_date, symbol, {fx.START} + d * {fx.DAY} + at_ * {SEC} ts_nanos from (
  select x.d * 10000 + y.s * 100 + z.at_ / 5 request, x.trading_date, 'S' || lpad(cast(y.s as varchar), 2, '0') symbol, d, z.at_ from (select distinct d, trading_date from base) x, (select unnest([3, 7, 11, 98])::bigint s) y, (select unnest([-5, 0, 5, 10, 25, 100, 10000])::bigint at_) z))"""


@query(f"""{STEPS}, {_ASKED}, seen_ as (select trading_date, symbol, min(ts_nanos) seen from steps group by 1, 2), feed_ends as (select trading_date, max(ts_nanos) feed_end from steps group by 1),
held as (select a.request, count(*) levels, max(case when side = '8' then price_raw end) bid, min(case when side = '5' then price_raw end) ask, cast(sum(level_size) as bigint) total
  from asked a join spans s on a.trading_date = s.trading_date and a.symbol = s.symbol and s.start_ <= a.ts_nanos and a.ts_nanos < s.end_ where level_size > 0 group by 1),
states as (select a.*, case when seen is null or seen > a.ts_nanos or feed_end < a.ts_nanos then 'missing' when levels is null then 'empty' else 'present' end state from asked a left join seen_ using (trading_date, symbol) left join feed_ends using (trading_date) left join held using (request))
select cast(request as bigint) request, state, case when state = 'present' then bid end bid_price_raw, case when state = 'present' then ask end ask_price_raw, case when state = 'present' then total end total from states left join held using (request)""")
def book_state_at(spark, sf_dir):
    """Books at requested times: present, empty, or missing as the feed hadn't seen the symbol or had ended. Every request gives a row."""
    steps = _steps(spark, sf_dir)
    days = fx.base(spark, sf_dir).select("d", "trading_date").distinct()
    each = lambda values, name: F.explode(F.array(*[F.lit(v).cast("bigint") for v in values])).alias(name)
    asked = days.select("*", each([3, 7, 11, 98], "s")).select("*", each([-5, 0, 5, 10, 25, 100, 10000], "at"))
    asked = asked.selectExpr("cast(d * 10000 + s * 100 + at div 5 as bigint) request", "trading_date", "concat('S', lpad(cast(s as string), 2, '0')) symbol", f"{fx.START} + d * {fx.DAY} + at * {SEC} ts_nanos")
    points = _points(spark, sf_dir, F.lit(1), book.level_changes(book.remaining(steps)))
    met = book.book_states(points, book.coverage(steps), asked)
    price = lambda side: F.when(F.col(f"best.{side}_levels") > 0, F.col(f"best.{side}_price_raw")).alias(f"{side}_price_raw")
    return met.select("request", "state", price("bid"), price("ask"), (F.col("best.bid_total") + F.col("best.ask_total")).alias("total"))


UPDATES = "(select trading_date, symbol, side, price_raw, ts_nanos, level_size + case when ts_nanos // 1000000 % 997 = 0 then 1 else 0 end declared from sizes)"


def _updates(spark, sf_dir, changes=None):
    return _declared(book.level_sizes(_changes(spark, sf_dir) if changes is None else changes))


def _declared(sizes):
    return sizes.withColumn("declared", F.expr("level_size + case when ts_nanos div 1000000 % 997 = 0 then 1 else 0 end")).withColumn("seq", F.lit(0).cast("bigint")).drop("delta", "level_size")


@query(f"{STEPS} select symbol, count(*) compared, count(*) filter (where declared = level_size) matched, count(*) filter (where declared <> level_size) mismatched, {ev.r6('count(*) filter (where declared = level_size) / count(*)')} match_rate from {UPDATES} u join sizes s using (trading_date, symbol, side, price_raw, ts_nanos) group by 1")
def level_check(spark, sf_dir):
    """Partitions by the numbers of rows, which are known before each step, so that a task's memory does not grow with them."""
    messages = tasks_for(spark, 3 * fx.base(spark, sf_dir).count())  # an order has up to three
    changes = written(book.level_changes(book.remaining(_steps(spark, sf_dir), messages)), "changes")
    levels = tasks_for(spark, 2 * changes.count())  # changes and updates
    updates = _declared(book.level_sizes(changes, levels))
    return ev.rounded(validate.match_report(validate.level_check(changes, updates, levels), ["symbol"]), "match_rate")


#: The level feed as transactions: each change of a level is told in a first row of half the size, which doesn't end its transaction, and in one that does; every third is told twice within its nanosecond.
_TOLD = """told as (
  select trading_date, symbol, side, price_raw, ts_nanos, 0 seq, level_size // 2 declared, 0 event_flags from sizes
  union all select trading_date, symbol, side, price_raw, ts_nanos, 1, level_size + 7, 1 from sizes where price_raw // 100 % 3 = 0
  union all select trading_date, symbol, side, price_raw, ts_nanos, 2, level_size + case when ts_nanos // 1000000 % 997 = 0 then 1 else 0 end, 1 from sizes)"""


@query(f"""{STEPS}, {_TOLD}, done as (select * from told where event_flags % 2 = 1 qualify row_number() over (partition by trading_date, symbol, side, price_raw, ts_nanos order by seq desc) = 1),
skipped as (select symbol, count(*) filter (where event_flags % 2 = 0) mid_transaction, count(*) filter (where event_flags % 2 = 1 and seq = 1) superseded from told group by 1)
select symbol, compared, matched, mismatched, mid_transaction, superseded from (
  select symbol, count(*) compared, count(*) filter (where declared = level_size) matched, count(*) filter (where declared <> level_size) mismatched from done join sizes using (trading_date, symbol, side, price_raw, ts_nanos) group by 1) join skipped using (symbol)""")
def transaction_check(spark, sf_dir):
    """Level sizes compared once a transaction is complete, rows on the way and superseded ones left out and counted."""
    changes = _changes(spark, sf_dir)
    sizes = written(book.level_sizes(changes), "sizes")
    told = lambda seq, size, flags: sizes.select(*book.LEVEL, "ts_nanos", F.lit(seq).cast("bigint").alias("seq"), F.expr(size).cast("bigint").alias("declared"), F.lit(flags).alias("event_flags"))
    updates = told(0, "level_size div 2", 0).unionByName(told(1, "level_size + 7", 1).filter("price_raw div 100 % 3 = 0")).unionByName(told(2, "level_size + case when ts_nanos div 1000000 % 997 = 0 then 1 else 0 end", 1))
    done, skipped = validate.complete_updates(updates)
    return validate.match_report(validate.level_check(changes, done), ["symbol"]).drop("match_rate").join(skipped, "symbol")


QUOTES = f"(select *, bid_size + case when request % 50 = 0 then 1 else 0 end quoted from {PROTECTED} where (bid_size > 0 or ask_size > 0))"


def _quotes(spark, sf_dir, points):
    found = book.best_at(points, _requests(spark, sf_dir)).select("request", "trading_date", "symbol", "ts_nanos", *[f"best.{c}" for c in book.BEST[:4]]).filter("bid_size > 0 or ask_size > 0")
    return found.withColumns({"bid_size": F.expr("bid_size + case when request % 50 = 0 then 1 else 0 end"), "seq": F.col("request")})


@query(f"{STEPS} select trading_date, count(*) compared, count(*) filter (where quoted = bid_size) matched, count(*) filter (where quoted <> bid_size) mismatched, {ev.r6('count(*) filter (where quoted = bid_size) / count(*)')} match_rate from {QUOTES} group by 1")
def bbo_check(spark, sf_dir):
    points = _points(spark, sf_dir, F.lit(100))
    return ev.rounded(validate.match_report(validate.bbo_check(_quotes(spark, sf_dir, points), points), ["trading_date"]), "match_rate")


_OFF = f"ts_nanos % {fx.DAY} < {fx.START % fx.DAY + 60 * SEC}"


@query(f"""{STEPS}, judged as (select *, quoted = bid_size good, {_OFF} off_ from {QUOTES})
select trading_date, count(*) compared, count(*) filter (where good) matched, count(*) filter (where not good) mismatched, count(*) filter (where off_) off_compared, count(*) filter (where off_ and good) off_matched, count(*) filter (where off_ and not good) off_mismatched,
  {ev.r6('case when count(*) filter (where not off_) = 0 then 0 else count(*) filter (where good and not off_) / count(*) filter (where not off_) end')} regular_rate, {ev.r6('case when count(*) filter (where off_) = 0 then 0 else count(*) filter (where good and off_) / count(*) filter (where off_) end')} off_rate from judged group by 1""")
def bbo_hours(spark, sf_dir):
    """Quotes against books inside and outside regular hours, which begin a minute after the day's first order here."""
    points = _points(spark, sf_dir, F.lit(100))
    return ev.rounded(validate.split_report(validate.bbo_check(_quotes(spark, sf_dir, points), points), F.expr(_OFF), ["trading_date"]), "regular_rate", "off_rate")


@query(f"{STEPS} select rank, symbol, matched, mismatched from (select symbol, count(*) filter (where quoted = bid_size) matched, count(*) filter (where quoted <> bid_size) mismatched, row_number() over (order by count(*) filter (where quoted <> bid_size) desc, symbol) as rank from {QUOTES} group by 1) where rank <= 5 and mismatched > 0")
def worst_symbols(spark, sf_dir):
    points = _points(spark, sf_dir, F.lit(100))
    return validate.worst_symbols(validate.bbo_check(_quotes(spark, sf_dir, points), points), 5).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""{STEPS}, kept as (select *, ts_nanos start_, coalesce(lead(ts_nanos) over (partition by trading_date, symbol, side, price_raw order by ts_nanos), 4611686018427387904) end_ from {UPDATES}),
snap as (select r.request, s.side, s.price_raw, s.declared from ({REQUESTS}) r join kept s on r.trading_date = s.trading_date and r.symbol = s.symbol and s.start_ <= r.ts_nanos and r.ts_nanos < s.end_ where s.declared > 0)
select request, max(case when side = '8' then price_raw end) bid_price_raw, min(case when side = '5' then price_raw end) ask_price_raw, cast(sum(declared) as bigint) total from snap group by 1""")
def level_feed_bbo(spark, sf_dir):
    """Best prices of books that the level feed replaces level by level."""
    sizes = written(validate.replaced_level_sizes(_updates(spark, sf_dir, book.level_changes(book.remaining(_steps(spark, sf_dir))))), "sizes")
    met = book.best_at(written(book.best_points(sizes, F.lit(1)), "points"), _requests(spark, sf_dir)).select("request", "best.*").filter("bid_levels + ask_levels > 0")
    price = lambda side: F.when(F.col(f"{side}_levels") > 0, F.col(f"{side}_price_raw")).alias(f"{side}_price_raw")
    return met.select("request", price("bid"), price("ask"), (F.col("bid_total") + F.col("ask_total")).alias("total"))


@query("""select coalesce(a.symbol, b.symbol) symbol, left_volume, right_volume, case when right_volume is null then 'only_left' when left_volume is null then 'only_right' when left_volume = right_volume then 'matched' else 'mismatched' end verdict,
  abs(coalesce(left_volume, 0) - coalesce(right_volume, 0)) difference from (select symbol, cast(sum(size) as bigint) left_volume from trades group by 1) a
  full join (select symbol, cast(sum(size) as bigint) right_volume from trades where trade_id % 97 <> 0 group by 1) b on a.symbol = b.symbol""")
def volume_reconcile(spark, sf_dir):
    trades = fx.trades(spark, sf_dir)
    return validate.reconcile_volumes(trades, trades.filter("trade_id % 97 != 0"))


_FED = f"""fed as (select *, ts_nanos start_, coalesce(lead(ts_nanos) over (partition by trading_date, symbol, side, price_raw order by ts_nanos), 4611686018427387904) end_ from {UPDATES}),
fed_snap as (select r.request, s.side, s.price_raw, s.declared from ({REQUESTS}) r join fed s on r.trading_date = s.trading_date and r.symbol = s.symbol and s.start_ <= r.ts_nanos and r.ts_nanos < s.end_ where s.declared > 0),
fed_best as (select request, coalesce(max(case when side = '8' and upto >= 100 then price_raw end), 0) bid_price, coalesce(arg_max(case when side = '8' and upto >= 100 then upto end, case when side = '8' and upto >= 100 then price_raw end), 0) bid,
  coalesce(min(case when side = '5' and upto >= 100 then price_raw end), 0) ask_price, coalesce(arg_min(case when side = '5' and upto >= 100 then upto end, case when side = '5' and upto >= 100 then price_raw end), 0) ask
  from (select *, sum(declared) over (partition by request, side order by case when side = '8' then -price_raw else price_raw end) upto from fed_snap) group by 1)"""


@query(f"""{STEPS}, {_FED}, rates as (select (select count(*) filter (where declared = level_size) / count(*) from {UPDATES} u join sizes s using (trading_date, symbol, side, price_raw, ts_nanos)) level_rate, (select count(*) filter (where quoted = bid_size) / count(*) from {QUOTES}) bbo_rate,
  (select count(*) filter (where coalesce(bid_price, 0) = bid_price_raw and coalesce(bid, 0) = quoted and coalesce(ask_price, 0) = ask_price_raw and coalesce(ask, 0) = ask_size) / count(*) from {QUOTES} q left join fed_best using (request)) level_feed_rate)
select {ev.r6('level_rate')} level_rate, {ev.r6('bbo_rate')} bbo_rate, {ev.r6('level_feed_rate')} level_feed_rate, case when level_rate is null or bbo_rate is null or level_feed_rate is null then 'failed' when level_rate < 0.9999 or bbo_rate < 0.99 or level_feed_rate < 0.99 then 'below_threshold' else 'passed' end verdict from rates""")
def match_report(spark, sf_dir):
    """The three legs of the triangle: orders against levels, orders against quotes, levels against quotes."""
    changes = _changes(spark, sf_dir)
    sizes = written(book.level_sizes(changes), "sizes")
    updates = _declared(sizes)
    points = written(book.best_points(sizes, F.lit(100)), "points")
    quotes = written(_quotes(spark, sf_dir, points), "quotes")
    rate = lambda checked, name: validate.match_report(checked, []).select(F.col("match_rate").alias(name), F.lit(1).alias("one"))
    legs = rate(validate.level_check(changes, updates), "level_rate")
    legs = legs.join(rate(validate.bbo_check(quotes, points), "bbo_rate"), "one")
    fed = written(book.best_points(written(validate.replaced_level_sizes(updates), "fed"), F.lit(100)), "fed-points")
    legs = legs.join(rate(validate.bbo_check(quotes, fed), "level_feed_rate"), "one").drop("one")
    return ev.rounded(legs.withColumn("verdict", validate.triangle_verdict(F.col("level_rate"), F.col("bbo_rate"), F.col("level_feed_rate"))), "level_rate", "bbo_rate", "level_feed_rate")


@query(f"""select 'S03' symbol, ts_nanos, feed, order_id, row_number() over (order by ts_nanos, feed_priority, seq) as place from (
  select ts_nanos, 'adds' feed, 0 feed_priority, order_id, seq, symbol from orders_add union all select ts_nanos, 'deletes', 1, order_id, seq, symbol from orders_delete) where symbol = 'S03' and ts_nanos between {fx.START} and {fx.START + 10 * SEC}""")
def trace_symbol(spark, sf_dir):
    feed = lambda df, name, p: df.select("symbol", "ts_nanos", "seq", "order_id", F.lit(name).alias("feed"), F.lit(p).alias("feed_priority"))
    rows = validate.trace([feed(fx.orders_add(spark, sf_dir), "adds", 0), feed(fx.orders_delete(spark, sf_dir), "deletes", 1)], "S03", fx.START + 5 * SEC, 5 * SEC)
    return rows.select("symbol", "ts_nanos", "feed", "order_id", F.col("place").cast("bigint").alias("place"))


# Facts around events.
WIDTH = 2 * SEC
_ev = f", {ev.EVENTS}"
_WINDOW = f"(select event_id, 'pre' win, trading_date, symbol, ts_nanos - {WIDTH} lo, ts_nanos hi from events where scorer_id = 'sweep' union all select event_id, 'post', trading_date, symbol, ts_end_nanos, ts_end_nanos + {WIDTH} from events where scorer_id = 'sweep')"
_TW = f"(select event_id, win, count(*) n_trades, cast(sum(size) as bigint) shares, cast(sum(size * price_raw) as bigint) notional_raw, min(price_raw) min_price_raw, max(price_raw) max_price_raw, min(t.ts_nanos) first_ts, max(t.ts_nanos) last_ts, sum(size * price_raw) / sum(size) / 10000.0 vwap from {_WINDOW} w join orders_executed t on t.trading_date = w.trading_date and t.symbol = w.symbol and t.ts_nanos >= lo and t.ts_nanos < hi group by 1, 2)"


def _sweep_events(spark, sf_dir):
    return ev._kept(ev._sweeps(spark, sf_dir)).withColumn("event_id", ev.sel.event_key())


@query(f"{_ev} select event_id, win as \"window\", n_trades, shares, notional_raw, min_price_raw, max_price_raw, first_ts, last_ts, {ev.r6('vwap')} vwap from {_TW}")
def trade_window_pre_post(spark, sf_dir):
    return ev.rounded(enrich.trade_windows(fx.orders_executed(spark, sf_dir), _sweep_events(spark, sf_dir), WIDTH), "vwap")


@query(f"""{_ev}, peaks as (select e.event_id, (s.lo + s.hi) / 2.0 / 10000.0 peak from events e join (select trading_date, symbol, min(ts_nanos) ts_nanos, max(ts_nanos) e_, min(price_raw) lo, max(price_raw) hi from {ev.islands('orders_executed', 'trading_date, symbol', 'ts_nanos, order_id, trade_id', 5 * SEC)} group by trading_date, symbol, island, part) s
  on e.trading_date = s.trading_date and e.symbol = s.symbol and e.ts_nanos = s.ts_nanos and e.ts_end_nanos = s.e_ where scorer_id = 'sweep'),
m as (select event_id, max(case when win = 'pre' then vwap end) pre, max(case when win = 'post' then vwap end) post from {_TW} group by 1)
select m.event_id, {ev.r6('case when pre > 0 then (post - pre) / pre * 10000.0 end')} move_bps, {ev.r6('case when abs(peak - pre) > 1e-9 then (peak - post) / (peak - pre) end')} reversion from m join peaks using (event_id)""")
def window_reversion(spark, sf_dir):
    sweeps = ev.rounded(ev._sweeps(spark, sf_dir), "score").withColumn("event_id", ev.sel.event_key())
    peaks = sweeps.select("event_id", ((F.col("min_price_raw") + F.col("max_price_raw")) / 2.0 / 10_000.0).alias("peak"))
    windows = enrich.trade_windows(fx.orders_executed(spark, sf_dir), sweeps, WIDTH)
    return ev.rounded(enrich.window_moves(windows, peaks), "move_bps", "reversion")


@query(f"""{_ev} select event_id, bids, asks, {ev.r6('greatest(bids, asks) / (bids + asks)')} sidedness, case when greatest(bids, asks) / (bids + asks) < 0.6 then 'two_sided' when bids > asks then 'bid_side' else 'ask_side' end sided from (
  select event_id, count(*) filter (where side = '8') bids, count(*) filter (where side = '5') asks from events e join (select d.*, a.side from orders_delete d join orders_add a using (trading_date, order_id)) d
  on e.trading_date = d.trading_date and e.symbol = d.symbol and d.ts_nanos between e.ts_nanos and e.ts_end_nanos where scorer_id = 'liquidity_withdrawal' group by 1)""")
def cancel_sidedness(spark, sf_dir):
    deletes = fx.orders_delete(spark, sf_dir).join(fx.orders_add(spark, sf_dir).select("trading_date", "order_id", "side"), ["trading_date", "order_id"])
    found = ev._kept(ev.dt.withdrawals(fx.orders_delete(spark, sf_dir), **ev.WITHDRAWAL)).withColumn("event_id", ev.sel.event_key())
    return ev.rounded(enrich.cancel_sides(deletes, found, SEC), "sidedness")


@query(f"""{_ev}, flow as (select trading_date, symbol, add_ts_nanos ts_nanos, side, 'add' kind, add_size from lifecycle union all select trading_date, symbol, delete_ts_nanos, side, 'delete', add_size from lifecycle where delete_ts_nanos is not null
  union all select trading_date, symbol, ts_nanos, null, 'fill', 0 from orders_executed),
win as (select event_id, 'in' w, trading_date, symbol, ts_nanos lo, ts_end_nanos hi from events where scorer_id = 'sweep' union all select event_id, 'pre', trading_date, symbol, ts_nanos - {WIDTH}, ts_nanos from events where scorer_id = 'sweep')
select event_id, posts, fills, {ev.r6('case when ba + br + aa + ar > 0 then ((ba - br) - (aa - ar)) / (ba + br + aa + ar) end')} flow_imbalance, case when fills > 0 then {ev.r6('posts / fills')} when posts > 0 then 'infinity'::double end order_to_trade from (
  select event_id, count(*) filter (where w = 'in' and kind = 'add') posts, count(*) filter (where w = 'in' and kind = 'fill') fills, coalesce(sum(add_size) filter (where w = 'pre' and side = '8' and kind = 'add'), 0) ba, coalesce(sum(add_size) filter (where w = 'pre' and side = '8' and kind = 'delete'), 0) br,
    coalesce(sum(add_size) filter (where w = 'pre' and side = '5' and kind = 'add'), 0) aa, coalesce(sum(add_size) filter (where w = 'pre' and side = '5' and kind = 'delete'), 0) ar
  from win join flow on win.trading_date = flow.trading_date and win.symbol = flow.symbol and flow.ts_nanos >= lo and flow.ts_nanos < hi group by 1)""")
def order_flow_around(spark, sf_dir):
    rows = enrich.order_flow(ev._lifecycle(spark, sf_dir), fx.orders_executed(spark, sf_dir), _sweep_events(spark, sf_dir), WIDTH)
    rows = rows.withColumn("order_to_trade", F.when(F.col("fills") > 0, F.floor(F.col("order_to_trade") * 1e6 + 0.5) / 1e6).otherwise(F.col("order_to_trade")))
    return ev.rounded(rows, "flow_imbalance")


@query(f"""select trading_date, symbol, n_fills, {ev.r6('realized')} realized_vol_bps, {ev.r6('jump')} jump_ratio, {ev.r6('vp')} vpin, floor(lambda_ * 1e9 + 0.5) / 1e9 kyle_lambda from (
 select trading_date, symbol, count(*) n_fills, sqrt(sum(lm * lm)) * 10000.0 realized, case when count(mv) >= 3 and sum(mv * mv) > 0 then least(1.0, greatest(0.0, 1 - coalesce(sum(abs(mv) * abs(mb)), 0) * (3.141592653589793 / 2) / sum(mv * mv))) end jump,
   abs(sum(case when sg > 0 then size else 0 end) - sum(case when sg < 0 then size else 0 end)) / sum(size) vp, case when count(mv) >= 3 and var_pop(case when mv is not null then sg end) > 0 then regr_slope(mv, case when mv is not null then sg end) end lambda_ from (
  select *, lag(mv) over (partition by trading_date, symbol order by ts_nanos, seq) mb from (
   select x.*, x.price_raw / 10000.0 - lag(x.price_raw / 10000.0) over w mv, ln((x.price_raw / 10000.0) / lag(x.price_raw / 10000.0) over w) lm, cast(case when a.side = '8' then x.size else -x.size end as double) sg
   from orders_executed x join orders_add a using (trading_date, order_id) window w as (partition by x.trading_date, x.symbol order by x.ts_nanos, x.seq))) group by 1, 2) where n_fills >= 3""")
def price_path(spark, sf_dir):
    executed = ev.lc.with_resting_side(fx.orders_executed(spark, sf_dir), ev._lifecycle(spark, sf_dir))
    rows = enrich.price_path(executed, ["trading_date", "symbol"])
    return ev.rounded(rows, "realized_vol_bps", "jump_ratio", "vpin").withColumn("kyle_lambda", F.floor(F.col("kyle_lambda") * 1e9 + 0.5) / 1e9)


@query(f"""{_ev}, fills as (select e.event_id, x.ts_nanos, x.seq, x.size, x.price_raw / 10000.0 p, cast(case when a.side = '8' then x.size else -x.size end as double) sg from (select * from events where scorer_id in ('sweep', 'layering', 'post_cancel_cluster')) e
  join orders_executed x on x.trading_date = e.trading_date and x.symbol = e.symbol and x.ts_nanos >= e.ts_nanos - {WIDTH} and x.ts_nanos < e.ts_end_nanos + {WIDTH} join orders_add a on a.trading_date = x.trading_date and a.order_id = x.order_id)
select event_id, n_fills, {ev.r6('realized')} realized_vol_bps, {ev.r6('jump')} jump_ratio, {ev.r6('vp')} vpin, floor(lambda_ * 1e9 + 0.5) / 1e9 kyle_lambda from (
 select event_id, count(*) n_fills, sqrt(sum(lm * lm)) * 10000.0 realized, case when count(mv) >= 3 and sum(mv * mv) > 0 then least(1.0, greatest(0.0, 1 - coalesce(sum(abs(mv) * abs(mb)), 0) * (3.141592653589793 / 2) / sum(mv * mv))) end jump,
   abs(sum(case when sg > 0 then size else 0 end) - sum(case when sg < 0 then size else 0 end)) / sum(size) vp, case when count(mv) >= 3 and var_pop(case when mv is not null then sg end) > 0 then regr_slope(mv, case when mv is not null then sg end) end lambda_ from (
  select *, lag(mv) over (partition by event_id order by ts_nanos, seq) mb from (select *, p - lag(p) over w mv, ln(p / lag(p) over w) lm from fills window w as (partition by event_id order by ts_nanos, seq))) group by 1) where n_fills >= 3""")
def execution_windows(spark, sf_dir):
    """Volatility, jumps and signed flow of the executions around each event."""
    executed = ev.lc.with_resting_side(fx.orders_executed(spark, sf_dir), ev._lifecycle(spark, sf_dir))
    events = ev.events(spark, sf_dir).filter(F.col("scorer_id").isin("sweep", "layering", "post_cancel_cluster"))
    rows = enrich.execution_windows(executed, events, WIDTH, WIDTH)
    return ev.rounded(rows, "realized_vol_bps", "jump_ratio", "vpin").withColumn("kyle_lambda", F.floor(F.col("kyle_lambda") * 1e9 + 0.5) / 1e9)
