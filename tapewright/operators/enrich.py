"""Market-structure facts about scored events, from the flow around them.

Events have event_id, trading_date, symbol, ts_nanos, ts_end_nanos. Flow is met
by range joins on symbol, day and time buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .patterns import range_join, with_before

KEYS = ["trading_date", "symbol"]


def windows_around(events: DataFrame, width_ns: int) -> DataFrame:
    """Two rows for each event: window pre [ts - width, ts) and post [end, end + width)."""
    ts, end = F.col("ts_nanos"), F.coalesce("ts_end_nanos", "ts_nanos")
    both = F.array(F.struct(F.lit("pre").alias("window"), (ts - width_ns).alias("start"), ts.alias("end")), F.struct(F.lit("post").alias("window"), end.alias("start"), (end + width_ns).alias("end")))
    return events.select("event_id", *KEYS, F.inline(both))


def trade_windows(trades: DataFrame, events: DataFrame, width_ns: int) -> DataFrame:
    """event_id, window, and the trades in it: count, shares, notional, prices, first and last time, vwap."""
    met = range_join(trades.select(*KEYS, "ts_nanos", "size", "price_raw"), windows_around(events, width_ns), KEYS, "ts_nanos", "start", "end", width_ns)
    shares, notional = F.sum(F.col("size").cast("bigint")), F.sum(F.col("size").cast("bigint") * F.col("price_raw"))
    return met.groupBy("event_id", "window").agg(F.count(F.lit(1)).alias("n_trades"), shares.alias("shares"), notional.alias("notional_raw"), F.min("price_raw").alias("min_price_raw"), F.max("price_raw").alias("max_price_raw"), F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts"), (notional / shares / 10_000.0).alias("vwap"))


def window_moves(windows: DataFrame, peaks: DataFrame) -> DataFrame:
    """event_id with the move of the vwap from before to after in basis points, and the share of the event's impact that was taken back. peaks: event_id, peak (price)."""
    by_event = windows.groupBy("event_id").agg(F.max(F.when(F.col("window") == "pre", F.col("vwap"))).alias("pre"), F.max(F.when(F.col("window") == "post", F.col("vwap"))).alias("post"))
    joined = by_event.join(peaks, "event_id")
    return joined.select("event_id", F.when(F.col("pre") > 0, (F.col("post") - F.col("pre")) / F.col("pre") * 10_000.0).alias("move_bps"), stats.reversion(F.col("pre"), F.col("peak"), F.col("post")).alias("reversion"))


def cancel_sides(deletes_with_side: DataFrame, events: DataFrame, bucket: int, cutoff: float = 0.60) -> DataFrame:
    """event_id with deletes by side in the closed interval [ts, ts_end], the larger share and its class."""
    spans = events.select("event_id", *KEYS, F.col("ts_nanos").alias("start"), (F.coalesce("ts_end_nanos", "ts_nanos") + 1).alias("end"))
    met = range_join(deletes_with_side.select(*KEYS, "ts_nanos", "side"), spans, KEYS, "ts_nanos", "start", "end", bucket)
    counted = met.groupBy("event_id").agg(F.count_if(F.col("side") == "8").alias("bids"), F.count_if(F.col("side") == "5").alias("asks"))
    share = stats.one_sidedness(F.col("bids"), F.col("asks"))
    return counted.select("event_id", "bids", "asks", share.alias("sidedness"), F.when(share < cutoff, "two_sided").when(F.col("bids") > F.col("asks"), "bid_side").otherwise("ask_side").alias("sided"))


def order_flow(lifecycle: DataFrame, executed: DataFrame, events: DataFrame, width_ns: int) -> DataFrame:
    """event_id with posts and fills in [ts, ts_end), orders to trades, and the flow imbalance of the width before it."""
    flow = lifecycle.select(*KEYS, F.col("add_ts_nanos").alias("ts_nanos"), "side", F.lit("add").alias("kind"), "add_size").unionByName(lifecycle.filter("delete_ts_nanos is not null").select(*KEYS, F.col("delete_ts_nanos").alias("ts_nanos"), "side", F.lit("delete").alias("kind"), "add_size"))
    flow = flow.unionByName(executed.select(*KEYS, "ts_nanos", F.lit(None).cast("string").alias("side"), F.lit("fill").alias("kind"), F.lit(0).alias("add_size")))
    spans = events.select("event_id", *KEYS, F.inline(F.array(F.struct(F.lit("in").alias("window"), F.col("ts_nanos").alias("start"), F.coalesce("ts_end_nanos", "ts_nanos").alias("end")), F.struct(F.lit("pre").alias("window"), (F.col("ts_nanos") - width_ns).alias("start"), F.col("ts_nanos").alias("end")))))
    met = range_join(flow, spans.filter("start < end"), KEYS, "ts_nanos", "start", "end", width_ns)
    inside, before = F.col("window") == "in", F.col("window") == "pre"
    size = lambda side, kind: F.sum(F.when(before & (F.col("side") == side) & (F.col("kind") == kind), F.col("add_size")).otherwise(0)).cast("double")
    counted = met.groupBy("event_id").agg(F.count_if(inside & (F.col("kind") == "add")).alias("posts"), F.count_if(inside & (F.col("kind") == "fill")).alias("fills"), stats.flow_imbalance(size("8", "add"), size("8", "delete"), size("5", "add"), size("5", "delete")).alias("flow_imbalance"))
    return counted.withColumn("order_to_trade", stats.order_to_trade(F.col("posts"), F.col("fills")))


def price_path(executed_with_side: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """By key: realized volatility in basis points, jump ratio, VPIN and Kyle's lambda of executions in order.

    Moves are differences of consecutive prices; a move's flow is that of the
    later execution, signed by the resting side. Windows run inside pieces of
    time, so a busy key is spread over many tasks.
    """
    price, order = F.col("price_raw") / 10_000.0, ["ts_nanos", "seq"]
    rows = with_before(executed_with_side.withColumn("price", price), keys, order, "price", "before")
    rows = rows.withColumns({"move": F.col("price") - F.col("before"), "log_move": F.when((F.col("before") > 0) & (F.col("price") > 0), F.log(F.col("price") / F.col("before"))), "signed": F.when(F.col("resting_side") == "8", F.col("size")).otherwise(-F.col("size")).cast("double")})
    rows = with_before(rows, keys, order, "move", "move_before")
    squares, n = F.sum(F.col("move") * F.col("move")), F.count("move")
    smooth = F.sum(F.abs("move") * F.abs("move_before")) * (3.141592653589793 / 2)
    buys, sells = F.sum(F.when(F.col("signed") > 0, F.col("size")).otherwise(0)).cast("double"), F.sum(F.when(F.col("signed") < 0, F.col("size")).otherwise(0)).cast("double")
    moved = F.col("move").isNotNull()
    slope = F.when((n >= 3) & (F.var_pop(F.when(moved, F.col("signed"))) > 0), F.regr_slope(F.col("move"), F.when(moved, F.col("signed"))))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_fills"), (F.sqrt(F.sum(F.col("log_move") * F.col("log_move"))) * 10_000.0).alias("realized_vol_bps"),
        F.when((n >= 3) & (squares > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.coalesce(smooth, F.lit(0.0)) / squares))).alias("jump_ratio"), stats.vpin(buys, sells).alias("vpin"), slope.alias("kyle_lambda"),
    ).filter(F.col("n_fills") >= least)


def execution_windows(executed_with_side: DataFrame, events: DataFrame, before_ns: int, after_ns: int, least: int = 3) -> DataFrame:
    """price_path() of the executions in [ts - before, ts_end + after) of each event; events of fewer than ``least`` have no row."""
    ts, end = F.col("ts_nanos"), F.coalesce("ts_end_nanos", "ts_nanos")
    spans = events.select("event_id", *KEYS, (ts - before_ns).alias("start"), (end + after_ns).alias("end"))
    rows = executed_with_side.select(*KEYS, "ts_nanos", "seq", "size", "price_raw", "resting_side")
    return price_path(range_join(rows, spans, KEYS, "ts_nanos", "start", "end", before_ns + after_ns), ["event_id"], least)


def merge(events: DataFrame, found: DataFrame, key: str = "event_id") -> DataFrame:
    """events with the columns of found; where both have one, a found value that isn't null wins."""
    e, f = events.alias("e"), found.alias("f")
    columns = [F.coalesce(f"f.{c}", f"e.{c}").alias(c) if c in found.columns and c != key else F.col(f"e.{c}") for c in events.columns]
    return e.join(f, F.col(f"e.{key}") == F.col(f"f.{key}"), "left").select(*columns, *[F.col(f"f.{c}") for c in found.columns if c not in events.columns])


def book_requests(events: DataFrame, recovery_ns: int) -> DataFrame:
    """Times at which events need the book: at their start, and for withdrawals also at their end and some time later."""
    at = F.struct(F.lit("at").alias("role"), F.col("ts_nanos").alias("ts_nanos"))
    end = F.coalesce("ts_end_nanos", "ts_nanos")
    later = F.array(F.struct(F.lit("after").alias("role"), end.alias("ts_nanos")), F.struct(F.lit("recovery").alias("role"), (end + recovery_ns).alias("ts_nanos")))
    roles = F.when(F.col("scorer_id") == "liquidity_withdrawal", F.concat(F.array(at), later)).when(F.col("scorer_id").isin("halt", "layering", "sweep"), F.array(at))
    return events.select("event_id", "trading_date", "symbol", F.inline(roles))


def book_facts(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What the book adds to events, from best prices of their requests (event_id, role, best_prices columns).

    Spread at a halt; a sweep's effective spread against the middle; how far a
    layer's prices lie from the touch; the share of the book that a withdrawal
    removed (if not negative), and the share that had come back later; the
    imbalance of depth. Events have min_price_raw, max_price_raw and side, null
    where they have none.
    """
    of = lambda role, name: F.max(F.when(F.col("role") == role, F.col(name)))
    total = F.col("bid_total") + F.col("ask_total")
    by_event = snapshots.withColumn("total", total).groupBy("event_id").agg(*[of("at", n).alias(n) for n in ("bid_price_raw", "ask_price_raw", "bid_total", "ask_total")], of("at", "total").alias("before"), of("after", "total").alias("after"), of("recovery", "total").alias("recovery"))
    rows = events.join(by_event, "event_id")
    mid = (F.col("bid_price_raw") + F.col("ask_price_raw")) / 2.0
    spread = F.col("ask_price_raw") - F.col("bid_price_raw")
    touch = F.when(F.col("side") == "5", F.col("ask_price_raw")).when(F.col("side") == "8", F.col("bid_price_raw"))
    away = [F.abs(F.col(c) - touch) / touch * 10_000.0 for c in ("min_price_raw", "max_price_raw")]
    own = lambda scorer, value: F.when(F.col("scorer_id") == scorer, value)
    removed = (F.col("before") - F.col("after")) / F.col("before") * 100.0
    return rows.select(
        "event_id",
        own("halt", F.when(spread > 0, spread / mid * 10_000.0)).alias("halt_spread_bps"),
        own("sweep", stats.effective_spread_bps((F.col("min_price_raw") + F.col("max_price_raw")) / 2.0, mid)).alias("effective_spread_bps"),
        own("layering", F.least(*away)).alias("near_bps"),
        own("layering", F.greatest(*away)).alias("far_bps"),
        own("liquidity_withdrawal", F.when((F.col("before") > 0) & (removed >= 0), removed)).alias("removed_pct"),
        own("liquidity_withdrawal", F.when(F.col("before") > 0, F.col("recovery") / F.col("before") * 100.0)).alias("recovered_pct"),
        F.when(F.col("scorer_id") != "liquidity_withdrawal", stats.depth_imbalance(F.col("bid_total"), F.col("ask_total"))).alias("depth_imbalance"),
    )
