"""Nine event detectors. Each takes tables and thresholds and returns one row for each event.

All rows have trading_date, symbol, ts_nanos, ts_end_nanos, scorer_id, score,
then the detector's own facts, and source_refs where an event has source rows.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt, stats
from ..session import written
from . import lifecycle as lc
from .patterns import gap_clusters

MS = 1_000_000
DETECTORS: dict[str, Callable[..., DataFrame]] = {}


def detector(scorer_id: str):
    """Registers a detector under its id."""

    def add(function):
        DETECTORS[scorer_id] = function
        return function

    return add


def _event(df: DataFrame, scorer_id: str, score: Column, *facts: Column | str, start: str = "ts_nanos", end: Column | None = None) -> DataFrame:
    return df.select("trading_date", "symbol", F.col(start).alias("ts_nanos"), (F.lit(None).cast("bigint") if end is None else end).alias("ts_end_nanos"), F.lit(scorer_id).alias("scorer_id"), score.alias("score"), *facts)


def _at_least_one(value: Column) -> Column:
    return F.log10(F.greatest(value.cast("double"), F.lit(1.0)))


def _refs(order: list[str], most: int) -> list[Column]:
    rows = F.sort_array(F.collect_list(F.struct(*order)))
    return [F.slice(rows, 1, most).alias("source_refs"), F.greatest(F.size(rows) - most, F.lit(0)).alias("truncated_count")]


@detector("halt")
def halts(status: DataFrame) -> DataFrame:
    """A halt lasts until the next trading-status row of its symbol, whatever it says."""
    along = Window.partitionBy("symbol").orderBy("ts_nanos", "seq")
    rows = status.filter("event_kind = 'H'").withColumns({"next_ts": F.lead("ts_nanos").over(along), "next_sub": F.lead("sub_type").over(along)}).filter("sub_type = 'H'")
    seconds = F.floor(F.col("next_ts") / 1_000_000_000) - F.floor(F.col("ts_nanos") / 1_000_000_000)
    rows = rows.withColumn("seconds", seconds)
    bucket = F.when(seconds < 300, "under_5min").when(seconds < 1_800, "5_to_30min").when(seconds < 7_200, "30min_to_2h").when(seconds < 11_700, "2h_to_half_session").when(seconds < 23_400, "half_to_full_session").when(seconds.isNotNull(), "exceeds_full_session")
    score = F.when(F.col("seconds").isNull(), 0.0).otherwise(F.log10(F.col("seconds") + 1.0) * fmt.phase_weight(F.col("ts_nanos")))
    return _event(rows, "halt", score, F.col("seconds").alias("duration_seconds"), bucket.alias("duration_bucket"), F.coalesce(F.col("next_sub") == "T", F.lit(False)).alias("resumed"), fmt.halt_reason(F.col("reason")).alias("reason_label"), fmt.halt_span(F.col("ts_nanos"), F.col("next_ts")).alias("phase_span"), end=F.col("next_ts"))


@detector("large_trade")
def large_trades(trades: DataFrame, baseline: DataFrame | None = None, symbols: DataFrame | None = None, cutoff_dollars: int = 1_000_000) -> DataFrame:
    """Trades over a notional. baseline: day, symbol, median; symbols: symbol, prev_close_dollars, round_lot (about ten thousand rows)."""
    raw = F.col("size").cast("bigint") * F.col("price_raw")
    rows = trades.filter(raw > cutoff_dollars * 10_000).withColumns({"notional": F.col("size") * (F.col("price_raw") / 10_000.0), "price": F.col("price_raw") / 10_000.0})
    if baseline is not None:
        rows = rows.join(baseline.select(F.col("day").alias("trading_date"), "symbol", "median"), ["trading_date", "symbol"], "left")
    else:
        rows = rows.withColumn("median", F.lit(None).cast("double"))
    if symbols is not None:
        rows = rows.join(symbols.select("symbol", "prev_close_dollars", "round_lot"), "symbol", "left")
    else:
        rows = rows.withColumns({"prev_close_dollars": F.lit(None).cast("double"), "round_lot": F.lit(None).cast("int")})
    change = F.when(F.col("prev_close_dollars") > 0, (F.col("price") - F.col("prev_close_dollars")) / F.col("prev_close_dollars") * 100.0)
    return _event(rows, "large_trade", F.log10("notional") * fmt.phase_weight(F.col("ts_nanos")), "trade_id", F.col("size").cast("bigint").alias("total_shares"), "notional", stats.percent_of(F.col("size"), F.col("median")).alias("pct_of_baseline_volume"), change.alias("pct_from_prev_close"), F.floor(F.col("size") / F.col("round_lot")).alias("round_lots"))


@detector("sweep")
def sweeps(executed: DataFrame, max_gap: int = 10 * MS, least_levels: int = 3, cap: int = 10_000) -> DataFrame:
    """Bursts of executions of a symbol at several prices."""
    order = ["ts_nanos", "order_id", "trade_id"]
    first = F.min_by("price_raw", F.struct(*order))
    found = gap_clusters(executed, ["trading_date", "symbol"], order, max_gap, cap).groupBy("trading_date", "symbol", "cluster").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("price_raw").alias("n_levels"), F.sum(F.col("size").cast("bigint")).alias("total_shares"), F.sum(F.col("size").cast("bigint") * F.col("price_raw")).alias("notional_raw"),
        F.min("price_raw").alias("min_price_raw"), F.max("price_raw").alias("max_price_raw"), first.alias("first_price"), F.max_by("price_raw", F.struct(*order)).alias("last_price"), F.min("ts_nanos").alias("ts_nanos"), F.max("ts_nanos").alias("end"), *_refs(order, 32),
    ).filter(F.col("n_levels") >= least_levels)
    notional = F.col("notional_raw") / 10_000.0
    score = (_at_least_one(notional) + _at_least_one(F.col("n_levels"))) * fmt.phase_weight(F.col("ts_nanos"))
    bps = stats.slippage_bps(F.col("first_price").cast("double"), F.col("last_price").cast("double"))
    return _event(found, "sweep", score, "n_rows", "n_levels", "total_shares", notional.alias("notional"), "min_price_raw", "max_price_raw", bps.alias("slippage_bps"), F.when(bps > 0, "up").when(bps < 0, "down").otherwise("flat").alias("slippage_direction"), "source_refs", "truncated_count", end=F.col("end"))


def _short_lived_clusters(lifecycle: DataFrame, most_ns: int, max_gap: int, least_orders: int, cap: int) -> DataFrame:
    """Bursts of orders that are cancelled at once, which post_cancel_clusters() and layering() tell."""
    order = ["add_ts_nanos", "order_id"]
    times = F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda s: s["add_ts_nanos"])
    lifetimes = F.sort_array(F.collect_list("lifetime_ns"))
    return gap_clusters(lc.short_lived(lifecycle, most_ns), ["trading_date", "symbol", "side"], order, max_gap, cap).groupBy("trading_date", "symbol", "side", "cluster").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("add_price_raw").alias("n_levels"), F.sum(F.col("add_size").cast("bigint")).alias("total_shares"), F.min("add_price_raw").alias("min_price_raw"), F.max("add_price_raw").alias("max_price_raw"),
        F.min("add_ts_nanos").alias("ts_nanos"), F.max("add_ts_nanos").alias("end"), times.alias("times"), F.element_at(lifetimes, (F.floor(F.size(lifetimes) / 2) + 1).cast("int")).alias("median_lifetime_ns"), *_refs(order, 32),
    ).filter(F.col("n_rows") >= least_orders)


#: Columns of a burst that hold its rows, and the facts that are made of them.
_OF_ROWS = {"times": ("arrival_autocorr", "burstiness_fano"), "median_lifetime_ns": ("median_lifetime_ns",), "source_refs": (), "truncated_count": ("truncated_count",)}


def short_lived_bursts(lifecycle: DataFrame, most_ns: int = 50 * MS, max_gap: int = 50 * MS, least_orders: int = 20, cap: int = 10_000, only: Collection[str] | None = None) -> DataFrame:
    """The bursts that both detectors read, for a caller that runs both and writes them once; only: as in with_breakdown(), columns that its facts don't need are null."""
    found = _short_lived_clusters(lifecycle, most_ns, max_gap, least_orders, cap)
    left_out = [] if only is None else [c for c, facts in _OF_ROWS.items() if not any(f in only for f in facts)]
    return found.withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in left_out})


@detector("post_cancel_cluster")
def post_cancel_clusters(lifecycle: DataFrame | None, most_ns: int = 50 * MS, max_gap: int = 50 * MS, least_orders: int = 20, cap: int = 10_000, bursts: DataFrame | None = None) -> DataFrame:
    """Bursts of orders of a symbol and side that are cancelled at once. bursts: those of short_lived_bursts(), if they are at hand."""
    found = _short_lived_clusters(lifecycle, most_ns, max_gap, least_orders, cap) if bursts is None else bursts.filter(F.col("n_rows") >= least_orders)
    score = _at_least_one(F.col("total_shares")) * F.col("n_rows") * fmt.phase_weight(F.col("ts_nanos"))
    gaps = F.transform(F.sequence(F.lit(2), F.greatest(F.size("times"), F.lit(2))), lambda i: (F.try_element_at("times", i) - F.try_element_at("times", i - 1)).cast("double"))
    return _event(found, "post_cancel_cluster", score, "side", "n_rows", "n_levels", "total_shares", "median_lifetime_ns", F.when(F.col("n_rows") >= 4, stats.autocorrelation(gaps)).alias("arrival_autocorr"), _burstiness().alias("burstiness_fano"), "source_refs", "truncated_count", end=F.col("end"))


def _burstiness() -> Column:
    """Fano factor of the times with a fifth as many bins as rows, from 2 to 50."""
    bins = F.greatest(F.lit(2), F.least(F.lit(50), F.floor(F.col("n_rows") / 5))).cast("int")
    low, span, n = F.col("ts_nanos"), F.col("end") - F.col("ts_nanos"), F.col("n_rows")
    counts = F.transform(F.sequence(F.lit(0), bins - 1), lambda b: F.size(F.filter("times", lambda t: F.least(F.floor((t - low) / span * bins), bins - 1) == b)))
    mean = n / bins
    return F.when((n >= 2) & (span > 0), (F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) / bins - mean * mean) / mean)


@detector("layering")
def layering(lifecycle: DataFrame | None, most_ns: int = 50 * MS, max_gap: int = 50 * MS, least_orders: int = 20, least_levels: int = 5, cap: int = 10_000, bursts: DataFrame | None = None) -> DataFrame:
    """The same bursts, at several prices."""
    found = _short_lived_clusters(lifecycle, most_ns, max_gap, least_orders, cap) if bursts is None else bursts.filter(F.col("n_rows") >= least_orders)
    found = found.filter(F.col("n_levels") >= least_levels)
    score = _at_least_one(F.col("total_shares")) * F.col("n_levels") * fmt.phase_weight(F.col("ts_nanos"))
    per_level, mid = F.col("n_rows") / F.col("n_levels"), (F.col("min_price_raw") + F.col("max_price_raw")) / 2
    return _event(found, "layering", score, "side", "n_rows", "n_levels", "total_shares", "median_lifetime_ns", F.when(per_level < 2, "sparse").when(per_level < 5, "moderate").otherwise("stacked").alias("density"), ((F.col("max_price_raw") - F.col("min_price_raw")) / mid * 10_000.0).alias("range_bps"), "source_refs", "truncated_count", end=F.col("end"))


def _even(n: Column, total: Column, squares: Column, most_cv: float) -> Column:
    """Whether sizes vary by most_cv at most, in whole numbers: at the limit itself a quotient of doubles depends on the order of rows."""
    whole = lambda x: x.cast("decimal(38,0)")
    limit = Fraction(str(most_cv)) ** 2
    return whole(whole(n) * whole(squares)) * F.lit(limit.denominator) <= whole(whole(total) * whole(total)) * F.lit(limit.numerator + limit.denominator)


@detector("iceberg")
def icebergs(executed: DataFrame, max_gap: int = 600_000 * MS, least_fills: int = 8, least_span: int = 30_000 * MS, most_cv: float = 0.20, cap: int = 10_000) -> DataFrame:
    """Runs of fills of even size at one price."""
    order = ["ts_nanos", "order_id", "trade_id"]
    sizes = F.sort_array(F.collect_list("size"))
    n, total, squares = F.count(F.lit(1)), F.sum(F.col("size").cast("bigint")), F.sum(F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)"))
    rows = gap_clusters(executed, ["trading_date", "symbol", "price_raw"], order, max_gap, cap)
    along = Window.partitionBy("trading_date", "symbol", "price_raw", "cluster").orderBy(*order)
    rows = rows.withColumn("gap", F.col("ts_nanos") - F.lag("ts_nanos").over(along))
    found = rows.groupBy("trading_date", "symbol", "price_raw", "cluster").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("size").cast("bigint")).alias("total_shares"), (F.stddev_pop("size") / F.avg("size")).alias("size_cv"), F.element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int")).alias("median_fill"),
        (F.stddev_samp("gap") / F.avg("gap")).alias("cadence_cv"), F.min("ts_nanos").alias("ts_nanos"), F.max("ts_nanos").alias("end"), _even(n, total, squares, most_cv).alias("even"), *_refs(order, 32),
    ).filter((F.col("n_rows") >= least_fills) & (F.col("end") - F.col("ts_nanos") >= least_span) & F.col("even"))
    score = _at_least_one(F.col("total_shares")) * F.col("n_rows") * fmt.phase_weight(F.col("ts_nanos"))
    cadence = F.when(F.col("n_rows") >= 3, F.col("cadence_cv"))
    return _event(found, "iceberg", score, "price_raw", "n_rows", "total_shares", "size_cv", F.col("median_fill").cast("bigint").alias("median_fill"), cadence.alias("cadence_cv"), F.when(cadence < 0.3, "metronomic").when(cadence < 1, "regular").when(cadence < 2, "irregular").when(cadence.isNotNull(), "erratic").alias("cadence_class"), "source_refs", "truncated_count", end=F.col("end"))


@detector("liquidity_withdrawal")
def withdrawals(deletes: DataFrame, max_gap: int = 100 * MS, least_deletes: int = 50, cap: int = 10_000) -> DataFrame:
    """Bursts of deletes of a symbol."""
    order = ["ts_nanos", "order_id"]
    found = gap_clusters(deletes, ["trading_date", "symbol"], order, max_gap, cap).groupBy("trading_date", "symbol", "cluster").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts_nanos").alias("ts_nanos"), F.max("ts_nanos").alias("end"), *_refs(order, 16)).filter(F.col("n_rows") >= least_deletes)
    seconds = (F.col("end") - F.col("ts_nanos")) / 1e9
    score = F.log10(F.col("n_rows").cast("double")) * F.col("n_rows") * fmt.phase_weight(F.col("ts_nanos"))
    rate = F.when(seconds > 0, F.col("n_rows") / seconds).otherwise(0.0)
    return _event(found, "liquidity_withdrawal", score, "n_rows", rate.alias("rate_per_second"), F.when(seconds < 1, "sub_second").when(seconds < 10, "brief").when(seconds < 60, "sustained").otherwise("extended").alias("intensity"), "source_refs", "truncated_count", end=F.col("end"))


def _day_start(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000_000


@detector("volume_deviation")
def volume_deviations(daily: DataFrame, days: int = 14, least_days: int = 3, least_median: float = 25_000, least_volume: int = 100_000, least_ratio: float = 3.0) -> DataFrame:
    """Days on which a symbol's volume is a multiple of its trailing median."""
    rows = lc.trailing(daily, "total_volume", days).withColumn("median", stats.median(F.col("values")))
    ratio = F.col("total_volume") / F.col("median")
    rows = rows.filter((F.col("n_days") >= least_days) & (F.col("median") >= least_median) & (F.col("total_volume") >= least_volume) & (ratio >= least_ratio))
    rows = rows.withColumns({"trading_date": F.col("day"), "ts_nanos": _day_start(F.col("day")), "spread": stats.mad(F.col("values"))})
    value = F.col("total_volume").cast("double")
    return _event(rows, "volume_deviation", ratio, F.col("total_volume").alias("total_shares"), F.col("median").alias("baseline_median"), "n_days", F.when(F.col("spread") > 0, stats.robust_z(value, F.col("median"), F.col("spread"))).alias("robust_z"), stats.percentile_rank(F.col("values"), value).alias("percentile_rank"), stats.cusum(F.col("values")).alias("regime_shift"))


@detector("time_in_book_drift")
def lifetime_drifts(daily: DataFrame, days: int = 14, least_days: int = 5, least_ns: float = 1_000, least_orders: int = 1_000, least_factor: float = 3.0) -> DataFrame:
    """Days on which a symbol's orders live much longer or shorter than by its trailing median."""
    rows = lc.trailing(daily, "avg_lifetime_ns", days).withColumn("median", stats.median(F.col("values")))
    ratio = F.col("avg_lifetime_ns") / F.col("median")
    factor = F.greatest(ratio, 1 / ratio)
    rows = rows.filter((F.col("n_days") >= least_days) & (F.col("median") >= least_ns) & (F.col("order_count") >= least_orders) & (factor >= least_factor))
    rows = rows.withColumns({"trading_date": F.col("day"), "ts_nanos": _day_start(F.col("day")), "spread": stats.mad(F.col("values"))})
    value = F.col("avg_lifetime_ns").cast("double")
    return _event(rows, "time_in_book_drift", factor, F.col("order_count").alias("n_rows"), "avg_lifetime_ns", F.col("median").alias("baseline_median"), F.when(ratio < 1, "shorter").otherwise("longer").alias("direction"), F.when(F.col("spread") > 0, stats.robust_z(value, F.col("median"), F.col("spread"))).alias("robust_z"))


COMMON = ["trading_date", "symbol", "ts_nanos", "ts_end_nanos", "scorer_id", "score"]


def with_breakdown(events: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """The common columns, the facts as JSON, and the source rows as JSON; with only, just these facts and no source rows, so that nothing else is worked out."""
    facts = [c for c in events.columns if c not in (*COMMON, "source_refs") and (only is None or c in only)]
    refs = F.to_json("source_refs") if "source_refs" in events.columns and only is None else F.lit("[]")
    return events.select(*COMMON, (F.to_json(F.struct(*facts)) if facts else F.lit("{}")).alias("breakdown"), refs.alias("source_refs"))


def run_all(calls: dict[str, tuple], keep: Callable[[DataFrame, str], DataFrame] = written, shape: Callable[[DataFrame], DataFrame] = with_breakdown) -> tuple[DataFrame | None, dict[str, Exception]]:
    """All events of {scorer_id: (tables and thresholds)}, and the detectors that failed, in planning or in running; one failing does not stop the rest.

    keep runs a detector: by default its events are written to the shared folder,
    in the columns that shape gives them.
    """
    events, failed = None, {}
    for scorer_id, (args, options) in calls.items():
        try:
            found = keep(shape(DETECTORS[scorer_id](*args, **options)), f"events-{scorer_id}")
        except Exception as error:  # reported to the caller by its id
            failed[scorer_id] = error
            continue
        events = found if events is None else events.unionByName(found)
    return events, failed
