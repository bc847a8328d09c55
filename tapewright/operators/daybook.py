"""Tables of a day and of a week as they are read: headlines, a table for each scorer, bullets.

Events come with their facts as JSON (breakdown), as run_all() gives them. A
fact that an event lacks leaves out its part of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt
from .patterns import first_rows
from .tables import DAY_LEVEL

#: What stands for an event that has nothing to tell.
NOTHING = "—"
#: By scorer the facts that its table shows, besides symbol, time and metric.
SCORER_COLUMNS = {
    "halt": ["duration_seconds", "duration_bucket", "resumed", "reason_label", "phase_span"],
    "large_trade": ["total_shares", "notional", "pct_of_baseline_volume", "pct_from_prev_close", "round_lots"],
    "sweep": ["n_rows", "n_levels", "total_shares", "notional", "slippage_bps", "slippage_direction"],
    "post_cancel_cluster": ["side", "n_rows", "total_shares", "median_lifetime_ns", "burstiness_fano"],
    "layering": ["side", "n_rows", "n_levels", "density", "range_bps"],
    "iceberg": ["price_raw", "n_rows", "total_shares", "median_fill", "cadence_class"],
    "liquidity_withdrawal": ["n_rows", "rate_per_second", "intensity"],
    "volume_deviation": ["total_shares", "baseline_median", "n_days", "robust_z"],
    "time_in_book_drift": ["n_rows", "avg_lifetime_ns", "baseline_median", "direction"],
}

#: Facts that metric() reads.
TOLD_FACTS = ["duration_seconds", "reason_label", "notional", "n_levels", "n_rows", "total_shares", "median_lifetime_ns", "removed_pct", "direction"]


def _fact(name: str) -> Column:
    found = F.get_json_object("breakdown", f"$.{name}")
    return F.when(found != "", found)


def _whole(name: str) -> Column:
    """A whole number with separators; null for 0."""
    n = _fact(name).try_cast("double").cast("bigint")
    return F.when(n != 0, fmt.thousands(n))


def _joined(separator: str, *parts: Column) -> Column:
    text = F.concat_ws(separator, *parts)
    return F.when(text == "", NOTHING).otherwise(text)


def _tenths(value: Column) -> Column:
    return fmt.rounded(value, 1).cast("string")


def metric(scorer_id: Column) -> Column:
    """What is told first of an event."""
    dollars = F.concat(F.lit("$"), fmt.thousands(F.floor(_fact("notional").try_cast("double"))))
    counted = lambda name, label: F.concat(_whole(name), F.lit(f" {label}"))
    texts = {
        "halt": F.concat_ws(" ", fmt.duration_words(_fact("duration_seconds").try_cast("bigint")), F.lit("halt"), F.concat(F.lit("("), _fact("reason_label"), F.lit(")"))),
        "large_trade": F.concat_ws(" ", dollars, F.lit("block")),
        "sweep": F.concat_ws(", ", F.concat_ws(" ", dollars, F.lit("sweep")), counted("n_levels", "levels")),
        "iceberg": _joined(", ", counted("n_rows", "fills"), counted("total_shares", "shares")),
        "layering": _joined(", ", counted("n_rows", "orders"), counted("n_levels", "levels")),
        "post_cancel_cluster": _joined(", ", counted("n_rows", "orders"), F.concat(F.floor(_fact("median_lifetime_ns").try_cast("double") / 1_000_000).cast("string"), F.lit("ms median"))),
        "liquidity_withdrawal": _joined(", ", counted("n_rows", "deletes"), F.concat(_tenths(_fact("removed_pct").try_cast("double")), F.lit("% of book"))),
        "volume_deviation": F.concat(_tenths(F.col("score")), F.lit("x trailing median")),
        "time_in_book_drift": F.concat_ws(" ", F.concat(_tenths(F.col("score")), F.lit("x")), _fact("direction"), F.lit("lifetime")),
    }
    out = scorer_id
    for name, text in texts.items():
        out = F.when(scorer_id == name, F.coalesce(text, scorer_id)).otherwise(out)
    return out


def when(scorer_id: Column, ts_nanos: Column) -> Column:
    """The time of an event in New York; events of a whole day say so."""
    return F.when(scorer_id.isin(*DAY_LEVEL), "day-level").otherwise(F.concat(fmt.new_york_time(ts_nanos), F.lit(" ET")))


def told(events: DataFrame) -> DataFrame:
    """events with metric and at, what is told of them and when."""
    return events.withColumns({"metric": metric(F.col("scorer_id")), "at": when(F.col("scorer_id"), F.col("ts_nanos"))})


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("scorer_id"), F.asc("symbol"), F.asc("ts_nanos"), F.asc("metric")]


def strongest(events: DataFrame, k: int, period: str = "trading_date") -> DataFrame:
    """The events that can be among the k strongest of their period, whatever is told of them: only these need be told."""
    place = F.rank().over(Window.partitionBy(period).orderBy(*_order()[:-1]))  # what ties but for its text stays
    return events.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def headlines(rows: DataFrame, k: int = 5, period: str = "trading_date") -> DataFrame:
    """The k strongest of told() events of each day, or of another period, with their place."""
    return first_rows(rows, [period], _order(), k, "place").select(period, F.col("place").cast("bigint").alias("place"), "scorer_id", "symbol", "at", "metric", "score")


def scorer_tables(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k strongest told() events of each day and scorer, with the scorer's own columns as a map of texts; facts that an event lacks are left out."""
    top = first_rows(rows, ["trading_date", "scorer_id"], _order(), k, "place")
    columns = F.lit(None).cast("map<string,string>")
    for scorer, names in SCORER_COLUMNS.items():
        own = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[_fact(n) for n in names])), lambda _, v: v.isNotNull())
        columns = F.when(F.col("scorer_id") == scorer, own).otherwise(columns)
    return top.select("trading_date", "scorer_id", F.col("place").cast("bigint").alias("place"), "symbol", "at", "metric", columns.alias("facts"))


def _leaders(rows: DataFrame, by: str) -> DataFrame:
    """trading_date, names (all that share the largest number of events, in order) and n."""
    counts = rows.groupBy("trading_date", by).agg(F.count(F.lit(1)).alias("n"))
    most = counts.withColumn("most", F.max("n").over(Window.partitionBy("trading_date"))).filter("n = most")
    return most.groupBy("trading_date", "n").agg(F.sort_array(F.collect_list(by)).alias("names"))


def bullets(rows: DataFrame, most: int = 5) -> DataFrame:
    """trading_date and up to so many bullets: who led, which scorer, the largest block, the longest halt, the change from the day before.

    Those who tie are named together. A day without blocks or halts has fewer.
    """
    symbols = _leaders(rows, "symbol").select("trading_date", F.when(F.size("names") == 1, F.concat(F.col("names")[0], F.lit(" led the day with "))).otherwise(F.concat(fmt.listed(F.col("names")), F.lit(" each led with "))).alias("who"), "n")
    symbols = symbols.select("trading_date", F.concat("who", fmt.thousands(F.col("n")), F.lit(" events")).alias("b1"))
    named = _leaders(rows, "scorer_id").withColumn("names", F.transform("names", lambda name: fmt.scorer_name(name)))
    scorers = named.select("trading_date", F.when(F.size("names") == 1, F.concat(F.col("names")[0], F.lit(" dominated ("), fmt.thousands(F.col("n")), F.lit(" events)"))).otherwise(F.concat(fmt.listed(F.col("names")), F.lit(" each saw "), fmt.thousands(F.col("n")), F.lit(" events"))).alias("b2"))
    largest = lambda scorer, fact: rows.filter(F.col("scorer_id") == scorer).withColumn("v", _fact(fact).try_cast("double")).filter("v is not null").groupBy("trading_date").agg(F.max_by(F.struct("symbol", "v"), F.struct("v", F.col("symbol"))).alias("top"))
    blocks = largest("large_trade", "notional").select("trading_date", F.concat(F.lit("Largest block: "), "top.symbol", F.lit(" $"), fmt.thousands(F.floor("top.v"))).alias("b3"))
    halts = largest("halt", "duration_seconds").select("trading_date", F.concat(F.lit("Longest halt: "), "top.symbol", F.lit(" "), fmt.duration_words(F.col("top.v").cast("bigint"))).alias("b4"))
    along = Window.partitionBy(F.lit(1)).orderBy("trading_date")  # one row for each trading day
    totals = rows.groupBy("trading_date").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.lag("n").over(along))
    change = F.floor((F.col("n") - F.col("before")) * 100.0 / F.col("before") + 0.5).cast("bigint")
    changes = totals.select("trading_date", F.when(F.abs(change) >= 10, F.concat(F.lit("Event volume "), F.when(change > 0, "+").otherwise(""), change.cast("string"), F.lit("% vs prior session"))).alias("b5"))
    out = totals.select("trading_date")
    for part in (symbols, scorers, blocks, halts, changes):
        out = out.join(part, "trading_date", "left")
    all_ = F.filter(F.array("b1", "b2", "b3", "b4", "b5"), lambda b: b.isNotNull())
    return out.select("trading_date", F.slice(all_, 1, most).alias("bullets"))
