"""Cross-checks of independent feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import book
from .patterns import PIECE


def last_of_instant(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows of equal keys and time, the one that arrived last."""
    inside = Window.partitionBy(*keys, F.floor(F.col("ts_nanos") / PIECE)).orderBy("ts_nanos", "seq")  # one for a piece of time, not for each instant
    nxt = F.lead("ts_nanos").over(inside)
    return df.withColumn("__next", nxt).filter(F.col("__next").isNull() | (F.col("__next") != F.col("ts_nanos"))).drop("__next")


def level_check(changes: DataFrame, updates: DataFrame, tasks: int | None = None) -> DataFrame:
    """Declared level sizes against summed order sizes as of the same time; orders win ties.

    One window over the union of both, by level, so a busy symbol is spread
    over its levels. updates: level keys, ts_nanos, seq, declared. tasks: the
    number of partitions to sort in, by default the session's.
    """
    declared = last_of_instant(updates, book.LEVEL)
    union = changes.select(*book.LEVEL, "ts_nanos", "delta", F.lit(None).cast("bigint").alias("declared")).unionByName(declared.select(*book.LEVEL, "ts_nanos", F.lit(0).cast("bigint").alias("delta"), F.col("declared").cast("bigint").alias("declared")))
    if tasks is not None:
        union = union.repartition(tasks, *book.LEVEL)
    upto = Window.partitionBy(*book.LEVEL).orderBy("ts_nanos").rangeBetween(Window.unboundedPreceding, 0)
    return union.withColumn("summed", F.sum("delta").over(upto)).filter("declared is not null").drop("delta").withColumn("matches", F.col("declared") == F.col("summed"))


def complete_updates(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates that end their transaction, the last one of a level and instant; and how many rows were mid-transaction or superseded, by symbol.

    event_flags 1 ends a transaction. What comes before it shows a level on its
    way, and of several transactions of one level within a nanosecond only the
    last is a state that the orders can be held against.
    """
    done = updates.withColumn("complete", F.col("event_flags").bitwiseAND(F.lit(1)) == 1)
    place = F.row_number().over(Window.partitionBy(*book.LEVEL, "ts_nanos", "complete").orderBy(F.desc("seq")))
    placed = done.withColumn("__place", place)
    skipped = placed.groupBy("symbol").agg(F.count_if(~F.col("complete")).alias("mid_transaction"), F.count_if(F.col("complete") & (F.col("__place") > 1)).alias("superseded"))
    return placed.filter("complete and __place = 1").drop("__place", "complete"), skipped


def replaced_level_sizes(updates: DataFrame) -> DataFrame:
    """Level sizes of a book that the level feed replaces level by level (size 0 removes)."""
    return last_of_instant(updates, book.LEVEL).withColumn("level_size", F.col("declared").cast("bigint"))


def bbo_check(quotes: DataFrame, points: DataFrame) -> DataFrame:
    """Quotes, the last one of a symbol and instant, with the protected prices of a book at their time, 0 where it has none, and whether all four numbers match.

    points: the book's change points, of best_points() with the lot asked for.
    """
    last = last_of_instant(quotes, ["trading_date", "symbol"])
    names = ["bid_price_raw", "bid_size", "ask_price_raw", "ask_size"]
    met = book.best_at(points, last)
    joined = met.select(*last.columns, *[F.coalesce(F.col(f"best.{n}"), F.lit(0)).alias(f"book_{n}") for n in names])
    matches = F.lit(True)
    for n in names:
        matches = matches & (F.coalesce(n, F.lit(0)) == F.col(f"book_{n}"))
    return joined.withColumn("matches", matches)


def match_report(checked: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    good = F.count_if("matches")
    return checked.groupBy(*keys).agg(n.alias("compared"), good.alias("matched"), (n - good).alias("mismatched"), (good / n).alias("match_rate"))


def split_report(checked: DataFrame, off_hours: Column, keys: list[str]) -> DataFrame:
    """match_report() with the part of it that fell outside regular hours, and the regular part's own rate (0 if there is none)."""
    n, good = F.count(F.lit(1)), F.count_if("matches")
    off, off_good = F.count_if(off_hours), F.count_if(off_hours & F.col("matches"))
    rate = lambda part, whole: F.when(whole == 0, 0.0).otherwise(part / whole)
    return checked.groupBy(*keys).agg(n.alias("compared"), good.alias("matched"), (n - good).alias("mismatched"), off.alias("off_compared"), off_good.alias("off_matched"), (off - off_good).alias("off_mismatched"), rate(good - off_good, n - off).alias("regular_rate"), rate(off_good, off).alias("off_rate"))


def worst_symbols(checked: DataFrame, n: int) -> DataFrame:
    """The n symbols with the most mismatches, ties by name: rank, symbol, matched, mismatched."""
    counts = checked.groupBy("symbol").agg(F.count_if("matches").alias("matched"), F.count_if(~F.col("matches")).alias("mismatched")).filter("mismatched > 0")
    top = counts.orderBy(F.desc("mismatched"), "symbol").limit(n)  # a top-n, so the window sees n rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mismatched"), "symbol")))


def reconcile_volumes(left: DataFrame, right: DataFrame) -> DataFrame:
    """symbol, left_volume, right_volume, verdict, difference of two feeds' shares by symbol."""
    both = left.groupBy("symbol").agg(F.sum(F.col("size").cast("bigint")).alias("left_volume")).join(right.groupBy("symbol").agg(F.sum(F.col("size").cast("bigint")).alias("right_volume")), "symbol", "full_outer")
    verdict = F.when(F.col("right_volume").isNull(), "only_left").when(F.col("left_volume").isNull(), "only_right").when(F.col("left_volume") == F.col("right_volume"), "matched").otherwise("mismatched")
    return both.select("symbol", "left_volume", "right_volume", verdict.alias("verdict"), F.abs(F.coalesce("left_volume", F.lit(0)) - F.coalesce("right_volume", F.lit(0))).alias("difference"))


def traded(*parts: DataFrame) -> DataFrame:
    """symbol and size of all that a feed says was traded: executions of orders and hidden trades, or trade reports."""
    rows = parts[0].select("symbol", "size")
    for part in parts[1:]:
        rows = rows.unionByName(part.select("symbol", "size"))
    return rows


def largest_differences(reconciled: DataFrame, n: int = 10) -> DataFrame:
    """Of reconcile_volumes(), the n symbols whose volumes differ most, ties by name, with their rank."""
    top = reconciled.filter("difference > 0").orderBy(F.desc("difference"), "symbol").limit(n)  # a top-n, so the window sees n rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("difference"), "symbol")))


def trace_levels(changes: DataFrame, symbol: str, around_ns: int, within_ns: int) -> DataFrame:
    """The level changes of a symbol around a time, each with its level's size after it; sizes count from the start of the day."""
    near = F.col("ts_nanos").between(around_ns - within_ns, around_ns + within_ns)
    own = changes.filter((F.col("symbol") == symbol) & (F.col("ts_nanos") <= around_ns + within_ns))
    upto = Window.partitionBy(*book.LEVEL).orderBy("ts_nanos", "seq", "delta").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("level_size", F.sum("delta").over(upto)).filter(near)


def triangle_verdict(level_rate, bbo_rate, other_bbo_rate):
    """Fixed limits: 0.9999 for levels, 0.99 for best prices."""
    missing = level_rate.isNull() | bbo_rate.isNull() | other_bbo_rate.isNull()
    return F.when(missing, "failed").when((level_rate < 0.9999) | (bbo_rate < 0.99) | (other_bbo_rate < 0.99), "below_threshold").otherwise("passed")


def trace(feeds: list[DataFrame], symbol: str, around_ns: int, within_ns: int) -> DataFrame:
    """Rows of several feeds (each with feed, feed_priority, symbol, ts_nanos, seq) of a symbol around a time, merged in order with their place."""
    union = feeds[0]
    for feed in feeds[1:]:
        union = union.unionByName(feed, allowMissingColumns=True)
    near = union.filter((F.col("symbol") == symbol) & F.col("ts_nanos").between(around_ns - within_ns, around_ns + within_ns))
    return near.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("ts_nanos", "feed_priority", "seq")))
