"""Order lifecycles and daily baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .patterns import day_rows, feed_rows

KEY = ["trading_date", "order_id"]


def last_execution(executed: DataFrame) -> DataFrame:
    return executed.groupBy(*KEY).agg(F.max("ts_nanos").alias("execute_ts_nanos"))


def order_lifecycle(adds: DataFrame, deletes: DataFrame, executed: DataFrame) -> DataFrame:
    """One row for each order added in a day. Deleted comes before executed, executed before open.

    Both joins have the same keys, so the orders are shuffled once for them;
    executions are aggregated first. Modifies don't change the size or price added.
    """
    gone = deletes.groupBy(*KEY).agg(F.max("ts_nanos").alias("delete_ts_nanos"))
    joined = adds.join(gone, KEY, "left").join(last_execution(executed), KEY, "left")
    state = F.when(F.col("delete_ts_nanos").isNotNull(), "deleted").when(F.col("execute_ts_nanos").isNotNull(), "executed").otherwise("open")
    return joined.select(
        "trading_date", "symbol", "order_id", "side", F.col("ts_nanos").alias("add_ts_nanos"), F.col("price_raw").alias("add_price_raw"), F.col("size").alias("add_size"),
        "delete_ts_nanos", "execute_ts_nanos", state.alias("terminal_state"), (F.coalesce("delete_ts_nanos", "execute_ts_nanos") - F.col("ts_nanos")).alias("lifetime_ns"), "feed_source",
    )


def short_lived(lifecycle: DataFrame, most_ns: int = 50_000_000) -> DataFrame:
    return lifecycle.filter((F.col("terminal_state") == "deleted") & (F.col("lifetime_ns") > 0) & (F.col("lifetime_ns") <= most_ns))


def with_resting_side(executed: DataFrame, lifecycle: DataFrame) -> DataFrame:
    return executed.join(lifecycle.select(*KEY, F.col("side").alias("resting_side")), KEY)


def refresh_day(trades: DataFrame, path: str, day: str, feed: str | None = None) -> None:
    """Writes one day of the daily volumes at path anew and leaves the other days."""
    daily_volume(feed_rows(day_rows(trades, day), feed)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def daily_volume(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.col("trading_date").alias("day"), "symbol").agg(
        F.sum(F.col("size").cast("bigint")).alias("total_volume"), F.count(F.lit(1)).alias("trade_count"),
        F.round(F.avg("price_raw")).cast("bigint").alias("avg_price_raw"), F.min("price_raw").alias("min_price_raw"), F.max("price_raw").alias("max_price_raw"),
    )


def daily_lifetime(lifecycle: DataFrame) -> DataFrame:
    ended = lifecycle.filter("terminal_state != 'open'")
    return ended.groupBy(F.col("trading_date").alias("day"), "symbol").agg(F.round(F.avg("lifetime_ns")).cast("bigint").alias("avg_lifetime_ns"), F.count(F.lit(1)).alias("order_count"))


def trailing(daily: DataFrame, value: str, days: int = 14) -> DataFrame:
    """daily with n_days, median and values (by day) of the calendar days [day - days, day) of the same symbol."""
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("symbol").orderBy("__n").rangeBetween(-days, -1)
    return daily.withColumn("__n", number).withColumns({
        "values": F.transform(F.sort_array(F.collect_list(F.struct("__n", F.col(value).cast("double").alias("v"))).over(before)), lambda s: s["v"]),
        "n_days": F.count(F.lit(1)).over(before),
    }).drop("__n")


def baseline_rows(daily: DataFrame, rows: int = 30) -> DataFrame:
    """Averages over a symbol's last rows before each day."""
    before = Window.partitionBy("symbol").orderBy("day").rowsBetween(-rows, -1)
    return daily.select("day", "symbol", F.avg("total_volume").over(before).alias("avg_volume"), F.avg("trade_count").over(before).alias("avg_trades"), F.count(F.lit(1)).over(before).alias("n_days"))
