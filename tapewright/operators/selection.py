"""Nesting and selection of scored events.

Events have trading_date, symbol, ts_nanos, ts_end_nanos, scorer_id, score and
a distinct event_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patterns import first_rows


def event_key() -> Column:
    """An id that depends on what the event is, not on the run that found it."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ("trading_date", "symbol", "scorer_id", "ts_nanos", "ts_end_nanos", "n_rows", "total_shares")])


def _order() -> list:
    return [F.desc("score"), "ts_nanos", "event_id"]


def within_budget(events: DataFrame, share: float, least: int, most: int) -> DataFrame:
    """Of each day and scorer the best events: a share of them, at least and at most so many."""
    keys = ["trading_date", "scorer_id"]
    best = events.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order()))).filter(F.col("__rank") <= most)  # the window stops at most rows of a group
    counted = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    budget = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.lit(share) * F.col("__n"))))
    return best.join(counted, keys).filter(F.col("__rank") <= budget).select(*events.columns)


def nest(events: DataFrame, share: float = 0.05, least: int = 1, most: int = 30, mutual: bool = False) -> DataFrame:
    """events with subsumed_by: the best parent that holds the event's interval.

    Parents are the best events of each scorer. A parent claims events of its
    symbol and day, of other scorers, inside its interval; events without an
    end are never claimed. Two parents of the same interval would claim each
    other; unless mutual, only the better one claims.
    """
    parents = within_budget(events, share, least, most)
    p = parents.select(*[F.col(c).alias(f"p_{c}") for c in ("trading_date", "symbol", "scorer_id", "ts_nanos", "ts_end_nanos", "score", "event_id")])
    candidate = events.join(parents.select("event_id", F.lit(True).alias("is_parent")), "event_id", "left")
    inside = (
        (F.col("trading_date") == F.col("p_trading_date"))
        & (F.col("symbol") == F.col("p_symbol"))
        & (F.col("scorer_id") != F.col("p_scorer_id"))
        & (F.col("ts_nanos") >= F.col("p_ts_nanos"))
        & (F.col("ts_end_nanos") <= F.col("p_ts_end_nanos"))
    )
    claims = candidate.join(p, inside)
    if not mutual:
        same = (F.col("ts_nanos") == F.col("p_ts_nanos")) & (F.col("ts_end_nanos") == F.col("p_ts_end_nanos"))
        better = (F.col("score") > F.col("p_score")) | ((F.col("score") == F.col("p_score")) & (F.struct("scorer_id", "event_id") < F.struct("p_scorer_id", "p_event_id")))
        claims = claims.filter(~(same & better & F.coalesce("is_parent", F.lit(False))))
    best = claims.groupBy("event_id").agg(F.min_by("p_event_id", F.struct(-F.col("p_score"), "p_ts_nanos", "p_event_id")).alias("subsumed_by"))
    return events.join(best, "event_id", "left")


def children(nested: DataFrame) -> DataFrame:
    """What each parent holds, by the children's scorer."""
    held = nested.filter("subsumed_by is not null")
    return held.groupBy(F.col("subsumed_by").alias("parent_id"), "scorer_id").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_rows").alias("n_rows"), F.sum("total_shares").alias("total_shares"))


def children_sums(nested: DataFrame, columns: list[str]) -> DataFrame:
    """What each parent holds, by the children's scorer: their number and the sums of some columns, in which null counts 0."""
    held = nested.filter("subsumed_by is not null")
    return held.groupBy(F.col("subsumed_by").alias("parent_id"), "scorer_id").agg(F.count(F.lit(1)).alias("n_children"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def select_top(nested: DataFrame, share: float = 0.05, least: int = 3, most: int = 30, per_symbol: int = 8) -> DataFrame:
    """Events that stand for their day: not subsumed, within their scorer's budget, and at most so many of a symbol."""
    free = within_budget(nested.filter("subsumed_by is null"), share, least, most)
    kept = first_rows(free, ["trading_date", "symbol"], _order(), per_symbol)
    rank = F.row_number().over(Window.partitionBy("trading_date").orderBy(*_order())).cast("bigint")
    return kept.select("trading_date", "symbol", "ts_nanos", "ts_end_nanos", "scorer_id", "score", "event_id", rank.alias("narration_rank"))
