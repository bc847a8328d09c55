"""Order books as tables: level changes, level sizes, snapshots and best prices.

A book's state is the running sum of its level changes, so no operator replays
messages one by one. Windows run by order or by price level, never by symbol.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patterns import PIECE, asof_last, long_span_join

ORDER = ["trading_date", "symbol", "order_id"]
LEVEL = ["trading_date", "symbol", "side", "price_raw"]


def order_steps(adds: DataFrame, modifies: DataFrame, executed: DataFrame, deletes: DataFrame, clears: DataFrame | None = None) -> DataFrame:
    """All messages of all orders: op (add, modify, execute, delete, clear), size, price_raw and side, null where an op has none.

    A clear ends every order that its symbol has then; what comes later of such
    an order is left out. Clears are few, so they are met by their symbol and day.
    """
    row = lambda df, op, size="size", price="price_raw", side=F.lit(None): df.select("trading_date", "symbol", "order_id", "ts_nanos", "seq", F.lit(op).alias("op"), (F.col(size) if size else F.lit(None)).cast("bigint").alias("size"), (F.col(price) if price else F.lit(None)).cast("bigint").alias("price_raw"), side.cast("string").alias("side"))
    steps = row(adds, "add", side=F.col("side")).unionByName(row(modifies, "modify")).unionByName(row(executed, "execute", price=None)).unionByName(row(deletes, "delete", size=None, price=None))
    if clears is None:
        return steps
    c = clears.select("trading_date", "symbol", F.col("ts_nanos").alias("clear_ts"), F.col("seq").alias("clear_seq"))
    after = (F.col("clear_ts") > F.col("ts_nanos")) | ((F.col("clear_ts") == F.col("ts_nanos")) & (F.col("clear_seq") > F.col("seq")))
    ended = adds.join(c, ["trading_date", "symbol"]).filter(after).groupBy(*ORDER).agg(F.min(F.struct("clear_ts", "clear_seq")).alias("clear"))
    kept = steps.join(ended, ORDER, "left").filter(F.col("clear").isNull() | (F.struct("ts_nanos", "seq") < F.col("clear"))).drop("clear")
    synthetic = ended.select(*ORDER, F.col("clear.clear_ts").alias("ts_nanos"), F.col("clear.clear_seq").alias("seq"))
    return kept.unionByName(row(synthetic, "clear", size=None, price=None))


def _along_orders(part: pa.Table) -> list[pa.Array]:
    """What remaining() adds to rows of whole orders in order: side, base, px, rem, rem_before, px_before."""
    n, row = part.num_rows, np.arange(part.num_rows)
    starts = np.zeros(n, bool)
    starts[:1] = True
    for key in ORDER:
        codes = pc.dictionary_encode(part.column(key).combine_chunks()).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts[1:] |= codes[1:] != codes[:-1]
    begin = np.maximum.accumulate(np.where(starts, row, 0))
    order = np.cumsum(starts) - 1
    number = lambda name: pc.fill_null(part.column(name), 0).to_numpy()
    there = lambda name: part.column(name).is_valid().to_numpy()
    is_op = lambda *ops: pc.is_in(part.column("op"), pa.array(ops)).to_numpy()

    def last_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last of these rows in the order up to each row, and whether there is none."""
        at = np.maximum.accumulate(np.where(rows, row, -1))
        return np.maximum(at, 0), at < begin

    size, price, sets = number("size"), number("price_raw"), is_op("add", "modify")
    sized, unsized = last_of(sets & there("size"))
    priced, unpriced = last_of(sets & there("price_raw"))
    set_at, _ = last_of(sets)
    gone = np.cumsum(np.where(is_op("execute"), size, 0))  # over all rows: only differences inside an order are used
    ended = is_op("delete", "clear")
    rem = np.where(ended, 0, size[sized] - (gone - gone[set_at]))
    no_rem = unsized & ~ended
    before = np.maximum(row - 1, 0)
    sided, first = np.flatnonzero(there("side")), np.full(order[-1] + 1, -1)
    first[order[sided[::-1]]] = sided[::-1]
    side = part.column("side").combine_chunks().take(pa.array(first[order], mask=first[order] < 0))
    number_of = lambda values, missing: pa.array(values, pa.int64(), mask=missing)
    return [side, number_of(size[sized], unsized), number_of(price[priced], unpriced), number_of(rem, no_rem), number_of(rem[before], no_rem[before] | starts), number_of(price[priced][before], unpriced[before] | starts)]


def remaining(steps: DataFrame, tasks: int | None = None) -> DataFrame:
    """steps with the order's side, price and size left after each step (rem), and those before it.

    Orders have few messages each, so windows would cost most by their number:
    rows are sorted by order and many orders at a time are worked out as arrays.
    tasks: the number of partitions to sort in, by default the session's.
    """
    own = [c for c in steps.columns if c != "side"]
    added = ["side", "base", "px", "rem", "rem_before", "px_before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
            table = pa.table([*(part.column(c) for c in own), *_along_orders(part)], [*own, *added])
            yield from table.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part if kept is None else pa.concat_tables([kept, part])
            same = np.ones(part.num_rows, bool)
            for key in ORDER:
                codes = pc.dictionary_encode(part.column(key).combine_chunks()).indices.fill_null(-1).to_numpy(zero_copy_only=False)
                same &= codes == codes[-1]
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last order's other rows may be in the next batch
            kept = part.slice(last)
            if last:
                yield from done(part.slice(0, last))
        if kept is not None:
            yield from done(kept)

    kinds = ", ".join(f"`{c}` {steps.schema[c].dataType.simpleString()}" for c in own)
    # dealt by a value of its own: Spark leaves out a repartition by the keys of a join before it, and then may run that join otherwise
    dealt = steps.repartition(*[] if tasks is None else [tasks], F.xxhash64(*ORDER)).sortWithinPartitions(*ORDER, "ts_nanos", "seq")
    return dealt.mapInArrow(run, f"{kinds}, side string, base bigint, px bigint, rem bigint, rem_before bigint, px_before bigint")


def level_changes(rows: DataFrame) -> DataFrame:
    """trading_date, symbol, side, price_raw, ts_nanos, seq, delta from remaining()."""
    out = F.when(F.col("op") != "add", F.struct(F.col("px_before").alias("price_raw"), (-F.col("rem_before")).alias("delta")))
    into = F.when(~F.col("op").isin("delete", "clear"), F.struct(F.col("px").alias("price_raw"), F.col("rem").alias("delta")))
    changes = rows.select("trading_date", "symbol", "side", "ts_nanos", "seq", F.explode(F.filter(F.array(out, into), lambda c: c.isNotNull())).alias("c"))
    return changes.select("trading_date", "symbol", "side", F.col("c.price_raw").alias("price_raw"), "ts_nanos", "seq", F.col("c.delta").alias("delta")).filter("price_raw is not null and delta != 0")


def level_sizes(changes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Size of each level after each time at which it changes."""
    at = changes.repartition(*[] if tasks is None else [tasks], *LEVEL).groupBy(*LEVEL, "ts_nanos").agg(F.sum("delta").alias("delta"))  # dealt out once, by level, for the sums and for their window
    upto = Window.partitionBy(*LEVEL).orderBy("ts_nanos").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("level_size", F.sum("delta").over(upto))


def level_intervals(sizes: DataFrame, forever: int = 1 << 62) -> DataFrame:
    """Times [start, end) for which a level holds a size over 0."""
    nxt = F.lead("ts_nanos").over(Window.partitionBy(*LEVEL).orderBy("ts_nanos"))
    return sizes.select(*LEVEL, F.col("ts_nanos").alias("start"), F.coalesce(nxt, F.lit(forever)).alias("end"), "level_size").filter("level_size > 0")


def violations(steps: DataFrame) -> DataFrame:
    """Messages that no consistent book allows: trading_date, symbol, order_id, ts_nanos, seq, reason."""
    along = Window.partitionBy(*ORDER).orderBy("ts_nanos", "seq")
    rows = remaining(steps).withColumn("before", F.coalesce("rem_before", F.lit(0)))
    reason = (
        F.when((F.col("op") == "add") & (F.row_number().over(along) > 1) & (F.col("before") > 0), "duplicate add")
        .when((F.col("op") != "add") & F.col("rem_before").isNull(), F.concat(F.lit("unknown order: "), F.col("op")))
        .when((F.col("op") != "add") & (F.col("op") != "clear") & (F.col("before") <= 0), F.concat(F.lit("gone order: "), F.col("op")))
        .when((F.col("op") == "execute") & (F.col("size") > F.col("before")), "executed over its size")
    )
    return rows.withColumn("reason", reason).filter("reason is not null").select(*ORDER, "ts_nanos", "seq", "reason")


def priority_times(steps_with_flags: DataFrame) -> DataFrame:
    """Each step's time priority: that of the order's last add, or modify that doesn't keep it (keep false)."""
    upto = Window.partitionBy(*ORDER).orderBy("ts_nanos", "seq").rowsBetween(Window.unboundedPreceding, 0)
    resets = F.when((F.col("op") == "add") | ((F.col("op") == "modify") & ~F.coalesce("keep", F.lit(False))), F.col("ts_nanos"))
    return steps_with_flags.withColumn("priority_ts", F.last(resets, ignorenulls=True).over(upto))


def snapshot(intervals: DataFrame, requests: DataFrame, bucket: int) -> DataFrame:
    """The levels that the book of a request's symbol and day holds at its ts_nanos.

    Requests have trading_date, symbol, ts_nanos and what else tells them apart.
    Intervals are cut to the time between a symbol's first and last request of a
    day. One that lasts for very many buckets costs a few rows only, so give
    bucket about the length of usual intervals.
    """
    ends = requests.groupBy("trading_date", "symbol").agg(F.min("ts_nanos").alias("__from"), F.max("ts_nanos").alias("__to"))
    cut = intervals.join(ends, ["trading_date", "symbol"]).withColumns({"start": F.greatest("start", "__from"), "end": F.least(F.col("end"), F.col("__to") + 1)}).filter("start < end").drop("__from", "__to")
    return long_span_join(requests, cut, ["trading_date", "symbol"], "ts_nanos", "start", "end", bucket).drop("start", "end")


def negative_levels(changes: DataFrame) -> DataFrame:
    """Times at which a level's size falls below 0: no consistent book has any."""
    return level_sizes(changes).filter("level_size < 0").select(*LEVEL, "ts_nanos", "level_size")


def nth_level(levels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, side, price and size of the nth best level (from 1) of each side that has so many."""
    towards = Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "8", -F.col("price_raw")).otherwise(F.col("price_raw")))
    return levels.withColumn("__n", F.row_number().over(towards)).filter(F.col("__n") == n).select(*keys, "side", "price_raw", "level_size")


def size_at(levels: DataFrame, keys: list[str], price_raw: Column) -> DataFrame:
    """keys with the sizes of both sides at a price, 0 where a side has no such level."""
    here = F.col("price_raw") == price_raw
    of = lambda side: F.sum(F.when(here & (F.col("side") == side), F.col("level_size")).otherwise(0))
    return levels.groupBy(*keys).agg(of("8").alias("bid_size"), of("5").alias("ask_size"))


def round_lot(price_raw: Column) -> Column:
    """Shares of a round lot by price in dollars."""
    price = price_raw / 10_000.0
    return F.when(price <= 250, 100).when(price <= 1_000, 40).when(price <= 10_000, 10).otherwise(1)


def best_prices(levels: DataFrame, keys: list[str], min_size: int = 1) -> DataFrame:
    """keys with the best bid and ask of at least a size, the number of levels and the total size by side."""
    bid, ask = F.col("side") == "8", F.col("side") == "5"
    big = F.col("level_size") >= min_size
    bids, asks = F.when(bid & big, F.col("price_raw")), F.when(ask & big, F.col("price_raw"))
    return levels.groupBy(*keys).agg(
        F.max(bids).alias("bid_price_raw"), F.max_by(F.when(bid & big, F.col("level_size")), bids).alias("bid_size"),
        F.min(asks).alias("ask_price_raw"), F.min_by(F.when(ask & big, F.col("level_size")), asks).alias("ask_size"),
        F.count(F.when(bid, 1)).alias("bid_levels"), F.count(F.when(ask, 1)).alias("ask_levels"), F.sum(F.when(bid, F.col("level_size")).otherwise(0)).alias("bid_total"), F.sum(F.when(ask, F.col("level_size")).otherwise(0)).alias("ask_total"),
    )


def protected_prices(levels: DataFrame, keys: list[str], lot: Column | None = None) -> DataFrame:
    """keys with the protected bid and ask: the price at which the sizes from the best level on reach a round lot, and their sum.

    lot is by default that of the level's own price; 0 and 0 where none is reached.
    """
    lot = round_lot(F.col("price_raw")) if lot is None else lot
    towards = Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "8", -F.col("price_raw")).otherwise(F.col("price_raw"))).rowsBetween(Window.unboundedPreceding, 0)
    summed = levels.withColumn("upto", F.sum("level_size").over(towards)).withColumn("enough", F.col("upto") >= lot)
    bid, ask = (F.col("side") == "8") & F.col("enough"), (F.col("side") == "5") & F.col("enough")
    zero = F.lit(0).cast("bigint")
    return summed.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(bid, F.col("price_raw"))), zero).alias("bid_price_raw"), F.coalesce(F.max_by(F.when(bid, F.col("upto")), F.when(bid, F.col("price_raw"))), zero).alias("bid_size"),
        F.coalesce(F.min(F.when(ask, F.col("price_raw"))), zero).alias("ask_price_raw"), F.coalesce(F.min_by(F.when(ask, F.col("upto")), F.when(ask, F.col("price_raw"))), zero).alias("ask_size"),
    )


BEST = ["bid_price_raw", "bid_size", "ask_price_raw", "ask_size", "bid_levels", "ask_levels", "bid_total", "ask_total"]


class _Side:
    """The levels of one side, best first; sign is -1 for bids, whose best price is the highest."""

    def __init__(self, sign: int):
        self.sign, self.order, self.levels, self.total = sign, [], {}, 0

    def put(self, price: int, size: int, lot: int) -> None:
        key = self.sign * price
        old = self.levels.pop(key, None)
        self.total += max(size, 0) - (old[0] if old else 0)
        if size > 0:
            self.levels[key] = size, lot
            if old is None:
                insort(self.order, key)
        elif old is not None:
            del self.order[bisect_left(self.order, key)]

    def first(self) -> tuple[int, int]:
        """The price at which sizes from the best level on reach that level's lot, and their sum; zeros if they don't."""
        upto = 0
        for key in self.order:
            size, lot = self.levels[key]
            upto += size
            if upto >= lot:
                return self.sign * key, upto
        return 0, 0


def best_points(sizes: DataFrame, lot: Column | None = None, piece: int = PIECE) -> DataFrame:
    """trading_date, symbol, ts_nanos, seq and best: the times at which a book's best prices, levels or totals change.

    One pass over level sizes in pieces of time: each piece of a symbol begins
    with the levels that it takes over, so a busy symbol is spread over its
    pieces and a task holds one book at a time. The prices of best are those at
    which sizes from the best level on reach lot, that of the level's own price
    by default, 0 where none is reached; lot 1 gives the plain best prices.
    """
    book_key = ["trading_date", "symbol"]
    lot = (round_lot(F.col("price_raw")) if lot is None else lot).cast("bigint")
    rows = sizes.select(*LEVEL, "ts_nanos", "level_size", F.floor(F.col("ts_nanos") / piece).alias("piece"))
    ends = rows.groupBy(*LEVEL, "piece").agg(F.max_by("level_size", "ts_nanos").alias("level_size"))
    following = F.lead("piece").over(Window.partitionBy(*LEVEL).orderBy("piece"))
    last = ends.groupBy(*book_key).agg(F.max("piece").alias("last"))
    kept = ends.withColumn("until", following).filter("level_size > 0").join(last, book_key).withColumn("until", F.coalesce("until", "last")).filter("piece < until")
    carried = kept.select(*LEVEL, F.lit(None).cast("bigint").alias("ts_nanos"), "level_size", F.explode(F.sequence(F.col("piece") + 1, F.col("until"))).alias("piece"))
    both = rows.unionByName(carried).select(*book_key, "piece", "ts_nanos", "side", "price_raw", "level_size", lot.alias("lot"))
    dealt = both.repartition(*book_key, "piece").sortWithinPartitions(*book_key, "piece", F.asc_nulls_first("ts_nanos"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, told, sides = None, None, None, {}
        out: list[tuple] = []

        def settle() -> None:
            nonlocal told
            if now is None:
                return
            bid, ask = sides["8"], sides["5"]
            state = *bid.first(), *ask.first(), len(bid.order), len(ask.order), bid.total, ask.total
            if state != told:
                out.append((*key[:2], now, *state))
                told = state

        for batch in batches:
            for day, symbol, piece_no, ts, side, price, size, own_lot in zip(*(c.to_pylist() for c in batch.columns)):
                if (day, symbol, piece_no) != key:
                    settle()
                    key, now, told, sides = (day, symbol, piece_no), None, None, {"8": _Side(-1), "5": _Side(1)}
                elif ts != now:
                    settle()
                now = ts
                sides[side].put(price, size, own_lot)
            yield _points(out)
            out = []
        settle()
        yield _points(out)

    def _points(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 11
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.date32()), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["trading_date", "symbol", "ts_nanos", *BEST])

    found = dealt.mapInArrow(sweep, "trading_date date, symbol string, ts_nanos bigint, " + ", ".join(f"{n} bigint" for n in BEST))
    return found.select(*book_key, "ts_nanos", F.lit(0).cast("bigint").alias("seq"), F.struct(*BEST).alias("best"))


def best_at(points: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (trading_date, symbol, ts_nanos, ...) with best as of their time, null before a book's first change."""
    return asof_last(points, requests, ["trading_date", "symbol"], "best")


def coverage(messages: DataFrame, feed_end: DataFrame | None = None) -> DataFrame:
    """trading_date, symbol, seen (time of a symbol's first message) and ended (time of the day's last one); feed_end: trading_date and ended of a feed whose end is known otherwise."""
    seen = messages.groupBy("trading_date", "symbol").agg(F.min("ts_nanos").alias("seen"))
    return seen.join(messages.groupBy("trading_date").agg(F.max("ts_nanos").alias("ended")) if feed_end is None else feed_end, "trading_date")


def book_states(points: DataFrame, covered: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with state and best: missing if the feed ended before it or hadn't seen its symbol, else empty or present.

    Coverage has a row for each symbol and day, so it is met by those, and the
    book by its change points: no request lists a book's levels.
    """
    met = best_at(points, requests).join(covered, ["trading_date", "symbol"], "left")
    there = (F.col("seen") <= F.col("ts_nanos")) & (F.col("ts_nanos") <= F.col("ended"))
    levels = F.coalesce(F.col("best.bid_levels") + F.col("best.ask_levels"), F.lit(0))
    state = F.when(~F.coalesce(there, F.lit(False)), "missing").when(levels == 0, "empty").otherwise("present")
    return met.withColumn("state", state).withColumn("best", F.when(F.col("state") == "present", F.col("best"))).drop("seen", "ended")
