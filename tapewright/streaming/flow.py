"""Order flow as streams: rows put back in order, gap clusters and books as keyed state.

A stream's rows may come late by a delay. Each key's rows wait in state until
the watermark has passed them, and then go on in the order of time and arrival:
a batch run in any order of its rows gives what a sorted run gives. What is
done with rows in order is up to a subclass: pass them on, add them to the open
cluster, or apply them to the orders of a book. Rows that come later than the
delay are left out by the watermark and counted in the query's progress.

State is kept in RocksDB, so a micro-batch reads and writes the entries that
its rows touch. Each access to state is a call from Python to the JVM, so rows
wait as parts of up to HOLD rows in pieces of time, and open orders as small
groups: calls grow with pieces and groups, not with rows. Only one piece of a
key's rows is in memory at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions import fmt

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Streams of this module need a state store with column families; those begun before keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def with_event_time(stream: DataFrame, delay: str = "1 second") -> DataFrame:
    """A stream with an event time from ts_nanos, whose rows may come late by the delay."""
    return stream.withColumn("ts", fmt.instant(F.col("ts_nanos"))).withWatermark("ts", delay)


def late_rows(query: StreamingQuery) -> int:
    """Rows of a query that came later than the delay, by the progress that it still remembers."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])


def gap_cluster_counts(stream: DataFrame, keys: list[str], max_gap_ns: int) -> DataFrame:
    """keys, start, end, n of runs whose neighbours are at most max_gap apart, to the microsecond. A run is given once it is over."""
    gap = f"{max_gap_ns // 1000 + 1} microseconds"
    window = F.session_window("ts", gap)
    return stream.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_nanos").alias("ts_nanos"), F.max("ts_nanos").alias("ts_end_nanos")).drop("w")


#: Rows of a key in memory before they are put into state; they wait in pieces of so many nanoseconds.
HOLD = 100_000
WAIT_PIECE = 3_600_000_000_000


class InOrder(StatefulProcessor):
    """Gives each key's rows to released() in the order of ts_nanos and seq, once the watermark has passed them.

    Rows wait as parts (their least time and a number -> their values), each of one piece of time.
    """

    def __init__(self, schema: StructType, hold: int = HOLD, piece: int = WAIT_PIECE):
        self.schema, self.hold, self.piece = schema, hold, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "least bigint, part bigint", "rows binary")
        self.row, self.at = Row(*self.schema.names), self.schema.names.index("ts_nanos")

    def released(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        """What a subclass makes of rows that have come into their place; called piece by piece."""
        raise NotImplementedError

    def finished(self, key: tuple) -> None:
        """Called after the last released() of a key's turn."""

    def passed(self, key: tuple, micros: int) -> Iterator[Row]:
        """What a subclass makes of the fact that no row up to a time will come any more."""
        return iter(())

    def next_time(self) -> int | None:
        """A time in nanoseconds at which a subclass wants to hear of the watermark."""
        return None

    def _put(self, pieces: dict[int, list[tuple]], parts: dict[int, list[tuple]]) -> None:
        """Adds rows, by piece, to the parts that wait, and to parts: piece -> keys of its parts."""
        for piece, rows in pieces.items():
            entry = min(r[self.at] for r in rows), 1 + max((n for _, n in parts.get(piece, ())), default=0)
            self.waiting.updateValue(entry, (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),))
            parts.setdefault(piece, []).append(entry)
        pieces.clear()

    def _go_on(self, key: tuple, rows: Iterator[Row], watermark_ms: int) -> Iterator[Row]:
        micros = watermark_ms * 1000
        parts, fresh, n = {}, {}, 0
        for least, number in self.waiting.keys() if self.waiting.exists() else ():
            parts.setdefault(least // self.piece, []).append((least, number))
        for row in rows:
            fresh.setdefault(row[self.at] // self.piece, []).append(tuple(row))
            n += 1
            if n == self.hold:
                self._put(fresh, parts)
                n = 0
        for piece in sorted({*parts, *fresh}):
            if piece * self.piece // 1000 > micros:
                break
            ready, rest = [], []
            entries = [e for e in parts.get(piece, ()) if e[0] // 1000 <= micros]
            for values in [*(v for e in entries for v in pickle.loads(self.waiting.getValue(e)[0])), *fresh.pop(piece, ())]:
                (ready if values[self.at] // 1000 <= micros else rest).append(values)
            for entry in entries:
                self.waiting.removeKey(entry)
            if left := [e for e in parts.pop(piece, ()) if e[0] // 1000 > micros]:
                parts[piece] = left
            if rest:
                self._put({piece: rest}, parts)
            if ready:
                yield from self.released(key, sorted((self.row(*values) for values in ready), key=lambda r: (r.ts_nanos, r.seq)))
        self.finished(key)
        yield from self.passed(key, micros)
        self._put(fresh, parts)
        times = [t for t in (min((least for keys in parts.values() for least, _ in keys), default=None), self.next_time()) if t is not None]
        due = max(watermark_ms + 1, -(-min(times) // 1_000_000)) if times else None
        set_ = False
        for (timer,) in ((t,) if isinstance(t, int) else t for t in list(self.handle.listTimers())):
            if timer == due:
                set_ = True
            else:
                self.handle.deleteTimer(timer)
        if due is not None and not set_:
            self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._go_on(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._go_on(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, keys: list[str], processor: InOrder, result: str) -> DataFrame:
    use_state_store(stream.sparkSession)
    return stream.groupBy(*keys).transformWithState(processor, result, "Append", "EventTime")


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


class _Pass(InOrder):
    """Passes rows on with their place among those of their key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n bigint")

    def released(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        place, told = self.count.get()[0] if self.count.exists() else 0, Row(*self.schema.names, "place")
        for row in rows:
            place += 1
            yield told(*row, place)
        self.count.update((place,))


def in_order(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a stream with event time (ts_nanos, seq, ts) with place: their number, from 1, in the order of ts_nanos and seq within their keys."""
    rows = stream.select([c for c in stream.columns])
    return _keyed(rows, keys, _Pass(rows.schema), f"{_kinds(rows, rows.columns)}, place bigint")


class _Clusters(InOrder):
    """Holds a key's open cluster: its first and last time, rows and sum."""

    def __init__(self, schema: StructType, keys: list[str], max_gap: int, cap: int, value: str | None):
        super().__init__(schema)
        self.keys, self.max_gap, self.cap, self.value = keys, max_gap, cap, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "first bigint, last bigint, n bigint, total bigint")

    def _told(self, key: tuple, cluster: list[int]) -> Row:
        return Row(*self.keys, "ts_nanos", "ts_end_nanos", "n", "total")(*key, *cluster)

    def released(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        cluster = list(self.open.get()) if self.open.exists() else None
        for row in rows:
            if cluster and (row.ts_nanos - cluster[1] > self.max_gap or cluster[2] == self.cap):
                yield self._told(key, cluster)
                cluster = None
            size = (row[self.value] or 0) if self.value else 0
            cluster = [cluster[0], row.ts_nanos, cluster[2] + 1, cluster[3] + size] if cluster else [row.ts_nanos, row.ts_nanos, 1, size]
        self.open.update(tuple(cluster))

    def passed(self, key: tuple, micros: int) -> Iterator[Row]:
        if self.open.exists():
            cluster = self.open.get()
            if (cluster[1] + self.max_gap) // 1000 <= micros - 1:
                self.open.clear()
                yield self._told(key, list(cluster))

    def next_time(self) -> int | None:
        return self.open.get()[1] + self.max_gap + 2_000 if self.open.exists() else None


def gap_cluster_rows(stream: DataFrame, keys: list[str], max_gap: int, cap: int = 10_000, value: str | None = None) -> DataFrame:
    """keys, ts_nanos, ts_end_nanos, n and total (of value) of clusters as gap_clusters() makes them, to the nanosecond and cut after cap rows.

    A cluster is given once a later row ends it, or the watermark has passed the
    time at which a row could still join it.
    """
    rows = stream.select(*dict.fromkeys([*keys, "ts_nanos", "seq", "ts", *([value] if value else [])]))
    return _keyed(rows, keys, _Clusters(rows.schema, keys, max_gap, cap, value), f"{_kinds(rows, keys)}, ts_nanos bigint, ts_end_nanos bigint, n bigint, total bigint")


CHANGES = "symbol string, side string, price_raw bigint, ts_nanos bigint, seq bigint, delta bigint"


def _apply(orders, row) -> Iterator[tuple]:
    """Level changes of one message; orders: id -> [side, price, size left]."""
    key = row.order_id
    if row.op == "clear":
        for side, price, size in list(orders.values()):
            yield side, price, -size
        orders.clear()
        return
    old = orders.get(key)
    if row.op == "add":
        orders[key] = [row.side, row.price_raw, row.size]
        yield row.side, row.price_raw, row.size
    elif old is not None:
        side, price, size = old
        yield side, price, -size
        if row.op == "modify":
            orders[key] = [side, row.price_raw, row.size]
            yield side, row.price_raw, row.size
        elif row.op == "execute" and size > row.size:
            orders[key] = [side, price, size - row.size]
            yield side, price, size - row.size
        else:
            del orders[key]


#: Groups of a part's open orders; each is one entry of state.
GROUPS = 64


class _Orders:
    """Open orders (id -> order) in a map state of groups of ids. A turn reads and writes the groups of its messages' orders, each once."""

    def __init__(self, state):
        self.state, self.groups, self.changed, self.stored = state, {}, set(), set()

    def _group(self, key: int) -> tuple[int, dict]:
        no = ((key or 0) * 0x9E3779B97F4A7C15 >> 32) % GROUPS
        if no not in self.groups:
            found = self.state.getValue((no,))
            self.groups[no] = pickle.loads(found[0]) if found else {}
            if found:
                self.stored.add(no)
        return no, self.groups[no]

    def get(self, key: int) -> list | None:
        return self._group(key)[1].get(key)

    def __setitem__(self, key: int, order: list) -> None:
        no, group = self._group(key)
        group[key] = order
        self.changed.add(no)

    def __delitem__(self, key: int) -> None:
        no, group = self._group(key)
        del group[key]
        self.changed.add(no)

    def values(self) -> Iterator[list]:
        self.write()
        return (order for (group,) in self.state.values() for order in pickle.loads(group).values())

    def clear(self) -> None:
        self.state.clear()
        for known in (self.groups, self.changed, self.stored):
            known.clear()

    def write(self) -> None:
        """Puts changed groups into state."""
        for no in sorted(self.changed):
            if self.groups[no]:
                self.state.updateValue((no,), (pickle.dumps(self.groups[no], pickle.HIGHEST_PROTOCOL),))
                self.stored.add(no)
            elif no in self.stored:
                self.state.removeKey((no,))
                self.stored.remove(no)
        self.changed.clear()


#: Parts of a symbol's orders that have a state of their own; an order's changes depend on that order alone.
PARTS = 64


class _Book(InOrder):
    """Holds the open orders of one part of a symbol."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("orders", "group_no bigint", "orders binary")
        self.orders = None

    def finished(self, key: tuple) -> None:
        if self.orders:
            self.orders.write()
        self.orders = None

    def released(self, key: tuple, rows: list[Row]) -> Iterator[Row]:
        self.orders = orders = self.orders or _Orders(self.open)
        told = Row("symbol", "side", "price_raw", "ts_nanos", "seq", "delta")
        for row in rows:
            for side, price, delta in _apply(orders, row):
                if delta:
                    yield told(key[0], side, price, row.ts_nanos, row.seq, delta)


def book_changes(stream: DataFrame, parts: int = PARTS) -> DataFrame:
    """Level changes of a stream of messages (symbol, op, order_id, side, price_raw, size, ts_nanos, seq, and the event time ts).

    One state for each symbol and part of its orders, with an entry for each
    open order. So a busy symbol is spread over many states, a message costs the
    entry of its order, and a level's size is the sum of the changes of all
    parts. A clear has a row for each part (part from 0 on) or for each order.
    """
    part = F.pmod(F.xxhash64("order_id"), F.lit(parts))
    part = F.coalesce(F.col("part").cast("bigint"), part) if "part" in stream.columns else part
    rows = stream.select("symbol", part.alias("part_no"), "op", F.col("order_id").cast("bigint").alias("order_id"), "side", F.col("price_raw").cast("bigint").alias("price_raw"), F.col("size").cast("bigint").alias("size"), "ts_nanos", "seq", "ts")
    return _keyed(rows, ["symbol", "part_no"], _Book(rows.schema), CHANGES)
