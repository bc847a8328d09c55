"""Packets of fixed-width little-endian messages: splitting, decoding, packing.

Packets are independent, so Spark deals them out; a batch of packets is walked
in step, the nth messages of all of them together, and all messages of a type
are read at once as an array of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES = 40

# Fields of the packet header, as (name, offset, width), after version and reserved.
HEADER = [("protocol_id", 2, 2), ("channel_id", 4, 4), ("session_id", 8, 4), ("payload_length", 12, 2), ("message_count", 14, 2), ("stream_offset", 16, 8), ("first_sequence", 24, 8), ("send_ts_nanos", 32, 8)]

# Fields of each message type, as (name, offset, width, kind). Kinds: u1 unsigned byte, c1 character,
# i4 and i8 signed, u4 unsigned, s8 and s4 text padded with spaces.
_HEAD = [("ts_nanos", 2, 8, "i8"), ("symbol", 10, 8, "s8")]
LAYOUTS: dict[str, tuple[str, int, list[tuple[str, int, int, str]]]] = {
    # order feed
    "orders_add": ("a", 38, [("side", 1, 1, "c1"), *_HEAD, ("order_id", 18, 8, "i8"), ("size", 26, 4, "i4"), ("price_raw", 30, 8, "i8")]),
    "orders_modify": ("M", 38, [("modify_flags", 1, 1, "u1"), *_HEAD, ("order_id", 18, 8, "i8"), ("size", 26, 4, "i4"), ("price_raw", 30, 8, "i8")]),
    "orders_delete": ("R", 26, [*_HEAD, ("order_id", 18, 8, "i8")]),
    "orders_executed": ("L", 46, [("sale_condition_flags", 1, 1, "u1"), *_HEAD, ("order_id", 18, 8, "i8"), ("size", 26, 4, "i4"), ("price_raw", 30, 8, "i8"), ("trade_id", 38, 8, "i8")]),
    "trades": ("T", 38, [("sale_condition_flags", 1, 1, "u1"), *_HEAD, ("size", 18, 4, "i4"), ("price_raw", 22, 8, "i8"), ("trade_id", 30, 8, "i8")]),
    "trade_breaks": ("B", 38, [("sale_condition_flags", 1, 1, "u1"), *_HEAD, ("size", 18, 4, "i4"), ("price_raw", 22, 8, "i8"), ("broken_trade_id", 30, 8, "i8")]),
    "clear_books": ("C", 18, _HEAD),
    # administration
    "system_events": ("S", 10, [("sub_type", 1, 1, "c1"), ("ts_nanos", 2, 8, "i8")]),
    "securities": ("D", 31, [("flags", 1, 1, "u1"), *_HEAD, ("round_lot_size", 18, 4, "i4"), ("adjusted_poc_price_raw", 22, 8, "i8"), ("luld_tier", 30, 1, "u1")]),
    "trading_status": ("H", 22, [("sub_type", 1, 1, "c1"), *_HEAD, ("reason", 18, 4, "s4")]),
    "retail_liquidity": ("I", 18, [("indicator", 1, 1, "c1"), *_HEAD]),
    "operational_halts": ("O", 18, [("sub_type", 1, 1, "c1"), *_HEAD]),
    "short_sale": ("P", 19, [("sub_type", 1, 1, "u1"), *_HEAD, ("detail", 18, 1, "c1")]),
    "security_events": ("E", 18, [("sub_type", 1, 1, "c1"), *_HEAD]),
    # quote feed
    "quotes": ("Q", 42, [("flags", 1, 1, "u1"), *_HEAD, ("bid_size", 18, 4, "i4"), ("bid_price_raw", 22, 8, "i8"), ("ask_price_raw", 30, 8, "i8"), ("ask_size", 38, 4, "i4")]),
    "official_prices": ("X", 26, [("price_type", 1, 1, "c1"), *_HEAD, ("price_raw", 18, 8, "i8")]),
    "auction_info": ("A", 80, [("auction_type", 1, 1, "c1"), *_HEAD, ("paired_shares", 18, 4, "i4"), ("reference_price_raw", 22, 8, "i8"), ("indicative_clearing_price_raw", 30, 8, "i8"), ("imbalance_shares", 38, 4, "i4"), ("imbalance_side", 42, 1, "c1"), ("extension_number", 43, 1, "u1"), ("scheduled_auction_time_seconds", 44, 4, "u4"), ("auction_book_clearing_price_raw", 48, 8, "i8"), ("collar_reference_price_raw", 56, 8, "i8"), ("lower_collar_raw", 64, 8, "i8"), ("upper_collar_raw", 72, 8, "i8")]),
    # level feed; sides are message types of their own
    "level_updates_buy": ("8", 30, [("event_flags", 1, 1, "u1"), *_HEAD, ("size", 18, 4, "i4"), ("price_raw", 22, 8, "i8")]),
    "level_updates_sell": ("5", 30, [("event_flags", 1, 1, "u1"), *_HEAD, ("size", 18, 4, "i4"), ("price_raw", 22, 8, "i8")]),
}
#: Which status kind each administrative message becomes.
STATUS_KINDS = {"system_events": "S", "trading_status": "H", "operational_halts": "O", "short_sale": "P", "security_events": "E"}


#: Of each kind: how it lies in a message, and as what it is given.
_FORMS = {"u1": ("u1", "smallint"), "i4": ("<i4", "int"), "u4": ("<u4", "bigint"), "i8": ("<i8", "bigint"), "c1": ("S1", "string"), "s4": ("S4", "string"), "s8": ("S8", "string")}
_ARROW = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
_HEADER = np.dtype({"names": [n for n, _, _ in HEADER], "formats": [f"<u{w}" for _, _, w in HEADER], "offsets": [at for _, at, _ in HEADER], "itemsize": HEADER_BYTES})
#: Packets that are walked in step.
PACKETS = 4096


def _record(table: str) -> np.dtype:
    _, length, fields = LAYOUTS[table]
    return np.dtype({"names": [n for n, *_ in fields], "formats": [_FORMS[k][0] for *_, k in fields], "offsets": [at for _, at, _, _ in fields], "itemsize": length})


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where its values begin and end in them; a null has none."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Pieces of data as a binary column."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i4").tobytes()), pa.py_buffer(data[at].tobytes())])


def _text(values: np.ndarray) -> np.ndarray:
    return np.char.decode(np.char.rstrip(values, b" "), "ascii", "replace")


def _column(records: np.ndarray, name: str, kind: str, given: str) -> pa.Array:
    values = records[name]
    if kind[0] in "sc":
        return pa.array(_text(values) if kind[0] == "s" else np.char.decode(values, "ascii", "replace"), pa.string())
    return pa.array(values.astype(str) if given == "string" else values.astype(_ARROW[given].to_pandas_dtype()), _ARROW[given])


def _walk(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, str]]]:
    """Of a column of packets: its bytes, the packets' send times; of each message its packet, number, start and size; and (packet, number, reason) of what is malformed.

    Packets without a whole header, or whose header declares no messages or no
    length, have none. A length of 0, or beyond the payload, ends a packet.
    """
    data, offsets = _raw(column)
    begin, end = offsets[:-1], offsets[1:]
    headed = np.flatnonzero(end - begin >= HEADER_BYTES)
    bad = [(int(p), 0, "shorter than a header") for p in np.flatnonzero(end - begin < HEADER_BYTES)]
    header = np.ascontiguousarray(data[begin[headed, None] + np.arange(HEADER_BYTES)]).view(_HEADER).ravel() if len(headed) else np.zeros(0, _HEADER)
    sent, counts = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    sent[headed] = header["send_ts_nanos"].astype(np.int64)
    counts[headed] = np.where(header["payload_length"] > 0, header["message_count"], 0)
    live, n, found = np.flatnonzero(counts > 0), 0, []
    at = begin[live] + HEADER_BYTES
    while len(live):
        early = at + 2 > end[live]
        size = np.zeros(len(live), np.int64)
        there = at[~early]
        size[~early] = data[there].astype(np.int64) | data[there + 1].astype(np.int64) << 8
        none = ~early & (size == 0)
        beyond = ~early & (at + 2 + size > end[live])
        for wrong, reason in ((early, "payload ends early"), (none, "message length of 0"), (beyond & ~none, "message beyond payload")):
            bad += [(int(p), n, reason) for p in live[wrong]]
        good = ~(early | none | beyond)
        found.append((live[good], np.full(int(good.sum()), n), at[good] + 2, size[good]))
        n += 1
        on = good & (counts[live] > n)
        live, at = live[on], (at + 2 + size)[on]
    packet, number, start, size = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    order = np.lexsort((number, packet))
    return data, sent, packet[order], number[order], start[order], size[order], bad


def _in_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PACKETS):
            yield batch.slice(start, PACKETS)


def split_messages(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets (capture_id, packet_no, payload) to messages (capture_id, packet_no, msg_idx, send_ts_nanos, msg_type, msg), and to what is malformed (reason)."""
    names = ["capture_id", "packet_no", "msg_idx", "send_ts_nanos", "msg", "bad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_step(batches):
            data, sent, packet, number, start, size, bad = _walk(batch.column(2))
            whole = [batch.column(0).take(pa.array(packet)), batch.column(1).take(pa.array(packet)), pa.array(number, pa.int32()), pa.array(sent[packet]), _gather(data, start, size), pa.nulls(len(packet), pa.string())]
            yield pa.RecordBatch.from_arrays(whole, names)
            at = pa.array([p for p, *_ in bad], pa.int64())
            odd = [batch.column(0).take(at), batch.column(1).take(at), pa.array([n for _, n, _ in bad], pa.int32()), pa.nulls(len(bad), pa.int64()), pa.nulls(len(bad), pa.binary()), pa.array([r for *_, r in bad], pa.string())]
            yield pa.RecordBatch.from_arrays(odd, names)

    walked = packets.select(F.col("capture_id").cast("string").alias("capture_id"), F.col("packet_no").cast("bigint").alias("packet_no"), "payload").mapInArrow(run, "capture_id string, packet_no bigint, msg_idx int, send_ts_nanos bigint, msg binary, bad string")
    messages = walked.filter("bad is null").select("capture_id", "packet_no", "msg_idx", "send_ts_nanos", F.decode(F.substring("msg", 1, 1), "ISO-8859-1").alias("msg_type"), "msg")
    return messages, walked.filter("bad is not null").select("capture_id", "packet_no", F.col("bad").alias("reason"))


def decode(messages: DataFrame, table: str) -> DataFrame:
    """One table's rows of split messages, with capture order; messages that are too short are left out (see malformed)."""
    kind, length, fields = LAYOUTS[table]
    record, names = _record(table), ["capture_id", "packet_no", "msg_idx", *(n for n, *_ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _raw(batch.column(3))
            rows = np.ascontiguousarray(data[offsets[:-1, None] + np.arange(length)]).view(record).ravel() if batch.num_rows else np.zeros(0, record)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(_column(rows, n, k, _FORMS[k][1]) for n, _, _, k in fields)], names)

    own = messages.filter((F.col("msg_type") == kind) & (F.length("msg") >= length))
    return own.select("capture_id", "packet_no", "msg_idx", "msg").mapInArrow(run, "capture_id string, packet_no bigint, msg_idx int, " + ", ".join(f"{n} {_FORMS[k][1]}" for n, _, _, k in fields))


#: Fields that decode_packets() calls otherwise, as its own columns have their names.
NAMED = {"reason": "halt_reason"}


def fields_of(tables: list[str]) -> dict[str, str]:
    """The fields of tables with their types; one that is a number in one table and text in another is text."""
    out: dict[str, str] = {}
    for table in tables:
        for name, _, _, kind in LAYOUTS[table][2]:
            given, name = _FORMS[kind][1], NAMED.get(name, name)
            out[name] = given if out.get(name, given) == given else "string"
    return out


def decode_packets(packets: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """All messages of packets in one pass: capture_id, packet_no, msg_idx, send_ts_nanos, msg_type, table, reason, and the fields of all tables, null where a table has none.

    What is malformed, of a type that no table has, or shorter than its type, has
    a reason and no table.
    """
    tables = list(LAYOUTS) if tables is None else tables
    given = fields_of(tables)
    names = ["capture_id", "packet_no", "msg_idx", "send_ts_nanos", "msg_type", "table", "reason", *given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_step(batches):
            data, sent, packet, number, start, size, bad = _walk(batch.column(2))
            types = data[start] if len(start) else np.zeros(0, np.uint8)

            def made(packets_, numbers, kinds, table, reason, columns):
                n, at = len(packets_), pa.array(packets_, pa.int64())
                row = [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(sent[packets_]), kinds, pa.array([table] * n, pa.string()), pa.array(reason if isinstance(reason, list) else [reason] * n, pa.string())]
                return pa.RecordBatch.from_arrays([*row, *(columns.get(c, pa.nulls(n, _ARROW[k])) for c, k in given.items())], names)

            char = lambda codes: pa.array([chr(c) for c in codes], pa.string())
            known = np.zeros(len(types), bool)
            for table in tables:
                kind, length, fields = LAYOUTS[table]
                own = types == ord(kind)
                known |= own
                for part, reason in ((own & (size >= length), None), (own & (size < length), "too short")):
                    if not part.any():
                        continue
                    columns = {}
                    if reason is None:
                        rows = np.ascontiguousarray(data[start[part, None] + np.arange(length)]).view(_record(table)).ravel()
                        columns = {NAMED.get(n, n): _column(rows, n, k, given[NAMED.get(n, n)]) for n, _, _, k in fields}
                    yield made(packet[part], number[part], pa.array([kind] * int(part.sum()), pa.string()), None if reason else table, reason, columns)
            if not known.all():
                yield made(packet[~known], number[~known], char(types[~known]), None, "unknown type", {})
            if bad:
                yield made(np.array([p for p, *_ in bad]), [n for _, n, _ in bad], pa.nulls(len(bad), pa.string()), None, [r for *_, r in bad], {})

    kinds = "".join(f", {n} {k}" for n, k in given.items())
    return packets.select(F.col("capture_id").cast("string").alias("capture_id"), F.col("packet_no").cast("bigint").alias("packet_no"), "payload").mapInArrow(run, f"capture_id string, packet_no bigint, msg_idx int, send_ts_nanos bigint, msg_type string, table string, reason string{kinds}")


def rows_of(decoded: DataFrame, table: str) -> DataFrame:
    """One table's rows of decode_packets(), with capture order."""
    return decoded.filter(F.col("table") == table).select("capture_id", "packet_no", "msg_idx", *[F.col(NAMED.get(n, n)).cast(_FORMS[k][1]).alias(n) for n, _, _, k in LAYOUTS[table][2]])


def malformed(messages: DataFrame, tables: list[str]) -> DataFrame:
    """Counts of messages of unknown types, or shorter than their type."""
    known = {LAYOUTS[t][0]: LAYOUTS[t][1] for t in tables}
    length = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col("msg_type")]
    reason = F.when(length.isNull(), "unknown type").when(F.length("msg") < length, "too short")
    return messages.withColumn("reason", reason).filter("reason is not null").groupBy("msg_type", "reason").agg(F.count(F.lit(1)).alias("n"))


def status_events(decoded: DataFrame) -> DataFrame:
    """All administrative messages of decode_packets() in one table."""
    kind = F.create_map(*[F.lit(x) for pair in STATUS_KINDS.items() for x in pair])[F.col("table")]
    return decoded.withColumn("event_kind", kind).filter("event_kind is not null").select("capture_id", "packet_no", "msg_idx", "ts_nanos", "symbol", "event_kind", "sub_type", F.col("halt_reason").alias("reason"), "detail")


#: Which wire table each message type is written to, if it has another name there.
TABLE_OF = {**dict.fromkeys(STATUS_KINDS, "status_events"), "level_updates_buy": "level_updates", "level_updates_sell": "level_updates"}


def write_tables(decoded: DataFrame, place: str, feed_source: str) -> None:
    """All wire tables of one feed from one pass over decode_packets(), by table, feed and day, with COMMON's columns.

    Days that are written again are replaced, those of other feeds and days stay.
    """
    to = F.coalesce(F.create_map(*[F.lit(x) for pair in TABLE_OF.items() for x in pair])[F.col("table")], F.col("table"))
    kind = F.create_map(*[F.lit(x) for pair in STATUS_KINDS.items() for x in pair])[F.col("table")]
    side = F.when(F.col("table") == "level_updates_buy", "8").when(F.col("table") == "level_updates_sell", "5").otherwise(F.col("side"))
    rows = decoded.filter("table is not null").withColumns({
        "wire_table": to, "feed_source": F.lit(feed_source), "trading_date": F.to_date(F.timestamp_micros(F.floor(F.col("ts_nanos") / 1000))),
        "seq": F.col("packet_no") * 65_536 + F.col("msg_idx"), "event_kind": kind, "side": side,
    }).drop("table", "msg_type", "reason", "send_ts_nanos", "capture_id", "packet_no", "msg_idx").withColumnRenamed("halt_reason", "reason")
    rows.sortWithinPartitions("wire_table", "trading_date", "symbol", "ts_nanos").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("wire_table", "feed_source", "trading_date").parquet(place)


def read_table(spark: SparkSession, place: str, table: str) -> DataFrame:
    """One wire table of write_tables(), in its own columns."""
    from ..schemas import wire_schema

    wanted = wire_schema(table)
    rows = spark.read.parquet(place).filter(F.col("wire_table") == table)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def pack(rows: DataFrame, table: str, key: Column, order: list[str], capture: str = "test") -> DataFrame:
    """Packets of a table's rows, one for each key: the inverse of splitting and decoding. A packet has up to 65,535 bytes of messages."""
    kind, length, fields = LAYOUTS[table]
    record = _record(table)
    framed = np.dtype([("size", "<u2"), ("message", record)])

    def messages(batch: pa.Table) -> np.ndarray:
        out = np.zeros(batch.num_rows, framed)
        out["size"] = length
        raw = out.view(np.uint8).reshape(batch.num_rows, framed.itemsize)
        raw[:, 2] = ord(kind)
        for name, _, width, k in fields:
            column = batch.column(name)
            if k[0] in "sc":
                texts = np.char.ljust(np.array([(t or "").encode("ascii", "replace") for t in column.to_pylist()], f"S{width}"), width, b" ")
                out["message"][name] = texts
            else:
                out["message"][name] = column.to_numpy().astype(_FORMS[k][0])
        return out

    def packet(no: int, sent: int, body: np.ndarray) -> bytes:
        header = np.zeros(1, _HEADER)
        for name, value in (("protocol_id", 0x8005), ("channel_id", 1), ("session_id", 1), ("payload_length", body.nbytes), ("message_count", len(body)), ("first_sequence", no), ("send_ts_nanos", sent)):
            header[name] = value
        return b"\x01" + header.tobytes()[1:] + body.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []

        def packed(part: pa.Table) -> pa.RecordBatch:
            keys, times, body = part.column("packet_no").to_numpy(), part.column("ts_nanos").to_numpy(), messages(part)
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            made = [(int(keys[a]), packet(int(keys[a]), int(times[a:b].max()), body[a:b])) for a, b in zip(bounds, bounds[1:])]
            return pa.RecordBatch.from_arrays([pa.array([capture] * len(made)), pa.array([n for n, _ in made], pa.int64()), pa.array([p for _, p in made], pa.binary())], ["capture_id", "packet_no", "payload"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.concat_tables([*kept, pa.Table.from_batches([batch])])
            keys = part.column("packet_no").to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))  # its other rows may be in the next batch
            kept = [part.slice(last)]
            if last:
                yield packed(part.slice(0, last))
        if kept:
            yield packed(kept[0])

    dealt = rows.withColumn("packet_no", key.cast("bigint")).repartition("packet_no").sortWithinPartitions("packet_no", *order)
    names = dict.fromkeys(["packet_no", "ts_nanos", *(n for n, *_ in fields)])
    return dealt.select(*names).mapInArrow(run, "capture_id string, packet_no bigint, payload binary")
