"""Packets against a walk message by message, and wire tables written in one pass."""

import random

from pyspark.sql import functions as F

from tapewright.sources import wire


def walk(payload):
    """Messages of one packet, and why it ends early."""
    if payload is None or len(payload) < 40:
        return [], "shorter than a header"
    length, count = int.from_bytes(payload[12:14], "little"), int.from_bytes(payload[14:16], "little")
    out, at = [], 40
    while length and len(out) < count:
        if at + 2 > len(payload):
            return out, "payload ends early"
        size = int.from_bytes(payload[at : at + 2], "little")
        if not size:
            return out, "message length of 0"
        if at + 2 + size > len(payload):
            return out, "message beyond payload"
        out.append(payload[at + 2 : at + 2 + size])
        at += 2 + size
    return out, None


def random_packet(rng):
    messages = [bytes([rng.choice(b"aMRLTBCSDHIOPEQXA85?")]) + bytes(rng.randrange(256) for _ in range(rng.choice([0, 3, 9, 17, 18, 25, 30, 37, 45, 79]))) for _ in range(rng.randrange(6))]
    body = b"".join(len(m).to_bytes(2, "little") + m for m in messages)
    count = max(0, len(messages) + rng.choice([0, 0, 0, 1, -1]))
    head = bytes(12) + len(body).to_bytes(2, "little") + count.to_bytes(2, "little") + bytes(24)
    payload = head + body
    return rng.choice([payload, payload, payload, payload[: rng.randrange(len(payload) + 1)], payload[:40] + bytes(2)])


def test_walked_in_step_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(wire, "PACKETS", 7)
    rng = random.Random(4)
    packets = [random_packet(rng) for _ in range(300)] + [None, b""]
    df = spark.createDataFrame([("c", k, bytearray(p) if p is not None else None) for k, p in enumerate(packets)], "capture_id string, packet_no bigint, payload binary")
    messages, bad = wire.split_messages(df)
    got = {}
    for r in messages.collect():
        got.setdefault(r.packet_no, {})[r.msg_idx] = bytes(r.msg)
    reasons = {r.packet_no: r.reason for r in bad.collect()}
    sizes = {kind: (table, length) for table, (kind, length, _) in wire.LAYOUTS.items()}
    decoded = {}
    for r in wire.decode_packets(df).collect():
        decoded[r.packet_no, r.msg_idx, r.msg_type is None] = r.table, r.reason
    for k, p in enumerate(packets):
        want, reason = walk(p)
        assert [m for _, m in sorted(got.get(k, {}).items())] == want and reasons.get(k) == reason
        for n, m in enumerate(want):
            table, length = sizes.get(chr(m[0]), (None, 0))
            expected = (None, "unknown type") if table is None else (table, None) if len(m) >= length else (None, "too short")
            assert decoded[k, n, False] == expected
    assert wire.decode_packets(df.limit(0)).count() == 0 and wire.split_messages(df.limit(0))[0].count() == 0


def test_decoded_once_as_table_by_table(spark):
    rng = random.Random(8)
    packets = [random_packet(rng) for _ in range(400)]
    df = spark.createDataFrame([("c", k, bytearray(p)) for k, p in enumerate(packets)], "capture_id string, packet_no bigint, payload binary")
    messages, decoded = wire.split_messages(df)[0].cache(), wire.decode_packets(df).cache()
    for table in wire.LAYOUTS:
        one, all_ = (sorted(map(str, x.collect())) for x in (wire.decode(messages, table), wire.rows_of(decoded, table)))
        assert one == all_ and (one or table not in ("orders_add", "quotes", "auction_info"))


def test_tables_written_in_one_pass(spark, tmp_path):
    ts = 1_704_119_400_000_000_123
    rows = lambda n, **columns: spark.createDataFrame([(k, ts + k, f"S{k}", *columns.values()) for k in range(n)], ["k", "ts_nanos", "symbol", *columns])
    packs = [
        wire.pack(rows(5, event_flags=1, size=-7, price_raw=12345), "level_updates_buy", F.col("k"), ["k"]),
        wire.pack(rows(3, event_flags=0, size=9, price_raw=-1), "level_updates_sell", F.col("k") + 100, ["k"]),
        wire.pack(rows(4, sub_type="H", reason="T1"), "trading_status", F.col("k") + 200, ["k"]),
        wire.pack(rows(2, sub_type=1, detail="A"), "short_sale", F.col("k") + 300, ["k"]),
    ]
    packets = packs[0]
    for more in packs[1:]:
        packets = packets.unionByName(more)
    place = str(tmp_path / "wire")
    wire.write_tables(wire.decode_packets(packets), place, "LEVELS")
    wire.write_tables(wire.decode_packets(packets), place, "OTHER")
    wire.write_tables(wire.decode_packets(packs[0].unionByName(packs[3])), place, "LEVELS")  # the day's level updates are replaced
    levels = wire.read_table(spark, place, "level_updates").filter("feed_source = 'LEVELS'").collect()
    assert len(levels) == 5 and {(r.side, r.size, r.price_raw, r.event_flags, r.ts_nanos - ts) for r in levels} == {("8", -7, 12345, 1, k) for k in range(5)}
    assert wire.read_table(spark, place, "level_updates").filter("feed_source = 'OTHER' and side = '5'").count() == 3
    status = wire.read_table(spark, place, "status_events").filter("feed_source = 'OTHER'").collect()
    assert sorted((r.event_kind, r.sub_type, r.reason, r.detail) for r in status) == sorted([("H", "H", "T1", None)] * 4 + [("P", "1", None, "A")] * 2, key=str)
