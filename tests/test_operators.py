"""Operators against plain Python, on small made-up tables."""

import random

from pyspark.sql import functions as F

from tapewright.operators import book, patterns, validate
from tapewright.sources import wire
from tapewright.streaming import flow


def test_gap_clusters_chain_over_pieces_and_are_cut(spark):
    rng = random.Random(3)
    rows, clock = [], {"a": 0, "b": 0}
    for k in range(600):
        key = rng.choice("ab")
        clock[key] += rng.choice([1, 3, 5, 6, 40, 200])
        rows.append((key, clock[key], k))
    want, last, size = {}, {}, {}
    for key, t, k in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or t - last[key] > 5 or size[key] == 7:
            size[key], start = 0, (key, t, k)
            want[start] = []
            last[key + "start"] = start
        last[key], size[key] = t, size[key] + 1
        want[last[key + "start"]].append(k)
    df = spark.createDataFrame(rows, "key string, t bigint, k bigint")
    for piece in (1, 13, 10_000):
        got = patterns.gap_clusters(df, ["key"], ["t", "k"], 5, 7, piece).groupBy("key", "cluster").agg(F.sort_array(F.collect_list("k")).alias("ks")).collect()
        # the cut counts rows from an island's start, so it is compared by island and size
        assert sorted(map(sorted, want.values())) == sorted(list(r.ks) for r in got), piece


def _play(messages):
    """A book by order, message after message: size of each level."""
    orders, levels = {}, {}

    def put(side, price, size):
        levels[side, price] = levels.get((side, price), 0) + size

    for op, oid, side, price, size in messages:
        if op == "add":
            orders[oid] = [side, price, size]
            put(side, price, size)
            continue
        if op == "clear":
            for s, p, n in orders.values():
                put(s, p, -n)
            orders.clear()
            continue
        if oid not in orders:
            continue
        s, p, n = orders[oid]
        put(s, p, -n)
        if op == "modify":
            orders[oid] = [s, price, size]
            put(s, price, size)
        elif op == "execute" and n > size:
            orders[oid][2] -= size
            put(s, p, n - size)
        else:
            del orders[oid]
    return {k: v for k, v in levels.items() if v}


def test_book_equals_replay(spark):
    rng, messages, live = random.Random(5), [], {}
    for k in range(400):
        op = rng.choice(["add", "add", "modify", "execute", "delete"]) if k != 200 else "clear"
        if op == "add":
            live[k] = rng.randint(50, 300)
            messages.append((op, k, rng.choice("85"), rng.randint(100, 105), live[k]))
        elif op == "clear":
            messages.append((op, None, None, None, None))
            live.clear()
        elif live:
            oid = rng.choice(sorted(live))
            size = rng.randint(1, live[oid])
            if op == "delete" or (op == "execute" and size == live[oid]):
                del live[oid]
            else:
                live[oid] = size if op == "modify" else live[oid] - size
            messages.append((op, oid, None, rng.randint(100, 105) if op == "modify" else None, size if op != "delete" else None))
    rows = [("2024-01-01", "S", t + 1, t, *m) for t, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "trading_date string, symbol string, ts_nanos bigint, seq bigint, op string, order_id bigint, side string, price_raw bigint, size bigint").withColumn("trading_date", F.to_date("trading_date"))
    part = lambda op: df.filter(F.col("op") == op)
    steps = book.order_steps(part("add"), part("modify"), part("execute"), part("delete"), part("clear"))
    changes = book.level_changes(book.remaining(steps))
    got = {(r.side, r.price_raw): r.n for r in changes.groupBy("side", "price_raw").agg(F.sum("delta").alias("n")).filter("n != 0").collect()}
    assert got == _play(messages)
    assert book.violations(steps).count() == 0
    updates = book.level_sizes(changes).withColumn("declared", F.col("level_size")).withColumn("seq", F.lit(0))
    assert validate.level_check(changes, updates).filter("not matches").count() == 0


def test_streamed_book_steps_equal_replay():
    class Row:
        def __init__(self, op, oid, side, price, size):
            self.op, self.order_id, self.side, self.price_raw, self.size = op, oid, side, price, size

    messages = [("add", 1, "8", 990500, 200), ("add", 2, "8", 990500, 150), ("modify", 2, None, 990500, 100), ("execute", 1, None, None, 60), ("delete", 2, None, None, None), ("add", 3, "5", 990700, 10), ("clear", None, None, None, None)]
    orders, levels = {}, {}
    for m in messages:
        for side, price, delta in flow._apply(orders, Row(*m)):
            levels[side, price] = levels.get((side, price), 0) + delta
    assert {k: v for k, v in levels.items() if v} == _play(messages) == {}


def _walk(side, levels, lot_of):
    """The protected price of one side, level by level from the best one."""
    total = 0
    for price, size in sorted(levels, reverse=side == "8"):
        total += size
        if total >= lot_of(price):
            return price, total
    return 0, 0


def test_protected_prices_equal_a_walk(spark):
    rng = random.Random(21)
    lot_of = lambda raw: 100 if raw <= 2_500_000 else 40 if raw <= 10_000_000 else 10 if raw <= 100_000_000 else 1
    ladders, rows = {}, []
    for k in range(250):
        for side in "85":
            top = rng.choice([40_000, 2_490_000, 9_990_000, 99_990_000, 300_000_000])
            levels = {top + 1_000 * rng.randrange(40): rng.randint(1, 70) for _ in range(rng.randint(0, 6))}
            ladders[k, side] = sorted(levels.items())
            rows += [(k, side, p, s) for p, s in levels.items()]
    df = spark.createDataFrame(rows, "k int, side string, price_raw bigint, level_size bigint")
    got = {r.k: ((r.bid_price_raw, r.bid_size), (r.ask_price_raw, r.ask_size)) for r in book.protected_prices(df, ["k"]).collect()}
    assert got == {k: (_walk("8", ladders[k, "8"], lot_of), _walk("5", ladders[k, "5"], lot_of)) for k in {r[0] for r in rows}}
    second = {(r.k, r.side): (r.price_raw, r.level_size) for r in book.nth_level(df, ["k"], 2).collect()}
    assert second == {key: sorted(levels, reverse=key[1] == "8")[1] for key, levels in ladders.items() if len(levels) > 1}


def test_decoding(spark):
    data = bytes.fromhex("61 38 b2 8f a5 a0 ab 86 6d 14".replace(" ", "")) + b"ZIEXT   " + bytes.fromhex("968f060000000000") + bytes.fromhex("e8030000") + bytes.fromhex("241d0f0000000000")
    df = spark.createDataFrame([("c", 1, 0, 0, "a", bytearray(data)), ("c", 1, 1, 0, "a", bytearray(data[:20])), ("c", 1, 2, 0, "?", bytearray(b"?"))], "capture_id string, packet_no bigint, msg_idx int, send_ts_nanos bigint, msg_type string, msg binary")
    r = wire.decode(df, "orders_add").collect()
    assert [(x.side, x.ts_nanos, x.symbol, x.order_id, x.size, x.price_raw) for x in r] == [("8", 1471980724912754610, "ZIEXT", 429974, 1000, 990500)]
    assert {(x.msg_type, x.reason): x.n for x in wire.malformed(df, ["orders_add"]).collect()} == {("a", "too short"): 1, ("?", "unknown type"): 1}


def test_malformed_packets(spark):
    header = bytes([1, 0]) + (0x8005).to_bytes(2, "little") + bytes(8) + (30).to_bytes(2, "little") + (2).to_bytes(2, "little") + bytes(24)
    good = header + (3).to_bytes(2, "little") + b"Sxy" + (2).to_bytes(2, "little") + b"Hz"
    rows = [("c", 0, b"short"), ("c", 1, good), ("c", 2, good[:-1]), ("c", 3, header + bytes(2)), ("c", 4, header[:14] + bytes(26))]
    messages, bad = wire.split_messages(spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "capture_id string, packet_no bigint, payload binary"))
    assert sorted((r.packet_no, r.msg_idx, r.msg_type) for r in messages.collect()) == [(1, 0, "S"), (1, 1, "H"), (2, 0, "S")]
    assert {r.packet_no for r in bad.collect()} == {0, 2, 3}


def test_range_join_equals_comparison(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), rng.randint(0, 500), k) for k in range(200)]
    spans = [(rng.choice("ab"), s, s + rng.randint(0, 90), k) for k in range(60) for s in [rng.randint(0, 500)]]
    got = patterns.range_join(spark.createDataFrame(points, "key string, t bigint, p bigint"), spark.createDataFrame(spans, "key string, s bigint, e bigint, i bigint"), ["key"], "t", "s", "e", 37)
    assert sorted((r.p, r.i) for r in got.collect()) == sorted((p, i) for k, t, p in points for k2, s, e, i in spans if k == k2 and s <= t < e)


def test_long_spans_equal_comparison(spark):
    rng = random.Random(2)
    points = [(rng.choice("ab"), rng.randint(0, 400_000), k) for k in range(150)]
    spans = [(rng.choice("ab"), s, s + rng.choice([0, 1, 5, 300, 40_000, 390_000, 1 << 40]), k) for k in range(120) for s in [rng.randint(0, 400_000)]]
    p, s = spark.createDataFrame(points, "key string, t bigint, p bigint"), spark.createDataFrame(spans, "key string, s bigint, e bigint, i bigint")
    near = s.withColumn("e", F.least("e", F.lit(400_001)))
    for bucket in (1, 7, 1000):
        got = patterns.long_span_join(p, near, ["key"], "t", "s", "e", bucket)
        assert sorted((r.p, r.i) for r in got.collect()) == sorted((pp, i) for k, t, pp in points for k2, a, b, i in spans if k == k2 and a <= t < min(b, 400_001)), bucket
    # a span of all day costs a few rows, not one for each bucket
    day = spark.createDataFrame([("a", 5, 86_400 * 1_000 - 3)], "key string, s bigint, e bigint").select(F.size(patterns._blocks(F.floor(F.col("s") / 1000), F.floor(F.col("e") / 1000) + 1)).alias("n"))
    assert day.first().n <= 300


def test_pieces_of_time_change_nothing(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randint(0, 300), k, rng.choice([None, k])) for k in range(200)]
    asks = [(rng.choice("abc"), rng.randint(0, 300), k) for k in range(80)]
    df, at = spark.createDataFrame(rows, "key string, ts_nanos bigint, seq bigint, v bigint"), spark.createDataFrame(asks, "key string, ts_nanos bigint, k bigint")
    for piece in (1, 40, 10_000):
        last = {r.k: r.v for r in patterns.asof_last(df, at, ["key"], "v", piece=piece).collect()}
        total = {r.k: r.v for r in patterns.asof_sum(df, at, ["key"], "v", piece=piece).collect()}
        before = {r.seq: r.b for r in patterns.with_before(df, ["key"], ["ts_nanos", "seq"], "v", "b", piece).collect()}
        for key, t, k in asks:
            met = sorted(r[1:] for r in rows if r[0] == key and r[1] <= t)
            assert last[k] == next((v for _, _, v in reversed(met) if v is not None), None)
            assert total[k] == sum(v or 0 for _, _, v in met)
        for key in "ab":
            own = sorted(r[1:] for r in rows if r[0] == key)
            assert [before[s] for _, s, _ in own] == [None, *[v for _, _, v in own]][:-1]


def test_upsert_of_null_and_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a", 1), (None, "b", 2), (3, "c", 3)], "k int, t string, v int")
    updates = spark.createDataFrame([(None, "z", 9), (3, "y", 8), (3, "x", 7), (4, "n", 0)], "k int, t string, v int")
    assert sorted(map(tuple, patterns.upsert(target, updates, ["k"]).collect()), key=str) == sorted([(1, "a", 1), (None, "z", 9), (3, "y", 8), (4, "n", 0)], key=str)


def test_one_failing_detector_stops_no_other(spark):
    from tapewright.operators import detectors

    deletes = spark.range(60).selectExpr("date'2024-01-02' trading_date", "'S' symbol", "id * 1000 ts_nanos", "id order_id")
    odd = deletes.withColumn("ts_nanos", F.expr("raise_error('lost')").cast("bigint"))
    events, failed = detectors.run_all({"liquidity_withdrawal": ((deletes,), {}), "sweep": ((odd,), {}), "halt": ((odd.withColumn("event_kind", F.lit("H")).withColumn("sub_type", F.lit("H")).withColumn("reason", F.lit("")).withColumn("seq", F.lit(1)),), {})})
    assert set(failed) == {"sweep", "halt"} and [(r.scorer_id, r.ts_nanos) for r in events.collect()] == [("liquidity_withdrawal", 0)]
    refs = events.select(F.size(F.from_json("source_refs", "array<struct<ts_nanos:bigint>>")).alias("n"), F.get_json_object("breakdown", "$.truncated_count").cast("int").alias("cut")).first()
    assert (refs.n, refs.cut) == (16, 44)


def test_day_refresh_and_json(spark, tmp_path):
    from tapewright.functions import fmt
    from tapewright.operators import enrich, lifecycle, tables

    trades = spark.sql("select date_add(date'2024-01-01', cast(id % 3 as int)) trading_date, 'S' symbol, 1704067200000000000 + (id % 3) * 86400000000000 + id ts_nanos, 10 size, 5L price_raw, if(id % 2 = 0, 'A', 'B') feed_source from range(12)")
    place = str(tmp_path / "daily")
    lifecycle.daily_volume(trades).write.partitionBy("day").parquet(place)
    lifecycle.refresh_day(trades, place, "2024-01-02", "A")
    assert {str(r.day): r.trade_count for r in spark.read.parquet(place).collect()} == {"2024-01-01": 4, "2024-01-02": 2, "2024-01-03": 4}
    row = spark.sql("""select '{"a":"1,234","b":"x"}' j, '{"b":"y","c":null,"d":"2"}' n""").select(fmt.json_number(F.col("j"), "$.a").alias("a"), fmt.json_merged(F.col("j"), F.col("n")).alias("m"), fmt.json_without(F.col("j"), "a").alias("w")).first()
    assert row.a == 1234.0 and row.w == '{"b":"x"}' and dict(__import__("json").loads(row.m)) == {"a": "1,234", "b": "y", "d": "2"}
    events = spark.createDataFrame([(1, 5.0, None), (2, 6.0, 1)], "event_id int, score double, n int")
    merged = enrich.merge(events, spark.createDataFrame([(1, 9.0, "q")], "event_id int, score double, extra string"))
    assert sorted(map(tuple, merged.collect())) == [(1, 9.0, None, "q"), (2, 6.0, 1, None)]
    texts = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "event_id int, text string, created int")
    told = {r.event_id: r.text for r in tables.event_texts(events, texts, texts.withColumn("text", F.lit("told")).withColumn("event_id", F.lit(2)), ["event_id"]).collect()}
    assert told == {1: "new", 2: "told"}


def test_remaining_sizes_take_no_windows_and_deal_orders_anew(spark):
    """A join by order before them may be run as a broadcast, which deals rows otherwise."""
    from tapewright.plans import books, facts

    small = "/root/testdata/sf0.001"
    rows = book.remaining(books._steps(spark, small))
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.filter("op = 'execute'").count() > 0 and rows.filter("rem is null or (op <> 'add' and rem_before is null)").count() == 0
    # sweeps run once: what the as-of join reads twice is a table
    for made in (facts.halts_and_layers, books.level_feed_bbo):
        assert "MapInArrow" not in made(spark, small)._jdf.queryExecution().optimizedPlan().toString()
