"""Queries on wire packets, written summaries and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fmt
from ..operators import book
from ..operators import textcheck as tc
from ..sources import wire
from ..session import removed, shared_folder
from ..streaming import flow
from . import books
from . import events as ev
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


@query(f"with {fx.SQL} select symbol, ts_nanos, side, order_id, size, price_raw from orders_add")
def wire_decode_roundtrip(spark, sf_dir):
    adds = fx.orders_add(spark, sf_dir)
    packets = wire.pack(adds, "orders_add", F.expr("order_id div 10"), ["order_id"])
    return wire.rows_of(wire.decode_packets(packets, ["orders_add"]), "orders_add").select("symbol", "ts_nanos", "side", "order_id", "size", "price_raw")


@query(f"with {fx.SQL} select 'R' msg_type, 'unknown type' reason, count(*) n from orders_delete")
def wire_malformed(spark, sf_dir):
    packets = wire.pack(fx.orders_delete(spark, sf_dir), "orders_delete", F.expr("order_id div 10"), ["order_id"])
    return wire.malformed(wire.split_messages(packets)[0], ["orders_add", "orders_modify"])


_SAID = "(1 + k % 500 + case when k % 7 = 0 then 1 else 0 end)"
_TEXT = "concat(symbol, ' saw ', cast({0} as {1}), ' shares at $', cast((1000000 + k % 100 * 100) as {1}))"


def _texts(spark, sf_dir):
    return fx.base(spark, sf_dir).selectExpr("k doc_id", f"{_TEXT.format(_SAID, 'string')} text", "symbol", "1 + k % 500 size", "1000000 + k % 100 * 100 price")


@query(f"with {fx.SQL} select k doc_id, cast({_SAID} as varchar) number from base where k % 7 = 0 and {_SAID} >= 10")
def number_grounding(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    texts = texts.withColumn("text", F.regexp_replace("text", "^S[0-9]+", "It"))
    facts = texts.select("doc_id", F.explode(F.array(F.col("size").cast("string"), F.col("price").cast("string"))).alias("value"))
    return tc.ungrounded_numbers(texts, facts)


@query(r"""select doc_id, regexp_extract_all(lower(text), '\b(?:manipul\w*|spoof\w*|front[- ]?run\w*|wash[- ]?trad\w*|illegal\w*|fake\w*)\b') words from (
  select doc_id, case doc_id % 5 when 0 then 'looks like spoofing; ' when 1 then 'no wash-trading here; ' when 2 then 'fake_orders, spoof2 ' else '' end || coalesce(text, '') as text from documents)""")
def banned_words(spark, sf_dir):
    text = F.expr("concat(case doc_id % 5 when 0 then 'looks like spoofing; ' when 1 then 'no wash-trading here; ' when 2 then 'fake_orders, spoof2 ' else '' end, coalesce(text, ''))")
    return fx.table(spark, sf_dir, "documents").select("doc_id", tc.intent_words(text).alias("words"))


@query("select doc_id, regexp_extract(coalesce(text, ''), '[^\\x20-\\x7E\\t\\n\\r" + tc.TYPOGRAPHY + "]', 0) bad from documents")
def bad_chars(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(tc.first_bad_character(F.col("text")), F.lit("")).alias("bad"))


_FACTS = "concat('{{\"size\":', {0}, ',\"note\":{{\"by\":[\"', {1}, '\",7]}}}}')"


@query("select o_orderkey doc_id, [cast(o_custkey as varchar), o_orderstatus, '7'] as values, cast(1234.5 + o_custkey as double) price, o_custkey % 2 = 0 missing from orders")
def json_facts(spark, sf_dir):
    """Leaves of nested facts, a number with separators, and fields that are missing."""
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_FACTS.format("cast(o_custkey as string)", "o_orderstatus")).alias("facts"), "o_custkey")
    price = F.concat(F.lit('{"price":"'), F.format_number(F.lit(1234.5) + F.col("o_custkey"), 1), F.when(F.col("o_custkey") % 2 == 1, F.lit('","note":{"by":"x"}}')).otherwise(F.lit('"}')))
    return rows.select("doc_id", tc.leaf_values(F.col("facts")).alias("values"), fmt.json_number(price, "$.price").alias("price"), (F.size(tc.missing_fields(price, ["note.by"])) == 1).alias("missing"))


@query("select passed was, now, count(*) n from (select o_orderkey % 3 <> 0 passed, o_orderkey % 5 <> 0 now from orders) group by all")
def rechecked_texts(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders")
    return tc.recheck(rows.selectExpr("o_orderkey doc_id", "o_orderkey % 3 != 0 passed"), rows.selectExpr("o_orderkey doc_id", "o_orderkey % 5 != 0 passed"))


def _trip(spark, df, table, order):
    return wire.decode(wire.split_messages(wire.pack(df, table, F.expr(f"{order} div 10"), [order]))[0], table)


@query(f"with {fx.SQL} select symbol, ts_nanos, bid_size, bid_price_raw, ask_price_raw, ask_size, flags from (select symbol, ts_nanos, size bid_size, price_raw bid_price_raw, price_raw + 100 ask_price_raw, -size ask_size, order_id % 256 flags from orders_add)")
def wire_quotes(spark, sf_dir):
    rows = fx.orders_add(spark, sf_dir).selectExpr("symbol", "ts_nanos", "size bid_size", "price_raw bid_price_raw", "price_raw + 100 ask_price_raw", "-size ask_size", "cast(order_id % 256 as smallint) flags", "order_id")
    return _trip(spark, rows, "quotes", "order_id").select("symbol", "ts_nanos", "bid_size", "bid_price_raw", "ask_price_raw", "ask_size", "flags")


@query(f"with {fx.SQL} select symbol, ts_nanos, size, price_raw, cast(1 as smallint) event_flags from orders_add where side = '8'")
def wire_level_updates(spark, sf_dir):
    rows = fx.orders_add(spark, sf_dir).filter("side = '8'").withColumn("event_flags", F.lit(1).cast("smallint"))
    return _trip(spark, rows, "level_updates_buy", "order_id").select("symbol", "ts_nanos", "size", "price_raw", "event_flags")


@query(f"with {fx.SQL} select symbol, ts_nanos, event_kind, sub_type, reason from status_events where reason is not null")
def wire_status(spark, sf_dir):
    """Trading-status messages, packed, split, decoded and put into the table of all administrative messages."""
    rows = fx.status_events(spark, sf_dir).filter("reason is not null")
    decoded = wire.decode_packets(wire.pack(rows, "trading_status", F.expr("seq div 10"), ["seq"]))
    return wire.status_events(decoded).select("symbol", "ts_nanos", "event_kind", "sub_type", "reason")


def _field(kind: str, i: int, text: str) -> str:
    """A value of a field's kind from k, in either engine."""
    if kind == "c1":
        return f"chr(cast(65 + (k + {i}) % 26 as int))"
    if kind[0] == "s":
        return f"concat('{'S' if kind == 's8' else 'R'}', cast(k % {10 ** (int(kind[1]) - 1)} as {text}))"
    return {"u1": f"cast((k + {i}) % 256 as smallint)", "u4": f"cast(4294967295 - k - {i} as bigint)", "i4": f"cast((k * 7919 + {i}) % 2000000 - 1000000 as int)", "i8": f"cast(k * 1000000007 - 3000000000 - {i} as bigint)"}[kind]


def _table_values(table: str, text: str) -> dict[str, str]:
    """Each field of a table with its value; times are those of orders."""
    return {n: "ts_nanos" if n == "ts_nanos" else _field(kind, i, text) for i, (n, _, _, kind) in enumerate(wire.LAYOUTS[table][2])}


def _layouts_sql() -> str:
    order, parts = list(wire.fields_of(list(wire.LAYOUTS))), []
    for t, table in enumerate(wire.LAYOUTS):
        values = {wire.NAMED.get(n, n): v for n, v in _table_values(table, "varchar").items()}
        parts.append(f"select '{table}' as \"table\", k // 10 packet_no, concat_ws('|', {', '.join(f'cast({values[n]} as varchar)' for n in order if n in values)}) as fields from base where k % {len(wire.LAYOUTS)} = {t}")
    return f"with {fx.SQL} " + " union all ".join(parts)


@query(_layouts_sql())
def wire_layouts(spark, sf_dir):
    """Messages of every layout, packed, walked once and decoded in the same pass, with all their fields."""
    tables, base, packets = list(wire.LAYOUTS), fx.base(spark, sf_dir), None
    for t, table in enumerate(tables):
        rows = base.filter(f"k % {len(tables)} = {t}").selectExpr("k", *[f"{v} {n}" for n, v in _table_values(table, "string").items()])
        own = wire.pack(rows, table, F.expr("k div 10"), ["k"], table)
        packets = own if packets is None else packets.unionByName(own)
    decoded = wire.decode_packets(packets)
    return decoded.select("table", "packet_no", F.concat_ws("|", *[F.col(n).cast("string") for n in wire.fields_of(tables)]).alias("fields"))


@query(f"with {fx.SQL}, {ev.EVENTS} select symbol || '|' || scorer_id doc_id, symbol, cast(n + 1 as bigint) claimed, scorer_id, n from (select symbol, scorer_id, count(*) n from events group by 1, 2) where n % 3 = 0")
def claim_counts(spark, sf_dir):
    """Attributed counts that the events don't bear out."""
    counts = ev.events(spark, sf_dir).groupBy("symbol", "scorer_id").agg(F.count(F.lit(1)).alias("n"))
    texts = counts.selectExpr("concat(symbol, '|', scorer_id) doc_id", "concat(symbol, ' recorded ', cast(n + case when n % 3 = 0 then 1 else 0 end as string), ' ', case scorer_id when 'sweep' then 'sweeps' when 'iceberg' then 'iceberg runs' when 'layering' then 'layering clusters' when 'liquidity_withdrawal' then 'liquidity withdrawals' else 'cancelled bursts' end, ' over the month.') text")
    nouns = {"sweep": "sweep", "iceberg": "iceberg", "layering": "layering", "withdrawal": "liquidity_withdrawal", "cancelled": "post_cancel_cluster"}
    return tc.wrong_claims(tc.count_claims(texts, nouns), counts)


#: A row of no symbol ends the feed so many nanoseconds later, so that the watermark passes all others.
_END = 60_000_000_000


def _replayed(spark, df, name: str):
    """A stream over df's rows (symbol, ts_nanos, seq, ...), dealt into files without any order, in the folder that executors share, and the place of its files."""
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.repartition("seq").write.parquet(f"{place}/in")
    last = spark.read.parquet(f"{place}/in").agg(F.max("ts_nanos")).first()[0]
    ends = {"symbol": "", "ts_nanos": (last or 0) + _END, "seq": 0}
    spark.range(1).select(*[F.lit(ends.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns]).write.mode("append").parquet(f"{place}/in")
    return flow.with_event_time(spark.readStream.schema(df.schema).parquet(f"{place}/in")), place


def _finished(spark, stream, place: str):
    """What a stream gives from the files so far. Its input and state are removed; the result stays for its reader."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").option("path", f"{place}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert flow.late_rows(query) == 0
    removed(spark, [f"{place}/in", f"{place}/state"])
    return spark.read.schema(stream.schema).parquet(f"{place}/out").filter("symbol != ''")


@query(f"with {fx.SQL} {books.STEPS.replace('join clear_books c on', 'join (select * from clear_books where false) c on')} select symbol, side, price_raw, cast(sum(delta) as bigint) streamed, cast(sum(delta) as bigint) batch, true agrees from changes group by 1, 2, 3")
def streaming_parity(spark, sf_dir):
    """Level changes of the book kept as stream state, against those of the batch windows: sums by level, and whether they agree."""
    steps = books._steps(spark, sf_dir, clears=False).select("symbol", "op", "order_id", "side", "price_raw", "size", "ts_nanos", "seq")
    source, place = _replayed(spark, steps, "book")
    streamed = _finished(spark, flow.book_changes(source), place).groupBy("symbol", "side", "price_raw").agg(F.sum("delta").alias("streamed"))
    batch = book.level_changes(book.remaining(books._steps(spark, sf_dir, clears=False))).groupBy("symbol", "side", "price_raw").agg(F.sum("delta").alias("batch"))
    return streamed.join(batch, ["symbol", "side", "price_raw"], "full_outer").withColumn("agrees", F.col("streamed").eqNullSafe(F.col("batch")))


@query(f"with {fx.SQL} select symbol, count(*) n, min(ts_nanos) ts_nanos, max(ts_nanos) ts_end_nanos from {ev.islands('orders_delete', 'symbol', 'ts_nanos, seq', 2_000_000_000, 25)} group by symbol, island, part")
def streaming_clusters(spark, sf_dir):
    """Bursts of deletes kept as open clusters of a stream, to the nanosecond and cut after 25 rows."""
    source, place = _replayed(spark, fx.orders_delete(spark, sf_dir).select("symbol", "ts_nanos", "seq"), "deletes")
    return _finished(spark, flow.gap_cluster_rows(source, ["symbol"], 2_000_000_000, 25), place).select("symbol", "n", "ts_nanos", "ts_end_nanos")


@query(f"with {fx.SQL} select symbol, order_id, ts_nanos, row_number() over (partition by symbol order by ts_nanos, seq) as place from orders_add")
def streaming_order(spark, sf_dir):
    """Order adds of a shuffled stream, put back in order."""
    source, place = _replayed(spark, fx.orders_add(spark, sf_dir).select("symbol", "ts_nanos", "seq", "order_id"), "adds")
    return _finished(spark, flow.in_order(source, ["symbol"]), place).select("symbol", "order_id", "ts_nanos", "place")
