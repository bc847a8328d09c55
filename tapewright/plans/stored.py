"""Queries on stored tables: incremental rollups, retention, rebuilding, facts of any depth, and texts checked again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fmt
from ..operators import periods, tables
from ..operators import textcheck as tc
from ..session import removed, shared_folder, written
from . import events as ev
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of days from orders: by fate and by symbol.
_DAYS = """select trading_date, 'scorer' kind, 'f' || cast(fate as varchar) as member, count(*) n from base{0} group by 1, 3
  union all select trading_date, 'symbol', symbol, count(*) from base{0} group by 1, 3"""
_CHANGED = " where not (trading_date = date '2024-01-10' and fate = 3)"
_LEVELS = [periods.Level("week", "day", fmt.week_start), periods.Level("quarter", "week", fmt.quarter_start, 2), periods.Level("year", "quarter", fmt.year_start)]


def _day_rows(base):
    n = F.count(F.lit(1)).alias("n")
    by = lambda kind, member: base.groupBy("trading_date", F.lit(kind).alias("kind"), member.alias("member")).agg(n)
    return by("scorer", F.concat(F.lit("f"), F.col("fate").cast("string"))).unionByName(by("symbol", F.col("symbol")))


_TOP = "select * exclude place from (select *, row_number() over (partition by period, kind order by n desc, member) place from ({0})) where kind <> 'symbol' or place <= 12"


@query(f"""with {fx.SQL}, days as (select trading_date as period, kind, member, n, 1 n_days from ({_DAYS.format(_CHANGED)})),
weeks as ({_TOP.format("select cast(date_trunc('week', period) as date) period, kind, member, sum(n) n, sum(n_days) n_days from days group by all")}),
quarters as ({_TOP.format("select cast(date_trunc('quarter', period) as date) period, kind, member, sum(n) n, sum(n_days) n_days from weeks where period <> date '2024-01-01' group by all")}),
years as ({_TOP.format("select cast(date_trunc('year', period) as date) period, kind, member, sum(n) n, sum(n_days) n_days from quarters group by all")})
select level, period, kind, member, cast(n as bigint) n, cast(n_days as bigint) n_days, (level = 'day' and period = date '2024-01-10') or (level = 'week' and period = date '2024-01-08') or level in ('quarter', 'year') as rewritten from (
  select 'day' level, * from days union all select 'week', * from weeks union all select 'quarter', * from quarters union all select 'year', * from years)""")
def incremental_rollups(spark, sf_dir):
    """Stored periods after one day changed, and which of them the second refresh rewrote: the day, its week, quarter and year."""
    base = written(fx.base(spark, sf_dir), "base")
    store = periods.Store(spark, _place(spark, "periods"))
    days = base.select(F.col("trading_date").alias("period")).distinct()
    of = lambda level, start: days.select(F.lit(level).alias("level"), start.alias("period")).distinct()
    verified = of("day", F.col("period")).unionByName(of("week", fmt.week_start(F.col("period"))).filter("period != date'2024-01-01'")).unionByName(of("quarter", fmt.quarter_start(F.col("period"))))
    periods.refresh(store, _day_rows(base), verified, _LEVELS)
    again = periods.refresh(store, _day_rows(base.filter("not (trading_date = date'2024-01-10' and fate = 3)")), verified, _LEVELS)
    rows = None
    for level in ("day", "week", "quarter", "year"):
        own = store.rows(level).withColumn("level", F.lit(level))
        rows = own if rows is None else rows.unionByName(own)
    marked = again.filter("action = 'rewritten'").select("level", "period", F.lit(True).alias("rewritten"))
    return rows.join(F.broadcast(marked), ["level", "period"], "left").select("level", "period", "kind", "member", "n", "n_days", F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


@query(f"""with {fx.SQL}, rows_ as (select trading_date, sha256(strlen(symbol) || ':' || symbol || strlen(order_id::varchar) || ':' || order_id || '-') h from orders_add),
chunks as (select trading_date, h[1 : 2] chunk, sha256(string_agg(h, '' order by h)) c from rows_ group by 1, 2) select trading_date, sha256(string_agg(c, '' order by chunk)) content_hash from chunks group by 1""")
def period_hashes(spark, sf_dir):
    """Hashes of days, each from the hashes of its chunks."""
    return periods.chunked_hash(fx.orders_add(spark, sf_dir).withColumn("note", F.lit(None).cast("string")), ["trading_date"], ["symbol", "order_id", "note"])


@query(f"""with {fx.SQL}, kept as (select 'orders_add' table_name, trading_date, count(*) n from orders_add where trading_date >= date '2024-01-08' group by all
  union all select 'lifecycle', trading_date, count(*) from lifecycle where trading_date >= date '2024-01-08' group by all
  union all select 'texts', trading_date, count(*) from orders_add where side = '8' group by all union all select 'days', trading_date, count(distinct symbol) from orders_add group by all) select * from kept""")
def retention_sweep(spark, sf_dir):
    """What a sweep leaves of four tables: whole partitions of wire and derived rows go, texts and rollups stay."""
    place, adds = _place(spark, "swept"), fx.orders_add(spark, sf_dir)
    parts = {"orders_add": ("wire", adds), "lifecycle": ("derived", ev._lifecycle(spark, sf_dir)), "texts": ("text", adds.filter("side = '8'")), "days": ("rollup", adds.select("trading_date", "symbol").distinct())}
    for name, (_, rows) in parts.items():
        rows.write.partitionBy("trading_date").parquet(f"{place}/{name}")
    periods.sweep(spark, {name: (kind, f"{place}/{name}") for name, (kind, _) in parts.items()}, "2024-01-20", 1)
    out = None
    for name in parts:
        left = spark.read.parquet(f"{place}/{name}").groupBy("trading_date").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "trading_date", "n")
        out = left if out is None else out.unionByName(left)
    out = written(out, "left")
    removed(spark, [place])
    return out


def _week_rows(events):
    return events.groupBy(fmt.week_start(F.col("trading_date")).alias("period"), "symbol").agg(F.count(F.lit(1)).alias("n_events"), F.max("score").alias("top_score"))


def _day_table(events):
    return events.groupBy("trading_date", "symbol").agg(F.count(F.lit(1)).alias("n_events"), F.max("score").alias("top_score"))


@query(f"""with {fx.SQL}, {ev.EVENTS} select 'day' kind, trading_date as start, symbol, count(*) n_events, max(score) top_score from events group by 2, 3
  union all select 'week', cast(date_trunc('week', trading_date) as date), symbol, count(*), max(score) from events group by 2, 3""")
def rebuilt_tables(spark, sf_dir):
    """Day and week tables of which one day was spoilt, and with it its week, and built anew."""
    place, events = _place(spark, "rebuilt"), ev.events(spark, sf_dir)
    all_days = events.select(F.col("trading_date").alias("day")).distinct()
    spoilt = events.filter("not (trading_date = date'2024-01-10' and symbol > 'S05')")
    periods.rebuild(spoilt, all_days, place, _day_table, _week_rows)
    periods.rebuild(events, all_days.filter("day = date'2024-01-10'"), place, _day_table, _week_rows)
    day = spark.read.parquet(f"{place}/days").select(F.lit("day").alias("kind"), F.col("trading_date").alias("start"), "symbol", "n_events", "top_score")
    return day.unionByName(spark.read.parquet(f"{place}/weeks").select(F.lit("week").alias("kind"), F.col("period").alias("start"), "symbol", "n_events", "top_score"))


#: Facts of six levels, with arrays of objects, nulls, empty ones, and a string with brackets.
_DEEP = """concat('{"size":', cast(o_custkey as {0}), ',"note":{"by":["', o_orderstatus, '",7,{"deep":[{"x":{"y":', cast(o_orderkey % 13 as {0}), ',"z":null}},{"x":{"y":-1.5}}],"none":[]}],"said":"a [b] {c}"},"ok":',
  case when o_orderkey % 2 = 0 then 'true' else 'false' end, '}')"""


@query(f"""with facts as (select o_orderkey doc_id, {_DEEP.replace('{0}', 'varchar')} facts from orders)
select doc_id, fullkey as path, json_extract_string(facts, fullkey) as value from facts, json_tree(facts) where type not in ('OBJECT', 'ARRAY', 'NULL')""")
def json_leaves(spark, sf_dir):
    """All leaves of facts six levels deep, each with its path."""
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_DEEP.replace("{0}", "string")).alias("facts"))
    return tc.json_nodes(rows).filter("value is not null").select("doc_id", "path", "value")


@query(f"""with facts as (select o_orderkey doc_id, {_DEEP.replace('{0}', 'varchar')} facts from orders), asked as (select * from facts, (select unnest(['size', 'note.said', 'note.by[2].deep[0].x.y', 'note.by[2].deep[0].x.z', 'note.by[2].deep[1].x.z', 'note.by[9]', 'note', 'absent']) as path))
select doc_id, path from asked where json_extract(facts, '$.' || path) is null or json_type(json_extract(facts, '$.' || path)) = 'NULL'""")
def json_paths(spark, sf_dir):
    """Source paths that facts don't have, or have null at, told from the facts' nodes."""
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_DEEP.replace("{0}", "string")).alias("facts"))
    paths = ["size", "note.said", "note.by[2].deep[0].x.y", "note.by[2].deep[0].x.z", "note.by[2].deep[1].x.z", "note.by[9]", "note", "absent"]
    asked = rows.select("doc_id", F.explode(F.array(*[F.lit(p) for p in paths])).alias("path"))
    return tc.missing_paths(asked, tc.json_nodes(rows))


#: What texts were found to be when they were stored: by an older pass, here by a rule.
_STORED = {"intent": "doc_id % 7 <> 0", "characters": "doc_id % 5 <> 0", "streak": "true", "numbers": "doc_id % 11 <> 0"}
_CHECKED = "case doc_id % 5 when 0 then 'looks like spoofing; ' when 1 then 'a fifth consecutive week; ' when 2 then 'seen 1,204 times; ' else '' end || coalesce(text, '')"
_NOW = {
    "intent": r"len(regexp_extract_all(lower(text), '\b(?:manipul\w*|spoof\w*|front[- ]?run\w*|wash[- ]?trad\w*|illegal\w*|fake\w*)\b')) = 0",
    "characters": "regexp_extract(text, '[^\\x20-\\x7E\\t\\n\\r" + tc.TYPOGRAPHY + "]', 0) = ''",
    "streak": "case when contains(text, 'a fifth consecutive week') then 5 else 0 end <= doc_id % 6 + 1",
    "numbers": "not list_has_any(list_filter(list_transform(regexp_extract_all(text, '([0-9][0-9,_]*(?:\\.[0-9]+)?)', 1), lambda x : case when contains(x, '.') then regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[,_]', '', 'g'), '0+$', ''), '\\.$', ''), '^0+([0-9])', '\\1') else coalesce(nullif(regexp_replace(regexp_replace(x, '[,_]', '', 'g'), '^0+', ''), ''), '0') end), lambda x : len(x) >= 2 and x not in ('2025', '2026', cast(n_chars as varchar))), list_filter(list_transform(regexp_extract_all(text, '([0-9][0-9,_]*(?:\\.[0-9]+)?)', 1), lambda x : case when contains(x, '.') then regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[,_]', '', 'g'), '0+$', ''), '\\.$', ''), '^0+([0-9])', '\\1') else coalesce(nullif(regexp_replace(regexp_replace(x, '[,_]', '', 'g'), '^0+', ''), ''), '0') end), lambda x : len(x) >= 2 and x not in ('2025', '2026', cast(n_chars as varchar))))",
}


@query("with texts as (select doc_id, n_chars, " + _CHECKED + " as text from documents), verdicts as (" + " union all ".join(f"select doc_id, '{c}' as check_name, {_STORED[c]} as was, {_NOW[c]} as now from texts" for c in _STORED) + """)
select doc_id, check_name, was, now, case when was then 'regressed' else 'mended' end change from verdicts where was <> now""")
def rechecked_documents(spark, sf_dir):
    """Stored verdicts of documents against all checks of their texts in one pass: what each check sees otherwise now."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.expr(_CHECKED.replace("||", ",").join(["concat(", ")"])).alias("text"), F.array(F.col("n_chars").cast("string")).alias("allowed"), (F.col("doc_id") % 6).alias("prior"))
    stored = docs.select("doc_id", F.struct(*[F.expr(rule).alias(name) for name, rule in _STORED.items()]).alias("verdict"))
    return tc.changed_verdicts(stored, docs.select("doc_id", tc.verdict(F.col("text"), F.col("allowed"), F.col("prior")).alias("verdict")))
