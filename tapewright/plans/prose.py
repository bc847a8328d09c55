"""Queries on sentences written from the tables' own values, each checked against the values it was written from."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import textcheck as tc
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


_SMALL = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
_TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def _spelled(n):
    """A whole number from 1 to 99 in words."""
    small, tens = F.array(*[F.lit(w) for w in _SMALL]), F.array(*[F.lit(w) for w in _TENS])
    ten, one = F.floor(n / 10), n % 10
    rest = F.when(one > 0, F.concat(F.lit(" "), F.get(small, (one - 1).cast("int")))).otherwise("")
    return F.when(n < 20, F.get(small, (n - 1).cast("int"))).otherwise(F.concat(F.get(tens, (ten - 2).cast("int")), rest))


@query("""select l_orderkey, l_linenumber, [cast((1 + l_partkey % 19) * case when l_returnflag = 'N' then 1000 else 100 end as varchar)]
  || case when q < 20 or q % 10 = 0 then [cast(q as varchar)] else [cast(q - q % 10 as varchar), cast(q % 10 as varchar)] end || [cast(1 + l_suppkey % 12 as varchar)] as numbers
  from (select *, cast(l_quantity as bigint) q from lineitem)""")
def word_numbers(spark, sf_dir):
    """Sentences on order lines with quantities in words, a compound at the end, capitals, and a number in a hyphenated word that is none."""
    lines = fx.table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    scale = F.when(F.col("l_returnflag") == "N", "thousand").otherwise("hundred")
    text = F.concat(F.initcap(_spelled(F.col("q"))), F.lit(" shares came in "), _spelled(1 + F.col("l_suppkey") % 12), F.lit(" fills; of a "), _spelled(1 + F.col("l_suppkey") % 12), F.lit("-part order "), _spelled(1 + F.col("l_partkey") % 19), F.lit(" "), F.upper(scale), F.lit(" were asked."))
    return lines.select("l_orderkey", "l_linenumber", tc.word_numbers(text).alias("numbers"))


def _named(symbol: str, text: str) -> str:
    """A ticker in letters with what follows it: nothing, a class, or a mark."""
    return f"concat('S', chr(cast(65 + {symbol} % 25 as int)), case {symbol} % 3 when 0 then '' when 1 then '.A' else '.' end)"


@query(f"""select distinct o_orderkey doc_id, ticker from (
    select o_orderkey, 'S' || chr(cast(65 + o_custkey % 25 as int)) || case o_custkey % 25 % 3 when 1 then '.A' else '' end ticker, o_custkey % 25 s from orders
    union all select l_orderkey, 'S' || chr(cast(65 + l_partkey % 25 as int)), l_partkey % 25 from lineitem join orders on o_orderkey = l_orderkey)
  where s not in (select s_suppkey from supplier where s_suppkey < 25 and s_acctbal > 2000)""")
def ticker_check(spark, sf_dir):
    """Sentences on an order's symbol and those of its lines, against the symbols of suppliers of some balance; tickers come with and without suffixes."""
    orders = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey doc_id", f"{_named('(o_custkey % 25)', 'string')} own")
    of_lines = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey doc_id", "concat('S', chr(cast(65 + l_partkey % 25 as int))) other").groupBy("doc_id").agg(F.concat_ws(", ", F.array_sort(F.collect_set("other"))).alias("others"))  # 25 at most
    texts = orders.join(of_lines, "doc_id", "left").select("doc_id", F.concat(F.lit("On NYSE, "), F.col("own"), F.lit(" rose at 10 AM ET"), F.when(F.col("others").isNotNull(), F.concat(F.lit(", ahead of "), F.col("others"))).otherwise(""), F.lit("; the ETF fell.")).alias("text"))
    known = fx.table(spark, sf_dir, "supplier").filter("s_suppkey < 25 and s_acctbal > 2000").selectExpr(f"{_named('s_suppkey', 'string')} symbol")
    return tc.unknown_tickers(texts, known)


@query("""select o_orderkey, case when o_orderstatus <> 'P' then c.c_name = own.c_name and c.c_mktsegment = own.c_mktsegment end agrees
  from orders join customer c on c.c_custkey = o_custkey join customer own on own.c_custkey = o_custkey % 25""")
def company_agree(spark, sf_dir):
    """Whether the customer that a sentence names beside a symbol is the company of this symbol; partly executed orders name no symbol."""
    customers = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(c_name, ' ', lower(c_mktsegment)) said")
    own = fx.table(spark, sf_dir, "customer").filter("c_custkey < 25").selectExpr("c_custkey i", "concat('The ', c_name, ' ', c_mktsegment, ' Corp.') company")
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey c_custkey", "o_custkey % 25 i", "o_orderstatus").join(customers, "c_custkey").join(own, "i")
    rows = rows.selectExpr("o_orderkey", "company", "concat('S', i) symbol", "concat('Today the ', said, ', Inc.', case when o_orderstatus = 'P' then '' else concat(' (S', i, ')') end, ' traded') text")
    return rows.select("o_orderkey", tc.names_agree(F.col("text"), F.col("symbol"), F.col("company")).alias("agrees"))


_WEEKS = """weeks as (select symbol, w, n, row_number() over (partition by symbol, w - place order by w) as run from (
  select *, row_number() over (partition by symbol order by w) as place from (
  select o_custkey % 25 symbol, cast(floor((epoch(o_orderdate) / 86400 + 3) / 7) as bigint) w, count(*) n from orders group by 1, 2)))"""


def _weeks(spark, sf_dir):
    """symbol, w, n and run, the week's place among consecutive weeks with orders, from 1."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    weeks = fx.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("symbol"), F.floor((days + 3) / 7).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    runs = weeks.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("w")))  # a row for each week of a symbol
    return runs.withColumn("run", F.row_number().over(Window.partitionBy("symbol", F.col("w") - F.col("place")).orderBy("w"))).drop("place")


@query(f"with {_WEEKS} select symbol, w, cast(case when n % 5 = 4 then 0 else greatest(run + n % 3, case when n % 2 = 0 then 2 else 0 end) end as integer) claimed, n % 5 <> 4 and greatest(run + n % 3, case when n % 2 = 0 then 2 else 0 end) > run as too_long from weeks")
def streak_claims(spark, sf_dir):
    """Sentences on weeks with orders that claim the symbol's streak or one or two weeks more, against the streak that the orders bear out."""
    said = F.col("run") + F.col("n") % 3
    ending = F.when((said % 100).between(11, 13), "th").when(said % 10 == 1, "st").when(said % 10 == 2, "nd").when(said % 10 == 3, "rd").otherwise("th")
    ordinal = F.when(said <= 12, F.get(F.array(*[F.lit(w) for w in tc.ORDINALS]), (said - 1).cast("int"))).otherwise(F.concat(said.cast("string"), ending))
    streak = F.concat(F.lit("S"), F.col("symbol"), F.lit(" had its "), ordinal, F.when(F.col("n") % 5 == 4, " week").otherwise(" consecutive week"), F.lit(" of orders"))
    text = F.concat(streak, F.when((F.col("n") % 2 == 0) & (F.col("n") % 5 != 4), "; a 2nd straight week of more than one.").otherwise("."))
    claimed = tc.claimed_streak(text)
    return _weeks(spark, sf_dir).select("symbol", "w", claimed.cast("int").alias("claimed"), (claimed > F.col("run")).alias("too_long"))


@query(f"""with {_WEEKS} select symbol, w, case when run = 1 then cast([] as varchar[]) else list_transform(range(2, least(run, 14) + 1), lambda k: 'a ' ||
  ['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth', 'eleventh', 'twelfth', 'thirteenth', 'fourteenth'][k] || ' consecutive week') end phrases from weeks""")
def streak_phrases(spark, sf_dir):
    """The phrases that each week's streak of orders allows."""
    return _weeks(spark, sf_dir).select("symbol", "w", tc.allowed_streaks(F.col("run") - 1).alias("phrases"))


def _asked(text: str) -> str:
    return f"concat('S', lpad(cast(l_partkey % 25 as {text}), 2, '0'))"


@query(f"with {fx.SQL} select l_orderkey doc_id, l_linenumber, {_asked('varchar')} symbol, l_partkey % 25 in (o_custkey % 25, l_suppkey % 25) said from lineitem join orders on o_orderkey = l_orderkey")
def symbol_named(spark, sf_dir):
    """Whether a sentence on an order's and a line's symbols holds the one asked for."""
    rows = fx.table(spark, sf_dir, "lineitem").join(fx.base(spark, sf_dir).selectExpr("k l_orderkey", "symbol own"), "l_orderkey")
    rows = rows.selectExpr("l_orderkey doc_id", "l_linenumber", f"{_asked('string')} symbol", "concat('An order in ', own, ' was met from ', concat('S', lpad(cast(l_suppkey % 25 as string), 2, '0')), '.') text")
    return rows.select("doc_id", "l_linenumber", "symbol", tc.names_symbol(F.col("text"), F.col("symbol")).alias("said"))


_PHRASES = {"sweep": "sweep", "iceberg": "iceberg run", "layering": "layering cluster", "liquidity_withdrawal": "liquidity withdrawal", "post_cancel_cluster": "cancelled burst"}


@query(f"""with {fx.SQL}, {ev.EVENTS}, kinds as (select distinct symbol, trading_date, scorer_id from events), every as (select symbol, list_sort(list(distinct scorer_id)) said from kinds group by 1)
  select symbol, trading_date, list_sort(list_filter(said, lambda s: not list_contains(own, s))) others from (select symbol, trading_date, list(scorer_id) own from kinds group by all) join every using (symbol)""")
def scorer_mentions(spark, sf_dir):
    """Kinds of events that a symbol's text mentions though the day has none of them; the text is written from the events of all days."""
    kinds = ev.events(spark, sf_dir).select("symbol", "trading_date", "scorer_id").distinct()
    phrase = F.create_map(*[F.lit(x) for pair in _PHRASES.items() for x in pair])
    mention = F.concat(F.when(F.length("scorer_id") % 2 == 0, "Two ").otherwise("a "), phrase[F.col("scorer_id")], F.when(F.length("scorer_id") % 2 == 0, "s").otherwise(""))
    texts = kinds.select("symbol", mention.alias("mention")).groupBy("symbol").agg(F.concat_ws(", ", F.collect_set("mention")).alias("text"))
    days = kinds.groupBy("symbol", "trading_date").agg(F.collect_set("scorer_id").alias("own"))
    return days.join(texts, "symbol").select("symbol", "trading_date", F.array_sort(tc.other_scorers(F.concat(F.lit("Sweepstakes aside: "), F.col("text"), F.lit(".")), F.col("own"), _PHRASES)).alias("others"))


@query("""with said as (select l_orderkey, string_agg('Line ' || l_linenumber || ' sold ' || cast(l_quantity as bigint) || '.', ' ' order by l_linenumber, cast(l_quantity as bigint)) filter (where l_returnflag <> 'N') facts from lineitem group by 1)
  select o_orderkey doc_id, concat_ws(' ', case when o_orderstatus <> 'P' then 'Customer ' || o_custkey || ' asked.' end, facts, case when o_orderpriority not like '3%' then 'Priority ' || o_orderpriority || '.' end) as text from orders left join said on l_orderkey = o_orderkey""")
def stitched_texts(spark, sf_dir):
    """Texts of orders from slots: a lead, one for each line in order, and a tail; some are blank."""
    line = F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.concat(F.lit(" Line "), F.col("l_linenumber"), F.lit(" sold "), F.col("l_quantity").cast("bigint"), F.lit(". ")))
    lines = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), line.alias("slot"))))["slot"].alias("facts"))
    orders = fx.table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    lead = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Customer "), F.col("o_custkey"), F.lit(" asked.")))
    tail = F.when(F.col("o_orderpriority").startswith("3"), " ").otherwise(F.concat(F.lit("Priority "), F.col("o_orderpriority"), F.lit(". ")))
    return orders.select(F.col("o_orderkey").alias("doc_id"), tc.stitched(lead, F.coalesce("facts", F.array().cast("array<string>")), tail).alias("text"))
