"""Queries on counts that texts attribute to symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: What orders of a fate stand for, as events: three kinds a symbol and day.
_KINDS = ["sweep", "halt", "liquidity_withdrawal"]
_WRITTEN = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]


def _names(engine: str) -> str:
    """A symbol's name in letters, as tickers are: SA to SZ for S00 to S25."""
    return "chr(65 + cast(substring(symbol, 2, 2) as int))" if engine == "spark" else "chr(65 + cast(substring(symbol, 2, 2) as integer))"


def _said(n: str, text: str) -> str:
    """A number in words up to twelve, else in digits."""
    return f"case {' '.join(f'when {n} = {k} then {chr(39)}{w}{chr(39)}' for k, w in enumerate(_WRITTEN))} else cast({n} as {text}) end"


def _text(engine: str) -> str:
    """A text for each symbol and day, of seven shapes; a, b, c are the symbols of a claim and x, y, z what is said of them."""
    t = "string" if engine == "spark" else "varchar"
    x, y, z = (_said(n, t) for n in "xyz")
    return f"""case shape
      when 0 then concat(a, ' recorded ', {x}, ' sweeps over the session.')
      when 1 then concat('There were ', {y}, ' trading halts on ', a, ', and ', {x}, ' aggressive sweeps for ', a, '.')
      when 2 then concat(a, ', ', b, ' and ', c, ' collectively saw ', cast(z as {t}), ' order-deletion events.')
      when 3 then concat(a, ' was quiet while ', {x}, ' sweeps hit ', b, '.')
      when 4 then concat(a, ' had ', cast(w as {t}), ' events split between sweeps and halts.')
      when 5 then concat('The ', b, ' book thinned; ', {y}, ' regulatory-halts came, and in the end ', a, ' saw ', {x}, ' sweep patterns.')
      else concat('ZZ printed ', {x}, ' icebergs, but nobody in ', a, ' counted any halts.') end"""


def _claims_frame(engine: str) -> str:
    """Rows d, symbol, shape, a, b, c, w, x, y, z from counts n0, n1, n2 by symbol and day; one in three says one too many."""
    name = _names(engine)
    return f"""select d, symbol, cast((d + i) % 7 as int) shape, concat('S', {name}) a,
      concat('S', lead({name}, 1, 'A') over w) b, concat('S', lead({name}, 2, 'B') over w) c,
      n0 + n1 + n2 + odd w, n0 + odd x, n1 + odd y, n2 + lead(n2, 1, 0) over w + lead(n2, 2, 0) over w + odd z
      from (select *, cast(substring(symbol, 2, 2) as int) i, case when (d + cast(substring(symbol, 2, 2) as int)) % 3 = 0 then 1 else 0 end odd from counts)
      window w as (partition by d order by symbol)"""


_COUNTS = "select d, symbol, count(case when fate < 5 then 1 end) n0, count(case when fate in (5, 6) then 1 end) n1, count(case when fate > 6 then 1 end) n2 from base group by d, symbol"

_TRUTH = " union all ".join(f"select d, concat('S', {_names('duck')}) name, '{kind}' scorer_id, n{k} n from counts" for k, kind in enumerate(_KINDS))


def _expected() -> str:
    """The claims that each shape makes: claim number, symbols, count, kind and noun."""
    row = lambda shape, no, symbols, n, kind, noun: f"select d, symbol, {no} claim_no, {symbols} symbols, {n} claimed, {kind} scorer_id, '{noun}' noun from said where shape = {shape}"
    return " union all ".join([
        row(0, 0, "[a]", "x", "'sweep'", "sweeps"),
        row(1, 0, "[a]", "y", "'halt'", "trading halts"),
        row(1, 1, "[a]", "x", "'sweep'", "aggressive sweeps"),
        row(2, 0, "[a, b, c]", "z", "'liquidity_withdrawal'", "order-deletion events"),
        row(3, 0, "[b]", "x", "'sweep'", "sweeps"),
        row(4, 0, "[a]", "w", "null", "events"),
        row(5, 0, "[b]", "y", "'halt'", "regulatory-halts"),
        row(5, 1, "[a]", "x", "'sweep'", "sweep patterns"),
        row(6, 0, "['ZZ']", "x", "'iceberg'", "icebergs"),
    ])


def attributed_claims(spark, sf_dir):
    """Claims of a text for each symbol and day, with words, digits, several symbols, clauses and an unknown symbol."""
    counts = spark.sql(_COUNTS.replace("from base", "from {rows}"), rows=fx.base(spark, sf_dir))
    said = spark.sql(_claims_frame("spark").replace("from counts)", "from {rows})"), rows=counts)
    texts = said.selectExpr("d * 100 + cast(substring(symbol, 2, 2) as int) doc_id", "d", f"{_text('spark')} text")
    found = claims.attributed_counts(texts).withColumn("d", F.floor(F.col("doc_id") / 100))
    name = F.concat(F.lit("S"), F.expr(_names("spark")))
    truth = counts.select("d", name.alias("name"), F.explode(F.array(*[F.struct(F.lit(kind).alias("scorer_id"), F.col(f"n{k}").alias("n")) for k, kind in enumerate(_KINDS)])).alias("t")).select("d", "name", "t.*").filter("n > 0")
    # A symbol's counts are those of its day, so days are part of the names that claims and counts meet by.
    of_day = lambda symbol: F.concat(F.col("d").cast("string"), F.lit("|"), symbol)
    dated = found.withColumn("symbols", F.expr("transform(symbols, s -> concat(cast(d as string), '|', s))"))
    done = claims.judged(dated, truth.select(of_day(F.col("name")).alias("symbol"), "scorer_id", "n"))
    return done.select("doc_id", F.col("claim_no").cast("bigint").alias("claim_no"), F.expr("array_join(transform(symbols, s -> substring_index(s, '|', -1)), ',')").alias("symbols"), "claimed", "scorer_id", "noun", "actual", "verdict")


QUERIES["attributed_claims"] = attributed_claims
ORACLE_SQL["attributed_claims"] = f"""with {fx.SQL}, counts as ({_COUNTS}), said as ({_claims_frame('duck')}), expected as ({_expected()}),
truth as (select * from ({_TRUTH}) where n > 0), totals as (select d, name, sum(n) total from truth group by 1, 2),
each_ as (select d, symbol, claim_no, scorer_id, unnest(symbols) name from expected),
summed as (select e.d, e.symbol, e.claim_no, bool_or(total is null) unknown_, sum(case when e.scorer_id is null then total else coalesce(n, 0) end) actual
  from each_ e left join totals t on e.d = t.d and e.name = t.name left join truth u on e.d = u.d and e.name = u.name and e.scorer_id = u.scorer_id group by 1, 2, 3)
select e.d * 100 + cast(substring(e.symbol, 2, 2) as integer) doc_id, cast(claim_no as bigint) claim_no, array_to_string(symbols, ',') symbols, cast(claimed as bigint) claimed, e.scorer_id, noun,
  case when not unknown_ then cast(actual as bigint) end actual, case when unknown_ then 'unknown_symbol' when claimed = actual then 'right' else 'wrong' end verdict
from expected e join summed s using (d, symbol, claim_no)"""
