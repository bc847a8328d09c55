"""Summary tables of scored events, by day, week, quarter and year.

Events have trading_date, symbol, ts_nanos, scorer_id, score, n_rows,
total_shares and event_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt
from .patterns import first_rows

DAY_LEVEL = ("volume_deviation", "time_in_book_drift")


def headline(events: DataFrame, k: int = 5) -> DataFrame:
    """The k strongest events of all days."""
    return events.orderBy(F.desc("score"), "ts_nanos", "event_id").limit(k)


def top_per_scorer(events: DataFrame, k: int = 5) -> DataFrame:
    return first_rows(events, ["trading_date", "scorer_id"], [F.desc("score"), "ts_nanos", "event_id"], k, "place")


def phase_of(events: DataFrame) -> Column:
    """Session phase from the time; events of a whole day have none."""
    return F.when(F.col("scorer_id").isin(*DAY_LEVEL), "unknown").otherwise(F.coalesce(fmt.session_phase(F.col("ts_nanos")), F.lit("unknown")))


def counts(events: DataFrame, *keys: Column | str) -> DataFrame:
    return events.groupBy("trading_date", *keys).agg(F.count(F.lit(1)).alias("n_events"))


def _shares(events: DataFrame, by: str, keys: list[str]) -> DataFrame:
    n = events.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def concentration(events: DataFrame, by: str = "symbol", keys: tuple[str, ...] = ("trading_date",)) -> DataFrame:
    """Herfindahl index of event counts, and the largest share."""
    return _shares(events, by, list(keys)).groupBy(*keys).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top_share"), F.count(F.lit(1)).alias("n_members"))


def mix_entropy(events: DataFrame, by: str = "scorer_id", keys: tuple[str, ...] = ("trading_date",)) -> DataFrame:
    """Entropy of the mix, in nats and over the log of the number of members."""
    h = F.sum(-F.col("share") * F.log("share"))
    n = F.count(F.lit(1))
    return _shares(events, by, list(keys)).groupBy(*keys).agg(h.alias("entropy_nats"), F.when(n >= 2, h / F.log(n.cast("double"))).alias("entropy_normalised"))


def day_summary(events: DataFrame) -> DataFrame:
    """One row for each day: totals, dominant scorer and symbol, concentration, entropy."""
    total = events.groupBy("trading_date").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("symbol").alias("n_symbols"), F.max("score").alias("top_score"))
    by = lambda c: first_rows(events.groupBy("trading_date", c).agg(F.count(F.lit(1)).alias("n")), ["trading_date"], [F.desc("n"), c]).select("trading_date", F.col(c).alias(f"dominant_{c}"), F.col("n").alias(f"dominant_{c}_events"))
    out = total
    for part in (by("scorer_id"), by("symbol"), concentration(events), mix_entropy(events)):
        out = out.join(part, "trading_date")
    return out


def top_symbols(events: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The k symbols of most events; ties by symbol."""
    n = events.groupBy(*keys, "symbol").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("trading_date").alias("n_days"))
    return first_rows(n, list(keys), [F.desc("n_events"), "symbol"], k, "place") if keys else n.orderBy(F.desc("n_events"), "symbol").limit(k)


def extremes(events: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """For each day and metric (name -> scorer and column) the event of the largest value; ties by id."""
    rows = None
    for name, (scorer, column) in metrics.items():
        own = events.filter((F.col("scorer_id") == scorer) & F.col(column).isNotNull())
        best = own.groupBy("trading_date").agg(F.min_by(F.struct("event_id", "symbol", F.col(column).cast("double").alias("value")), F.struct(-F.col(column).cast("double"), "event_id")).alias("best"))
        part = best.select("trading_date", F.lit(name).alias("metric"), "best.event_id", "best.symbol", "best.value")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def percent_change(now: Column, before: Column) -> Column:
    """Whole percent, half up; from 0 to more is 100."""
    return F.when(before == 0, F.when(now > 0, 100).otherwise(0)).otherwise(F.floor((now - before) * 100.0 / before + 0.5)).cast("bigint")


def vs_prior_day(summary: DataFrame) -> DataFrame:
    """day_summary() rows against those of the trading day before."""
    along = Window.partitionBy(F.lit(1)).orderBy("trading_date")  # one row for each trading day
    rows = summary.withColumns({f"prior_{c}": F.lag(c).over(along) for c in ("trading_date", "n_events", "dominant_scorer_id", "dominant_symbol")})
    rows = rows.filter("prior_trading_date is not null")
    return rows.select("trading_date", "prior_trading_date", "n_events", "prior_n_events", percent_change(F.col("n_events"), F.col("prior_n_events")).alias("change_pct"), (F.col("dominant_scorer_id") == F.col("prior_dominant_scorer_id")).alias("scorer_persisted"), (F.col("dominant_symbol") == F.col("prior_dominant_symbol")).alias("symbol_persisted"))


def scorer_changes(events: DataFrame, day: str, before: str) -> DataFrame:
    """Counts by scorer of two days; a scorer missing on one counts 0 there."""
    of = lambda d, name: events.filter(F.col("trading_date") == F.lit(d).cast("date")).groupBy("scorer_id").agg(F.count(F.lit(1)).alias(name))
    both = of(day, "now").join(of(before, "before"), "scorer_id", "full_outer").fillna(0, ["now", "before"])
    return both.withColumn("change_pct", percent_change(F.col("now"), F.col("before")))


def top_streaks(events: DataFrame, by: str = "symbol", cap: int = 60) -> DataFrame:
    """For each day, its top member and for how many trading days in a row it has been so, at most cap."""
    top = first_rows(events.groupBy("trading_date", by).agg(F.count(F.lit(1)).alias("n")), ["trading_date"], [F.desc("n"), by])
    along = Window.partitionBy(F.lit(1)).orderBy("trading_date")  # one row for each trading day
    rows = top.withColumn("__day", F.row_number().over(along))
    run = F.col("__day") - F.row_number().over(Window.partitionBy(by).orderBy("__day"))
    rows = rows.withColumn("__run", run)
    length = F.row_number().over(Window.partitionBy(by, "__run").orderBy("__day"))
    return rows.select("trading_date", by, F.col("n").alias("n_events"), F.least(length, F.lit(cap)).cast("bigint").alias("streak"))


def day_aggregates(events: DataFrame) -> DataFrame:
    """Long rows (trading_date, kind, member, n): counts by scorer, phase and symbol, from which periods are rolled up."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("member")) for k, v in (("scorer", F.col("scorer_id")), ("phase", phase_of(events)), ("symbol", F.col("symbol")))])
    return events.select("trading_date", F.explode(kinds).alias("x")).groupBy("trading_date", "x.kind", "x.member").agg(F.count(F.lit(1)).alias("n"))


def roll_up(aggregates: DataFrame, period: Column, top: int = 12, exact: bool = True) -> DataFrame:
    """period, kind, member, n, n_days: counts of days summed by period; of symbols the top ones.

    exact: symbols are summed over all rows of all days; else over each day's ten first ones, as summaries of summaries do.
    """
    rows = aggregates.withColumn("period", period)
    if not exact:
        ranked = first_rows(rows, ["trading_date", "kind"], [F.desc("n"), "member"], 10)
        rows = rows.filter("kind != 'symbol'").unionByName(ranked.filter("kind = 'symbol'"))
    summed = rows.groupBy("period", "kind", "member").agg(F.sum("n").alias("n"), F.count_distinct("trading_date").alias("n_days"))
    place = F.row_number().over(Window.partitionBy("period", "kind").orderBy(F.desc("n"), "member"))
    return summed.withColumn("place", place).filter((F.col("kind") != "symbol") | (F.col("place") <= top)).drop("place")


def gated(periods: DataFrame, parent: Column, least: int) -> DataFrame:
    """Parents (quarters of weeks, years of quarters) that have at least so many verified children. periods: period, verified."""
    return periods.withColumn("parent", parent).groupBy("parent").agg(F.count_if("verified").alias("n_verified"), F.count(F.lit(1)).alias("n_children")).filter(F.col("n_verified") >= least)


def newest_before(periods: DataFrame, period: str, n: int) -> DataFrame:
    """The n newest periods before one."""
    return periods.filter(F.col("period") < F.lit(period).cast("date")).orderBy(F.desc("period")).limit(n)


def bullets(summary: DataFrame) -> DataFrame:
    """A sentence for each day."""
    text = F.concat(fmt.thousands(F.col("n_events")), F.lit(" events on "), F.col("n_symbols").cast("string"), F.lit(" symbols; most were "), F.col("dominant_scorer_id"), F.lit(" ("), F.col("dominant_scorer_id_events").cast("string"), F.lit("), led by "), F.col("dominant_symbol"))
    return summary.select("trading_date", text.alias("bullet"))


def coverage(events: DataFrame, column: str) -> DataFrame:
    """By scorer: rows, rows that have a value, and its mean, least and largest."""
    v = F.col(column).cast("double")
    return events.groupBy("scorer_id").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("with_value"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("largest"), F.count_if(v < 0).alias("below_zero"))


def prune_report(texts: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Of stored texts: how many are kept, no longer reachable, or superseded by a better or newer one. texts: keys, verified, created."""
    reachable = texts.join(selected.select(*keys).distinct().withColumn("reachable", F.lit(True)), keys, "left").fillna(False, ["reachable"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("verified"), F.desc("created")))
    ranked = reachable.withColumn("place", place)
    return ranked.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reachable") & (F.col("place") == 1)).alias("keep"), F.count_if(~F.col("reachable")).alias("unreachable"), F.count_if(F.col("reachable") & (F.col("place") > 1)).alias("superseded"))


def best_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    return first_rows(texts, keys, [F.desc("verified"), F.desc("created")])


def event_texts(events: DataFrame, interpretations: DataFrame, narratives: DataFrame, keys: list[str]) -> DataFrame:
    """Events with their newest interpretation, or else narrative (tables of keys, text, created)."""
    newest = lambda df, name: df.groupBy(*keys).agg(F.max_by("text", "created").alias(name))
    return events.join(newest(interpretations, "interpretation"), keys, "left").join(newest(narratives, "narrative"), keys, "left").withColumn("text", F.coalesce("interpretation", "narrative")).drop("interpretation", "narrative")


def content_hash(rows: DataFrame, keys: list[str], order: list[str], parts: list[str]) -> DataFrame:
    """SHA-256 over ordered parts, to see whether a period's children changed. A key's rows meet in one value; see periods.chunked_hash() for periods of very many rows."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, *[p for p in parts if p not in order]))), lambda s: F.concat_ws("\x00", *[s[p].cast("string") for p in parts]))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(listed, "\x1e"), 256).alias("content_hash"))


def changed(hashes: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hash is new or differs from the stored one."""
    return hashes.join(stored.withColumnRenamed("content_hash", "stored_hash"), keys, "left").filter(~F.col("content_hash").eqNullSafe(F.col("stored_hash"))).drop("stored_hash")


def date_scope(dates: DataFrame, ranges: DataFrame) -> DataFrame:
    """Weekdays named one by one (day) or by ranges (a, b), either way round, each once."""
    one = dates.select(F.col("day").alias("a"), F.col("day").alias("b")).distinct().unionByName(ranges.select(F.to_date("a").alias("a"), F.to_date("b").alias("b")))
    days = one.select(F.explode(F.sequence(F.least("a", "b"), F.greatest("a", "b"))).alias("day")).distinct()
    return days.filter(F.weekday("day") < 5)


def touched_periods(days: DataFrame) -> DataFrame:
    """Weeks, quarters and years that days fall into."""
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), f(F.col("day")).alias("start")) for n, f in (("week", fmt.week_start), ("quarter", fmt.quarter_start), ("year", fmt.year_start))])
    return days.select(F.inline(kinds)).distinct()


def forward_ranges(periods: DataFrame) -> DataFrame:
    """kind, start and end (exclusive) of periods, with the days from one to the next."""
    step = F.when(F.col("kind") == "week", F.date_add("start", 7)).when(F.col("kind") == "quarter", F.add_months("start", 3)).otherwise(F.add_months("start", 12))
    return periods.select("kind", "start", step.alias("end"), F.datediff(step, "start").alias("n_days"))


def scorer_mix(events: DataFrame) -> DataFrame:
    """By symbol, events, days, and its mix of scorers as a map."""
    n = events.groupBy("symbol", "scorer_id").agg(F.count(F.lit(1)).alias("n"))
    days = events.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("trading_date").alias("n_days"))
    mix = n.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("scorer_id", "n")))).alias("mix"))  # as many as scorers
    return days.join(mix, "symbol")


def digest(selected: DataFrame, texts: DataFrame) -> DataFrame:
    """trading_date, place, phase, event_id, symbol, scorer_id, score, text: the order in which a day is told.

    Events of the whole day come first, then the phases of the day in their
    order, the strongest first; the text is that of texts (event_id,
    interpretation, narrative), interpretation before narrative. A day has at
    most as many events as are selected of it.
    """
    phases = list(dict.fromkeys(p[1] for p in fmt.PHASES))
    order = F.array_position(F.array(*[F.lit(p) for p in ("unknown", *phases)]), F.col("phase"))
    told = selected.join(texts.select("event_id", F.coalesce("interpretation", "narrative").alias("text")), "event_id", "left").withColumn("phase", phase_of(selected))
    place = F.row_number().over(Window.partitionBy("trading_date").orderBy(order, F.desc("score"), "ts_nanos", "event_id"))
    return told.select("trading_date", place.cast("bigint").alias("place"), "phase", "event_id", "symbol", "scorer_id", "score", "text")


def headline_text(events: DataFrame) -> Column:
    """A line on an event: what it is, where, when in New York, its size; parts that are null are left out."""
    size = F.when(F.col("total_shares") > 0, F.concat(fmt.thousands(F.col("total_shares")), F.lit(" shares")))
    rows = F.when(F.col("n_rows") > 0, F.concat(fmt.thousands(F.col("n_rows")), F.lit(" orders")))
    time = F.when(~F.col("scorer_id").isin(*DAY_LEVEL), F.concat(F.lit("at "), fmt.new_york_time(F.col("ts_nanos"))))
    return F.concat_ws(", ", F.concat(fmt.scorer_name(F.col("scorer_id")), F.lit(" in "), F.col("symbol")), time, rows, size)


def rebuild_scope(days: DataFrame) -> DataFrame:
    """day, week_start, week_day: the days whose tables are built anew, and Monday to Friday of each one's week."""
    weeks = days.select(fmt.week_start(F.col("day")).alias("week_start")).distinct()
    return weeks.select("week_start", F.explode(F.sequence("week_start", F.date_add("week_start", 4))).alias("day"))


def published_dates(selected: DataFrame) -> DataFrame:
    """Dates that have published events, with counts."""
    return selected.groupBy("trading_date").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("symbol").alias("n_symbols"))


def one_day(selected: DataFrame, day: str | None = None) -> DataFrame:
    """A day's events by scorer and rank, by default the latest day's."""
    when = selected.agg(F.max("trading_date").alias("trading_date")) if day is None else selected.select(F.lit(day).cast("date").alias("trading_date")).limit(1)
    return selected.join(F.broadcast(when), "trading_date").select("trading_date", "scorer_id", "narration_rank", "event_id", "symbol", "score")  # one row


def one_symbol(selected: DataFrame, symbol: str) -> DataFrame:
    return selected.filter(F.col("symbol") == symbol).groupBy("symbol", "trading_date").agg(F.count(F.lit(1)).alias("n_events"), F.max("score").alias("top_score"))
