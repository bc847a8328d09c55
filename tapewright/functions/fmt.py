"""Session phases, durations, amounts and names as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phases of the trading day in New York, with their first minute, weight and label.
PHASES = [
    (0, "overnight", 0.80, "outside regular trading hours"),
    (240, "pre_market", 0.95, "in pre-market trading"),
    (570, "opening_5min", 1.10, "in the opening minutes of regular trading"),
    (575, "early_session", 1.02, "in the early session"),
    (690, "midday", 0.98, "around midday"),
    (840, "late_session", 1.05, "in the late session"),
    (955, "closing_5min", 1.10, "in the final minutes before the close"),
    (960, "post_market", 0.95, "in post-market trading"),
    (1200, "overnight", 0.80, "outside regular trading hours"),
]
# Fixed values: "through" phrases of the phases.
THROUGH = {
    "overnight": "outside regular trading hours",
    "pre_market": "through pre-market trading",
    "opening_5min": "through the opening minutes of regular trading",
    "early_session": "through the early session",
    "midday": "through midday",
    "late_session": "through the late session",
    "closing_5min": "through the final minutes before the close",
    "post_market": "through post-market trading",
}
# Names of trading-halt reasons.
HALT_REASONS = {
    "T1": "news-pending halt",
    "T2": "news-dissemination halt",
    "IPO1": "IPO opening-auction halt",
    "IPO2": "IPO order-acceptance halt",
    "IPO3": "IPO pre-launch halt",
    "IPOD": "IPO deferred halt",
    "MCB1": "market-wide circuit-breaker level-1 halt",
    "MCB2": "market-wide circuit-breaker level-2 halt",
    "MCB3": "market-wide circuit-breaker level-3 halt",
    "LUDP": "LULD price-band halt",
}
# Words that end security names without belonging to the company's name.
DECORATION = ["common", "stock", "shares", "ordinary", "ordinaries", "class", "series", "adr", "ads", "preferred", "preference", "depositary", "receipts"]


# What scorers are called in tables of days and of weeks.
SCORER_NAMES = {
    "halt": "Trading halts",
    "large_trade": "Large block trades",
    "sweep": "Multi-level sweeps",
    "layering": "Layering",
    "post_cancel_cluster": "Rapid quote-cycling",
    "iceberg": "Iceberg executions",
    "liquidity_withdrawal": "Liquidity withdrawals",
    "volume_deviation": "Volume surges",
    "time_in_book_drift": "Order-lifetime drift",
}
WEEK_SCORER_NAMES = SCORER_NAMES | {"iceberg": "Iceberg execution", "post_cancel_cluster": "Post-cancel clusters", "time_in_book_drift": "Order-lifetime regime shifts"}


def scorer_name(scorer_id: Column, weekly: bool = False) -> Column:
    """The name of a scorer; an unknown one's id."""
    return _lookup(scorer_id, WEEK_SCORER_NAMES if weekly else SCORER_NAMES, scorer_id)


def json_number(json: Column, path: str) -> Column:
    """A number in a JSON text, also if it is written with thousands separators; null if there is none."""
    return F.regexp_replace(F.get_json_object(json, path), ",", "").try_cast("double")


def json_merged(json: Column, new: Column) -> Column:
    """A flat JSON object with the members of another one set, as text; members of new that are null are left out."""
    kind = "map<string,string>"
    base, more = F.coalesce(F.from_json(json, kind), F.create_map().cast(kind)), F.map_filter(F.coalesce(F.from_json(new, kind), F.create_map().cast(kind)), lambda k, v: v.isNotNull())
    return F.to_json(F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(more), k)), more))


def json_without(json: Column, *names: str) -> Column:
    return F.to_json(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: ~k.isin(*names)))


def rounded(value: Column, digits: int) -> Column:
    """Half up, also for negative numbers: floor(v * 10^d + 0.5) / 10^d."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def instant(ts_nanos: Column) -> Column:
    return F.timestamp_micros(F.floor(ts_nanos / 1000).cast("bigint"))


def new_york(ts_nanos: Column) -> Column:
    return F.from_utc_timestamp(instant(ts_nanos), "America/New_York")


def new_york_time(ts_nanos: Column) -> Column:
    return F.date_format(new_york(ts_nanos), "HH:mm")


def _by_phase(ts_nanos: Column, place: int) -> Column:
    local = new_york(ts_nanos)
    minute = F.hour(local) * 60 + F.minute(local)
    out = F.when(ts_nanos.isNull(), F.lit(None))
    for nxt, row in zip(PHASES[1:], PHASES):
        out = out.when(minute < nxt[0], row[place])
    return out.otherwise(PHASES[-1][place])


def session_phase(ts_nanos: Column) -> Column:
    return _by_phase(ts_nanos, 1)


def phase_weight(ts_nanos: Column) -> Column:
    return _by_phase(ts_nanos, 2)


def phase_label(ts_nanos: Column) -> Column:
    return _by_phase(ts_nanos, 3)


def _lookup(value: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value], other)


def halt_span(start: Column, end: Column) -> Column:
    first, last = phase_label(start), phase_label(end)
    return (
        F.when(start.isNull(), F.lit(None))
        .when(end.isNull(), F.concat(F.lit("starting "), first, F.lit(" with no resume in the window")))
        .when(first == last, F.concat(F.lit("lasting "), _lookup(session_phase(start), THROUGH, F.lit(""))))
        .otherwise(F.concat(F.lit("starting "), first, F.lit(" and resuming "), last))
    )


def halt_reason(reason: Column) -> Column:
    return _lookup(F.coalesce(F.upper(F.trim(reason)), F.lit("")), HALT_REASONS, F.lit("trading halt"))


def duration(nanos: Column) -> Column:
    """Short text in the unit that fits, of nanoseconds as whole numbers or decimals."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    sec = div(nanos, 1_000_000_000)
    return (
        F.when(nanos.isNull(), F.lit(None))
        .when(nanos < 0, "unknown")
        .when(nanos < 1_000, F.concat(nanos.cast("string"), F.lit(" ns")))
        .when(nanos < 1_000_000, F.format_string("%.2f μs", nanos.cast("double") / 1e3))
        .when(nanos < 1_000_000_000, F.format_string("%.1f ms", nanos.cast("double") / 1e6))
        .when(nanos < 60_000_000_000, F.format_string("%.1f sec", nanos.cast("double") / 1e9))
        .when(sec < 3600, F.format_string("%dm %ds", div(sec, 60), sec % 60))
        .otherwise(F.format_string("%dh %dm", div(sec, 3600), div(sec % 3600, 60)))
    )


def _counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("bigint").cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))


def duration_words(seconds: Column) -> Column:
    """Whole words with plurals: '1 minute 5 seconds'."""
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    rest_s, rest_m = seconds % 60, F.floor(seconds % 3600 / 60)
    return (
        F.when(seconds < 0, "unknown duration")
        .when(seconds < 60, _counted(seconds, "second"))
        .when(seconds < 3600, F.concat_ws(" ", _counted(minutes, "minute"), F.when(rest_s > 0, _counted(rest_s, "second"))))
        .when(seconds.isNotNull(), F.concat_ws(" ", _counted(hours, "hour"), F.when(rest_m > 0, _counted(rest_m, "minute"))))
    )


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def dollars(v: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(v, 2))


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("bigint").cast("string"), end)


def listed(names: Column) -> Column:
    """'A', 'A and B', 'A, B and C', and beyond four 'A, B, C and N others'."""
    n = F.size(names)
    head = lambda k: F.array_join(F.slice(names, 1, k), ", ")
    return (
        F.when(n <= 1, F.array_join(names, ""))
        .when(n <= 4, F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(names, F.greatest(n, F.lit(1)))))
        .otherwise(F.concat(head(3), F.lit(" and "), (n - 3).cast("string"), F.lit(" others")))
    )


# What follows a company's name in listings: partnership units, maturities, states of incorporation.
SUFFIXES = [
    r"\s*-?\s*Common\s+Units\s+representing\s+Limited\s+Partner\s+Interests\s*$",
    r"\s+due\s+[A-Za-z]+(?:\s+\d{1,2})?(?:,?\s+\d{4})?\s*$",
    r"\s*/(?:al|ak|az|ar|ca|co|ct|de|fl|ga|hi|id|il|in|ia|ks|ky|la|me|md|ma|mi|mn|ms|mo|mt|ne|nv|nh|nj|nm|ny|nc|nd|oh|ok|or|pa|ri|sc|sd|tn|tx|ut|vt|va|wa|wv|wi|wy|dc)\s*$",
]


def company(name: Column) -> Column:
    """A security's name without what filings add: share classes, series, countries, maturities."""
    out = F.trim(F.regexp_replace(F.trim(name), r"\s+", " "))
    for suffix in SUFFIXES:
        out = F.trim(F.regexp_replace(out, "(?i)" + suffix, ""))
    words = "|".join(DECORATION)
    odd = "[^A-Za-z0-9\\s]*"
    dropped = rf"(?:\([A-Z][a-z]+\)|{odd}(?:(?i:{words})|[A-Za-z]|[0-9]+)?{odd})"
    out = F.regexp_replace(out, rf"(?:(?:^|\s+){dropped})+$", "")
    return F.trim(F.regexp_replace(out, r"[,\s\-]+$", ""))


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def quarter_start(day: Column) -> Column:
    return F.date_trunc("quarter", day).cast("date")


def year_start(day: Column) -> Column:
    return F.date_trunc("year", day).cast("date")


def retention_boundary(day: Column, weeks: int) -> Column:
    """Monday of the day's week, some weeks earlier; whole weeks before it may go."""
    return F.date_sub(week_start(day), 7 * weeks)


# Words whose case is their own.
ENTITY_FORMS = {"inc": "Inc", "corp": "Corp", "ltd": "Ltd", "plc": "plc", "llc": "LLC", "lp": "LP", "nv": "N.V.", "ag": "AG", "sa": "S.A."}


def mixed_case(name: Column) -> Column:
    return F.coalesce(name.rlike("[a-z]") & name.rlike("[A-Z]"), F.lit(False))


def title_case(name: Column) -> Column:
    """A name in capitals with each word's first letter kept large and entity words in their own form; other names as they are."""

    def one(word: Column) -> Column:
        bare = F.regexp_replace(word, "[^a-z]", "")
        form = F.create_map(*[F.lit(x) for pair in ENTITY_FORMS.items() for x in pair])[bare]
        tail = F.regexp_extract(word, "([^a-z0-9]*)$", 1)
        plain = F.concat(F.upper(F.substring(word, 1, 1)), F.regexp_replace(word, "^.", ""))
        return F.coalesce(F.concat(form, tail), plain)

    words = F.transform(F.split(F.lower(name), r"\s+"), one)
    return F.when(mixed_case(name) | ~name.rlike("[A-Z]"), name).otherwise(F.array_join(words, " "))


def better_name(listed_name: Column, title: Column) -> Column:
    """The title, unless only the listed name is in mixed case; titles in capitals are put in title case."""
    prefer = F.coalesce(F.trim(listed_name) == "", F.lit(True)) | mixed_case(title) | ~mixed_case(listed_name)
    return F.when(title.isNotNull() & prefer, title_case(title)).otherwise(listed_name)
