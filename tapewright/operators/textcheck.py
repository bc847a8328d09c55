"""Checks of written summaries against the facts they cite, over tables of texts.

Texts are exploded to what they claim and met with facts by joins or within
the row; a claim without a fact is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words for numbers.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "dozen": 12,
}
COMPOUND = {"hundred": 100, "thousand": 1000}
# Numbers that need no fact.
YEARS = ["2025", "2026"]
# Capital words that are no tickers.
NOT_TICKERS = ["IEX", "NYSE", "NASDAQ", "ETF", "ETN", "ETP", "MCB", "MCB1", "MCB2", "MCB3", "LULD", "T1", "T2", "IPO", "IPO1", "IPO2", "IPO3", "IPOD", "NMS", "SEC", "FOMC", "SPX", "DJI", "NBBO", "VWAP", "TWAP", "HFT", "SRO", "ATS", "ET", "EDT", "EST", "UTC", "AM", "PM", "USD", "GMT", "API", "DPLS", "TOPS", "DEEP"]
# Claims of intent that a summary must not make.
INTENT = r"(?i)\b(?:manipul\w*|spoof\w*|front[- ]?run\w*|wash[- ]?trad\w*|illegal\w*|fake\w*)\b"
# What looks like a ticker.
TICKER = r"\b([A-Z]{2,5}(?:\.[A-Z]{1,2}|[.=])?)\b"
# Characters allowed besides printable ASCII, tab and line ends.
TYPOGRAPHY = "©®°±²³µμ¼½¾×÷–—‘’“”…′″™−≤≥≈"
# Written ordinals of streaks.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]
DIGITS = r"([0-9][0-9,_]*(?:\.[0-9]+)?)"


def canonical(number: Column) -> Column:
    """Without separators, trailing zeros and leading zeros; '0' for nothing."""
    plain = F.regexp_replace(number, "[,_]", "")
    short = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    bare = F.regexp_replace(short, "^0+(?=[0-9])", "")
    return F.when(bare == "", "0").otherwise(bare)


def digit_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DIGITS), F.lit(1))


def word_numbers(text: Column) -> Column:
    """Numbers written as words, compounds ('two hundred') first; words with hyphens are no numbers."""
    lower = F.lower(text)
    small = "|".join(w for w, n in NUMBER_WORDS.items() if 0 < n < 20 and w != "dozen")
    pair = rf"(?<![a-z0-9_])((?:{small})\s+(?:hundred|thousand))(?![a-z0-9_])"
    value = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, n)])
    compounds = F.transform(F.regexp_extract_all(lower, F.lit(pair), F.lit(1)), lambda p: (value[F.split(p, r"\s+")[0]] * value[F.split(p, r"\s+")[1]]).cast("string"))
    words = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
    rest = F.regexp_extract_all(F.regexp_replace(lower, pair, "#"), F.lit(rf"(?<![\w-])({words})(?![\w-])"), F.lit(1))
    return F.concat(compounds, F.transform(rest, lambda w: value[w].cast("string")))


def ungrounded_numbers(texts: DataFrame, facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, number): numbers of a text that no fact (key, value as text) of it equals, also not rounded to the number's decimals.

    Single characters and years are left out.
    """
    said = texts.select(key, F.explode(F.array_distinct(digit_numbers(F.col("text")))).alias("raw")).withColumn("number", canonical(F.col("raw")))
    said = said.filter((F.length("number") >= 2) & ~F.col("number").isin(*YEARS)).select(key, "number", F.length(F.regexp_extract("number", r"\.([0-9]+)$", 1)).alias("places")).distinct()
    f = facts.select(key, canonical(F.col("value")).alias("fact"))
    scale = F.pow(F.lit(10.0), F.col("places"))
    v, n = F.try_to_number(F.col("fact"), F.lit("999999999999999999.999999999")).cast("double"), F.col("number").cast("double")
    rounds = F.array(F.floor(v * scale + 0.5) / scale, F.floor(v * scale) / scale, F.ceil(v * scale) / scale)
    met = said.join(f, key, "left").withColumn("fits", (F.col("fact") == F.col("number")) | F.coalesce(F.exists(rounds, lambda r: F.abs(r - n) < 1e-9), F.lit(False)))
    return met.groupBy(key, "number").agg(F.max(F.coalesce("fits", F.lit(False))).alias("fits")).filter("not fits").select(key, "number")


def tickers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TICKER), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(x) for x in NOT_TICKERS]))


def unknown_tickers(texts: DataFrame, symbols: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ticker): tickers of texts that no symbol equals, with or without its suffix."""
    said = texts.select(key, F.explode(tickers(F.col("text"))).alias("ticker"))
    known = symbols.select(F.explode(F.array_distinct(F.array("symbol", F.regexp_replace("symbol", r"[.=].*$", "")))).alias("ticker")).distinct()
    return said.join(known, "ticker", "left_anti").select(key, "ticker")


def names_symbol(text: Column, symbol: Column) -> Column:
    """Whether a text holds its symbol."""
    return F.coalesce(text.contains(symbol), F.lit(False))


def intent_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(INTENT), F.lit(0))


def first_bad_character(text: Column) -> Column:
    """The first character that prose may not hold, or an empty string."""
    return F.regexp_extract(text, rf"[^\x20-\x7E\t\n\r{TYPOGRAPHY}]", 0)


def claimed_streak(text: Column, unit: str = "week") -> Column:
    """The longest 'Nth consecutive week' that a text claims, 0 if none."""
    words = "|".join(ORDINALS)
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9])((?:{words})|[0-9]+(?:st|nd|rd|th))\s+(?:consecutive|straight)\s+{unit}s?"), F.lit(1))
    value = F.create_map(*[F.lit(x) for k, w in enumerate(ORDINALS) for x in (w, k + 1)])
    return F.coalesce(F.array_max(F.transform(found, lambda w: F.coalesce(value[w], F.regexp_extract(w, "^([0-9]+)", 1).try_cast("int")))), F.lit(0))


def allowed_streaks(prior: Column, unit: str = "week") -> Column:
    """Phrases that a number of earlier periods allows."""
    names = F.array(*[F.lit(w) for w in [*ORDINALS, "thirteenth", "fourteenth"]])
    last = F.least(prior + 1, F.lit(14))
    return F.when(prior <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), lambda n: F.concat(F.lit("a "), F.element_at(names, n.cast("int")), F.lit(f" consecutive {unit}"))))


def names_agree(text: Column, symbol: Column, company: Column) -> Column:
    """Whether the words before '(SYMBOL)' end with the company's significant words; null if the symbol isn't named so."""
    clean = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, "[^A-Za-z0-9 ]", "")), r"\s+"), lambda w: (w != "") & ~w.isin("inc", "corp", "ltd", "plc", "co", "company", "the"))
    before = F.split_part(text, F.concat(F.lit(" ("), symbol, F.lit(")")), F.lit(1))
    own = clean(company)
    said = clean(before)
    n = F.size(own)
    tail = F.slice(said, F.greatest(F.size(said) - n + 1, F.lit(1)), F.greatest(n, F.lit(1)))
    return F.when(text.contains(F.concat(F.lit(" ("), symbol, F.lit(")"))), tail == own)


def missing_fields(facts: Column, paths: list[str]) -> Column:
    """Dotted paths that a JSON text doesn't have."""
    return F.filter(F.array(*[F.when(F.get_json_object(facts, f"$.{p}").isNull(), F.lit(p)) for p in paths]), lambda p: p.isNotNull())


def leaf_values(facts: Column, depth: int = 3) -> Column:
    """Values of a JSON object as text, those of objects and arrays inside it too, up to a depth; deeper ones stay as JSON."""
    nested = F.transform(F.coalesce(F.map_values(F.from_json(facts, "map<string,string>")), F.from_json(facts, "array<string>"), F.array().cast("array<string>")), lambda v: v)
    for _ in range(depth - 1):
        parts = lambda v: F.when(v.startswith("{"), F.map_values(F.from_json(v, "map<string,string>"))).when(v.startswith("["), F.from_json(v, "array<string>"))
        nested = F.flatten(F.transform(nested, lambda v: F.coalesce(parts(v), F.array(v))))
    return F.filter(nested, lambda v: v.isNotNull())


def other_scorers(text: Column, allowed: Column, names: dict[str, str]) -> Column:
    """Scorers whose names a text mentions though they are not allowed."""
    whole = lambda phrase: F.lower(text).rlike(rf"(?<![a-z0-9_]){re.escape(phrase)}s?(?![a-z0-9_])")
    said = F.filter(F.array(*[F.when(whole(phrase), F.lit(scorer)) for scorer, phrase in names.items()]), lambda s: s.isNotNull())
    return F.array_except(said, allowed)


def stitched(lead: Column, facts: Column, tail: Column) -> Column:
    """Slots of a structured text, blanks skipped."""
    slots = F.filter(F.transform(F.concat(F.array(lead), facts, F.array(tail)), lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    return F.concat_ws(" ", slots)


#: How many words back the subject of a count may stand.
LOOK_BACK = 12


def _claims(text: str, nouns: dict[str, str]) -> list[tuple[str, int, str]]:
    """(subject, count, scorer): a number before a noun, and the nearest ticker before it in the clause."""
    out, words = [], text.replace("(", " ").replace(")", " ").split()
    for at, word in enumerate(words):
        bare = word.strip(".,;:").replace(",", "")
        count = int(bare) if bare.isdigit() else NUMBER_WORDS.get(bare.lower())
        if count is None:
            continue
        after = " ".join(w.strip(".,;:").lower() for w in words[at + 1 : at + 5])
        scorer = next((s for noun, s in nouns.items() if noun in after), None)
        if scorer is None:
            continue
        for back in range(at - 1, max(-1, at - 1 - LOOK_BACK), -1):
            if words[back][-1] in ".;":
                break
            name = words[back].strip(",:")
            if 1 < len(name) <= 5 and name.isupper() and name[0].isalpha() and name not in NOT_TICKERS:
                out.append((name, count, scorer))
                break
    return out


def count_claims(texts: DataFrame, nouns: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, symbol, claimed, scorer_id): counts that texts attribute to symbols. Only the reading of a clause is Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *c) for k, t in zip(batch[key], batch["text"]) for c in _claims(t or "", nouns)]
            yield pd.DataFrame(rows, columns=[key, "symbol", "claimed", "scorer_id"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, symbol string, claimed bigint, scorer_id string")


def wrong_claims(claims: DataFrame, counts: DataFrame) -> DataFrame:
    """Claims that the counts (symbol, scorer_id, n) don't bear out; no count is 0."""
    return claims.join(counts, ["symbol", "scorer_id"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("claimed != n")


def recheck(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(was, now, n): how verdicts of stored texts change. Both have key and passed."""
    return old.select(key, F.col("passed").alias("was")).join(new.select(key, F.col("passed").alias("now")), key).groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))


def json_nodes(facts: DataFrame, key: str = "doc_id", column: str = "facts") -> DataFrame:
    """key, path, value of every node of JSON texts, of any depth; value, as text, is null for objects, arrays and nulls.

    Each text is read and parsed once: level after level is taken apart inside
    its row; the depth is that of the deepest one.
    Paths are as $.a.b[0]. What isn't JSON has no nodes.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(column), r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    shapes = facts.select(bare.alias("shape")).distinct()
    deepest = F.aggregate(F.transform(F.split("shape", ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")), lambda a: a["most"])
    depth = shapes.agg(F.max(deepest)).first()[0] or 0

    as_map = lambda n: F.try_variant_get(n["node"], "$", "map<string,variant>")
    as_list = lambda n: F.try_variant_get(n["node"], "$", "array<variant>")
    none = F.array().cast("array<struct<path:string,node:variant>>")

    def children(n: Column) -> Column:
        members = F.transform(F.map_entries(as_map(n)), lambda e: F.struct(F.concat(n["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("node")))
        items = F.transform(as_list(n), lambda x, i: F.struct(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("node")))
        return F.coalesce(members, items, none)

    told = lambda n: F.struct(n["path"].alias("path"), F.when(as_map(n).isNull() & as_list(n).isNull(), n["node"].cast("string")).alias("value"))
    out = facts.select(key, F.array(F.struct(F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("node"))).alias("level0"))
    for k in range(depth):
        out = out.withColumn(f"level{k + 1}", F.flatten(F.transform(f"level{k}", children)))
    nodes = F.concat(none, *[F.col(f"level{k}") for k in range(1, depth + 1)])
    return out.select(key, F.explode(F.transform(nodes, told)).alias("n")).select(key, "n.path", "n.value")


def missing_paths(asked: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Those of asked (key, path, as a.b[0]) at which a text's nodes have nothing, or null. An object or an array is something."""
    there = nodes.withColumn("__parent", F.regexp_extract("path", r"^(.*)(?:\.[^.\[]*|\[[0-9]+\])$", 1))
    bare = lambda p: F.regexp_replace(p, r"^\$\.?", "")
    both = F.array_compact(F.array(F.when(F.col("value").isNotNull(), bare(F.col("path"))), bare(F.col("__parent"))))
    held = there.select(key, F.explode(both).alias("path"))
    return asked.join(held, [key, "path"], "left_anti").select(key, "path")


def verdict(text: Column, allowed_numbers: Column, prior: Column, unit: str = "week") -> Column:
    """All checks of a text by itself in one struct, true where it passes: no claim of intent, only allowed characters, no streak longer than prior and one more, no numbers but allowed ones.

    Single digits and years need no fact; a null text passes.
    """
    said = F.filter(F.transform(digit_numbers(text), canonical), lambda n: (F.length(n) >= 2) & ~n.isin(*YEARS))
    checks = {
        "intent": F.size(intent_words(text)) == 0,
        "characters": first_bad_character(text) == "",
        "streak": claimed_streak(text, unit) <= prior + 1,
        "numbers": F.size(F.array_except(said, F.transform(allowed_numbers, canonical))) == 0,
    }
    return F.struct(*[F.coalesce(text.isNull() | passed, F.lit(False)).alias(name) for name, passed in checks.items()])


def changed_verdicts(stored: DataFrame, now: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, check_name, was, now, change: what each check sees otherwise than when it was stored. regressed passed then, mended passes now.

    Both have key and verdict, a struct of checks; a check that wasn't stored yet, or a text that is new, has nothing to differ from.
    """
    names = [n for n in now.schema["verdict"].dataType.names if n in stored.schema["verdict"].dataType.names]
    both = stored.select(key, F.col("verdict").alias("__was")).join(now.select(key, F.col("verdict").alias("__now")), key)
    each = both.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"__was.{n}").alias("was"), F.col(f"__now.{n}").alias("now")) for n in names])).alias("c")).select(key, "c.*")
    return each.filter("was != now").withColumn("change", F.when(F.col("was"), "regressed").otherwise("mended"))
