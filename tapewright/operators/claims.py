"""Counts that texts attribute to symbols, read clause by clause and held against the counts of events.

Reading a text is a small pass over its words in Python; who is right is a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcheck import NUMBER_WORDS

# What events are called.
NOUNS = {
    "halt": ["halt", "halts", "trading halt", "trading halts", "trading suspension", "trading suspensions", "regulatory halt", "regulatory halts", "regulatory suspension", "regulatory suspensions", "trading interruption", "trading interruptions", "pre-market halt", "pre-market halts"],
    "large_trade": ["large trade", "large trades", "large block", "large blocks", "large-block trade", "large-block trades", "block trade", "block trades", "block execution", "block executions", "block print", "block prints"],
    "sweep": ["sweep", "sweeps", "sweep event", "sweep events", "sweep pattern", "sweep patterns", "multi-level sweep", "multi-level sweeps", "aggressive sweep", "aggressive sweeps"],
    "iceberg": ["iceberg", "icebergs", "iceberg pattern", "iceberg patterns", "iceberg order", "iceberg orders", "iceberg execution", "iceberg executions"],
    "layering": ["layering", "layering event", "layering events", "layering pattern", "layering patterns", "layering burst", "layering bursts"],
    "post_cancel_cluster": ["post-cancel cluster", "post-cancel clusters", "post-cancel burst", "post-cancel bursts", "post-cancel event", "post-cancel events", "post cancel cluster", "post cancel clusters"],
    "liquidity_withdrawal": ["liquidity withdrawal", "liquidity withdrawals", "quote pull", "quote pulls", "cancel storm", "cancel storms", "depth contraction", "depth contractions", "order-deletion event", "order-deletion events", "order deletion event", "order deletion events"],
    "volume_deviation": ["volume surge", "volume surges", "volume deviation", "volume deviations", "volume spike", "volume spikes"],
    "time_in_book_drift": ["time-in-book drift", "drift event", "drift events", "lifetime regime shift"],
}
# Nouns that stand for events of any kind.
ANY_EVENT = ["event", "events", "incident", "incidents", "occurrence", "occurrences", "pattern", "patterns", "occasion", "occasions", "instance", "instances", "print", "prints"]
# Words after a noun that lead to its symbol.
LINKS = ["on", "for", "from", "across", "hit", "in", "by"]
# Words by which a count is that of several symbols together.
TOGETHER = ["collectively", "together", "combined", "jointly"]
# Words at which a clause with another subject begins.
NEW_CLAUSE = ["while", "whereas", "where", "though", "although", "but", "however", "as", "since", "because", "yet", "still", "meanwhile", "alongside", "before", "after", ";"]
# How far a reader looks, in words and characters.
WORDS_BACK, CHARS_BACK, WORDS_ON, CHARS_ON = 12, 200, 4, 60
GROUP_WORDS_BACK, GROUP_WORDS_ON, GROUP_CHARS_ON, GROUP_LOOSE = 15, 20, 80, 3

#: Nouns are looked up with spaces for hyphens, so those that are only listed with hyphens stand for events of any kind.
_KIND = {noun: kind for kind, nouns in NOUNS.items() for noun in nouns}
_NOUN = re.compile(r"\b(?:" + "|".join(re.sub(" ", r"[\\s-]+", re.escape(n).replace(r"\ ", " ")) for n in sorted([*(n for ns in NOUNS.values() for n in ns), *ANY_EVENT], key=len, reverse=True)) + r")\b", re.IGNORECASE | re.ASCII)
_WORD = re.compile("(?:\\S|[\x85\xa0  ])+")
_DIGITS = re.compile(r"[0-9][0-9,_]*")
_WRITTEN = re.compile(r"(?<![\w-])(?:" + "|".join(NUMBER_WORDS) + r")(?![\w-])")
_SYMBOL = re.compile(r"[A-Z]{2,5}(?:\.[A-Z]{1,2})?")


@dataclass(frozen=True)
class Word:
    """A word with its place in the text and what it can be."""

    raw: str
    start: int
    bare: str = field(init=False)
    symbol: str | None = field(init=False)
    count: int | None = field(init=False)

    def __post_init__(self):
        bare = re.sub("^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", self.raw)
        name = re.sub("^[^A-Za-z0-9.=]+|[,;:!?.]+$", "", self.raw)
        for what, value in (("bare", bare), ("symbol", name if _SYMBOL.fullmatch(name) else None), ("count", _count(bare))):
            object.__setattr__(self, what, value)


def _count(bare: str) -> int | None:
    if _DIGITS.fullmatch(bare):
        n = int(bare.replace(",", "").replace("_", ""))
        return n if n < 1 << 31 else None
    values = {NUMBER_WORDS[w] for w in _WRITTEN.findall(bare.lower())}
    return values.pop() if len(values) == 1 else None


def _words(text: str, start: int, end: int) -> list[Word]:
    return [Word(m[0], start + m.start()) for m in _WORD.finditer(text[start:end])]


def _kind(noun: str) -> str | None:
    return _KIND.get(re.sub(r"[\s-]+", " ", noun.lower()).strip())


def _together(text: str, taken: set[int]) -> Iterator[tuple]:
    """Claims such as 'A, B and C together had 7 halts'."""
    words = _words(text, 0, len(text))
    for at, word in enumerate(words):
        if word.bare.lower() not in TOGETHER:
            continue
        first = max(0, at - GROUP_WORDS_BACK)
        last = next((j for j in range(at - 1, max(first, at - GROUP_LOOSE) - 1, -1) if words[j].symbol), None)
        if last is None:
            continue
        symbols, parted = [words[last].symbol], False
        for w in reversed(words[first:last]):  # a list is walked backwards as symbols that commas or 'and' part
            joins = w.bare.lower() == "and" or "," in w.raw
            if parted and w.symbol:
                symbols.append(w.symbol)
                parted = False
            elif not parted and joins:
                if "," in w.raw and w.symbol:
                    symbols.append(w.symbol)
                else:
                    parted = True
            else:
                break
        counted = next((w for w in words[at + 1 : at + 1 + GROUP_WORDS_ON] if w.count is not None), None)
        if len(symbols) < 2 or counted is None:
            continue
        end = counted.start + len(counted.bare)
        noun = _NOUN.search(text[end : end + GROUP_CHARS_ON])
        if noun:
            taken.add(counted.start)
            yield symbols[::-1], counted.count, _kind(noun[0]), noun[0]


def _single(text: str, taken: set[int]) -> Iterator[tuple]:
    """Claims such as 'A had 7 halts' or '7 halts on A'. A count belongs to the first noun that reaches it."""
    for noun in _NOUN.finditer(text):
        near = _words(text, max(0, noun.start() - CHARS_BACK), noun.start())[-WORDS_BACK:]
        found = None
        counts = [k for k, w in enumerate(near) if w.count is not None and w.start not in taken]
        fence = max((k for k, w in enumerate(near) if w.bare.lower() in NEW_CLAUSE), default=-1)
        if counts and counts[-1] > fence:
            before = [w.symbol for w in near[fence + 1 : counts[-1]] if w.symbol]
            found = before[-1] if before else None
        if counts and found is None:
            after = re.split(r"\s+", text[noun.end() : noun.end() + CHARS_ON], flags=re.ASCII)
            while after and not after[-1]:
                after.pop()
            after = [Word(w, 0) for w in after]
            found = next((b.symbol for a, b in list(zip(after, after[1:]))[:WORDS_ON] if a.bare.lower() in LINKS and b.symbol), None)
        if found is not None:
            counted = near[counts[-1]]
            taken.add(counted.start)
            yield [found], counted.count, _kind(noun[0]), noun[0]


def read_claims(text: str | None) -> list[tuple[list[str], int, str | None, str]]:
    """(symbols, count, scorer or None for events of any kind, noun) of each claim of a text."""
    taken: set[int] = set()
    return [*_together(text, taken), *_single(text, taken)] if text else []


def attributed_counts(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, claim_no, symbols, claimed, scorer_id and noun of every claim of texts (key, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, *claim) for k, text in zip(batch[key], batch["text"]) for n, claim in enumerate(read_claims(text))]
            yield pd.DataFrame(rows, columns=[key, "claim_no", "symbols", "claimed", "scorer_id", "noun"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, claim_no int, symbols array<string>, claimed bigint, scorer_id string, noun string")


def judged(claims: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """claims with actual, the symbols' events of the claimed kind together, and verdict: right, wrong or unknown_symbol.

    counts: symbol, scorer_id, n. A symbol without any event is unknown; one without events of the kind has 0.
    """
    totals = counts.groupBy("symbol").agg(F.sum("n").alias("total"))
    each = claims.select(key, "claim_no", "scorer_id", F.explode("symbols").alias("symbol"))
    met = each.join(totals, "symbol", "left").join(counts, ["symbol", "scorer_id"], "left")
    own = F.when(F.col("scorer_id").isNull(), F.col("total")).otherwise(F.coalesce("n", F.lit(0)))
    summed = met.groupBy(key, "claim_no").agg(F.max(F.col("total").isNull()).alias("unknown"), F.sum(own).cast("bigint").alias("actual"))
    verdict = F.when(F.col("unknown"), "unknown_symbol").when(F.col("claimed") == F.col("actual"), "right").otherwise("wrong")
    return claims.join(summed, [key, "claim_no"]).withColumn("verdict", verdict).withColumn("actual", F.when(~F.col("unknown"), F.col("actual"))).drop("unknown")
