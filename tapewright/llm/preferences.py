"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

A pair's conversations share turns up to the first one that differs in role or
text. The shared turns are rendered once, as the prompt; what follows of each
conversation is rendered as its completion, with the spans that a loss counts:
the texts of assistant turns and their end marks. Everything else is masked.

Turns are rendered in chunks of CHUNK turns; a pair has one row for each part
(prompt, chosen, rejected) and chunk. A pair of at most CHUNK rows is gathered
into one row, so its texts are shuffled once, and all else happens in arrays. A
longer pair is never gathered: its turns are numbered by windows over CHUNK turn
numbers, and its first differing turn is a minimum, taken before the shuffle.

Edge cases: a null role is rendered as an empty one, a null text as no text,
and both equal only nulls; turns are ordered by number, then role and text,
nulls first; a repeated turn appears as often as it is given; a pair with one
conversation only has no prompt; a pair of equal conversations has a prompt and
no completions; if one conversation goes on where the other ends, only the
longer one has a completion; rows without pair or turn, or of another side, are
left out; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Lists of long pairs up to this many are broadcast, longer ones joined by a shuffle.
BROADCAST_ROWS = 200_000
CHUNK = 256
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, counted from 0.

    Equal turn numbers are told apart by role and text. Places are counted
    inside chunks of turn numbers and added up over the chunks, so no window
    spans a whole conversation.
    """
    key = ["pair_id", "side"]
    rows = turns.filter("pair_id is not null and turn is not null").withColumn("cut", F.floor(F.col("turn") / CHUNK))
    order = Window.partitionBy(*key, "cut").orderBy("turn", "role", "text")
    placed = rows.withColumn("inner", F.row_number().over(order) - 1)
    cuts = placed.groupBy(*key, "cut").agg((F.max("inner") + 1).alias("n"))
    before = Window.partitionBy(*key).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = cuts.select(*key, "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, [*key, "cut"]).select(*key, "role", "text", (F.col("start") + F.col("inner")).alias("place"))


def shared_turns(numbered: DataFrame) -> DataFrame:
    """pair_id and n_shared, the length of the longest common prefix of turns."""
    by_place = numbered.groupBy("pair_id", "place").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("role", "text")).alias("low"),
        F.max(F.struct("role", "text")).alias("high"),
    )
    differs = (F.col("n") < 2) | ~(F.col("low.role").eqNullSafe(F.col("high.role")) & F.col("low.text").eqNullSafe(F.col("high.text")))
    first = F.min(F.when(differs, F.col("place")))
    return by_place.groupBy("pair_id").agg(F.coalesce(first, F.max("place") + 1).alias("n_shared"))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def _chunk_text(turns: Column) -> list[Column]:
    """n_turns, text and loss_spans of an array of turns (piece, head, counts)."""
    spans = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["piece"])).alias("at"),
            F.when(t["counts"], F.concat(a["spans"], F.array(F.concat_ws(":", (a["at"] + t["head"]).cast("string"), (a["at"] + F.length(t["piece"]) - 1).cast("string"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: F.array_join(a["spans"], ","),
    )
    return [F.size(turns).cast("bigint").alias("n_turns"), F.array_join(F.transform(turns, lambda t: t["piece"]), "").alias("text"), spans.alias("loss_spans")]


def _turn(role: Column, text: Column, counts: Column) -> list[Column]:
    return [_rendered(role, text).alias("piece"), F.length(_head(role)).alias("head"), (counts & F.coalesce(role == "assistant", F.lit(False))).alias("counts")]


def _format_long(turns: DataFrame) -> DataFrame:
    numbered = _numbered(turns.select("pair_id", "side", "turn", "role", "text"))
    joined = numbered.join(shared_turns(numbered), "pair_id")
    shared = F.col("place") < F.col("n_shared")
    parts = joined.filter(~shared | (F.col("side") == "chosen")).select(
        "pair_id",
        F.when(shared, "prompt").otherwise(F.col("side")).alias("part"),
        F.when(shared, F.col("place")).otherwise(F.col("place") - F.col("n_shared")).alias("place"),
        *_turn(F.col("role"), F.col("text"), ~shared),
    )
    chunks = parts.groupBy("pair_id", "part", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("place", "piece", "head", "counts"))).alias("turns")
    )
    return chunks.select("pair_id", "part", F.col("chunk").cast("bigint").alias("chunk"), *_chunk_text(F.col("turns")))


def _format_short(turns: DataFrame) -> DataFrame:
    """turns may also have side 'both'."""
    gathered = turns.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "side"))).alias("turns"))
    of_side = gathered.select("pair_id", *[F.filter("turns", lambda t: t["side"].isin(side, "both")).alias(side) for side in ("chosen", "rejected")])
    both = F.least(F.size("chosen"), F.size("rejected"))
    same = lambda i: F.get("chosen", i - 1)["role"].eqNullSafe(F.get("rejected", i - 1)["role"]) & F.get("chosen", i - 1)["text"].eqNullSafe(F.get("rejected", i - 1)["text"])
    first = F.get(F.filter(F.sequence(F.lit(1), both), lambda i: ~same(i)), F.lit(0))
    met = of_side.withColumn("n_shared", F.when(both > 0, F.coalesce(first - 1, both)).otherwise(0))
    part = lambda name, turns, counts: F.struct(F.lit(name).alias("part"), F.transform(turns, lambda t: F.struct(*_turn(t["role"], t["text"], F.lit(counts)))).alias("turns"))
    rest = lambda side: F.slice(side, F.col("n_shared") + 1, F.size(side))
    parts = met.select("pair_id", F.explode(F.array(part("prompt", F.slice("chosen", F.lit(1), F.col("n_shared")), False), part("chosen", rest("chosen"), True), part("rejected", rest("rejected"), True))).alias("p"))
    return parts.filter(F.size("p.turns") > 0).select("pair_id", "p.part", F.lit(0).cast("bigint").alias("chunk"), *_chunk_text(F.col("p.turns")))


def _short_and_long(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most CHUNK rows, and the others (None if there are none)."""
    long = Scratch(rows.sparkSession).cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select(key), "long")
    n = long.count()
    if not n:
        return rows, None
    long = F.broadcast(long) if n <= BROADCAST_ROWS else long
    return rows.join(long, key, "left_anti"), rows.join(long, key, "left_semi")


def format_pairs(turns: DataFrame) -> DataFrame:
    """From turns (pair_id, side 'chosen' or 'rejected', turn, role, text): one row for each pair, part and chunk.

    pair_id, part, chunk, n_turns, text, and loss_spans: start:end of each
    counted span in the chunk's text, in characters, joined by commas.
    """
    usable = turns.filter("pair_id is not null and turn is not null and side in ('chosen', 'rejected')").select("pair_id", "side", "turn", "role", "text")
    short, long = _short_and_long(usable, "pair_id")
    return _format_short(short) if long is None else _format_short(short).unionByName(_format_long(long))


def _given_up(turn: Column, last: Column, pair_id: Column) -> Column:
    """Whether an answer is late enough to be the one that goes stale: at a quarter, half, three quarters or the end, by the pair's id."""
    return 4 * turn >= (1 + F.pmod(pair_id, F.lit(4))) * last


def _stale(turns: DataFrame, windowed: bool) -> DataFrame:
    """turns with at, the turn of the answer that goes stale (null if there is no answer), and stale, the answer before it."""
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    last = F.max(F.when(answer, F.col("turn")))
    given_up = F.min(F.when(answer & _given_up(F.col("turn"), F.col("last"), F.col("pair_id")), F.col("turn")))
    before = F.max(F.when(answer & (F.col("turn") < F.col("at")), F.struct("turn", "text")))
    if windowed:
        pair = Window.partitionBy("pair_id")
        return turns.withColumn("last", last.over(pair)).withColumn("at", F.coalesce(given_up.over(pair), "last")).withColumn("stale", before.over(pair))
    facts = turns.groupBy("pair_id").agg(last.alias("last"))
    facts = facts.join(turns.join(facts, "pair_id").groupBy("pair_id").agg(given_up.alias("given_up")), "pair_id").select("pair_id", "last", F.coalesce("given_up", "last").alias("at"))
    return turns.join(facts.join(turns.join(facts, "pair_id").groupBy("pair_id").agg(before.alias("stale")), "pair_id"), "pair_id")


def format_stale_answer_pairs(conversations: DataFrame) -> DataFrame:
    """format_pairs() of pairs made from single conversations (conv_id, turn, role, text), for tables that hold no pairs.

    Chosen is the conversation itself. Rejected is the conversation up to one of
    its assistant turns, which gives the previous assistant turn's answer again
    (or none, if it is the first), and nothing after it. The assistant turn is
    the first one at or after a quarter, half, three quarters or all of the
    last one's number, by the conversation's id. Conversations without an
    assistant turn make no pair; rows without conversation or turn are left out.
    """
    turns = conversations.filter("conv_id is not null and turn is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    short, long = _short_and_long(turns, "pair_id")
    at, answer = F.col("turn") == F.col("at"), F.coalesce(F.col("role") == "assistant", F.lit(False))
    side = lambda name, text=F.col("text"): F.struct(F.lit(name).alias("side"), text.alias("text"))
    stale = F.coalesce("stale.text", F.lit(""))

    marked = _stale(short, True).filter("at is not null")
    sides = F.when(at & answer, F.array(side("chosen"), side("rejected", stale))).when(F.col("turn") <= F.col("at"), F.array(side("both"))).otherwise(F.array(side("chosen")))
    formatted = _format_short(marked.select("pair_id", "turn", "role", F.explode(sides).alias("s")).select("pair_id", "turn", "role", "s.side", "s.text"))
    if long is None:
        return formatted
    marked = _stale(long, False).filter("at is not null")
    sides = F.when(at & answer, F.array(side("chosen"), side("rejected", stale))).when(F.col("turn") <= F.col("at"), F.array(side("chosen"), side("rejected"))).otherwise(F.array(side("chosen")))
    return formatted.unionByName(_format_long(marked.select("pair_id", "turn", "role", F.explode(sides).alias("s")).select("pair_id", "turn", "role", "s.side", "s.text")))
