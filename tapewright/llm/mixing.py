"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Documents of a source are put in a hashed order and cut into blocks of BLOCK.
Sources get integer shares; sources without one are mixed as one stream of
their own. With shares a and their sum q, block j of a stream has the release
time floor(j * q / a) and the deadline ceil((j + 1) * q / a); every slot takes,
of the released blocks, that of the earliest deadline, ties by larger share and
then by stream. So, in every prefix, each stream's blocks differ from its share
by less than one. When a stream runs out, the others start anew with their
shares, and the same holds from there: no row is dropped or repeated.
weights_by_source() gives each source that occurs a stream of its own. Beyond
MAX_SOURCES of them, the listed ones keep theirs, and the others are dealt
inside the rest's stream: a document of each in turn, those of more documents
first, for as long as they last. So they have equal shares of the rest in every
prefix, to a document, and the rest as a whole keeps its share as above.

Such a schedule repeats after q slots. Only the q slots of each phase are
worked out in advance, from the shares and the streams' numbers of documents,
both as few as the shares; the slot of each document follows by arithmetic.

Edge cases: null and unlisted sources belong to the rest; documents of equal
ids are ordered by a hash of their other columns; repeated rows each get a
place; null ids are allowed, however many, as they are dealt out by their
place; an empty table gives an empty table; a column that is called as one of
those added is left out by schedule() and kept by mix().
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

BLOCK = 16
ROWS_OF_BUCKET = 2000
#: Shares of the streams, and of all other sources together.
SHARES = {"src0": 6, "src1": 4, "src2": 3, "src3": 2}
REST = 5
#: Periods and their slots are worked out on the driver and grow with the streams; of more sources than this, those without a listed share are dealt inside one stream.
MAX_SOURCES = 128
#: Each power of two of document numbers is cut into so many cells for looking up rounds.
CELLS = 1024
#: Sources of one size are ranked in so many hashed parts.
PARTS = 4096


def weights_by_source(docs: DataFrame, shares: dict[str, int] = SHARES, rest: int = REST, source_col: str = "source") -> dict:
    """Options of schedule() and mix() that give every source in docs a share.

    Listed sources keep their part of the mix. The part of the rest is dealt in
    equal shares to the sources that aren't listed; null is one of them. Up to
    MAX_SOURCES sources have streams of their own.
    """
    found = [r[0] for r in docs.select(source_col).distinct().limit(MAX_SOURCES + 1).collect()]
    if len(found) > MAX_SOURCES:
        return {"shares": dict(shares), "rest": rest, "deal": True}
    others = sorted(s for s in found if s is not None and s not in shares)
    n = max(1, len(others) + (None in found))
    unit = math.gcd(rest, *(a * n for a in shares.values()))
    return {"shares": {**{s: a * n // unit for s, a in shares.items()}, **dict.fromkeys(others, rest // unit)}, "rest": rest // unit}


def one_period(shares: dict[int, int]) -> dict[int, list[int]]:
    """The slots of each stream's blocks in one period, by earliest deadline."""
    total, taken = sum(shares.values()), {k: [] for k in shares}
    due, waiting = [], [(0, k) for k in shares]  # heaps of released blocks by deadline, and of later ones by release time
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(due, (-(-(len(taken[k]) + 1) * total // shares[k]), -shares[k], k))
        k = heapq.heappop(due)[2]
        taken[k].append(slot)
        if len(taken[k]) < shares[k]:
            heapq.heappush(waiting, (len(taken[k]) * total // shares[k], k))
    return taken


def phases(shares: dict[int, int], blocks: dict[int, int]) -> list[dict]:
    """For each phase and stream in it: its first block and the number of blocks it takes, the phase's first slot, and its slots in a period."""
    left, done, slot, rows = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        own = {k: shares[k] for k in left}
        total, period = sum(own.values()), one_period(own)
        length = 1 + min((n - 1) // own[k] * total + period[k][(n - 1) % own[k]] for k, n in left.items())
        for k in list(left):
            taken = length // total * own[k] + sum(s < length % total for s in period[k])
            if taken:
                rows.append({"stream": k, "first_block": done[k], "n_blocks": taken, "first_slot": slot, "share": own[k], "period": total, "slots": period[k]})
            done[k] += taken
            left[k] -= taken
            if not left[k]:
                del left[k]
        slot += length
    return rows


def _stream(source: Column, names: list[str]) -> Column:
    out = F.lit(len(names))
    for k, name in enumerate(names):
        out = F.when(source == name, k).otherwise(out)
    return out


def _cell(n: str) -> str:
    """The cell of a number from 0, as SQL; cells ascend with numbers, and those of numbers below CELLS hold one number each."""
    bits, inner = f"(length(bin({n} + 1)) - 1)", CELLS.bit_length() - 1
    return f"({bits} * {CELLS}L + shiftright({n} + 1 - shiftleft(1L, {bits}), greatest({bits} - {inner}, 0)))"


def _turns(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How units (__unit, n: its documents) are dealt in turns: (__unit, __nth: its place in a turn), and (__cell, __from, __to, __base, __alive).

    Turn r has a document of each unit of more than r. Turns from __from to
    before __to come after __base documents of exhausted units, and __alive
    units still take part, so turn r begins at __base + __alive * r. Units of
    different sizes number at most the square root of twice the documents, so
    a table of sizes has at most that many rows, and a table of cells 64 * CELLS more.
    """
    sizes = units.groupBy("n").agg(F.count(F.lit(1)).alias("units"))
    up, down = Window.orderBy("n"), Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("n", "units", F.coalesce(F.sum("units").over(down), F.lit(0)).alias("larger"), F.sum(F.col("n") * F.col("units")).over(up).alias("upto"), F.lead("n").over(up).alias("next"))
    part = F.pmod(F.xxhash64("__unit"), F.lit(PARTS))
    parted = units.withColumn("part", part)
    counts = parted.groupBy("n", "part").count()
    counts = counts.select("n", "part", F.coalesce(F.sum("count").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("n", "part").orderBy("__unit")) - 1).join(counts, ["n", "part"])
    places = ranked.join(F.broadcast(sizes.select("n", "larger")), "n").select("__unit", (F.col("larger") + F.col("start") + F.col("rank")).alias("__nth"))
    first = sizes.agg(F.min("n").alias("__to"), F.sum("units").alias("__alive")).select(F.lit(0).cast("bigint").alias("__from"), "__to", F.lit(0).cast("bigint").alias("__base"), "__alive").filter("__to is not null")
    later = sizes.filter("next is not null").select(F.col("n").alias("__from"), F.col("next").alias("__to"), F.col("upto").alias("__base"), F.col("larger").alias("__alive"))
    steps = first.unionByName(later)
    return places, steps.select(F.explode(F.expr(f"sequence({_cell('__from')}, {_cell('(__to - 1)')})")).alias("__cell"), "__from", "__to", "__base", "__alive")


def schedule(docs: DataFrame, shares: dict[str, int] = SHARES, rest: int = REST, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", deal: bool = False) -> DataFrame:
    """docs with stream, block, slot, place (in the block) and position (in the mix, from 0). With deal, sources of the rest take turns in its stream."""
    spark, names = docs.sparkSession, list(shares)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("stream", "block", "slot", "place", "position")])
    of_stream = dict(enumerate([*shares.values(), rest]))
    streamed = docs.withColumn("stream", _stream(F.col(source_col), names))
    counted = streamed.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(id_col).isNull()).alias("nulls")).collect()  # one row for each share
    counts, nulls = {r.stream: r.n for r in counted}, -(-sum(r.nulls for r in counted) // ROWS_OF_BUCKET)
    sizes = {k: counts.get(k, 0) for k in of_stream}
    rows = phases(of_stream, {k: -(-n // block) for k, n in sizes.items()})
    last = [r["first_slot"] + (n - 1) // r["share"] * r["period"] + r["slots"][(n - 1) % r["share"]] for r in rows for n in [r["n_blocks"]] if r["first_block"] + n == -(-sizes[r["stream"]] // block)]
    short = [-sizes[r["stream"]] % block for r in rows if r["first_block"] + r["n_blocks"] == -(-sizes[r["stream"]] // block)]

    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    buckets = max(1, min(65_536, sum(sizes.values()) // ROWS_OF_BUCKET))
    bucket = F.floor(F.conv(F.substring(order, 1, 4), 16, 10).cast("bigint") * buckets / 65_536)
    others = [F.col(c) for c in docs.columns if c != id_col]
    keyed = streamed.withColumns({"__order": order, "__bucket": bucket, "__tie": F.xxhash64(*others) if others else F.lit(0)})
    if nulls > 1:
        # Null ids have one hash. They get buckets of their own, between those of lower and of higher hashes, by their place in the input, which is written down.
        among = F.when(order < F.md5(F.lit("")), 0).when(F.col(id_col).isNull(), 1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(nulls))).otherwise(nulls + 1)
        keyed = Scratch(spark).cut(keyed.withColumn("__bucket", F.col("__bucket") * (nulls + 2) + among), "buckets")
    unit = ["stream"]
    if deal:
        unit = ["stream", "__unit"]
        keyed = keyed.withColumn("__unit", F.when(F.col("stream") < len(names), "").otherwise(F.coalesce(F.concat(F.lit("="), source_col), F.lit(""))))
    inside = Window.partitionBy(*unit, "__bucket").orderBy("__order", id_col, "__tie")
    of_bucket = keyed.groupBy(*unit, "__bucket").count()
    if deal:
        of_bucket = Scratch(spark).cut(of_bucket, "unit-buckets")  # four consumers
    before = Window.partitionBy(*unit).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_bucket.select(*unit, "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    if deal:
        places, turns = _turns(of_bucket.filter(F.col("stream") == len(names)).groupBy("__unit").agg(F.sum("count").alias("n")))
        starts = starts.join(places.withColumn("stream", F.lit(len(names))), unit, "left")
    numbered = keyed.withColumn("__row", F.row_number().over(inside) - 1).join(starts, [*unit, "__bucket"]).withColumn("__row", F.col("__row") + F.col("__start"))
    if deal:
        turn = (F.expr(_cell("__row")) == F.col("__cell")) & F.col("__nth").isNotNull() & (F.col("__row") >= F.col("__from")) & (F.col("__row") < F.col("__to"))
        dealt = F.col("__base") + F.col("__alive") * F.col("__row") + F.col("__nth")
        numbered = numbered.join(F.broadcast(turns), turn, "left").withColumn("__row", F.coalesce(dealt, "__row"))  # for its size see _turns()
    numbered = numbered.withColumns({"block": F.floor(F.col("__row") / block), "place": F.col("__row") % block})

    if rows:
        values = ", ".join(f"({r['stream']}, {r['first_block']}L, {r['first_block'] + r['n_blocks']}L, {r['first_slot']}L, {r['share']}, {r['period']}, array({', '.join(map(str, r['slots']))}))" for r in rows)
        plan = spark.sql(f"SELECT * FROM VALUES {values} AS t(__stream, __first, __end, __slot, __share, __period, __slots)")
    else:
        plan = spark.sql("SELECT 0 __stream, 0L __first, 0L __end, 0L __slot, 1 __share, 1 __period, array(0) __slots WHERE false")
    met = numbered.join(F.broadcast(plan), (F.col("stream") == F.col("__stream")) & (F.col("block") >= F.col("__first")) & (F.col("block") < F.col("__end")))  # at most a row for each two shares
    nth = F.col("block") - F.col("__first")
    slot = F.col("__slot") + F.floor(nth / F.col("__share")) * F.col("__period") + F.element_at("__slots", (nth % F.col("__share")).cast("int") + 1)
    position = F.col("slot") * block + F.col("place")
    for at, missing in zip(last, short):
        position = position - F.when(F.col("slot") > at, missing).otherwise(0)
    return met.withColumn("slot", slot).withColumn("position", position).drop("__order", "__bucket", "__tie", "__start", "__row", "__unit", "__nth", "__cell", "__from", "__to", "__base", "__alive", *plan.columns)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs, stored in the order of the mix."""
    columns = docs.columns
    hidden = docs.select(*[F.col(c).alias(f"own_{c}") for c in columns])
    placed = schedule(hidden, id_col=f"own_{options.pop('id_col', 'doc_id')}", source_col=f"own_{options.pop('source_col', 'source')}", **options)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*[F.col(f"own_{c}").alias(c) for c in columns])
