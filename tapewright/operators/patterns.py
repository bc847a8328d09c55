"""Relational patterns that the analytics are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that a task sorts at once, where their number is known.
ROWS_A_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """A number of partitions that grows with the rows, so that what a task sorts does not."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def gap_clusters(df: DataFrame, keys: list[str], order: list[str], max_gap: int, cap: int = 10_000, piece: int | None = None) -> DataFrame:
    """df with cluster: rows of a key belong together while neighbours are at most max_gap apart.

    order[0] is the time; the others break ties. A cluster is cut after every
    cap rows. Rows are first chained inside pieces of time, and the pieces of a
    key are then stitched by their ends, so that a busy key is spread over many
    tasks: only one row for each piece meets in the second step. piece is the
    length of a piece, by default a thousand gaps.
    """
    time = F.col(order[0])
    length = piece or max(max_gap, 1) * 1000
    cut = df.withColumn("__piece", F.floor(time / length))
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order)
    upto_row = inside.rowsBetween(Window.unboundedPreceding, 0)
    chained = cut.withColumns({"__row": F.row_number().over(inside), "__break": F.coalesce(time - F.lag(order[0]).over(inside) > max_gap, F.lit(False))})
    chained = chained.withColumns({"__own": F.sum(F.col("__break").cast("int")).over(upto_row), "__from": F.max(F.when(F.col("__break"), F.col("__row"))).over(upto_row)})
    chained = chained.withColumn("__nth", F.col("__row") - F.coalesce("__from", F.lit(1)) + 1).drop("__break", "__from")

    # One row for each piece: how its islands go on from the pieces before it.
    pieces = chained.groupBy(*keys, "__piece").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.max("__own").alias("breaks"), F.max_by("__nth", "__row").alias("tail"))
    along = Window.partitionBy(*keys).orderBy("__piece")
    upto, earlier = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("first") - F.lag("last").over(along) > max_gap, F.lit(True))
    before_is_cut = F.coalesce(F.lag("breaks").over(along) > 0, F.lit(True))
    pieces = pieces.withColumns({"apart": apart, "starts": (apart | before_is_cut).cast("int"), "brought": F.when(apart, 0).otherwise(F.lag("tail").over(along))})
    pieces = pieces.withColumns({"run": F.sum("starts").over(upto), "__offset": F.sum(F.col("apart").cast("int")).over(upto) + F.coalesce(F.sum("breaks").over(earlier), F.lit(0))})
    # In a run every piece but the last is one island, so what came before a piece is what its run began with and the pieces since.
    in_run = Window.partitionBy(*keys, "run").orderBy("__piece")
    since = F.coalesce(F.sum("tail").over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("__before", F.first("brought").over(in_run) + since).select(*keys, "__piece", "__offset", "__before")
    joined = chained.join(pieces, [*keys, "__piece"])
    nth = F.col("__nth") + F.when(F.col("__own") == 0, F.col("__before")).otherwise(0)
    return joined.withColumn("cluster", F.struct((F.col("__own") + F.col("__offset")).alias("island"), F.floor((nth - 1) / cap).alias("part"))).drop("__piece", "__own", "__row", "__nth", "__offset", "__before")


PIECE = 3_600_000_000_000  # an hour of nanoseconds


def _carried(union: DataFrame, keys: list[str], own: Column, fold) -> DataFrame:
    """keys, __piece, __carry: what fold makes of own, by piece, over all earlier pieces of a key. One row for each piece."""
    pieces = union.groupBy(*keys, "__piece").agg(own.alias("__own"))
    earlier = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(*keys, "__piece", fold("__own").over(earlier).alias("__carry"))


def asof_last(rows: DataFrame, at: DataFrame, keys: list[str], value: str, time: str = "ts_nanos", seq: str = "seq", piece: int = PIECE) -> DataFrame:
    """at with the last value of rows of the same keys at or before its time (null if none).

    Windows run inside pieces of time; what the earlier pieces leave comes in by a join.
    """
    union = rows.select(*keys, F.col(time), F.lit(0).alias("__kind"), F.col(seq).alias("__seq"), F.col(value).alias("__value")).unionByName(
        at.select(*keys, F.col(time), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__seq"), F.lit(None).cast(rows.schema[value].dataType).alias("__value"), F.struct(*at.columns).alias("__at")), allowMissingColumns=True)
    union = union.withColumn("__piece", F.floor(F.col(time) / piece))
    last = F.max_by(F.when(F.col("__value").isNotNull(), F.col("__value")), F.when(F.col("__value").isNotNull(), F.struct(time, "__seq")))
    carried = _carried(union, keys, last, lambda c: F.last(c, ignorenulls=True))
    upto = Window.partitionBy(*keys, "__piece").orderBy(time, "__kind", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = union.withColumn("__last", F.last("__value", ignorenulls=True).over(upto)).filter("__kind = 1")
    return inside.join(carried, [*keys, "__piece"]).select("__at.*", F.coalesce("__last", "__carry").alias(value))


def asof_sum(rows: DataFrame, at: DataFrame, keys: list[str], value: str, time: str = "ts_nanos", piece: int = PIECE) -> DataFrame:
    """at with the sum of value over rows of the same keys at or before its time (0 if none), in pieces of time as asof_last()."""
    union = rows.select(*keys, F.col(time), F.col(value).alias("__value")).unionByName(at.select(*keys, F.col(time), F.lit(0).cast(rows.schema[value].dataType).alias("__value"), F.struct(*at.columns).alias("__at")), allowMissingColumns=True)
    union = union.withColumn("__piece", F.floor(F.col(time) / piece))
    carried = _carried(union, keys, F.sum("__value"), F.sum)
    upto = Window.partitionBy(*keys, "__piece").orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    inside = union.withColumn("__sum", F.sum("__value").over(upto)).filter("__at is not null")
    return inside.join(carried, [*keys, "__piece"]).select("__at.*", (F.col("__sum") + F.coalesce("__carry", F.lit(0))).alias(value))


def with_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, piece: int = PIECE) -> DataFrame:
    """df with the value of the row before, in an order whose first column is the time; windows run inside pieces of time."""
    cut = df.withColumn("__piece", F.floor(F.col(order[0]) / piece))
    pieces = cut.groupBy(*keys, "__piece").agg(F.max_by(value, F.struct(*order)).alias("__own"))
    along = Window.partitionBy(*keys).orderBy("__piece")
    carried = pieces.select(*keys, "__piece", F.lag("__own").over(along).alias("__carry"))
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order)
    rows = cut.withColumns({"__row": F.row_number().over(inside), "__lag": F.lag(value).over(inside)}).join(carried, [*keys, "__piece"])
    return rows.withColumn(name, F.when(F.col("__row") == 1, F.col("__carry")).otherwise(F.col("__lag"))).drop("__piece", "__row", "__lag", "__carry")


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, bucket: int, how: str = "inner") -> DataFrame:
    """points joined with the spans [start, end) of the same keys that hold their time.

    Spans are repeated for each time bucket that they touch, so the join has an
    equality on keys and bucket and never compares all pairs of a key.
    """
    last = F.greatest(F.col(end) - 1, F.col(start))
    dealt = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(last / bucket))))
    timed = points.withColumn("__bucket", F.floor(F.col(time) / bucket))
    p, s = timed.alias("p"), dealt.alias("s")
    same = F.col("p.__bucket") == F.col("s.__bucket")
    for key in keys:
        same &= F.col(f"p.{key}") == F.col(f"s.{key}")
    inside = (F.col(f"p.{time}") >= F.col(f"s.{start}")) & (F.col(f"p.{time}") < F.col(f"s.{end}"))
    kept = [c for c in spans.columns if c not in keys]
    return p.join(s, same & inside, how).select("p.*", *[F.col(f"s.{c}") for c in kept]).drop("__bucket")


BASE, LEVELS = 64, 3


def _blocks(first: Column, end: Column) -> Column:
    """Blocks (level, block) of BASE ** level buckets each that make up the buckets [first, end), every one once."""
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a < b, F.sequence(a, F.greatest(b - 1, a))).otherwise(none)
    at = lambda level: lambda b: F.struct(F.lit(level).alias("level"), b.alias("block"))
    out = []
    for level in range(LEVELS):
        width = BASE**level
        lo, hi = F.ceil(first / width), F.floor(end / width)
        if level == LEVELS - 1:
            blocks = run(lo, hi)
        else:  # what the next level's whole blocks leave over on both sides
            up = F.least(hi, F.ceil(first / (width * BASE)) * BASE)
            blocks = F.concat(run(lo, up), run(F.greatest(up, F.floor(end / (width * BASE)) * BASE), hi))
        out.append(F.transform(blocks, at(level)))
    return F.concat(*out)


def long_span_join(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, bucket: int) -> DataFrame:
    """As range_join, for spans that may last very many buckets.

    A span is repeated for the few blocks of 1, BASE or BASE ** 2 buckets that
    make it up, and a point for the LEVELS blocks that hold it.
    """
    whole = _blocks(F.floor(F.col(start) / bucket), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / bucket) + 1)
    dealt = spans.withColumn("__b", F.explode(whole)).withColumns({"__level": F.col("__b.level"), "__block": F.col("__b.block")}).drop("__b").alias("s")
    at = F.floor(F.col(time) / bucket)
    of_point = F.array(*[F.struct(F.lit(level).alias("level"), F.floor(at / BASE**level).alias("block")) for level in range(LEVELS)])
    timed = points.withColumn("__b", F.explode(of_point)).withColumns({"__level": F.col("__b.level"), "__block": F.col("__b.block")}).drop("__b").alias("p")
    same = (F.col("p.__level") == F.col("s.__level")) & (F.col("p.__block") == F.col("s.__block")) & (F.col(f"p.{time}") >= F.col(f"s.{start}")) & (F.col(f"p.{time}") < F.col(f"s.{end}"))
    for key in keys:
        same &= F.col(f"p.{key}") == F.col(f"s.{key}")
    return timed.join(dealt, same).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in spans.columns if c not in keys])


def streak(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    """keys, first, last, length of each run of consecutive periods (whole numbers)."""
    numbered = df.select(*keys, period).distinct().withColumn("__run", F.col(period) - F.row_number().over(Window.partitionBy(*keys).orderBy(period)))
    return numbered.groupBy(*keys, "__run").agg(F.min(period).alias("first"), F.max(period).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in an order; rank names a column for their places."""
    placed = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n)
    return placed.withColumnRenamed("__rank", rank) if rank else placed.drop("__rank")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """target with its rows replaced by updates of the same keys, and the other updates added.

    Nulls in keys are equal to each other. Of updates of equal keys the greatest row, column by column, counts.
    """
    others = [c for c in updates.columns if c not in keys]
    once = updates.groupBy(*keys).agg(F.max(F.struct(*others)).alias("__row")).select(*keys, "__row.*") if others else updates.select(*keys).distinct()
    new, same = once.select(*[F.col(k).alias(f"__{k}") for k in keys]), F.lit(True)
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"__{key}"))
    return target.join(new, same, "left_anti").unionByName(once.select(*updates.columns))


def day_rows(df: DataFrame, day: str, time: str = "ts_nanos") -> DataFrame:
    """Rows of a UTC day, [day, next day): by the partition column, if there is one, and by the time."""
    start = F.datediff(F.lit(day).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000_000
    rows = df.filter(F.col("trading_date") == F.lit(day).cast("date")) if "trading_date" in df.columns else df
    return rows.filter((F.col(time) >= start) & (F.col(time) < start + 86_400_000_000_000))


def feed_rows(df: DataFrame, feed: str | None) -> DataFrame:
    """Rows of one feed, or of all if feed is None."""
    return df if feed is None else df.filter(F.col("feed_source") == feed)


def retained(df: DataFrame, today: str, weeks: int, day: str = "trading_date") -> DataFrame:
    """Rows of the weeks that are kept, for a rewrite of a table of wire or derived rows; texts and rollups are never swept."""
    return df.filter(F.col(day) >= F.date_sub(F.date_trunc("week", F.lit(today).cast("date")).cast("date"), 7 * weeks))


def not_ingested(days: DataFrame, runs: DataFrame, feed: str, day: str = "trading_date") -> DataFrame:
    """Days without a run of a feed that ended well. runs: day, feed_source, status."""
    done = runs.filter((F.col("feed_source") == feed) & (F.col("status") == "ok")).select(day).distinct()
    return days.join(done, day, "left_anti")


def upsert_keeping(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """As upsert, but a null in an update keeps the old value. Of repeated updates of a key each column's greatest value counts."""
    once = updates.groupBy(*keys).agg(*[F.max(c).alias(c) for c in updates.columns if c not in keys])
    t, u, same = target.alias("t"), once.alias("u"), F.lit(True)
    for key in keys:
        same &= F.col(f"t.{key}").eqNullSafe(F.col(f"u.{key}"))
    return t.join(u, same, "full_outer").select(*[F.coalesce(f"u.{c}", f"t.{c}").alias(c) if c in once.columns else F.col(f"t.{c}") for c in target.columns])


def overwrite_days(df: DataFrame, path: str, day: str = "trading_date") -> None:
    """Writes df so that exactly the days it holds are replaced."""
    df.sortWithinPartitions("symbol", "ts_nanos").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
