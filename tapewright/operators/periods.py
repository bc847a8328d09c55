"""Stored summaries of days, weeks, quarters and years, of which only what changed is worked out anew.

A period's rows lie in a partition of their own, and so does a hash of them. A
refresh compares the days' hashes with the stored ones, rewrites changed days,
and climbs: a week, quarter or year is rewritten only if one of its children
changed, from those of its children that are verified, and is dropped if too few
are. What it reads is the children of the parents it rewrites.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fmt
from ..session import removed, written

ROWS = "period date, kind string, member string, n bigint, n_days bigint"
HASHES = "period date, content_hash string"
#: Hexadecimal digits of a row's hash that tell its chunk. Chunks are hashed on their own, so that no value holds a whole period.
CHUNK_DIGITS = 2


def chunked_hash(rows: DataFrame, keys: list[str], parts: list[str], digits: int = CHUNK_DIGITS) -> DataFrame:
    """keys, content_hash: a SHA-256 of the rows of a key, in any order, from the hashes of 16 ** digits chunks of them.

    Which chunk a row is in, and where, follows from the row alone. Null and
    empty parts differ, and parts can't run into each other.
    """
    row = F.concat(*[F.coalesce(F.concat(F.octet_length(F.col(p).cast("string")).cast("string"), F.lit(":"), F.col(p).cast("string")), F.lit("-")) for p in parts])
    hashed = rows.select(*keys, F.sha2(row, 256).alias("row_hash")).withColumn("chunk", F.substring("row_hash", 1, digits))
    of_chunk = hashed.groupBy(*keys, "chunk").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("row_hash")), ""), 256).alias("chunk_hash"))
    return of_chunk.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "chunk_hash")))["chunk_hash"], ""), 256).alias("content_hash"))


@dataclass(frozen=True)
class Level:
    """A kind of period: that of its children, how a child's start gives its own, and how many verified children it needs."""

    name: str
    below: str
    parent: Callable[[Column], Column]
    least: int = 1


LEVELS = [Level("week", "day", fmt.week_start), Level("quarter", "week", fmt.quarter_start, 8), Level("year", "quarter", fmt.year_start, 2)]


class Store:
    """The stored periods of a folder."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place

    def _read(self, path: str, schema: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def rows(self, level: str) -> DataFrame:
        return self._read(f"{self.place}/{level}", ROWS)

    def hashes(self, level: str) -> DataFrame:
        return self._read(f"{self.place}/{level}-hashes", HASHES)

    def replace(self, level: str, rows: DataFrame, hashes: DataFrame, gone: list) -> None:
        """Replaces the periods that rows hold, and drops those that are gone."""
        for table, df in ((level, rows), (f"{level}-hashes", hashes)):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{self.place}/{table}")
            removed(self.spark, [f"{self.place}/{table}/period={day}" for day in gone])


def _few(rows: DataFrame) -> list:
    """The periods of a table of a row for each period."""
    return [r[0] for r in rows.select("period").distinct().collect()]


def _among(column: Column, periods: list) -> Column:
    return column.isin(periods) if periods else F.lit(False)


def refresh(store: Store, days: DataFrame, verified: DataFrame, levels: list[Level] = LEVELS, top: int = 12) -> DataFrame:
    """level, period and action (rewritten or dropped) of all periods that a new table of days changes.

    days: trading_date, kind, member and n, all days that there are now;
    verified: level and period of what may go into a parent. Of symbols a
    period keeps the top ones, and parents add up what their children keep.
    """
    spark, done = store.spark, []
    now = days.select(F.col("trading_date").alias("period"), "kind", "member", "n", F.lit(1).cast("bigint").alias("n_days"))
    hashes = written(chunked_hash(now, ["period"], ["kind", "member", "n"]), "hashes")
    old = store.hashes("day").withColumnRenamed("content_hash", "old_hash")
    met = hashes.join(old, "period", "full_outer")
    changed = _few(met.filter("content_hash is not null and not content_hash <=> old_hash"))
    gone = _few(met.filter("content_hash is null"))
    store.replace("day", now.filter(_among(F.col("period"), changed)), hashes.filter(_among(F.col("period"), changed)), gone)
    done += [("day", d, "rewritten") for d in changed] + [("day", d, "dropped") for d in gone]
    for level in levels:
        touched = changed + gone
        if not touched:
            break
        parent = level.parent(F.col("period"))
        parents = _few(spark.createDataFrame([(d,) for d in touched], "period date").select(parent.alias("period")))
        may = verified.filter(F.col("level") == level.below).select("period")
        children = store.rows(level.below).filter(_among(parent, parents)).join(may, "period", "left_semi").withColumn("parent", parent)
        enough = children.groupBy("parent").agg(F.count_distinct("period").alias("n_children")).filter(F.col("n_children") >= level.least)
        summed = children.join(enough.select("parent"), "parent", "left_semi").groupBy("parent", "kind", "member").agg(F.sum("n").alias("n"), F.sum("n_days").alias("n_days"))
        place = F.row_number().over(Window.partitionBy("parent", "kind").orderBy(F.desc("n"), "member"))
        kept = summed.withColumn("place", place).filter((F.col("kind") != "symbol") | (F.col("place") <= top))
        rows = written(kept.select(F.col("parent").alias("period"), "kind", "member", "n", "n_days"), level.name)
        hashes = written(chunked_hash(rows, ["period"], ["kind", "member", "n", "n_days"]), "hashes")
        met = hashes.join(store.hashes(level.name).filter(_among(F.col("period"), parents)).withColumnRenamed("content_hash", "old_hash"), "period", "full_outer")
        changed = _few(met.filter("content_hash is not null and not content_hash <=> old_hash"))
        gone = _few(met.filter("content_hash is null"))
        store.replace(level.name, rows.filter(_among(F.col("period"), changed)), hashes.filter(_among(F.col("period"), changed)), gone)
        done += [(level.name, d, "rewritten") for d in changed] + [(level.name, d, "dropped") for d in gone]
    return spark.createDataFrame(done, "level string, period date, action string")


#: What may be swept: rows of the wire and what is derived from them. Texts, rollups and baselines stay for good.
SWEPT = ("wire", "derived")
KEPT = ("text", "rollup", "baseline")


def partition_days(spark: SparkSession, path: str, day: str = "trading_date") -> list[str]:
    """The days that a table partitioned by day has, from the names of its partitions."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(n.removeprefix(f"{day}=") for n in names if n.startswith(f"{day}=") and n != f"{day}=__HIVE_DEFAULT_PARTITION__")


def sweep(spark: SparkSession, catalogue: dict[str, tuple[str, str]], today: str, weeks: int) -> DataFrame:
    """table_name, day of the partitions that a retention sweep deletes.

    catalogue: by name the kind and the folder of each table. Only whole
    partitions of swept kinds that lie before the boundary go; no row is read.
    A kind that is neither swept nor kept is an error, before anything is deleted.
    """
    if odd := [n for n, (kind, _) in catalogue.items() if kind not in (*SWEPT, *KEPT)]:
        raise ValueError(f"no policy for {', '.join(odd)}")
    boundary = str(spark.range(1).select(fmt.retention_boundary(F.lit(today).cast("date"), weeks)).first()[0])
    gone = [(name, day, f"{path}/trading_date={day}") for name, (kind, path) in catalogue.items() if kind in SWEPT for day in partition_days(spark, path) if day < boundary]
    removed(spark, [path for *_, path in gone])
    return spark.createDataFrame([(name, day) for name, day, _ in gone], "table_name string, day string").withColumn("day", F.to_date("day"))


def rebuild(events: DataFrame, days: DataFrame, place: str, day_table: Callable[[DataFrame], DataFrame], week_table: Callable[[DataFrame], DataFrame]) -> None:
    """Builds the day tables of days, and those of their weeks, from events, and replaces just these.

    Only events of the days' weeks are read. day_table gives rows with
    trading_date, week_table rows with period, the week's Monday.
    """
    weeks = [r[0] for r in days.select(fmt.week_start(F.col("day")).alias("w")).distinct().collect()]
    wanted = [r[0] for r in days.select("day").distinct().collect()]
    near = events.filter(_among(fmt.week_start(F.col("trading_date")), weeks))
    for rows, key, table in ((day_table(near.filter(_among(F.col("trading_date"), wanted))), "trading_date", "days"), (week_table(near), "period", "weeks")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{place}/{table}")
