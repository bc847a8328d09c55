"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only a local session, as in
    tests, gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Intermediate tables in the shared folder.

    ``cut`` writes a DataFrame as Parquet and reads it back: the lineage ends
    there, a lost executor costs no more than the tasks it ran, and several
    consumers share one computation. A query's result reads them, so they are
    the caller's to remove: ``noted`` lists those that are written inside it,
    ``remove`` deletes them, and ``drop`` deletes all.
    """

    live: list[str] = []
    _notes: ContextVar[list[str] | None] = ContextVar("notes", default=None)

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def path(self, name: str) -> str:
        place = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.live.append(place)
        if (notes := Scratch._notes.get()) is not None:
            notes.append(place)
        return place

    @classmethod
    @contextmanager
    def noted(cls) -> Iterator[list[str]]:
        """A list to which the tables written by this thread are added."""
        token = cls._notes.set(places := [])
        try:
            yield places
        finally:
            cls._notes.reset(token)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        place = self.path(name)
        df.write.parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    @staticmethod
    def remove(spark: SparkSession, places: Iterable[str]) -> None:
        jvm = spark.sparkContext._jvm
        for place in places:
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            if place in Scratch.live:
                Scratch.live.remove(place)

    @classmethod
    def drop(cls, spark: SparkSession) -> None:
        """Removes every table cut so far; call it when their readers have ended."""
        cls.remove(spark, list(cls.live))


def hash_fraction(key: Column, fraction: float, seed: str) -> Column:
    """True for about that fraction of keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)


def text_key(text: Column) -> Column:
    """A 128-bit key of a text, null for null. Keys of 64 bits would repeat among 10 ** 10 texts."""
    return F.md5(text)


def hidden(docs: DataFrame) -> DataFrame:
    """docs with columns named own0, own1 and so on, so that columns can be added whatever the caller's are called."""
    return docs.toDF(*[f"own{k}" for k in range(len(docs.columns))])


def own(docs: DataFrame, name: str) -> str:
    """What hidden() calls a column of docs."""
    return f"own{docs.columns.index(name)}"


def shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, by their names again."""
    return rows.select(*[F.col(f"own{k}").alias(c) for k, c in enumerate(docs.columns)])


#: Rows that an operator turns into Python objects at a time.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a worker's memory doesn't follow Arrow's batch size."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


#: Bytes of texts that an operator turns into Python objects at a time.
SLICE_BYTES = 8 << 20


def slices_by_bytes(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """slices() of at most about SLICE_BYTES in these columns of strings, binaries or lists of 32-bit integers, or of one longer row."""
    for batch in slices(batches):
        ends = np.zeros(batch.num_rows, np.int64)
        for k in columns:
            column = batch.column(k)
            sizes = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
            ends += np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Characters of texts that an operator cuts into words at a time.
SLICE_CHARS = 1_000_000


def by_chars(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The same texts in lists of about SLICE_CHARS characters, or of one longer text."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: a vocabulary, a model, a memory of words.

    Spark uses a worker again for other operators, so it keeps one such thing at
    a time; asking for another frees the one before.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
