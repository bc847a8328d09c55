"""The package on executors, and tables in the folder that they share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

NAME = "tapewright.zip"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir. Only a local session, as in tests, gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables that written() made and nobody has removed, and lists that note them, in this thread.
_live: list[str] = []
_notes: ContextVar[list[str] | None] = ContextVar("notes", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there, for a table that several parts of a query read.

    The query's result reads it, so it stays until the caller has read that:
    noted() lists what is written inside it, removed() deletes it.
    """
    place = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    _live.append(place)
    if (notes := _notes.get()) is not None:
        notes.append(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


@contextmanager
def noted() -> Iterator[list[str]]:
    """A list to which the tables that this thread writes are added."""
    token = _notes.set(places := [])
    try:
        yield places
    finally:
        _notes.reset(token)


def removed(spark: SparkSession, places: Iterable[str] | None = None) -> None:
    """Deletes these tables, by default all that written() made."""
    jvm = spark.sparkContext._jvm
    for place in list(_live) if places is None else places:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if place in _live:
            _live.remove(place)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once, unless their path has it already."""
    root, context = Path(__file__).resolve().parent.parent, spark.sparkContext
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == root for p in found) or NAME in context._python_includes:
        return
    place = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), NAME)
    with zipfile.ZipFile(place, "w") as package:
        for file in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            package.write(file, file.relative_to(root))
    context.addPyFile(place)
