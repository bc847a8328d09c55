"""Corpus pipeline: language filter, near-duplicate removal, secret masking, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents, also columns that documents has beyond its
usual ones, whatever their names.

Edge cases: each stage's docstring says what it does with nulls, ties and
repeated rows; every stage gives an empty table for an empty one, and works on
whole texts of any length.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import byte_bpe, language_id, mixing, ngram_join, queries, secret_scan
from tapewright.llm.shared import Scratch, shared_folder

#: Intermediate tables of the stage before, in this thread; its result has been written when the next stage begins.
_read_before: ContextVar[tuple[str, ...]] = ContextVar("read_before", default=())


def _stage(function):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        Scratch.remove(spark, _read_before.get())
        with Scratch.noted() as places:
            out = function(spark, docs, sf_dir)
        _read_before.set(tuple(places))
        return out

    run_stage.__doc__ = function.__doc__
    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject.

    Null and empty texts, and texts without letters, are rejected; repeated
    rows have one fate; null ids and null languages are allowed, but nothing is
    learned from such rows. Without any labelled row all documents are rejected.
    """
    return language_id.accepted(docs, language_id.train(docs))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, nulls last, ties by a hash of the text.

    Of repeated rows one stays; texts without words, null ones too, all stay.
    """
    return ngram_join.keep_one(docs)


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars, if it is there, counted anew.

    A null text stays null and keeps its n_chars; repeated rows stay equal.
    """
    masked = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mix; every source, null included, has a share of its own.

    Equal ids are ordered by a hash of the other columns; repeated rows each get a place.
    """
    return mixing.mix(docs, **mixing.weights_by_source(docs))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, summed up, and what they decode to; one row for each row, a null text has no ids."""
    return byte_bpe.round_trip(docs, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.pattern())


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Shingle sets, language models and merges can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over documents. Only the last stage's table is left in the shared folder."""
    place, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        written = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        Scratch.remove(spark, before)
        before = [written]
    Scratch.remove(spark, _read_before.get())
    _read_before.set(())
    return docs
