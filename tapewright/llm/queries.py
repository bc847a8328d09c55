"""Queries of this subpackage, one for each operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, hnsw, language_id, line_quality, merkle, mixing, ngram_join, odd_sketch, oracles, preferences, secret_scan, token_counts, token_files
from .shared import Scratch, table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine; another place can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), pattern())
    return token_counts.with_suffix_sums(Scratch(spark).cut(token_counts.histogram(lengths), "lengths"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.search_all(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), pattern())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    found = language_id.identify(docs.withColumn("held_out", language_id.held_out()), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_stale_answer_pairs(table(spark, sf_dir, "conversations"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = line_quality.train(docs, table(spark, sf_dir, "labels"))
    return line_quality.with_verdict(line_quality.label(docs, field))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = Scratch(spark).path("token-files")
    token_files.write(table(spark, sf_dir, "documents"), place, tokenizer_file("byte_bpe_50k.json"), pattern(), 2)
    return token_files.records(spark, place).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    placed = mixing.schedule(docs, **mixing.weights_by_source(docs))
    return placed.select("doc_id", "source", F.col("stream").cast("long").alias("stream"), "block", "slot", F.col("place").cast("long").alias("place"), "position")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op11_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.tampered_documents(table(spark, sf_dir, "documents")), "claimed").withColumnRenamed("id", "doc_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_hnsw": op2_hnsw,
    "op3_secret_scan": op3_secret_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_language_id": op5_language_id,
    "op6_preferences": op6_preferences,
    "op7_line_quality": op7_line_quality,
    "op8_token_files": op8_token_files,
    "op9_mixing": op9_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op11_odd_sketch": op11_odd_sketch,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}

#: SQL for DuckDB, where SQL can express the query.
ORACLE_SQL: dict[str, str] = {
    "op6_preferences": oracles.PREFERENCES,
    "op9_mixing": oracles.mixing(),
    "op11_odd_sketch": oracles.NEAR_DUPLICATES,
    "op12_merkle": oracles.merkle(),
    "op13_collocations": oracles.COLLOCATIONS,
}
