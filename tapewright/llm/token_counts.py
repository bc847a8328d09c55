"""Exact length histogram of encoded documents.

Documents are counted by their encoded length. Running sums from the longest
length down then answer, for every context limit, how many documents reach it
and how many ids are left when each document is cut there, and running sums
give totals and quantiles. The histogram is exact; nothing is sampled.

Edge cases: a null or empty text has length 0; repeated rows count each time;
null ids and extra columns don't matter; an empty table gives an empty
histogram, and its answers are null or 0. The sums over all blocks of lengths
hold a row for each BLOCK lengths that occur: a hundred thousand for texts of up
to six million ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import codec
from .shared import slices_by_bytes

#: Lengths of one block of the two-level running sums.
BLOCK = 64


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``n_tokens`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in slices_by_bytes(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([len(own.encode(t)) // 4 for t in batch.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(text_col).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs: n_tokens, n_docs. Each task counts its rows before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds to each length L of a histogram:

    docs_at_least, tokens_at_least: documents of L ids or more, and their ids;
    docs_below, tokens_below: the same of shorter documents;
    truncated_total: ids left if every document is cut to L;
    share_at_most: share of documents of at most L ids.

    The sums run inside blocks of lengths and over the blocks' totals, so no
    task sees more rows than a block has lengths, or than there are blocks.
    """
    rows = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("ids"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("ids").alias("block_ids"))
    later, whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_ids").over(later), F.lit(0)).alias("later_ids"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_ids").over(whole).alias("all_ids"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    docs_at_least, tokens_at_least = F.sum("n_docs").over(inside) + F.col("later_docs"), F.sum("ids").over(inside) + F.col("later_ids")
    return (
        rows.join(blocks, "block")
        .withColumns({"docs_at_least": docs_at_least, "tokens_at_least": tokens_at_least})
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("all_docs") - F.col("docs_at_least")).alias("docs_below"),
            (F.col("all_ids") - F.col("tokens_at_least")).alias("tokens_below"),
            (F.col("all_ids") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
            ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that reach it, documents over it, and ids left when all are cut there.

    The first length that reaches the limit has the sums of all shorter ones.
    """
    columns = []
    for limit in limits:
        first = F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "docs_at_least", "tokens_below", "n_docs")))
        everything = F.max(F.struct("n_tokens", F.col("tokens_below"), "n_docs"))
        total = everything["tokens_below"] + everything["n_tokens"] * everything["n_docs"]
        over = F.when(first["n_tokens"] == limit, first["docs_at_least"] - first["n_docs"]).otherwise(first["docs_at_least"])
        columns.append(F.struct(F.lit(limit).cast("long").alias("context_limit"), F.coalesce(first["docs_at_least"], F.lit(0)).alias("docs_at_least"), F.coalesce(over, F.lit(0)).alias("docs_over"), F.coalesce(first["tokens_below"] + first["docs_at_least"] * limit, total, F.lit(0)).alias("truncated_total")))
    return sums.agg(F.array(*columns).alias("rows")).select(F.inline("rows"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share, the smallest length that at least that share of documents don't exceed."""
    columns = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return sums.agg(F.array(*columns).alias("rows")).select(F.inline("rows"))
