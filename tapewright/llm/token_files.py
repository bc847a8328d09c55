"""Token ids as compressed binary records with a shared dictionary.

Every document is encoded with the tokenizers library, ended with one id, and
its ids are serialized as little-endian unsigned integers, of 16 bits if the
vocabulary allows, else of 32. One zstandard dictionary is trained on the
serialized arrays of about SAMPLE_DOCS documents, and each document is
compressed with it on its own, so that short documents can be read one by one.

File format: a folder of Parquet files, so that any store that Spark writes to
can hold it. ``dictionary`` has one row: its SHA-256 and its bytes. ``blocks``
has rows of (part, block, dictionary hash, bytes of an id, document ids, number
of ids of each document, offsets, payload): the payload is the frames one after
the other, and frame k is payload[offsets[k]:offsets[k + 1]]. Documents are in
ascending order of their id, nulls first, then of a hash of their text; part
and block number that order. Each block also lists its first and last id, so
that a search for one document skips the others by Parquet's statistics.

Encoding: a text is split by the tokenizer's own pattern, each piece is encoded
by the library's model, and pieces met before are remembered. A text that
holds one of the tokenizer's added tokens, and every text if the tokenizer's
own splitting is not the given pattern, is encoded whole by the library.

Edge cases: a null or empty text has the end id alone; each row gives one
record, also for repeated rows and null ids, and equal rows are dealt out by
their place, so that many of them don't meet in one task; an empty table gives
a folder without blocks; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import PIECES, Pieces, splitter
from .shared import Scratch, hash_fraction, held, slices_by_bytes

SAMPLE_DOCS = 1000
#: Serialized ids, before compression, of one part of the files at most on average.
PART_BYTES = 512 << 20
#: Longer texts are left out of the sample that the dictionary is trained on, so that it is bounded in bytes.
SAMPLE_CHARS = 50_000
DICTIONARY_BYTES = 65_536
LEVEL = 1
BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096


class Encoder:
    """Texts -> their serialized ids, by the tokenizers library; one for each Python worker."""

    def __init__(self, path: str, pattern: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        own = parts["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
        self.by_piece = own and pattern == PIECES
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 and end_id < 65_536 else 4
        self.kind, code = f"<u{self.width}", "H" if self.width == 2 else "I"
        self.end = np.array([end_id], self.kind).tobytes()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves; the others follow from 256
        others = [b for b in range(256) if b not in plain]
        letters = {b: 256 + k for k, b in enumerate(others)}
        space, tokenize = chr(letters[32]), self.tokenizer.model.tokenize

        def encode(piece: str) -> bytes:
            if piece.isascii() and piece.isprintable():
                written = piece.replace(" ", space)
            else:
                written = piece.encode("utf-8").decode("latin-1").translate(letters)
            ids = [t.id for t in tokenize(written)]
            return struct.pack(f"<{len(ids)}{code}", *ids)

        self.split, self.memo = splitter(pattern), Pieces(encode)

    def serialized(self, text: str | None) -> bytes:
        """The ids of a text and the end id."""
        if not text:
            return self.end
        if not self.by_piece or any(token in text for token in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, self.kind).tobytes() + self.end
        return b"".join(map(self.memo.__getitem__, self.split(text))) + self.end


def encoder(path: str, pattern: str, end_id: int) -> Encoder:
    return held(("token_files", path, pattern, end_id), lambda: Encoder(path, pattern, end_id))


@lru_cache(maxsize=2)
def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def train_dictionary(docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A zstandard dictionary of serialized id arrays, from a sample drawn by a hash of the ids."""
    import zstandard

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, end_id)
        for batch in slices_by_bytes(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([own.serialized(t) for t in batch.column(0).to_pylist()], pa.binary())], ["ids"])

    drawn = docs.filter(hash_fraction(F.col(id_col).cast("string"), share, "dictionary")).select(text_col).filter(F.length(text_col) <= SAMPLE_CHARS)
    samples = sorted(bytes(r.ids) for r in drawn.mapInArrow(run, "ids binary").orderBy("ids").limit(2 * SAMPLE_DOCS).collect())  # the limit is for one id on very many rows
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on: the arrays themselves are the dictionary
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0")


def compress(docs: DataFrame, dictionary: bytes, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tie, row (distinct), n_tokens, width and frame of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own = encoder(path, pattern, end_id)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True).compress
        for batch in slices_by_bytes(batches, 3):
            arrays = [own.serialized(t) for t in batch.column(3).to_pylist()]
            sizes = pa.array([len(a) // own.width for a in arrays], pa.int64())
            frames = pa.array([squeeze(a) for a in arrays], pa.binary())
            widths = pa.array([own.width] * len(arrays), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, widths, frames], ["id", "tie", "row", "n_tokens", "width", "frame"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tie bigint, row bigint, n_tokens bigint, width int, frame binary")


def pack(frames: DataFrame, dictionary: bytes) -> DataFrame:
    """Rows of the ``blocks`` table; frames are dealt out by ranges of the order and sorted."""
    digest, kind = hashlib.sha256(dictionary).hexdigest(), frames.schema["id"].dataType
    names = ["part", "block", "dictionary", "width", "first_id", "last_id", "ids", "n_tokens", "offsets", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts, held, block, place = [], [], [], 0, 0, None

        def packed():
            ends = np.cumsum([0] + [len(p) for p in parts]).tolist()
            row = [[place[0]], [block], [digest], [place[1]], [ids[0]], [ids[-1]], [ids], [sizes], [ends], [b"".join(parts)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), id_kind, id_kind, pa.list_(id_kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

        for batch in slices_by_bytes(batches, 4):
            id_kind = batch.column(1).type
            for part, id_, n, width, frame in zip(*(c.to_pylist() for c in batch.columns)):
                place = part, width
                ids.append(id_)
                sizes.append(n)
                parts.append(frame)
                held += len(frame)
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield packed()
                    ids, sizes, parts, held, block = [], [], [], 0, block + 1
        if ids:
            yield packed()

    ids_bytes = frames.agg(F.sum(F.col("n_tokens") * F.col("width"))).first()[0] or 0
    count = max(1, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids_bytes // PART_BYTES))
    dealt = frames.repartitionByRange(count, "id", "tie", "row").sortWithinPartitions("id", "tie", "row")
    rows = dealt.select(F.spark_partition_id().alias("part"), "id", "n_tokens", "width", "frame")
    return rows.mapInArrow(run, f"part int, block int, dictionary string, width int, first_id {kind.simpleString()}, last_id {kind.simpleString()}, ids array<{kind.simpleString()}>, n_tokens array<bigint>, offsets array<bigint>, payload binary")


def write(docs: DataFrame, place: str, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the file format to a folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    dictionary = train_dictionary(docs, path, pattern, end_id, id_col, text_col)
    frames = scratch.cut(compress(docs, dictionary, path, pattern, end_id, id_col, text_col), "frames")
    pack(frames, dictionary).write.option("compression", "none").parquet(f"{place}/blocks")
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "hash string, content binary").write.parquet(f"{place}/dictionary")


def _documents(spark: SparkSession, place: str, columns: dict[str, str], turn: Callable[[list[bytes], int], list[pa.Array]]) -> DataFrame:
    """part, block, id, before (ids of earlier documents of the block), n_tokens and what turn() makes of serialized ids and their width, for every document in a folder."""
    known = {r.hash: bytes(r.content) for r in spark.read.parquet(f"{place}/dictionary").collect()}
    blocks = spark.read.parquet(f"{place}/blocks")
    names = ["part", "block", "id", "before", "n_tokens", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                dictionary = known.get(row["dictionary"].as_py())
                if dictionary is None:
                    raise ValueError("a block was written with another dictionary")
                expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
                payload, ends, width = memoryview(row["payload"].as_buffer()), row["offsets"].as_py(), row["width"].as_py()
                ids, at = row["ids"].values, 0
                for start in range(0, len(ends) - 1, 256):
                    stop = min(start + 256, len(ends) - 1)
                    arrays = [expand(payload[a:b]) for a, b in zip(ends[start:stop], ends[start + 1 : stop + 1])]
                    sizes = np.array([len(a) // width for a in arrays], np.int64)
                    before = at + np.cumsum(sizes) - sizes
                    at += int(sizes.sum())
                    same = [pa.array(np.full(stop - start, row[c].as_py(), np.int32)) for c in ("part", "block")]
                    yield pa.RecordBatch.from_arrays([*same, ids.slice(start, stop - start), pa.array(before), pa.array(sizes), *turn(arrays, width)], names)

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    more = "".join(f", {name} {t}" for name, t in columns.items())
    return blocks.select("part", "block", "dictionary", "width", "ids", "offsets", "payload").mapInArrow(run, f"part int, block int, id {kind}, before bigint, n_tokens bigint{more}")


def read(spark: SparkSession, place: str) -> DataFrame:
    """part, block, id, before, n_tokens, width and ids_bytes (the serialized ids) of every document in a folder."""
    return _documents(spark, place, {"width": "int", "ids_bytes": "binary"}, lambda arrays, width: [pa.array([width] * len(arrays), pa.int32()), pa.array(arrays, pa.binary())])


def read_document(spark: SparkSession, place: str, doc_id) -> bytes | None:
    """The serialized ids of one document: its block is found by the ids that blocks list, and only its frame is expanded."""
    import zstandard

    wanted, at = F.lit(doc_id), F.array_position("ids", F.lit(doc_id)).cast("int")
    frame = F.expr("substring(payload, cast(element_at(offsets, at) as int) + 1, cast(element_at(offsets, at + 1) - element_at(offsets, at) as int))")
    near = spark.read.parquet(f"{place}/blocks").filter((F.col("last_id") >= wanted) & ((F.col("first_id") <= wanted) | F.col("first_id").isNull()))
    row = near.withColumn("at", at).filter("at > 0").select("dictionary", frame.alias("frame")).first()
    if row is None:
        return None
    known = spark.read.parquet(f"{place}/dictionary").filter(F.col("hash") == row.dictionary).first()
    return zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(known.content))).decompress(bytes(row.frame))


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, start): ids of all documents before a block. Sums run inside parts, and over the few parts."""
    totals = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))  # one row for each partition written
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("in_part", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("in_part")).alias("start"))


def records(spark: SparkSession, place: str) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document, from the files."""

    def summed(arrays: list[bytes], width: int) -> list[pa.Array]:
        return [pa.array([zlib.crc32(a if width == 4 else np.frombuffer(a, f"<u{width}").astype("<u4")) for a in arrays], pa.int64())]

    starts = block_starts(spark.read.parquet(f"{place}/blocks").select("part", "block", "n_tokens"))
    documents = _documents(spark, place, {"ids_crc32": "bigint"}, summed)
    return documents.join(starts, ["part", "block"]).select("id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
