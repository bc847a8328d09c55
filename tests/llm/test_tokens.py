"""Encoding, length histogram and token files against the public libraries."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import byte_bpe, queries, shared, token_counts, token_files
from tapewright.llm.shared import Scratch

TEXTS = ["", None, "a", "Hello, world's  end\n\n", "é" * 70, "ab" * 3000, " \t\n", "x y\u0085z w", "naïve café №5 ½ ²³ _under_score", "日本語のテキスト 한국어", "👍🏽 emoji", "<|endoftext|> in a text", "\x1c\x1d odd \x00 controls", "the then there therefore " * 50, "don't can't we'll I'M", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k if k != 3 else None, t, 7) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=queries.pattern(), mergeable_ranks=byte_bpe.read_ranks(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")), special_tokens={})


def test_encoding_equals_library_and_decodes(docs, reference):
    path = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(docs, path, queries.pattern()), path).collect()
    want = sorted((reference.encode_ordinary(t or ""), (t or "").encode()) for t in TEXTS)
    assert sorted((list(r.ids), bytes(r.decoded)) for r in rows) == want
    sums = {r.doc_id: r for r in byte_bpe.round_trip(docs, path, queries.pattern()).collect()}
    ids = reference.encode_ordinary(TEXTS[8])
    assert sums[8].n_tokens == len(ids) and sums[8].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert byte_bpe.round_trip(docs.limit(0), path, queries.pattern()).count() == 0


def test_random_strings_of_tokens(reference):
    import random

    rng, codec = random.Random(1), byte_bpe.codec(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    tokens = list(byte_bpe.read_ranks(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")))
    for _ in range(1500):
        text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 20))).decode("utf-8", "ignore")
        assert np.frombuffer(codec.encode(text), "<i4").tolist() == reference.encode_ordinary(text)


def test_every_splitting_class(reference):
    codec = byte_bpe.codec(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    for point in [*range(0x600), *range(0x600, 0x30000, 41)]:
        if not 0xD800 <= point < 0xE000:
            text = f"a {chr(point)}b{chr(point) * 2} \n{chr(point)}"
            assert np.frombuffer(codec.encode(text), "<i4").tolist() == reference.encode_ordinary(text), hex(point)


def test_memories_are_bounded(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 7)
    monkeypatch.setattr(byte_bpe, "MEMO_PAIRS", 5)
    codec = byte_bpe.Codec(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    for text in TEXTS * 2:
        assert np.frombuffer(codec.encode(text), "<i4").tolist() == reference.encode_ordinary(text or "")
        assert len(codec.memo) <= 7 and len(codec.memo.before) <= 7 and all(len(p) <= byte_bpe.MEMO_LENGTH for p in codec.memo)


def test_repeated_rows_of_token_files(spark):
    rows = [(5, "same text"), (5, "same text"), (5, "same text"), (None, "x"), (None, "x")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, id int, frame int, row int")
    place = Scratch(spark).path("test-files")
    token_files.write(df, place, queries.tokenizer_file("byte_bpe_50k.json"), queries.pattern(), 2)
    got = token_files.records(spark, place).orderBy("start").collect()
    assert [(r.id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (None, 2, 2), (5, 4, 3), (5, 7, 3), (5, 10, 3)]


def test_histogram_answers(spark, docs, reference):
    lengths = token_counts.encoded_lengths(docs, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.pattern())
    want = [len(reference.encode_ordinary(t or "")) for t in TEXTS]
    sums = token_counts.with_suffix_sums(token_counts.histogram(lengths))
    rows = {r.n_tokens: r for r in sums.collect()}
    assert {n: r.n_docs for n, r in rows.items()} == dict(collections.Counter(want))
    for n, r in rows.items():
        assert (r.docs_at_least, r.tokens_at_least, r.truncated_total) == (sum(x >= n for x in want), sum(x for x in want if x >= n), sum(min(x, n) for x in want))
    limits = [0, 1, 3, 5, 100, 10**6]
    for r in token_counts.at_limits(sums, limits).collect():
        assert (r.docs_at_least, r.docs_over, r.truncated_total) == (sum(x >= r.context_limit for x in want), sum(x > r.context_limit for x in want), sum(min(x, r.context_limit) for x in want)), r
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(n for n in want if sum(x <= n for x in want) >= r.share * len(want))
    assert token_counts.with_suffix_sums(token_counts.histogram(lengths.limit(0))).count() == 0


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    place = Scratch(spark).path("test-files")
    token_files.write(docs, place, path, queries.pattern(), 2)
    rows = token_files.records(spark, place).orderBy("start").collect()
    assert len(rows) == len(TEXTS) and rows[0].id is None
    start = 0
    for r in rows:
        ids = library.encode((TEXTS[3 if r.id is None else r.id] or ""), add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = np.frombuffer(token_files.read_document(spark, place, 8), "<u2").tolist()
    assert {r.id: bytes(r.ids_bytes) for r in token_files.read(spark, place).collect()}[8] == np.array(one, "<u2").tobytes()
    assert one == library.encode(TEXTS[8], add_special_tokens=False).ids + [2]
    assert token_files.read_document(spark, place, 99) is None
    token_files.write(docs.limit(0), empty := Scratch(spark).path("test-files"), path, queries.pattern(), 2)
    assert token_files.records(spark, empty).count() == 0


def test_slices_hold_as_many_bytes_as_they_may():
    texts = ["x" * n for n in (5, 9 << 20, 3, 4 << 20, 4 << 20, 4 << 20, 0)] + [None]
    ids = [list(range(n)) for n in (1, 3 << 20, 2, 0, 0, 0, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(ids, pa.list_(pa.int32()))], ["text", "ids"])
    assert [b.num_rows for b in shared.slices_by_bytes(iter([batch]), 0)] == [1, 1, 2, 4]
    assert [b.num_rows for b in shared.slices_by_bytes(iter([batch]), 1)] == [1, 1, 6]
    for columns in ((0,), (1,), (0, 1)):
        parts = list(shared.slices_by_bytes(iter([batch]), *columns))
        assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([batch]).combine_chunks())
