r"""Phrase collocations from count streams in prefix and suffix order.

A phrase of 2 to MAX_WORDS words that occurs MIN_COUNT times or more is scored
by its weakest cut: with a its count and l and r the counts of the parts on
both sides of the cut, 1000000 * a * a / (l * r), floored. Phrases that mostly
occur inside one longer phrase are dropped.

1. Tasks count n-grams of about FLUSH_TOKENS words at a time as integers and
   pass distinct ones on; Spark adds the counts up and keeps frequent ones. All
   parts of a frequent n-gram are frequent, so nothing else is needed later, and
   longer n-grams are counted in passes of their own, in which tasks leave out
   those whose first or last words are no frequent n-gram. They tell by a bitmap
   of MAYBE_BITS, of fixed size for any corpus: a bit set by chance lets some
   more n-grams be counted, and none is lost.
2. The counts are laid out as two sorted streams in the shared folder: by words
   from the first to the last (prefix order), and from the last to the first
   (suffix order). A stream is cut into ranges, so a common first word may span
   many; each range gets the counts of the prefixes of its first n-gram, which
   lie in earlier ranges.
3. One pass over a range of a stream keeps the counts of the prefixes of the
   current n-gram. In prefix order they are the left counts, and an n-gram says
   whether the phrase without its last word mostly goes on like this; in suffix
   order they are the right counts, and it says so for the phrase without its
   first word. No table of counts is held or probed.
4. A merge join brings the two streams' results together.

A phrase inside one two words longer is inside one that is one word longer and
occurs as often at least, so one word more or less is enough.

Edge cases: null and empty texts have no words; a null language is UNKNOWN; a
text of any length is read in blocks; repeated rows count again; ties go to the
higher count, then to the phrase's UTF-8 bytes; extra columns are ignored; an
empty table gives an empty table. Counts up to 10 ** 15 are exact, larger ones
are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, slices_by_bytes

MAX_WORDS = 3
MIN_COUNT = 10
#: A phrase is dropped if a longer one has so many percent of its count.
INSIDE_PERCENT = 50
BEST = 2000
UNKNOWN = "und"
FLUSH_TOKENS = 2_000_000
#: Words that a task keeps numbers for; with one more block's words they fit into WORD_BITS.
FLUSH_WORDS = 1 << 19
WORD_BITS = 21
#: Bits of the map of frequent n-grams that tasks get: 16 MB.
MAYBE_BITS = 1 << 27
#: Bytes of a text that are cut into words at a time.
BLOCK_BYTES = 1 << 20

_BREAK = b"\n"
_PLAIN = bytes(0x20 if b == 0x09 else 0x0A if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _blocks(text: bytes) -> Iterator[bytes]:
    """A text in blocks of about BLOCK_BYTES that end before a space or a break, or at its end."""
    start = 0
    while start < len(text):
        ends = [text.find(mark, start + BLOCK_BYTES) for mark in (b" ", _BREAK)]
        end = min((e for e in ends if e >= 0), default=len(text))
        yield text[start:end]
        start = end


class _Numbers(dict):
    """Numbers of words from 1; a break is 0."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _mixed(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of the n-grams without their last word and of the last words."""
    with np.errstate(over="ignore"):
        out = (before * _MIX[0] ^ words) * _MIX[1]
        return out ^ (out >> np.uint64(32))


def _bits_of(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    return (hashes & np.uint64(n_bits - 1)).astype(np.int64)


class _Counter:
    """N-grams of some lengths of the words given since the last flush, by language.

    maybe: the map of frequent n-grams one word shorter than the shortest length.
    """

    def __init__(self, lengths: range, maybe: np.ndarray | None = None):
        self.lengths, self.maybe = lengths, maybe
        self.clear()

    def clear(self) -> None:
        self.numbers, self.parts, self.held = _Numbers(), {}, 0

    def full(self) -> bool:
        return self.held >= FLUSH_TOKENS or len(self.numbers) >= FLUSH_WORDS

    def add(self, lang: str, before: list[bytes], words: list[bytes]) -> None:
        """Counts the n-grams that end in words; before are the words that they follow."""
        tokens = [_BREAK, *before, *words]
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        fresh = np.ones(len(ids), bool)
        fresh[: 1 + len(before)] = False
        self.parts.setdefault(lang, []).append((ids, fresh))
        self.held += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        words = pa.array(self.numbers, pa.binary())
        own = np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), np.uint64, len(words)) if self.maybe is not None else None
        for lang, parts in self.parts.items():
            ids, fresh = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            valid, place, phrases = ids > 0, ids, words
            hashes = None if own is None else _mixed(np.full(1, xxhash.xxh64_intdigest(lang), np.uint64), own)
            if 1 in self.lengths:
                yield _batch(lang, pa.array([b""], pa.binary()), np.array([np.count_nonzero(valid & fresh)]))
                seen = np.bincount(ids[valid & fresh], minlength=len(words))
                there = np.flatnonzero(seen)
                yield from _batches(lang, words.take(pa.array(there)), seen[there])
            for n in range(2, self.lengths.stop):
                # place: of the n-gram that ends at a word, its number in phrases
                if n == self.lengths.start:
                    likely = np.zeros(len(ids), bool)
                    at = _bits_of(hashes[place[valid]], len(self.maybe) << 6)
                    likely[valid] = self.maybe[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0
                    valid = valid & likely
                valid = np.concatenate([[False], valid[:-1]]) & (valid if n == self.lengths.start else ids > 0)
                keys = np.concatenate([[0], place[:-1]]) << WORD_BITS | ids
                distinct, at = np.unique(keys[valid], return_inverse=True)
                first, last = distinct >> WORD_BITS, distinct & ((1 << WORD_BITS) - 1)
                place = np.zeros(len(ids), np.int64)
                place[valid] = at
                if hashes is not None:
                    hashes = _mixed(hashes[first], own[last])
                phrases = pc.binary_join_element_wise(phrases.take(pa.array(first)), words.take(pa.array(last)), b" ")
                if n in self.lengths:
                    counts = np.bincount(at[fresh[valid]], minlength=len(distinct))
                    there = np.flatnonzero(counts)
                    yield from _batches(lang, phrases.take(pa.array(there)), counts[there])
        self.clear()


def _batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])


def _batches(lang: str, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(counts), 1 << 16):
        yield _batch(lang, phrases[start : start + (1 << 16)], counts[start : start + (1 << 16)])


def _counted(docs: DataFrame, text_col: str, lang_col: str, lengths: range, min_count: int, maybe: np.ndarray | None = None) -> DataFrame:
    """lang, phrase and f of n-grams of these lengths that occur min_count times or more, and the numbers of words if 1 is a length."""
    given = None if maybe is None else docs.sparkSession.sparkContext.broadcast(maybe)
    most = lengths.stop - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(lengths, None if given is None else given.value)
        for batch in slices_by_bytes(batches, 1):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by_lang.setdefault(lang, []).append(text.translate(_PLAIN))
            for lang, texts in by_lang.items():
                before: list[bytes] = []
                for block in _blocks(_BREAK.join(texts)):
                    words = list(filter(None, block.replace(_BREAK, b" \n ").split(b" ")))
                    counter.add(lang, before, words)
                    before = [*before, *words][1 - most :] if most > 1 else []
                    if counter.full():
                        yield from counter.flush()
        yield from counter.flush()

    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    counted = read.mapInArrow(run, "lang string, phrase string, f bigint")
    # Tasks pass on distinct n-grams of many words, so adding up before the shuffle would hardly shrink them.
    return counted.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= min_count) | (F.col("phrase") == ""))


def maybe_map(phrases: DataFrame) -> np.ndarray:
    """The bits that the n-grams of phrases (lang, phrase) hash to. Of fixed size, so it can go to the driver and to all tasks."""
    n_bits = MAYBE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.zeros(batch.num_rows, np.uint64)
            for k, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                hash_ = np.full(1, xxhash.xxh64_intdigest(lang), np.uint64)
                for word in phrase.split(" "):
                    hash_ = _mixed(hash_, np.full(1, xxhash.xxh64_intdigest(word), np.uint64))
                hashes[k] = hash_[0]
            yield pa.RecordBatch.from_arrays([pa.array(_bits_of(hashes, n_bits))], ["bit"])

    bits = phrases.select("lang", "phrase").mapInArrow(run, "bit bigint")
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(n_bits >> 6, np.uint64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return out


def count_phrases(docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase and f of n-grams that occur min_count times or more; phrase '' has the number of words of a language."""
    found = [scratch.cut(_counted(docs, text_col, lang_col, range(1, min(max_words, 2) + 1), min_count), "counts")]
    for n in range(3, max_words + 1):
        shorter = found[-1].filter(F.size(F.split("phrase", " ")) == n - 1)
        found.append(scratch.cut(_counted(docs, text_col, lang_col, range(n, n + 1), min_count, maybe_map(shorter)), "counts"))
    counted = found[0]
    for more in found[1:]:
        counted = counted.unionByName(more)
    return counted


def stream(grams: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """grams (lang, key, f) as a sorted stream of ranges (part), with the prefixes of each range's first key from earlier ranges (carried)."""
    dealt = grams.select("lang", "key", "f").repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
    rows = scratch.cut(dealt.withColumn("part", F.spark_partition_id()), name)
    firsts = rows.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("first"))  # one row for each range
    wanted = firsts.filter(F.size("first.key") > 1).select("part", "first.lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("first.key") - 1), lambda n: F.slice("first.key", 1, n))).alias("key"))
    carried = rows.drop("part").join(F.broadcast(wanted), ["lang", "key"]).select("lang", "key", "f", "part", F.lit(True).alias("carried"))
    return rows.withColumn("carried", F.lit(False)).unionByName(carried)


def with_prefix_counts(streamed: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, key, f and counts (of its prefixes of 1, 2 and more words) of each key of two words or more; and, with null f and counts, keys that mostly go on in one way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        path: list[list] = []  # word, count and whether it has been told of, for each word of the last key
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                out: list[tuple] = []
                for part, lang, key, f, carried in zip(*(c.to_pylist() for c in batch.slice(start, 4096).columns)):
                    if at != (part, lang):
                        at, path = (part, lang), []
                    depth = len(key) - 1
                    if [p[0] for p in path[:depth]] != key[:depth]:
                        raise ValueError(f"the stream lacks a prefix of {key}")
                    path[depth:] = [[key[depth], f, False]]
                    if carried or not depth:
                        continue
                    out.append((lang, key, f, [p[1] for p in path[:depth]]))
                    last = path[depth - 1]
                    if depth > 1 and not last[2] and 100 * f >= inside_percent * last[1]:
                        last[2] = True
                        out.append((lang, key[:depth], None, None))
                columns = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names, kinds = ["lang", "key", "f", "counts"], [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64())]
    rows = streamed.select("part", "lang", "key", "f", "carried").repartitionByRange("part").sortWithinPartitions("part", "lang", "key")
    return rows.mapInArrow(run, "lang string, key array<string>, f bigint, counts array<bigint>")


#: Of all cuts the lowest score, then the earliest; a decimal of 38 digits holds 1000000 * a * a for a up to 10 ** 15.
WEAKEST_CUT = """array_min(transform(sequence(1, size(words) - 1), k -> struct(
  (1000000 * (cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)))) div (cast(lefts[k - 1] as decimal(15, 0)) * cast(rights[size(words) - k - 1] as decimal(15, 0))) as score,
  k as k, lefts[k - 1] as l, rights[size(words) - k - 1] as r)))"""


def scored(grams: DataFrame, scratch: Scratch, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, words, a, l, r and score of the phrases of grams (lang, words, f) that stay."""
    forward = scratch.cut(with_prefix_counts(stream(grams.withColumn("key", F.col("words")), scratch, "prefix-stream"), inside_percent), "lefts")
    backward = scratch.cut(with_prefix_counts(stream(grams.withColumn("key", F.reverse("words")), scratch, "suffix-stream"), inside_percent), "rights").withColumn("key", F.reverse("key"))
    lefts = forward.filter("f is not null").select("lang", F.col("key").alias("words"), F.col("f").alias("a"), F.col("counts").alias("lefts"))
    rights = backward.filter("f is not null").select("lang", F.col("key").alias("words"), F.col("counts").alias("rights"))
    dropped = forward.filter("f is null").select("lang", F.col("key").alias("words")).unionByName(backward.filter("f is null").select("lang", F.col("key").alias("words")))
    both = lefts.hint("merge").join(rights, ["lang", "words"]).join(dropped.hint("merge"), ["lang", "words"], "left_anti")
    return both.withColumn("cut", F.expr(WEAKEST_CUT)).select("lang", "words", "a", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, best: int = BEST, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    scratch = Scratch(docs.sparkSession)
    counted = count_phrases(docs, scratch, text_col, lang_col, max_words, min_count)
    grams = counted.filter("phrase != ''").select("lang", F.split("phrase", " ").alias("words"), "f")
    phrases = scored(grams, scratch, inside_percent).withColumn("phrase", F.concat_ws(" ", "words"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    totals = counted.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
