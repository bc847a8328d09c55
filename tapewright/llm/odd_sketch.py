r"""MinHash near-duplicates, pruned by odd sketches.

Links every pair of texts whose sets of word shingles have a Jaccard similarity
of PERCENT / 100 or more, and gives each document the smallest id of what such
links connect. Words are runs of bytes other than space and \x09-\x0D, with A-Z
lower-cased; a text of fewer than WIDTH words has one shingle, all its words.

1. Each text's shingles are hashed to 64 bits and sampled by SAMPLES MinHash
   values. The samples are folded into an odd sketch of BITS bits: each sample
   toggles the bit that its number and value hash to, so equal samples of two
   texts cancel out in the exclusive or of their sketches.
2. Texts with equal sets form a class, one of which goes on. MinHash values are
   dealt into bands; classes that share a band's bucket are candidates.
3. The number of ones in the exclusive or of two sketches grows with the number
   of samples that differ. A pair goes on if its count is not so high that a
   similarity of the threshold or more would give it with a chance under
   TOLERANCE; that chance is summed exactly over samples and toggles.
4. Pairs that go on are confirmed on their whole sets.

Only what links connect is asked for, so a pair whose texts are connected
already is not compared. Each bucket's classes first meet one of its members,
the one that shares most buckets with others: an original that its near copies
surround. Then only pairs of a bucket that are still in different components
meet, in pairs of blocks of about BLOCK classes and BLOCK_BYTES of shingles;
buckets that hang together are one group if that has fewer pairs.
Pairs of blocks with many pairs left get the sets of both blocks, others those
of each pair. No candidate is dropped by a cap.

Edge cases: texts without words (null and empty ones too) have no shingles,
are linked with nothing and stay; repeated rows are copies; ids may be null or
repeated: a component's id is its smallest id that is not null, null if all
are, and a row is kept if its id is that (or both are null); extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import BANDS, HASHES, PAIR_OF_BLOCKS, ROWS, bands, by_pair_of_blocks, connected, in_pairs_of_blocks, keyed_join, signature
from .shared import Scratch, held, slices_by_bytes, text_key

WIDTH = 4
PERCENT = 80
SAMPLES = HASHES
BITS = 1024
TOLERANCE = 1e-6
BLOCK = 1024
#: Bytes of shingles of about one block; 8 for each shingle.
BLOCK_BYTES = 8 << 20
#: Of two blocks with more pairs left than this for each class, sets are fetched for the blocks, else for the pairs.
DENSE = 8
MEMO_WORDS = 250_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text in UTF-8; bytes.split() splits at space and \\x09-\\x0D alone."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(held("odd_sketch", _WordHashes).__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    with np.errstate(over="ignore"):
        mixed = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            mixed = (mixed ^ hashes[k : len(words) - width + 1 + k]) * _MIX[k]
            mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


@lru_cache(maxsize=1)
def _sample_seeds() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, SAMPLES, np.uint64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """The parity bitmap of MinHash values, as 64-bit words."""
    with np.errstate(over="ignore"):
        mixed = (values.astype(np.uint64) ^ _sample_seeds()) * _MIX[0]
        mixed ^= mixed >> np.uint64(32)
        place = (mixed * _MIX[1]) >> np.uint64(64 - BITS.bit_length() + 1)
    odd = (np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


@lru_cache(maxsize=8)
def most_ones(percent: int = PERCENT) -> int:
    """The largest number of ones in the exclusive or of two sketches with which a pair goes on.

    With d samples that differ, 2 * d toggles fall on the bits; the number of
    odd bits is a Markov chain, and d is binomial. Ones become more likely as d
    grows, so the threshold itself is the worst case.
    """
    place, odd = np.arange(BITS + 1), np.zeros(BITS + 1)
    odd[0] = 1
    similar, chance = percent / 100, np.zeros(BITS + 1)
    for d in range(SAMPLES + 1):
        chance += math.comb(SAMPLES, d) * (1 - similar) ** d * similar ** (SAMPLES - d) * odd
        for _ in range(2):
            up, down = odd * (BITS - place) / BITS, odd * place / BITS
            odd = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    beyond = chance[::-1].cumsum()[::-1]  # of so many ones or more
    return int(np.flatnonzero(beyond >= TOLERANCE)[-1])


def estimated_similarity(ones: int) -> float:
    """The similarity that so many ones in the exclusive or of two sketches stand for."""
    toggles = math.log1p(-min(2 * ones / BITS, 1 - 1e-9)) / math.log1p(-2 / BITS)
    return max(0.0, 1 - toggles / 2 / SAMPLES)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, id, text_key, n_shingles, set_key (null without shingles), bands and odd of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, 3):
            keys, sizes, rows, odds = [], [], [], []
            for text in batch.column(3).to_pylist():
                items = shingles(text)
                sizes.append(len(items))
                if len(items):
                    values = signature(items)
                    keys.append(xxhash.xxh3_128_digest(items.tobytes()))
                    rows.append(bands(values))
                    odds.append(odd_sketch(values))
                else:
                    for column in (keys, rows, odds):
                        column.append(None)
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["row_id", "id", "text_key", "n_shingles", "set_key", "bands", "odd"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    read = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), text_key(text).alias("text_key"), text.cast("binary").alias("text"))
    return read.mapInArrow(run, f"row_id bigint, id {kind}, text_key string, n_shingles bigint, set_key binary, bands array<bigint>, odd array<bigint>")


def ones(a: str, b: str) -> Column:
    """The number of ones in the exclusive or of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shortest, longest = sorted((len(a), len(b)))
    if 100 * shortest < percent * longest:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _top(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _candidates(sides: np.ndarray, odd: np.ndarray, labels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of different labels of two blocks, or within one, that sketches leave."""
    within, out = not sides.any(), []
    second = np.arange(len(sides)) if within else np.flatnonzero(sides == 1)
    first = second if within else np.flatnonzero(sides == 0)
    for start in range(0, len(first), 64):
        part = first[start : start + 64]
        apart = labels[part, None] != labels[None, second]
        if within:
            apart &= part[:, None] < second
        i, j = np.nonzero(apart)
        for at in range(0, len(i), 1 << 16):
            a, b = part[i[at : at + (1 << 16)]], second[j[at : at + (1 << 16)]]
            left = np.bitwise_count(odd[a] ^ odd[b]).sum(1, dtype=np.int64) <= most_ones(percent)
            out.append((a[left], b[left]))
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.zeros(0, int), np.zeros(0, int))


def _words(odd: tuple) -> np.ndarray:
    return np.array(odd, np.int64).view(np.uint64)


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, hub: the pairs (node, hub, n_shingles of node) that reach the threshold. A hub's set goes once to each block of its nodes."""
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(8 * F.col("n_shingles")) / BLOCK_BYTES)).cast("int")
    blocks = pairs.groupBy("hub").agg(n_blocks.alias("n_blocks"))
    placed = pairs.join(blocks, "hub").join(sets, "node").select(F.col("hub").alias("grp"), F.pmod(F.xxhash64("node"), "n_blocks").cast("int").alias("first"), F.lit(1).alias("side"), "node", "items")
    hubs = blocks.join(sets.withColumnRenamed("node", "hub"), "hub").select(F.col("hub").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("first"), F.lit(0).alias("side"), F.col("hub").alias("node"), "items")

    def compare(key: tuple, sides: tuple, nodes: tuple, items: tuple) -> list[tuple[int, int]]:
        if sides[0] != 0:
            raise ValueError("a block without its hub")
        hub = np.frombuffer(items[0], np.uint64)
        return [(node, key[0]) for side, node, set_ in zip(sides, nodes, items) if side and _similar(hub, np.frombuffer(set_, np.uint64), percent)]

    rows = hubs.unionByName(placed).withColumns({"band": F.lit(-1), "second": F.col("first")})
    return by_pair_of_blocks(rows, ["items"], "node bigint, hub bigint", compare)


def _pair_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, hub: the pairs (a, b) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, 2, 3):
            rows = zip(*(c.to_pylist() for c in batch.columns))
            found = [(a, b) for a, b, x, y in rows if _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["node", "hub"])

    side = lambda name: sets.select(F.col("node").alias(name), F.col("items").alias(f"items_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b")
    return met.mapInArrow(run, "node bigint, hub bigint")


def _block_links(placed: DataFrame, percent: int) -> DataFrame:
    """node, hub: links that join the components of a pair of blocks; a pair whose texts are connected by then is passed over."""

    def compare(key: tuple, sides: tuple, nodes: tuple, odd: tuple, labels: tuple, items: tuple) -> list[tuple[int, int]]:
        a, b = _candidates(np.array(sides), _words(odd), np.array(labels), percent)
        index = {label: k for k, label in enumerate(dict.fromkeys(labels))}
        group, root, found = [index[label] for label in labels], list(range(len(index))), []
        sets = [np.frombuffer(s, np.uint64) for s in items]
        nearest = np.argsort(np.bitwise_count(_words(odd)[a] ^ _words(odd)[b]).sum(1, dtype=np.int64), kind="stable") if len(a) else []
        for i, j in zip(a[nearest].tolist(), b[nearest].tolist()):
            x, y = _top(root, group[i]), _top(root, group[j])
            if x != y and _similar(sets[i], sets[j], percent):
                root[max(x, y)] = min(x, y)
                found.append((nodes[i], nodes[j]))
        return found

    return by_pair_of_blocks(placed, ["odd", "label", "items"], "node bigint, hub bigint", compare)


def _left_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """The columns of PAIR_OF_BLOCKS with a and b, a pair that sketches leave, both null if the blocks have too many such pairs."""

    def compare(key: tuple, sides: tuple, nodes: tuple, odd: tuple, labels: tuple) -> list[tuple]:
        a, b = _candidates(np.array(sides), _words(odd), np.array(labels), percent)
        if len(a) > DENSE * len(nodes):
            return [(*key, None, None)]
        return [(*key, *sorted((nodes[i], nodes[j]))) for i, j in zip(a.tolist(), b.tolist())]

    return by_pair_of_blocks(placed, ["odd", "label"], "grp bigint, band int, first int, second int, a bigint, b bigint", compare)


def _edges(links: DataFrame) -> DataFrame:
    """(node, hub) with each hub's edge to itself."""
    links = links.select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub"))
    return links.unionByName(links.select(F.col("hub").alias("node"), "hub")).distinct()


def _groups(met: DataFrame, hubs: DataFrame, scratch: Scratch) -> DataFrame:
    """grp, band, n_blocks, node, odd and label: what is left to compare of met (bucket, node, label, odd, n_shingles).

    Buckets of one component are left out. Near copies of one text share most
    of its buckets, so buckets that hang together make one group, with each node
    once, if that has fewer pairs than they have one by one; else each is one.
    """
    open_ = met.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).filter("low != high").join(hubs, "bucket").select("bucket", "hub", "size")
    nodes = scratch.cut(met.join(open_, "bucket").select("bucket", "hub", "size", "node", "n_shingles", "odd", "label"), "open")
    part = connected(_edges(nodes.select("node", "hub").distinct()), scratch).withColumnRenamed("label", "part")
    pairs = nodes.filter("node = hub").join(part, "node").groupBy("part").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    whole = part.groupBy("part").agg(F.count(F.lit(1)).alias("nodes")).join(pairs, "part").select("part", (F.col("nodes") * F.col("nodes") <= F.col("pairs")).alias("whole"))
    dealt = nodes.join(part, "node").join(whole, "part").withColumns({"grp": F.when(F.col("whole"), F.col("part")).otherwise(F.col("bucket")), "band": F.when(F.col("whole"), -2).otherwise(-1)}).dropDuplicates(["grp", "band", "node"])
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(8 * F.col("n_shingles")) / BLOCK_BYTES)).cast("int")
    return dealt.join(dealt.groupBy("grp", "band").agg(n_blocks.alias("n_blocks")), ["grp", "band"]).select("grp", "band", "n_blocks", "node", "odd", "label")


def _with_items(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, 1):
            items = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], ["node", "items"])

    return texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, "node bigint, items binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: row_id, id, n_shingles, component_id and kept."""
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.cut(sketch(docs, id_col, text_col), "sketches")
    of_row = {c: F.min_by(c, "row_id").alias(c) for c in ("text_key", "n_shingles", "bands", "odd")}
    classes = scratch.cut(sketched.filter("set_key is not null").groupBy("set_key").agg(F.min("row_id").alias("node"), F.min("id").alias("least_id"), *of_row.values()), "classes")

    dealt = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    mates = scratch.cut(dealt.join(shared, "bucket").select("bucket", "node", "n"), "mates")
    weights = mates.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = scratch.cut(weights.join(classes.select("node", "text_key", "n_shingles", "odd"), "node"), "candidates")
    texts = keyed_join(docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")), weighed.select("node", "text_key"), "text_key")
    sets = scratch.cut(_with_items(texts.groupBy("node").agg(F.first("text").alias("text"))), "sets")

    hubs = scratch.cut(mates.join(weights, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub")), "hubs")
    odds = weighed.select("node", "odd", "n_shingles")
    pairs = mates.join(hubs, "bucket").filter("node != hub").select("node", "hub").distinct()
    pairs = pairs.join(odds, "node").join(odds.select(F.col("node").alias("hub"), F.col("odd").alias("hub_odd")), "hub").filter(ones("odd", "hub_odd") <= most_ones(percent)).select("node", "hub", "n_shingles")
    first = scratch.cut(_star_links(scratch.cut(pairs, "pairs"), sets, percent), "links")

    labels = connected(_edges(first), scratch)
    labelled = weighed.select("node", "n_shingles", "odd").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    met = mates.filter("n > 2").join(labelled, "node")  # two classes of a bucket have met already
    placed = scratch.cut(in_pairs_of_blocks(_groups(met, hubs, scratch)), "members")
    left = scratch.cut(_left_pairs(placed, percent), "left")
    dense = left.filter("a is null").select(*PAIR_OF_BLOCKS)
    of_blocks = placed.join(dense, PAIR_OF_BLOCKS).join(sets, "node")
    second = scratch.cut(_pair_links(left.filter("a is not null").select("a", "b").distinct(), sets, percent).unionByName(_block_links(of_blocks, percent)), "links")
    links = scratch.cut(_edges(first.unionByName(second)), "links")

    groups = connected(links, scratch)
    least = groups.join(classes.select("node", "least_id"), "node").groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = classes.select("set_key", "node", "least_id").join(groups.join(least, "label"), "node", "left").select("set_key", F.when(F.col("label").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    found = sketched.join(of_class, "set_key", "left").withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return found.select("row_id", "id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
