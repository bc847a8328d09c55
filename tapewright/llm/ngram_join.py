r"""N-gram Jaccard join with Bayesian candidate pruning.

Finds every pair of different texts whose sets of word n-grams have a Jaccard
similarity of THRESHOLD or more. Words are runs of letters, digits and
underscores, lower-cased; a text of fewer than WIDTH words has one n-gram, all
its words.

1. Each text's n-grams are hashed to 64 bits. Texts with equal sets form a
   class, and only one of them goes on, with the number of its copies.
2. MinHash values are dealt into BANDS bands; classes that share a band's
   bucket are candidates. Buckets are stars around their smallest member, never
   lists of pairs. Connected stars form a component.
3. Candidates are compared in groups. A group is a whole component, if that has
   fewer pairs than its buckets have together, as for near copies of one text;
   else each bucket is one, and a pair is compared only in the first bucket that
   it shares, so that chains of weakly similar texts aren't compared all with
   all. A group is cut into blocks of about BLOCK classes and BLOCK_BYTES of
   n-grams, and each pair of blocks is compared on its own.
4. MinHash values are compared STEP at a time. Under a uniform prior, the chance
   that a pair with so many equal values has a similarity of THRESHOLD or more
   is that of a binomial variable; a pair is dropped when it is below
   TOLERANCE. In groups of several blocks, and in buckets, only MinHash values
   are dealt out for that. If few pairs are left of two blocks, their n-grams
   are fetched pair by pair; if many are left, for both blocks. Pairs that are
   left are verified on their whole sets.
5. From a pair of blocks come, for each class, the number of documents it is
   linked with and one class of its group there: a forest, not all pairs. The
   forest's connected components are the groups of near duplicates.

A component of m different near copies takes m * m / 2 comparisons in numpy,
spread over its pairs of blocks; its rows grow with m * m / BLOCK.

Edge cases: texts without words (null and empty ones too) have no n-grams, are
linked with nothing and stay alone; repeated rows are copies of each other;
null ids are allowed, and a group's class id is its smallest id that is not
null, so two groups may have the same one, but are never taken as one; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, held, hidden, own, shown, slices_by_bytes, text_key

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-6
BLOCK = 512
#: Bytes of n-grams of about one block; 8 for each n-gram.
BLOCK_BYTES = 4 << 20
#: Of two blocks with more pairs left than this for each class, n-grams are fetched for the blocks, else for the pairs.
DENSE = 8
MEMO_WORDS = 250_000
#: Lists of keys up to this many rows of a few numbers are broadcast, longer ones joined by a shuffle.
BROADCAST_ROWS = 200_000

WORDS = re.compile(r"\w+").findall


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = WORDS(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(held("ngram_join", _WordHashes).__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    with np.errstate(over="ignore"):
        mixed = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            mixed = (mixed ^ hashes[k : len(words) - width + 1 + k]) * _SPREAD[k]
            mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


@lru_cache(maxsize=1)
def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.Generator(np.random.PCG64(20240117)).integers(0, 2**64, (2, HASHES), np.uint64)
    return numbers[0] | np.uint64(1), numbers[1]


def signature(items: np.ndarray) -> np.ndarray:
    """MinHash values of a set that isn't empty."""
    times, plus = _hash_family()
    with np.errstate(over="ignore"):
        lowest = None
        for start in range(0, len(items), 512):  # keeps the products in the processor's cache
            part = ((items[None, start : start + 512] * times[:, None] + plus[:, None]) >> np.uint64(32)).min(1)
            lowest = part if lowest is None else np.minimum(lowest, part)
    return lowest.astype(np.uint32)


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature; keys of different bands differ."""
    with np.errstate(over="ignore"):
        rows = values.reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _SPREAD[0]
        for k in range(ROWS):
            key = (key ^ rows[:, k]) * _SPREAD[1 + k % 4]
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


@lru_cache(maxsize=8)
def fewest_matches(threshold: float) -> dict[int, int]:
    """After n MinHash values, how many must be equal for a pair to go on.

    Under a uniform prior the chance of reaching the threshold, with m of n
    equal, is that of at most m successes in n + 1 trials.
    """
    least = {}
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < TOLERANCE:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        least[n] = m
    return least


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, the document's id, text_key, set_key (null without n-grams) and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, 3):
            keys, rows = [], []
            for text in batch.column(3).to_pylist():
                items = shingles(text)
                if len(items):
                    keys.append(xxhash.xxh3_128_digest(items.tobytes()))
                    rows.append(bands(signature(items)))
                else:
                    keys.append(None)
                    rows.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["row_id", "id", "text_key", "set_key", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"row_id bigint, id {kind}, text_key string, set_key binary, bands array<bigint>")


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): every node of edges (node, hub) with the smallest hub of its component. Hubs are nodes with an edge to themselves.

    Nodes are first drawn into the smallest of their hubs; what is left is a
    small graph of hubs that share a node. There, in each round, a hub takes
    the smallest label among its neighbours, and then that label's own label,
    so the number of rounds grows with the logarithm of a component's width.
    A node has as many hubs as bands, or as pairs of blocks it is in.
    """
    nodes = scratch.cut(edges.groupBy("node").agg(F.array_sort(F.collect_set("hub")).alias("hubs")), "nodes")
    pairs = nodes.select(F.col("hubs")[0].alias("node"), F.explode(F.slice("hubs", 2, 1 << 30)).alias("hub")).distinct()
    both = scratch.cut(pairs.union(pairs.select("hub", "node")).distinct(), "edges")
    labels = scratch.cut(both.groupBy("node").agg(F.least(F.min("hub"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "hub", "label": "near"}), "hub").groupBy("node").agg(F.min("near").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        heads = stepped.select(F.col("node").alias("head"), F.col("label").alias("jumped"))
        new = scratch.cut(stepped.join(heads, F.col("label") == F.col("head"), "left").select("node", "old", F.least("label", F.coalesce("jumped", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label != old").isEmpty():
            break
    drawn = nodes.select("node", F.col("hubs")[0].alias("hub"))
    return drawn.join(labels.withColumnRenamed("node", "hub"), "hub", "left").select("node", F.coalesce("label", "hub").alias("label"))


def _verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Of pairs (a, b), those whose sets reach the threshold exactly."""
    sizes = np.array([len(s) for s in sets])
    if len(a) <= 64:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    else:
        used = np.unique(np.concatenate([a, b]))
        items, times = np.unique(np.concatenate([sets[i] for i in used]), return_counts=True)
        items = items[times > 1]
        row = np.zeros(len(sets), np.int64)
        row[used] = np.arange(len(used))
        common = np.zeros(len(a), np.int64)
        for start in range(0, len(items), 4096):  # counts up to 4096 are exact in single precision
            part = items[start : start + 4096]
            there = np.zeros((len(used), len(part)), np.float32)
            for k, i in enumerate(used):
                at = np.minimum(np.searchsorted(part, sets[i]), len(part) - 1)
                there[k, at[part[at] == sets[i]]] = 1
            common += (there @ there.T)[row[a], row[b]].astype(np.int64)
    return common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9


def _left(signs: np.ndarray, sides: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of classes of two blocks, or within one, that pruning leaves; band: the first band that they must share, -1 for any pair."""
    within, out = not sides.any(), []
    second = np.arange(len(signs)) if within else np.flatnonzero(sides == 1)
    first = second if within else np.flatnonzero(sides == 0)
    keys = None if band < 0 else np.array([bands(s) for s in signs]).reshape(len(signs), BANDS)
    for start in range(0, len(first), 64):
        part = first[start : start + 64]
        equal = (signs[part, None, :STEP] == signs[None, second, :STEP]).sum(2)
        go_on = equal >= fewest_matches(threshold)[STEP]
        if within:
            go_on &= part[:, None] < second
        i, j = np.nonzero(go_on)
        a, b, equal = part[i], second[j], equal[i, j]
        for n, least in fewest_matches(threshold).items():
            if n > STEP and len(a):
                equal = equal + (signs[a, n - STEP : n] == signs[b, n - STEP : n]).sum(1)
                go_on = equal >= least
                a, b, equal = a[go_on], b[go_on], equal[go_on]
        if keys is not None and len(a):
            same = keys[a, : band + 1] == keys[b, : band + 1]
            go_on = same[:, band] & (same.sum(1) == 1)
            a, b = a[go_on], b[go_on]
        out.append((a, b))
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.zeros(0, int), np.zeros(0, int))


def _compare(band: int, threshold: float, sides: list[int], nodes: list[int], copies: list[int], values: list[bytes], sets: list[bytes]) -> list[tuple[int, int, int]]:
    """(node, linked documents, hub) of the classes of one pair of blocks, or within one block, that have links there."""
    a, b = _left(np.frombuffer(b"".join(values), np.uint32).reshape(len(nodes), HASHES), np.array(sides), band, threshold)
    if not len(a):
        return []
    good = _verified(a, b, [np.frombuffer(s, np.uint64) for s in sets], threshold)
    a, b = a[good], b[good]
    weights = np.array(copies, np.int64)
    linked = np.bincount(a, weights[b], len(nodes)) + np.bincount(b, weights[a], len(nodes))
    root = list(range(len(nodes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = top(i), top(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [(nodes[i], int(linked[i]), nodes[top(i)]) for i in np.flatnonzero(linked).tolist()]


PAIR_OF_BLOCKS = ["grp", "band", "first", "second"]


def by_pair_of_blocks(rows: DataFrame, columns: list[str], result: str, compare: Callable[..., list[tuple]]) -> DataFrame:
    """What compare() makes of the columns of each pair of blocks; rows also have the columns of PAIR_OF_BLOCKS, and side.

    Ranges deal the pairs of blocks out evenly; all rows of one stay together.
    """
    names, kinds = zip(*[c.split() for c in result.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(key, group):
            found = compare(key, *zip(*group)) if len(group) > 1 else []
            columns_ = zip(*found) if found else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, k in zip(columns_, kinds)], list(names))

        key, group = None, []
        for batch in slices_by_bytes(batches, *binary):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != key:
                    if key is not None:
                        yield given(key, group)
                    key, group = row[:4], []
                group.append(row[4:])
        if key is not None:
            yield given(key, group)

    binary = [len(PAIR_OF_BLOCKS) + 2 + k for k, c in enumerate(columns) if rows.schema[c].dataType.typeName() == "binary"]
    dealt = rows.select(*PAIR_OF_BLOCKS, "side", "node", *columns).repartitionByRange(*PAIR_OF_BLOCKS).sortWithinPartitions(*PAIR_OF_BLOCKS, "side", "node")
    return dealt.mapInArrow(run, result)


def in_pairs_of_blocks(members: DataFrame) -> DataFrame:
    """members (grp, band, n_blocks, node, ...) once for each pair of blocks that theirs is in."""
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    dealt = members.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    sides = {"first": F.least("own", "other"), "second": F.greatest("own", "other"), "side": F.when(F.col("own") <= F.col("other"), 0).otherwise(1)}
    return dealt.withColumns(sides).drop("own", "other", "n_blocks")


def _compare_sets(placed: DataFrame, threshold: float) -> DataFrame:
    """node, linked, hub; placed: classes by pairs of blocks, with copies, signs and items."""
    return by_pair_of_blocks(placed, ["copies", "signs", "items"], "node bigint, linked bigint, hub bigint", lambda key, *columns: _compare(key[1], threshold, *columns))


def _compare_signs(placed: DataFrame, threshold: float) -> DataFrame:
    """The columns of PAIR_OF_BLOCKS with a and b, a pair that pruning leaves, both null if the blocks have too many such pairs."""

    def compare(key: tuple, sides: tuple, nodes: tuple, values: tuple) -> list[tuple]:
        a, b = _left(np.frombuffer(b"".join(values), np.uint32).reshape(len(nodes), HASHES), np.array(sides), key[1], threshold)
        if len(a) > DENSE * len(nodes):
            return [(*key, None, None)]
        return [(*key, nodes[i], nodes[j]) for i, j in zip(a.tolist(), b.tolist())]

    return by_pair_of_blocks(placed, ["signs"], "grp bigint, band int, first int, second int, a bigint, b bigint", compare)


def _verify_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """node, linked, hub from pairs (a, b), each with its n-grams fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, 4, 5):
            out = []
            for a, b, copies_a, copies_b, items_a, items_b in zip(*(c.to_pylist() for c in batch.columns)):
                if _verified(np.array([0]), np.array([1]), [np.frombuffer(items_a, np.uint64), np.frombuffer(items_b, np.uint64)], threshold)[0]:
                    out += [(a, copies_b, min(a, b)), (b, copies_a, min(a, b))]
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "linked", "hub"])

    side = lambda name: sets.select(F.col("node").alias(name), F.col("copies").alias(f"copies_{name}"), F.col("items").alias(f"items_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "copies_a", "copies_b", "items_a", "items_b")
    return met.mapInArrow(run, "node bigint, linked bigint, hub bigint")


def _with_sets(texts: DataFrame) -> DataFrame:
    """(node, text, ...) with the signature and the n-grams of the text instead of it."""
    keep = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, len(keep)):
            sets = [shingles(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], [*keep, "signs", "items"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*keep, "text").mapInArrow(run, f"{kinds}, signs binary, items binary")


def keyed_join(left: DataFrame, keys: DataFrame, on: str | list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined with a table of keys, which is broadcast if it is short."""
    rows = keys.count() if rows is None else rows
    return left.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, on, how)


def _links(mates: DataFrame, components: DataFrame, sets: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """node, linked, hub: links of all classes. mates: node, bucket, band and n, the bucket's number of classes, of each bucket of two or more."""
    in_buckets = mates.groupBy("node").agg(F.sum("n").alias("pairs"))
    sizes = components.join(sets.select("node", F.length("items").alias("bytes")), "node").join(in_buckets, "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"), F.sum("pairs").alias("pairs"))
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    small = F.col("size") <= BLOCK
    of_node = scratch.cut(components.join(sizes.select("component", n_blocks.alias("n_blocks"), small.alias("small"), (~small & (F.col("pairs") < F.col("size") * F.col("size"))).alias("by_bucket")), "component"), "groups")

    as_group = [F.col("component").alias("grp"), F.lit(-1).alias("band"), "n_blocks", "node"]
    direct = _compare_sets(in_pairs_of_blocks(of_node.filter("small").select(*as_group).join(sets, "node")), threshold)
    large = of_node.filter("not small and not by_bucket").select(*as_group)
    by_bucket = mates.join(of_node.filter("by_bucket").select("node"), "node")
    bucket_bytes = by_bucket.join(sets.select("node", F.length("items").alias("bytes")), "node").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    bucket_blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    bucketed = by_bucket.join(bucket_bytes, "bucket").select(F.col("bucket").alias("grp"), "band", bucket_blocks.alias("n_blocks"), "node")
    members = scratch.cut(large.unionByName(bucketed), "members")
    left = scratch.cut(_compare_signs(in_pairs_of_blocks(members.join(sets.select("node", "signs"), "node")), threshold), "left")
    dense = left.filter("a is null").select(*PAIR_OF_BLOCKS)
    of_blocks = in_pairs_of_blocks(members).join(dense, PAIR_OF_BLOCKS).join(sets, "node")
    return direct.unionByName(_compare_sets(of_blocks, threshold)).unionByName(_verify_pairs(left.filter("a is not null").select("a", "b"), sets, threshold))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: row_id, id, text_key, class_id, n_links and group_id.

    n_links counts the other documents that reach the threshold with this one,
    copies included; class_id is the smallest id of the group that such links
    connect, the document's own if it has none. Ids may be null or repeated, so
    groups can have the same class_id; group_id, a row_id of the group, is the
    group's key (null without n-grams).
    """
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.cut(sketch(docs, id_col, text_col), "sketches")
    classes = scratch.cut(
        sketched.filter("set_key is not null").groupBy("set_key").agg(F.min("row_id").alias("node"), F.min_by("text_key", "row_id").alias("text_key"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min_by("bands", "row_id").alias("bands")),
        "classes",
    )
    dealt = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    stars = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1")
    mates = scratch.cut(dealt.join(stars, "bucket"), "mates")
    components = connected(mates.select("node", "hub"), scratch).withColumnRenamed("label", "component")

    candidates = scratch.cut(components.join(classes.select("node", "text_key", "copies"), "node"), "candidates")
    texts = keyed_join(docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")), candidates, "text_key")
    texts = texts.groupBy("text_key", "node", "copies").agg(F.first("text").alias("text"))
    sets = scratch.cut(_with_sets(texts.select("node", "copies", "text")), "sets")
    links = scratch.cut(_links(mates, candidates.select("node", "component"), sets, scratch, threshold), "links")

    groups = connected(links.select("node", "hub"), scratch)
    least = groups.join(classes.select("node", "least_id"), "node").groupBy("label").agg(F.min("least_id").alias("class_id"))
    linked = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    of_node = groups.join(least, "label").join(linked, "node").select("node", "label", "class_id", "linked")
    of_class = classes.select("set_key", "node", "least_id", "copies").join(of_node, "node", "left").select("set_key", F.coalesce("label", "node").alias("group_id"), F.coalesce("class_id", "least_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return sketched.join(of_class, "set_key", "left").select("row_id", "id", "text_key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group: that of the smallest id, nulls last, then of the smallest key of the text."""
    scratch = Scratch(docs.sparkSession)
    joined = scratch.cut(join(docs, id_col, text_col, threshold).filter("n_links > 0"), "groups")
    chosen = joined.groupBy("group_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key", "row_id")).alias("chosen"))
    staying = chosen.select(F.col("chosen.row_id").alias("row_id"), F.lit(True).alias("stays"))  # met by rows, so that a large group is spread
    marked = joined.join(staying, "row_id", "left").select("id", "text_key", F.coalesce("stays", F.lit(False)).alias("stays"))
    of_key = scratch.cut(marked.groupBy(F.col("id").alias("key_id"), "text_key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "keys")
    rows, own_id = hidden(docs).withColumn("own_key", text_key(F.col(own(docs, text_col)))), own(docs, id_col)
    same = F.col(own_id).eqNullSafe(F.col("key_id")) & (F.col("own_key") == F.col("text_key"))
    # A row goes if its group keeps another one, or if the row that stays has equals, of which one is put back.
    goes, again = of_key.filter("not stays or n > 1"), of_key.filter("stays and n > 1")
    left = rows.join(F.broadcast(goes) if goes.count() <= BROADCAST_ROWS else goes, same, "left_anti")
    if not again.isEmpty():
        repeated = rows.join(again, same, "left_semi")
        one = repeated.groupBy(own_id, "own_key").agg(F.first(F.struct(*repeated.columns)).alias("row")).select("row.*")
        left = left.unionByName(one)
    return shown(left, docs)
