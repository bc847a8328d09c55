r"""Merkle manifest of a table, with the proofs of whole partitions as Octopus multiproofs.

A row's leaf is the digest of its fields; the leaves of one source, in order of
their ids, are a tree whose nodes are the digests of FAN nodes below; the
sources' roots, in order of the sources, are a tree in the same way, whose root
stands for the table. Digests are SHA-256 in lowercase hex, and what they are
taken of is text.

1. Leaves are digested, sorted by ranges of (source, id) and numbered by the
   counts of earlier ranges, so one large source spans many tasks. Trees are
   built level by level with a group of FAN nodes at most for each node.
2. Leaves are dealt into partitions of CHUNK consecutive ones. A partition that
   knows its leaves needs, on each level, only those nodes that share a parent
   with nodes it knows or can derive: the smallest set of missing nodes for all
   its leaves together, worked out from coordinates alone.
3. All missing nodes are fetched by one join; the upper ones, which all
   partitions ask for, are repeated SALTS times for that.
4. A partition derives the interior nodes that its leaves share once, and from
   these expands each leaf's own proof: its siblings from the leaf up to the
   root.

Edge cases: null fields are `-`; null ids and null sources come first; rows of
equal source and id are ordered by their leaves; a source of one row has its
leaf as root; an empty table gives an empty table; texts of any length are
digested inside Spark; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

FAN = 16
#: Leaves of one partition.
CHUNK = 4096
#: Nodes of this level and above, of which there are few, are repeated for the join that fetches them.
UPPER = 3
SALTS = 64
#: The tree of the sources' roots.
TOP = -1
#: Sources up to this many rows are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The digest of fields, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    parts = []
    for field in fields:
        shown = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with place: their number in that order, from 0, which sorted ranges and the ranges' counts give."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.cut(dealt.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")).select("part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("start_"))  # one row for each range
    return placed.join(F.broadcast(starts), "part_").withColumn("place", F.col("start_") + F.col("at_")).drop("part_", "at_", "start_")


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def build(leaves: DataFrame, largest: int, scratch: Scratch) -> DataFrame:
    """tree, level, idx, n (nodes of that level of the tree) and digest of all nodes of leaves (tree, idx, n, digest); largest: the largest n."""
    levels = [leaves.select("tree", F.lit(0).alias("level"), "idx", "n", "digest")]
    for level in range(1, height(largest) + 1):
        below = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda node: node["digest"])
        grown = levels[-1].filter("n > 1").groupBy("tree", "n", (F.floor(F.col("idx") / FAN)).cast("bigint").alias("up")).agg(F.sha2(F.array_join(below, "").cast("binary"), 256).alias("digest"))
        levels.append(scratch.cut(grown.select("tree", F.lit(level).alias("level"), F.col("up").alias("idx"), F.ceil(F.col("n") / FAN).cast("bigint").alias("n"), "digest"), f"level{level}"))
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def missing(known: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(level, indices) of the fewest nodes that, with the leaves known (sorted, distinct) of a tree of n, give its root and a proof of each."""
    found, level = [], 0
    while n > 1:
        runs = np.unique(known // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        lacking = np.setdiff1d(members[members < n], known, assume_unique=True)
        if len(lacking):
            found.append((level, lacking))
        known, n, level = runs, -(-n // FAN), level + 1
    return found


class LocalTree:
    """What a partition knows of one tree: its leaves there, and nodes that were fetched."""

    def __init__(self, n: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str], above: tuple[LocalTree, int] | None = None):
        self.runs: list[dict[int, list[str]]] = []
        self.above, self._upper = above, {}
        known, level = leaves, 0
        while n > 1:
            runs = {k: [known[i] if i in known else fetched[level, i] for i in range(k * FAN, min(n, k * FAN + FAN))] for k in {i // FAN for i in known}}
            self.runs.append(runs)
            known = {k: digest("".join(run)) for k, run in runs.items()}
            n, level = -(-n // FAN), level + 1
        self.root = known[0]

    def siblings(self, level: int, idx: int) -> tuple[str, ...]:
        """Those before and after a node of a level and, in pairs like this, of the nodes above it, up to the root of the tree above."""
        if level == len(self.runs):
            return self.above[0].siblings(0, self.above[1]) if self.above else ()
        if (level, idx) not in self._upper:
            run, k = self.runs[level][idx // FAN], idx % FAN
            rest = self.siblings(level + 1, idx // FAN)
            own = "".join(run[:k]), "".join(run[k + 1 :])
            if not level:
                return *own, *rest
            self._upper[level, idx] = *own, *rest
        return self._upper[level, idx]


def fold(leaf: str, siblings: tuple[str, ...]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in zip(siblings[::2], siblings[1::2]):
        leaf = digest(before + leaf + after)
    return leaf


def placed_leaves(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (source, id, leaf, more) with tree (the source's number), idx (the row's place there), n (the source's rows), n_trees and chunk."""
    places = numbered(rows, [c for c in ("source", "id", "leaf", "claimed") if c in rows.columns], scratch, "leaves")
    trees = numbered(places.groupBy("source").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")), ["start"], scratch, "trees").withColumnRenamed("place", "tree")
    n_trees = trees.count()
    of_tree = trees.select(F.col("source").alias("source_"), "start", "n", "tree")
    met = places.join(F.broadcast(of_tree) if n_trees <= BROADCAST_ROWS else of_tree, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    out = met.withColumns({"idx": F.col("place") - F.col("start"), "n_trees": F.lit(n_trees).cast("bigint"), "chunk": F.floor(F.col("place") / CHUNK).cast("bigint")})
    return scratch.cut(out.drop("place", "start"), "placed")


def nodes_of(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """All nodes of the sources' trees and of the tree above them."""
    largest, n_trees = placed.agg(F.max("n"), F.max("n_trees")).first()
    inner = build(placed.select("tree", "idx", "n", F.col("leaf").alias("digest")), largest or 0, scratch)
    roots = inner.filter("n = 1").select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees or 0).cast("bigint").alias("n"), "digest")
    return inner.unionByName(build(scratch.cut(roots, "roots"), n_trees or 0, scratch))


def missing_nodes(placed: DataFrame) -> DataFrame:
    """chunk, tree, level and idx of the nodes that each partition must fetch."""

    def run(table: pa.Table) -> pa.Table:
        chunk, tree, idx, n, n_trees = (table.column(c).to_numpy() for c in ("chunk", "tree", "idx", "n", "n_trees"))
        order = np.lexsort((idx, tree))
        tree, idx, n = tree[order], idx[order], n[order]
        trees, first = np.unique(tree, return_index=True)
        found = [(TOP, level, i) for level, lacking in missing(trees, int(n_trees[0])) for i in lacking.tolist()]
        for t, known, size in zip(trees.tolist(), np.split(idx, first[1:]), n[first].tolist()):
            found += [(t, level, i) for level, lacking in missing(known, size) for i in lacking.tolist()]
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.table({"chunk": pa.array([int(chunk[0])] * len(found), pa.int64()), "tree": pa.array(columns[0], pa.int64()), "level": pa.array(columns[1], pa.int32()), "idx": pa.array(columns[2], pa.int64())})

    return placed.select("chunk", "tree", "idx", "n", "n_trees").groupBy("chunk").applyInArrow(run, "chunk bigint, tree bigint, level int, idx bigint")


def fetch(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted with the nodes' digests."""
    upper = (F.col("level") >= UPPER) | (F.col("tree") == TOP)
    salted = wanted.withColumn("salt", F.when(upper, F.pmod("chunk", F.lit(SALTS)).cast("int")).otherwise(0))
    repeated = nodes.withColumn("salt", F.explode(F.when(upper, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return salted.join(repeated, ["tree", "level", "idx", "salt"]).drop("salt")


def proofs(rows: DataFrame, prove: str = "leaf") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of rows (source, id, leaf, and the column prove: a leaf that a holder claims)."""
    scratch = Scratch(rows.sparkSession)
    placed = placed_leaves(rows if prove == "leaf" else rows.withColumnRenamed(prove, "claimed"), scratch)
    if prove == "leaf":
        placed = placed.withColumn("claimed", F.col("leaf"))
    nodes = nodes_of(placed, scratch)
    fetched = scratch.cut(fetch(missing_nodes(placed), nodes), "fetched")

    def expand(leaves: pa.Table, more: pa.Table) -> pa.Table:
        tree, idx, n, n_trees, leaf, claimed = (leaves.column(c).to_pylist() for c in ("tree", "idx", "n", "n_trees", "leaf", "claimed"))
        own: dict[int, dict[int, str]] = {}
        size = dict(zip(tree, n))
        for t, i, d in zip(tree, idx, leaf):
            own.setdefault(t, {})[i] = d
        others: dict[int, dict[tuple[int, int], str]] = {}
        for t, level, i, d in zip(*(more.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
            others.setdefault(t, {})[level, i] = d
        local = {t: LocalTree(size[t], known, others.get(t, {})) for t, known in own.items()}
        top = LocalTree(n_trees[0], {t: x.root for t, x in local.items()}, others.get(TOP, {}))
        for t, x in local.items():
            x.above = top, t
        paths = [local[t].siblings(0, i) for t, i in zip(tree, idx)]
        folded = [fold(c, p) for c, p in zip(claimed, paths)]
        made = [leaf, [local[t].root for t in tree], [top.root] * len(tree), [digest("".join(p)) for p in paths], folded]
        return pa.table([leaves.column("id"), *(pa.array(c, pa.string()) for c in made), pa.array([f == top.root for f in folded], pa.bool_())], names=names)

    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kind = placed.schema["id"].dataType.simpleString()
    columns = placed.select("chunk", "id", "tree", "idx", "n", "n_trees", "leaf", "claimed")
    return columns.groupBy("chunk").cogroup(fetched.groupBy("chunk")).applyInArrow(expand, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


UPPERS, LOWERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """source, id, leaf and claimed, the leaf of the row with its text in lower case where 5 divides the id's checksum."""
    fields = [F.col(c) for c in (id_col, source_col, lang_col, chars_col)]
    leaf, lowered = leaf_of(*fields, F.col(text_col)), leaf_of(*fields, F.translate(F.col(text_col), UPPERS, LOWERS))
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    return docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), leaf.alias("leaf"), F.when(hit, lowered).otherwise(leaf).alias("claimed"))
