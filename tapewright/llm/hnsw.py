"""Approximate nearest neighbours by largest inner product.

Vectors are dealt by a hash into shards of about SHARD_ROWS, and each shard
gets a hierarchical navigable small-world graph, kept as flat arrays of
neighbour numbers. Every query searches every shard, in blocks of queries, and
the shards' results are merged.

The graph itself is built by inner product: a vector is linked with those of
the largest inner product with it, so long vectors, which are the likely
answers, have most links. Graphs are built in batches of growing size: the
vectors of a batch search the graph so far, together, one numpy step for all,
and are also compared with each other.

The index holds every vector; SHARD_ROWS, LINKS, BUILD_WIDTH and SEARCH_WIDTH
trade time for recall. A search of a graph takes about as long however large it
is, so the work of all queries grows with their number times the number of
shards, and larger shards, with a wider search, are the way to lower it. A shard's
vectors of very different sizes are in graphs of their own, so that single
precision is enough in each.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do null ids; vectors of different lengths are
never compared; equal scores are ordered by id; with repeated ids each row is a
candidate, and a query row never finds rows of its own id; repeated query rows
each search, and the best NEAREST of all they find are given once for the id;
an inner product beyond the largest double is infinite, and one that is not a
number makes no pair; an empty table gives an empty table; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

SHARD_ROWS = 16_384
LINKS = 20  # of a node in upper layers; twice as many in the lowest
BUILD_WIDTH = 48
SEARCH_WIDTH = 192
NEAREST = 20
QUERY_BLOCK = 256
BATCH = 256
STEP = 4  # nodes of each query that are expanded at once


def search_layer(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``width`` nodes found for each query, and their inner products, best first; -1 and -inf where fewer are found.

    All queries go on in step: each expands its STEP best nodes not expanded yet.
    """
    count = len(queries)
    ids, scores = np.full((count, width), -1), np.full((count, width), -np.inf, np.float32)
    done = np.ones((count, width), bool)
    visited = np.zeros((count, len(vectors)), bool)
    k = min(entries.shape[1], width)
    ids[:, :k] = entries[:, :k]
    scores[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qd,qkd->qk", queries, vectors[ids[:, :k]]), -np.inf)
    done[:, :k] = ids[:, :k] < 0
    rows, cols = np.nonzero(ids[:, :k] >= 0)
    visited[rows, ids[rows, cols]] = True
    active = np.arange(count)
    while len(active):
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :STEP]
        fresh = ~np.take_along_axis(done[active], pick, 1)
        going = fresh.any(1)
        active, pick, fresh = active[going], pick[going], fresh[going]
        if not len(active):
            break
        done[active[:, None], pick] = True
        near = np.where(fresh[:, :, None], links[ids[active[:, None], pick]], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & visited[active[:, None], near]] = -1
        rows, cols = np.nonzero(near >= 0)
        visited[active[rows], near[rows, cols]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[rows, cols] = np.einsum("nd,nd->n", queries[active[rows]], vectors[near[rows, cols]])
        all_scores = np.concatenate([scores[active], found], 1)
        best = np.argsort(-all_scores, axis=1, kind="stable")[:, :width]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), best, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], near < 0], 1), best, 1)
        scores[active] = np.take_along_axis(all_scores, best, 1)
    return ids, scores


def choose(vectors: np.ndarray, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, up to ``most`` with a larger inner product with the row's node than with any chosen before; -1 fills up.

    Places that stay free are filled with the best of the others.
    """
    count, size = candidates.shape
    near = vectors[candidates]
    between = np.matmul(near, near.transpose(0, 2, 1))
    chosen, left = np.zeros((count, size), bool), np.full(count, most)
    closest = np.full((count, size), -np.inf, np.float32)  # of each candidate to those chosen
    own = (vectors**2).sum(1)[candidates]
    usable = candidates >= 0
    for c in range(size):
        take = usable[:, c] & (left > 0) & (closest[:, c] < scores[:, c]) & (own[:, c] > 0)
        chosen[:, c] = take
        left -= take
        closest = np.where(take[:, None], np.maximum(closest, between[:, c]), closest)
    order = np.argsort(np.where(chosen, 0, np.where(usable, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((count, most), -1)
    picked = np.take_along_axis(np.where(usable, candidates, -1), order, 1)
    out[:, : picked.shape[1]] = picked
    return out


class Layer:
    """One layer: numbers of its nodes in the shard, and a flat array of neighbours by place in the layer."""

    def __init__(self, vectors: np.ndarray, most: int):
        self.vectors, self.most = vectors, most
        self.links = np.full((len(vectors), most), -1)
        self.used = 0

    def add(self, until: int, entries: np.ndarray | None) -> np.ndarray | None:
        """Links the nodes up to a place, in one batch; entries: where each begins to search."""
        first, self.used = self.used, until
        new = np.arange(first, until)
        own = self.vectors[new]
        inside = own @ own.T
        np.fill_diagonal(inside, -np.inf)
        k = min(BUILD_WIDTH // 2, len(new))
        peers = np.argsort(-inside, axis=1)[:, :k]
        peer_scores = np.take_along_axis(inside, peers, 1)
        peers = np.where(np.isfinite(peer_scores), new[peers], -1)
        if first:
            ids, scores = search_layer(self.vectors[:first], self.links[:first], own, np.zeros((len(new), 1), int) if entries is None else entries, BUILD_WIDTH)
            ids, scores = np.concatenate([ids, peers], 1), np.concatenate([scores, peer_scores], 1)
        else:
            ids, scores = peers, peer_scores
        order = np.argsort(-scores, axis=1, kind="stable")[:, :BUILD_WIDTH]
        ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        mine = choose(self.vectors, ids, scores, max(self.most // 2, 1))
        self.links[new, : mine.shape[1]] = mine
        rows, cols = np.nonzero(mine >= 0)
        self._link_back(mine[rows, cols], new[rows])
        return ids

    def _link_back(self, nodes: np.ndarray, others: np.ndarray) -> None:
        if not len(nodes):
            return
        order = np.argsort(nodes, kind="stable")
        nodes, others = nodes[order], others[order]
        at, starts, counts = np.unique(nodes, return_index=True, return_counts=True)
        place = np.arange(len(nodes)) - np.repeat(starts, counts)
        incoming = np.full((len(at), counts.max()), -1)
        incoming[np.repeat(np.arange(len(at)), counts), place] = others
        full = np.sort(np.concatenate([self.links[at], incoming], 1), axis=1)
        full[:, 1:][full[:, 1:] == full[:, :-1]] = -1
        scores = np.where(full >= 0, np.einsum("nd,nkd->nk", self.vectors[at], self.vectors[full]), -np.inf).astype(np.float32)
        order = np.argsort(-scores, axis=1, kind="stable")
        full, scores = np.take_along_axis(full, order, 1), np.take_along_axis(scores, order, 1)
        over = (full >= 0).sum(1) > self.most
        self.links[at[~over]] = full[~over][:, : self.most]
        for start in range(0, int(over.sum()), 512):
            rows = np.flatnonzero(over)[start : start + 512]
            self.links[at[rows]] = choose(self.vectors, full[rows, : 2 * self.most], scores[rows, : 2 * self.most], self.most)


def build(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of the vectors, and for each layer, lowest first, the neighbours of its nodes.

    A layer's nodes are the first ones in that order, so neighbours are places in it.
    """
    n = len(vectors)
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(n)
    placed = vectors[order]
    sizes = [n]
    while sizes[-1] > LINKS * 2:
        sizes.append(max(1, sizes[-1] // LINKS))
    layers = [Layer(placed[:size], LINKS * (2 if k == 0 else 1)) for k, size in enumerate(sizes)]
    done = 0
    while done < n:
        until = min(n, done + max(1, min(BATCH, done or 32)))
        entries = None
        for layer in reversed(layers):
            size = len(layer.vectors)
            if layer.used >= size:  # complete: only to find the way down
                entries, _ = search_layer(layer.vectors, layer.links, placed[done:until], np.zeros((until - done, 1), int) if entries is None else entries, 4)
            else:
                stop = min(until, size)
                ids = layer.add(stop, None if entries is None else entries[: stop - done])
                if stop == until:
                    entries = ids[:, :4]
                else:  # the nodes beyond this layer search it
                    entries, _ = search_layer(layer.vectors[:stop], layer.links[:stop], placed[done:until], np.zeros((until - done, 1), int), 4)
                if layer is not layers[0]:
                    entries = np.where(entries < layers[layers.index(layer) - 1].used, entries, -1)
                    entries[(entries < 0).all(1), 0] = 0
        done = until
    return order, [layer.links for layer in layers]


def search(placed: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, width: int) -> np.ndarray:
    """Places of the best nodes found for each query, best first, -1 where fewer are found."""
    entries = np.zeros((len(queries), 1), int)
    for links in reversed(layers[1:]):
        entries, _ = search_layer(placed[: len(links)], links, queries, entries, 8)
    return search_layer(placed, layers[0], queries, entries, width)[0]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of doubles) and size of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


#: Vectors whose largest components lie within this many powers of two share a graph.
BAND_BITS = 32


def band(v: Column) -> Column:
    """The band of a vector's largest component. Bands part at powers of two far from 1, so that usual vectors are all in one."""
    largest = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.floor((F.log2(largest) + BAND_BITS / 2) / BAND_BITS).cast("int")


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one band in single precision, divided by their largest component: nothing overflows, and none becomes zero."""
    return (vectors / np.abs(vectors).max()).astype(np.float32)


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each shard, length and band of vectors: shard, size, band, ids, vectors (doubles in graph order), layers (flat 32-bit neighbour arrays) and their widths.

    shards, the same in all rows, is the number of shards.
    """
    rows = usable(vectors, id_col, vector_col)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"), "band": band(F.col("v"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built():
            ids, matrix = np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts])
            order = np.lexsort((matrix[:, 0], ids))  # the same graph however rows arrive
            ids, matrix = ids[order], matrix[order]
            order, layers = build(scaled(matrix))
            row = [*key, shards, ids[order].astype("<i8").tobytes(), matrix[order].tobytes(), [x.astype("<i4").tobytes() for x in layers], [x.shape[1] for x in layers]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "size", "band", "shards", "ids", "vectors", "layers", "widths"])

        key, parts = None, []
        for batch in batches:
            shard, sizes, bands, ids = (batch.column(k).to_numpy() for k in range(4))
            bounds = np.flatnonzero(np.diff(shard) | np.diff(sizes) | np.diff(bands)) + 1
            for a, b in zip([0, *bounds], [*bounds, batch.num_rows]):
                if a == b:
                    continue
                own = int(shard[a]), int(sizes[a]), int(bands[a])
                if own != key:
                    if parts:
                        yield built()
                    key, parts = own, []
                parts.append((ids[a:b], _matrix(batch.column(4).slice(a, b - a), own[1])))
        if parts:
            yield built()

    sorted_ = dealt.select("shard", "size", "band", "id", "v").repartition(shards, "shard").sortWithinPartitions("shard", "size", "band")
    return sorted_.mapInArrow(run, "shard int, size int, band int, shards int, ids binary, vectors binary, layers array<binary>, widths array<int>")


def query_blocks(queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """size, block, ids, and vectors of up to about QUERY_BLOCK queries each."""
    rows = usable(queries, id_col, vector_col)
    count = max(1, -(-rows.count() // QUERY_BLOCK))
    # A row that is there very often is dealt out by its place in the input; the blocks are written down, so they stay as they are.
    block = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(count)).cast("int").alias("block")
    return rows.groupBy("size", block).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows")).select("size", "block", "rows.id", F.flatten("rows.v").alias("v"))


#: Blocks of queries that a copy of a graph serves.
BLOCKS_OF_COPY = 64


def nearest(indexed: DataFrame, blocks: DataFrame, nearest_k: int = NEAREST, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: of the candidates found, those of the largest inner product, in doubles.

    A shard's graphs go before the blocks of queries that search them, once for
    each BLOCKS_OF_COPY blocks.
    """
    first = indexed.select("shards").first()
    shards = first.shards if first else 1
    highest = blocks.agg(F.max("block")).first()[0] or 0
    copies = -(-(highest + 1) // BLOCKS_OF_COPY)
    of_graph = indexed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    graphs = of_graph.select("shard", "copy", "size", "band", "ids", "vectors", "layers", "widths", F.lit(None).cast("array<bigint>").alias("query_ids"), F.lit(None).cast("array<double>").alias("v"))
    dealt = blocks.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "copy": F.pmod("block", F.lit(copies))})
    absent = {"ids": "binary", "vectors": "binary", "layers": "array<binary>", "widths": "array<int>"}
    asked = dealt.select("shard", "copy", "size", F.lit(None).cast("int").alias("band"), *[F.lit(None).cast(k).alias(c) for c, k in absent.items()], F.col("id").alias("query_ids"), "v")
    met = graphs.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "size", F.asc_nulls_last("band"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, graphs = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                own, size = (row["shard"].as_py(), row["copy"].as_py(), row["size"].as_py()), row["size"].as_py()
                if own != key:
                    key, graphs = own, []
                if row["ids"].is_valid:
                    ids, vectors = np.frombuffer(row["ids"].as_py(), "<i8"), np.frombuffer(row["vectors"].as_py()).reshape(-1, size)
                    layers = [np.frombuffer(x, "<i4").reshape(-1, w).astype(np.int64) for x, w in zip(row["layers"].as_py(), row["widths"].as_py())]
                    graphs.append((ids, vectors, scaled(vectors), layers))
                    continue
                query_ids, queries = np.array(row["query_ids"].as_py()), np.array(row["v"].as_py()).reshape(-1, size)
                directions = (queries / np.abs(queries).max(1, keepdims=True)).astype(np.float32)
                for ids, vectors, graph, layers in graphs:
                    places = search(graph, layers, directions, width)
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = np.einsum("qd,qkd->qk", queries, vectors[places])
                    here = (places >= 0) & (ids[places] != query_ids[:, None]) & ~np.isnan(scores)
                    found = np.where(here, ids[places], np.iinfo(np.int64).max)
                    scores = np.where(here, scores, -np.inf)
                    best = np.lexsort((found, -scores, ~here), axis=1)[:, :nearest_k]
                    found, scores, here = (np.take_along_axis(x, best, 1) for x in (found, scores, here))
                    rows, cols = np.nonzero(here)
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[rows]), pa.array(found[rows, cols]), pa.array(scores[rows, cols])], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest_k).select("query_id", "rank", "vec_id", "score")


def search_all(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest_k: int = NEAREST) -> DataFrame:
    """The index of all vectors, written, and the nearest of each query."""
    scratch = Scratch(vectors.sparkSession)
    indexed = scratch.cut(index(vectors, id_col, vector_col), "hnsw")
    return nearest(indexed, scratch.cut(query_blocks(queries, id_col, vector_col), "queries"), nearest_k)
