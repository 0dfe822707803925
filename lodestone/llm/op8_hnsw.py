"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, results merged.

Rows with one vector form a class; a class is one node of a graph and keeps its smallest row ids, one more
than a search returns, so copies in any number cost nothing and lose nothing. Classes are dealt by a hash to
shards of at most ``SHARD_ROWS`` rows and ``SHARD_BYTES`` bytes on average.

A shard's graph is built by insertion, ``BATCH`` nodes at a time: each new node descends the layers that
there are, searches the graph in every layer that it belongs to, and links to nodes found there or before it
in its batch, chosen so that they lie in different directions; nodes with too many links back choose anew.
Nearness is the inner product itself, so vectors of any lengths are served. Layers shrink by a factor of
``DEGREE`` and are stored as flat arrays: node numbers, and a row of neighbours for each (own number where
it has fewer). In the lowest layer each node also links to the next, so every node can be reached.

A search descends the layers and keeps the ``EF`` best nodes of the lowest; all queries of a block go in
step, as array operations. A full shard's search computes less than a tenth of its inner products. Every
block of ``QUERY_BLOCK`` queries meets every shard, in one task each, so work is the product of queries and
rows times that tenth, and tasks have bounded sizes. A query's shard results are merged by one window with
partial limits. Scores are computed in double precision on the original vectors.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part;
only vectors of one length are compared; a null vec_id takes no part; rows with one vec_id and vector are
one row, and an id with several vectors queries with the least of them and is a candidate with each, but
never its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.scratch import Scratch

K, QUERY_MODULUS = 20, 20
SHARD_ROWS, SHARD_BYTES, QUERY_BLOCK = 32768, 256 << 20, 16384
DEGREE, LOW_DEGREE, EF, EXPAND = 16, 32, 128, 4
#: Nodes inserted at a time, candidates kept by an insertion's search, and candidates from its own batch.
BATCH, EF_BUILD, PEERS = 512, 64, 16


def valid_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and embedding (array of double) of rows that take part."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("embedding"))
    return found.where(F.col("vec_id").isNotNull() & sound & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 1))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors in single precision, divided by the length of the longest."""
    most = np.abs(vectors).max() if vectors.size else 0.0
    points = vectors / most if most > 0 else vectors
    longest = np.sqrt((points * points).sum(1).max()) if len(points) else 1.0
    return (points / max(longest, 1e-300)).astype(np.float32)


def _spread(points: np.ndarray, ids: np.ndarray, near: np.ndarray, degree: int, block: int = 512) -> np.ndarray:
    """Which candidates (nearest first) become links: those nearer to the node than to any link before; then the nearest left."""
    chosen = np.zeros(ids.shape, bool)
    for k in range(0, len(ids), block):
        own, to = points[ids[k : k + block]], near[k : k + block]
        between = own @ own.transpose(0, 2, 1)
        kept, n = np.zeros(to.shape, bool), np.zeros(len(to), int)
        closest = np.full(to.shape, -np.inf, np.float32)  # of a candidate to any link so far
        for c in range(ids.shape[1]):
            good = (closest[:, c] < to[:, c]) & (n < degree)
            kept[:, c] = good
            n += good
            rows = np.flatnonzero(good)
            closest[rows] = np.maximum(closest[rows], between[rows, c])
        real = to > -np.inf
        rest = np.cumsum(~kept & real, 1) <= degree - n[:, None]
        chosen[k : k + block] = (kept | rest) & real
    return chosen


def _nearest_first(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-near, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


class Layer:
    """One layer while nodes are inserted: those before ``count`` are in."""

    def __init__(self, nodes: np.ndarray, degree: int):
        self.nodes, self.degree, self.count = nodes, degree, 0
        self.links = np.repeat(np.arange(len(nodes), dtype=np.int32)[:, None], degree, 1)
        self.near = np.full((len(nodes), degree), -np.inf, np.float32)

    def insert(self, points: np.ndarray, batch: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        """Link the next places ``batch`` to candidates (ids, near) and to nearest places before them in the batch."""
        own = points[self.nodes[batch]]
        peers = own @ own.T
        peers[np.triu_indices(len(batch))] = -np.inf
        top = np.argpartition(-peers, min(PEERS, len(batch)) - 1, 1)[:, :PEERS]
        ids, near = _nearest_first(np.hstack([ids, batch[top]]), np.hstack([near, np.take_along_axis(peers, top, 1)]))
        row, col = np.nonzero(_spread(points, self.nodes[ids], near, self.degree // 2))
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        self.links[batch[row], rank], self.near[batch[row], rank] = ids[row, col], near[row, col]
        self.count += len(batch)
        if len(row):
            self._link_back(points, ids[row, col], batch[row], near[row, col])

    def _link_back(self, points: np.ndarray, target: np.ndarray, source: np.ndarray, how: np.ndarray) -> None:
        order = np.lexsort((-how, target))
        target, source, how = target[order], source[order], how[order]
        some, start, size = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(start, size)
        width = min(int(size.max()), self.degree)
        fits, at = rank < width, np.repeat(np.arange(len(some)), size)
        new_ids, new_near = np.repeat(some[:, None], width, 1), np.full((len(some), width), -np.inf, np.float32)
        new_ids[at[fits], rank[fits]], new_near[at[fits], rank[fits]] = source[fits], how[fits]
        ids, near = _nearest_first(np.hstack([self.links[some], new_ids]), np.hstack([self.near[some], new_near]))
        full = (near > -np.inf).sum(1) > self.degree
        if full.any():
            chosen = _spread(points, self.nodes[ids[full]], near[full], self.degree)
            ids[full], near[full] = _nearest_first(ids[full], np.where(chosen, near[full], -np.inf))
        ids, near = ids[:, : self.degree], near[:, : self.degree]
        self.links[some], self.near[some] = np.where(near > -np.inf, ids, some[:, None]), near


def _descend(points: np.ndarray, nodes: np.ndarray, links: np.ndarray, queries: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The place in a layer from which no neighbour is nearer to the query, for each query."""
    best = np.einsum("ij,ij->i", points[nodes[place]], queries)
    live = np.arange(len(queries))
    while len(live):
        near = links[place[live]]
        s = np.einsum("ikj,ij->ik", points[nodes[near]], queries[live])
        top = s.argmax(1)[:, None]
        value, node = np.take_along_axis(s, top, 1)[:, 0], np.take_along_axis(near, top, 1)[:, 0]
        better = value > best[live]
        live = live[better]
        place[live], best[live] = node[better], value[better]
    return place


def _beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ``ef`` best nodes found for each query (-1 where fewer) and how near, nearest first.

    Only inner products of nodes that a query has not seen are computed; ``tally`` gets how many.
    """
    n, q = len(links), len(queries)
    ids, near = np.full((q, ef), -1, np.int64), np.full((q, ef), -np.inf, np.float32)
    opened, seen = np.ones((q, ef), bool), np.zeros(q * n, bool)
    ids[:, 0], near[:, 0], opened[:, 0] = entry, np.einsum("ij,ij->i", points[entry], queries), False
    seen[np.arange(q) * n + entry] = True
    while len(live := np.flatnonzero(~opened.all(1))):
        wait = np.where(opened[live], -np.inf, near[live])
        pick = np.argpartition(-wait, min(EXPAND, ef) - 1, 1)[:, :EXPAND]
        row, col = np.nonzero(np.take_along_axis(wait, pick, 1) > -np.inf)
        col = pick[row, col]
        opened[live[row], col] = True
        flat = (live[row] * n)[:, None] + links[ids[live[row], col]]
        flat = np.unique(flat[~seen[flat]])
        seen[flat] = True
        who, node = np.divmod(flat, n)
        s = np.einsum("ij,ij->i", points[node], queries[who])
        if tally is not None:
            tally.append(len(flat))
        first = np.searchsorted(who, live)  # new nodes as a rectangle, a row per query
        size = np.searchsorted(who, live, "right") - first
        row = np.repeat(np.arange(len(live)), size)
        place = np.arange(len(flat)) - np.repeat(first, size)
        new_ids, new_near = np.zeros((len(live), int(size.max())), np.int64), np.full((len(live), int(size.max())), -np.inf, np.float32)
        new_ids[row, place], new_near[row, place] = node, s
        all_near, all_ids, all_open = np.hstack([near[live], new_near]), np.hstack([ids[live], new_ids]), np.hstack([opened[live], new_near == -np.inf])
        top = np.argpartition(-all_near, ef - 1, 1)[:, :ef]
        near[live], ids[live], opened[live] = np.take_along_axis(all_near, top, 1), np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_open, top, 1)
        opened[live] |= near[live] == -np.inf
    ids, near = _nearest_first(ids, near)
    return np.where(near > -np.inf, ids, -1), near


def build_graph(vectors: np.ndarray, draws: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest: node numbers, neighbours (places in the layer). ``draws`` in (0, 1] set each node's height."""
    points = scaled(vectors)
    height = np.floor(-np.log(draws) / np.log(DEGREE)).astype(int)
    layers = [Layer(np.flatnonzero(height >= level).astype(np.int32), DEGREE if level else LOW_DEGREE) for level in range(int(height.max()) + 1)]
    within = [points, *[points[x.nodes] for x in layers[1:]]]
    for start in range(0, len(points), BATCH):
        own = np.arange(start, min(start + BATCH, len(points)))
        at = None
        for level in range(len(layers) - 1, -1, -1):
            layer = layers[level]
            place, mine = np.zeros(len(own), np.int64), np.flatnonzero(height[own] >= level)
            before = layer.count
            if before:
                if at is not None:
                    place = np.searchsorted(layer.nodes, at)
                if level:
                    place = _descend(points, layer.nodes, layer.links, points[own], place)
            if len(mine):
                ids, near = np.empty((len(mine), 0), np.int64), np.empty((len(mine), 0), np.float32)
                if before:
                    ids, near = _beam(within[level], layer.links[:before], points[own[mine]], place[mine], min(EF_BUILD, before))
                    ids = np.maximum(ids, 0)
                layer.insert(points, np.searchsorted(layer.nodes, own[mine]), ids, near)
            if before:
                at = layer.nodes[place].astype(np.int64)
    links = layers[0].links
    links[:, -1] = np.minimum(np.arange(len(links)) + 1, len(links) - 1)
    return [(x.nodes, x.links) for x in layers]


def search_graph(points: np.ndarray, layers: list, queries: np.ndarray, ef: int = EF, tally: list | None = None) -> np.ndarray:
    """Numbers of the ``ef`` best nodes found for each query (-1 where fewer), nearest first; points as ``scaled``."""
    at = np.zeros(len(queries), np.int64)
    for level in range(len(layers) - 1, 0, -1):
        nodes, links = layers[level]
        place = np.searchsorted(nodes, at) if level < len(layers) - 1 else np.zeros(len(queries), np.int64)
        at = nodes[_descend(points, nodes, links, queries, place)].astype(np.int64)
    return _beam(points, layers[0][1], queries, at, ef, tally)[0]


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by([("c1", "ascending"), ("c2", "ascending")])
    vectors = _matrix(group.column("embedding"))
    draws = ((group.column("c1").to_numpy().astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    layers = build_graph(vectors, draws)
    ids = group.column("ids").combine_chunks()
    flat = {
        "dim": group.column("dim")[:1], "shard": group.column("shard")[:1], "n": [len(vectors)], "vectors": [vectors.astype("<f8").tobytes()],
        "ids": [ids.flatten().to_numpy().astype("<i8").tobytes()], "id_counts": [np.diff(ids.offsets.to_numpy()).astype("<i4").tobytes()],
        "layer_sizes": [np.array([len(a) for a, _ in layers], "<i4").tobytes()], "nodes": [b"".join(a.astype("<i4").tobytes() for a, _ in layers)], "links": [b"".join(b.astype("<i4").tobytes() for _, b in layers)],
    }
    return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v) for k, v in flat.items()})


INDEX_SCHEMA = "dim int, shard long, n long, vectors binary, ids binary, id_counts binary, layer_sizes binary, nodes binary, links binary"


def stored_layers(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers of an index row; the lowest has LOW_DEGREE links per node, the others DEGREE."""
    sizes, nodes, links = (np.frombuffer(row[c], "<i4") for c in ("layer_sizes", "nodes", "links"))
    out, at, to = [], 0, 0
    for k, n in enumerate(sizes.tolist()):
        degree = DEGREE if k else LOW_DEGREE
        out.append((nodes[at : at + n], links[to : to + n * degree].reshape(n, degree)))
        at, to = at + n, to + n * degree
    return out


def build_index(rows: DataFrame, scratch: Scratch, k: int = K, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: its vectors, row ids and layers as flat arrays (little-endian)."""
    keyed = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("c1"), F.xxhash64(F.lit(1), "embedding").alias("c2")).distinct()
    first = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("vec_id"))
    few = keyed.withColumn("rank", first).where(F.col("rank") <= k + 1)
    classes = few.groupBy("c1", "c2").agg(F.min(F.when(F.col("rank") == 1, F.col("embedding"))).alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.save(classes.withColumn("dim", F.size("embedding")), "classes")
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.greatest(F.ceil(F.col("n") / shard_rows), F.ceil(F.col("n") * F.col("dim") * 8 / shard_bytes)).alias("shards"))
    dealt = classes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("c2"), "shards")).select(*classes.columns, "shard")
    return scratch.save(dealt.groupBy("dim", "shard").applyInArrow(_build, INDEX_SCHEMA), "index")


def _searcher(k: int, ef: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        row = {c: index.column(c)[0].as_py() for c in ("n", "vectors", "ids", "id_counts", "layer_sizes", "nodes", "links")}
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], -1)
        points = scaled(vectors)
        ids, counts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["id_counts"], "<i4").astype(np.int64)
        begin = np.cumsum(counts) - counts
        layers = stored_layers(row)
        wanted, query_ids = _matrix(queries.column("embedding")), queries.column("vec_id").to_numpy()
        out: list[tuple] = []
        for at in range(0, len(wanted), 256):
            part, own = wanted[at : at + 256], query_ids[at : at + 256]
            found = search_graph(points, layers, (part / np.abs(part).max(1, keepdims=True)).astype(np.float32), ef)[:, : k + 8]
            scores = np.where(found >= 0, np.einsum("ikj,ij->ik", vectors[found], part), -np.inf)
            # each class stands for its smallest ids
            size = np.where(found >= 0, counts[found], 0).ravel()
            query = np.repeat(np.repeat(np.arange(len(part)), found.shape[1]), size)
            score = np.repeat(scores.ravel(), size)
            place = np.arange(len(score)) - np.repeat(np.cumsum(size) - size, size)
            vec = ids[np.repeat(begin[found].ravel(), size) + place]
            other = vec != own[query]
            query, score, vec = query[other], score[other], vec[other]
            order = np.lexsort((vec, -score, query))
            query, score, vec = query[order], score[order], vec[order]
            top = np.arange(len(query)) - np.searchsorted(query, query) < k
            out.append((own[query[top]], vec[top], score[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return search


def search(index: DataFrame, queries: DataFrame, scratch: Scratch, k: int = K, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows found for each query (vec_id, embedding), its own id excepted."""
    queries = scratch.save(queries.withColumn("dim", F.size("embedding")), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = index.select("dim", "shard")
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).join(shards.groupBy("dim").agg(F.collect_list("shard").alias("shards")), "dim")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = dealt.select("vec_id", "embedding", "dim", "block", F.explode("shards").alias("shard"))
    keys = ["dim", "shard", "block"]
    found = scratch.save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searcher(k, ef), "query_id long, vec_id long, score double"), "found")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    rows = valid_vectors(table(spark, sf_dir, "embeddings"))
    queries = rows.where(F.col("vec_id") % QUERY_MODULUS == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return search(build_index(rows, scratch), queries, scratch)
