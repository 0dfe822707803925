import numpy as np
import pytest

from lodestone.llm import op8_hnsw as H
from lodestone.scratch import Scratch


def brute(vectors, query_id, k=20):
    own = min(v for i, v in vectors if i == query_id)
    scores = sorted({(-sum(a * b for a, b in zip(own, v)), i, tuple(v)) for i, v in vectors if i != query_id and len(v) == len(own)})
    return [(i, -s) for s, i, _ in scores[:k]]


def run(spark, rows, k=20, modulus=20, **options):
    scratch = Scratch(spark)
    valid = H.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))
    from pyspark.sql import functions as F

    queries = valid.where(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    out = H.search(H.build_index(valid, scratch, k, **options), queries, scratch, k)
    found = {}
    for r in out.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_recall_over_shards_and_lengths(spark):
    r = np.random.default_rng(0)
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(r.normal(size=(1200, 12)) * r.uniform(0.5, 2, (1200, 1)))]
    found = run(spark, rows, shard_rows=400)
    clean = [(i, np.float32(v).astype(float).tolist()) for i, v, _ in rows]
    hits = [len({i for i, _ in brute(clean, q)} & {i for i, _ in found[q]}) / 20 for q in found]
    assert len(found) == 60 and np.mean(hits) >= 0.95


@pytest.mark.parametrize("kind", ["lengths", "clusters"])
def test_a_whole_shard(kind):
    """Recall and work at the size of a shard, with vectors of differing length."""
    n, r = H.SHARD_ROWS, np.random.default_rng(0)
    v = r.normal(size=(n, 64)) if kind == "lengths" else r.normal(size=(40, 64))[r.integers(0, 40, n)] + 0.5 * r.normal(size=(n, 64))
    v *= r.uniform(0.5, 2, (n, 1))
    layers, points, q, tally = H.build_graph(v, 1 - r.random(n)), H.scaled(v), v[:256], []
    found = H.search_graph(points, layers, q.astype(np.float32), tally=tally)
    best = np.take_along_axis(found, np.argsort(-np.einsum("ikj,ij->ik", v[found], q), 1)[:, :20], 1)
    true = np.argsort(-(q @ v.T), 1)[:, :20]
    assert np.mean([len({*a} & {*b}) / 20 for a, b in zip(true.tolist(), best.tolist())]) >= 0.9
    assert sum(tally) / len(q) < n / 10


def test_a_small_shard_is_found_whole():
    """Short vectors that no node is nearest to can be reached."""
    r = np.random.default_rng(3)
    for n in (1, 2, 19, 60, 120):
        v = np.abs(r.normal(size=(n, 8))) * np.exp(3 * r.normal(size=(n, 1)))
        found = H.search_graph(H.scaled(v), H.build_graph(v, 1 - r.random(n)), v.astype(np.float32)[:5])
        assert all(sorted(x for x in row if x >= 0) == list(range(n)) for row in found.tolist())


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, None, 0), (3, [], 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0), (7, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (8, [2.0, 0.0], 0), (9, [-1.0, 0.0], 0), (20, [1.0, 2.0, 3.0], 0), (40, [0.0, 1.0], 0)]
    found = run(spark, rows)
    assert found == {0: [(8, 2.0), (1, 1.0), (40, 0.0), (9, -1.0)], 40: [(0, 0.0), (1, 0.0), (8, 0.0), (9, 0.0)]}
    assert run(spark, rows[:0]) == {}


def test_copies_come_by_smallest_id(spark):
    rows = [(k, [1.0, 1.0], 0) for k in range(300)] + [(1000 + k, [float(k), 0.5], 0) for k in range(3)]
    found = run(spark, rows, k=5)
    assert [i for i, _ in found[0]] == [1002, 1, 2, 3, 4] and [i for i, _ in found[20]] == [1002, 0, 1, 2, 3]
