from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.llm import op5_mixing as X

WEIGHTS = (5, 2, 1)


def targets(sizes):
    """Targets by repeated resharing, in the order of sources."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, list(names)
    left = float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_plan(spark, odd, none):
    for docs in (odd, odd.unionByName(odd.withColumn("source", F.lit("zz"))), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = X.plan(docs, keep=["doc_id", "source"], block_words=50, shards=4).collect()
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in rows:
            sizes[r.doc.source] += r["size"]
            taken[r.doc.source] += sum(p.words for p in r.pieces)
            assert sum(p.words for p in r.pieces) <= 3 * r["size"]
        want = targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.doc.source] and abs(r.target - want[r.doc.source]) < 1e-6 * max(1, r.target)
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert X.plan(none, keep=["doc_id"]).count() == 0 and X.mix(none).count() == 0


def test_reruns_agree_and_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    run = lambda n: sorted((r.doc.doc_id, [tuple(p) for p in r.pieces]) for r in X.plan(docs.repartition(n), keep=["doc_id"], block_words=100, shards=8).collect())
    first = run(3)
    assert first == run(7)
    assert {p[4] for _, pieces in first for p in pieces} == set(range(8))


def test_words_come_from_drawn_blocks(spark):
    """Pieces against blocks of the order; each drawn block is in one shard; another draw takes other words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    taken = {}
    for draw in (1, 2):
        rows = X.plan(docs, keep=["doc_id", "source"], block_words=100, shards=8, draw=draw).collect()
        sources = defaultdict(list)
        for r in rows:
            sources[r.doc.source].append(r)
        per_shard, total = defaultdict(set), 0
        for source, own in sources.items():
            own.sort(key=lambda r: r.hash)  # within a range of hashes; ranges by the low bits
            drawn = defaultdict(int)
            for r in own:
                total += sum(p.words for p in r.pieces)
                for copy in {p.copy for p in r.pieces}:
                    parts = sorted((p.begin, p.words) for p in r.pieces if p.copy == copy)
                    assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= r["size"]
                for p in r.pieces:
                    drawn[p.copy, p.block] += p.words
                    per_shard[p.shard].add((source, p.copy, p.block))
            size = own[0].source_size
            full = lambda b: min(100, size - 100 * b)
            assert all(n <= full(b) for (_, b), n in drawn.items())
            assert sum(n < full(b) for (_, b), n in drawn.items()) <= 1  # the block that the target cuts
            assert sum(drawn.values()) == round(own[0].target)
        blocks = [x for s in per_shard.values() for x in s]
        assert len(blocks) == len(set(blocks)) and max(map(len, per_shard.values())) - min(map(len, per_shard.values())) <= 1
        taken[draw] = {r.doc.doc_id: sum(p.words for p in r.pieces) for r in rows}
    assert sum(taken[1].values()) == sum(taken[2].values()) and taken[1] != taken[2]


def test_tree_quotas(spark):
    counts = spark.createDataFrame([(0, 5), (1, 17), (2, 0), (3, 1000)], "rank int, blocks long")
    rows = X.split_tree(counts, 8).collect()
    by_shard, by_source = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.quota >= 0
        by_shard[r.shard] += r.quota
        by_source[r["rank"]] += r.quota
    assert dict(by_source) == {0: 5, 1: 17, 2: 0, 3: 1000} and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_hypergeometric(spark):
    u = "(pmod(xxhash64(id), 9007199254740992) / 9007199254740992D)"
    mean, var, least, most = spark.range(20000).select(F.expr(X.hypergeometric("30L", "100L", "40L", u)).alias("k")).agg(F.avg("k"), F.var_samp("k"), F.min("k"), F.max("k")).first()
    assert abs(mean - 12) < 0.1 and abs(var - 40 * 0.3 * 0.7 * 60 / 99) < 0.25 and 0 <= least and most <= 30
    edge = spark.range(1).select(*[F.expr(X.hypergeometric(*a, "0.999D")) for a in (("0L", "10L", "4L"), ("10L", "10L", "4L"), ("3L", "10L", "0L"), ("3L", "10L", "10L"), ("0L", "0L", "0L"))]).first()
    assert tuple(edge) == (0, 4, 0, 3, 0)


def test_mix_cuts_at_words(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}.{n}" for n in range(40)), "ab"[k % 2]) for k in range(30)], "doc_id int, text string, source string")
    words = [w for r in X.mix(docs, block_words=16).collect() for w in r.text.split()]
    per = defaultdict(int)
    for w in words:
        per[int(w[1:].split(".")[0]) % 2] += 1
    assert abs(per[0] - 1200 * 5 / 7) <= 1 and abs(per[1] - 1200 * 2 / 7) <= 1 and len({w for w in words if w[-2:] == ".0"}) > 5


def test_mix_keeps_columns_and_texts(odd):
    out = X.mix(odd, whole=True)
    assert out.columns == odd.columns and {r.text for r in out.collect()} <= {r.text for r in odd.collect()}
