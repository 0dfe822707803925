"""Near-duplicates by MinHash bands and sequential Bayesian verification (BayesLSH, Satuluri and Parthasarathy, 2012).

1. A document's set is its distinct word shingles. Documents with one set form a class and only classes
   are compared, so copies in any number cost one row each.
2. A class's signature has ``HASHES`` minima. Bands of ``ROWS`` of them put classes in buckets; two classes
   at the threshold share none with a probability of about 4e-7 (see ``missed``). Callers with another
   shingle size or threshold give the rows of a band too.
3. In each bucket every class is compared with the bucket's least class: a star, not all pairs. Confirmed
   links give components, and a bucket that lies in one component is done.
4. In the other buckets classes of different components are compared, block against block of about
   ``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles at most, so that a large bucket is many tasks and what a
   task holds is bounded, however long the texts are. A first pass over signatures emits the classes
   that have a candidate left; only for those are whole sets read, and a task emits links that join what
   it has not joined yet. Rows follow the classes, never their pairs.
5. Signatures are compared batch by batch. Once the posterior probability, under a uniform prior, that the
   similarity reaches the threshold is below ``MISS``, a pair is dropped. Survivors are confirmed on whole
   sets.

No step gathers a group, bucket or component in one task or on the driver, and each step's table is
written. Work in step 4 grows with the product of sizes of different components that share a bucket.
Shingles and classes are told apart by 64-bit hashes.

Defined cases: a text without words and a null text have an empty set and link to nothing; a text with
fewer words than a shingle is one shingle; a null doc_id takes part, but a component's id is its smallest
id that is not null, and a null id is kept only if its component is that one row; rows with one doc_id and
one text are one document in as many rows; doc_ids of any integer type are read as long; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, text_batches
from lodestone.llm.components import connected_components
from lodestone.scratch import Scratch

SHINGLE, PERCENT = 3, 85
HASHES, ROWS, BATCH, MISS, BLOCK, BLOCK_SHINGLES = 128, 5, 16, 1e-9, 2048, 1 << 22
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def missed(similarity: float, hashes: int = HASHES, rows: int = ROWS) -> float:
    """Probability that two sets of that similarity share no band."""
    return (1 - similarity**rows) ** (hashes // rows)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    n = len(words) - size + 1
    if n < 1:
        return np.array([digest(b" ".join(words))], np.uint64)
    of = np.fromiter(map(digest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):  # a polynomial in word hashes, mixed
        key = of[:n].copy()
        for k in range(1, size):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + of[k : k + n]
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return np.unique(key)


@lru_cache(maxsize=2)
def _coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240601)
    return r.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, hashes, np.uint64)


def signature(keys: np.ndarray, hashes: int = HASHES, chunk: int = 512) -> np.ndarray:
    """Minimum of each hash function over a set, as unsigned 32-bit integers."""
    a, b = _coefficients(hashes)
    least = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(keys), chunk):
        mixed = keys[k : k + chunk, None] * a
        mixed += b
        least = np.minimum(least, (mixed >> np.uint64(32)).astype(np.uint32).min(0))
    return least


def least_matches(percent: int = PERCENT, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """For each number of compared hashes (a batch more each time), the fewest matches that keep a pair."""
    grid = (np.arange(200000) + 0.5) / 200000
    out = []
    for n in range(batch, hashes + 1, batch):
        m = np.arange(n + 1)
        logs = m[:, None] * np.log(grid[::20]) + (n - m)[:, None] * np.log1p(-grid[::20])
        mass = np.exp(logs - logs.max(1, keepdims=True))
        above = mass[:, grid[::20] >= percent / 100].sum(1) / mass.sum(1)
        out.append(int(np.argmax(above >= miss)))
    return out


def class_of(keys: np.ndarray) -> int:
    """A set's number: 64 bits of a hash of all its shingles."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signatures(batches, size: int = SHINGLE):
    for batch in batches:
        n, nodes, signatures = [], [], []
        for text in batch.column("text").to_pylist():
            own = shingle_hashes(text or "", size)
            n.append(len(own))
            nodes.append(class_of(own) if len(own) else None)
            signatures.append(signature(own).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "row_hash", "n_shingles", "node", "signature"])


def _whole_sets(batches, size: int = SHINGLE):
    for batch in batches:
        nodes, sets = [], []
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
            own = shingle_hashes(text or "", size)
            if len(own) and class_of(own) == node:
                nodes.append(node)
                sets.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])


def _survivors(signatures_a: np.ndarray, signatures_b: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows that the posterior bounds keep, one batch of hashes after another."""
    matches = np.zeros(len(i), np.int64)
    for k, fewest in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches += (signatures_a[i, part] == signatures_b[j, part]).sum(1)
        alive = matches >= fewest
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def _linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint32).reshape(-1, HASHES)


def _prune(batches, percent: int = PERCENT):
    """Star pairs that the posterior bounds keep."""
    least = least_matches(percent)
    for batch in batches:
        n = np.arange(batch.num_rows)
        kept, _ = _survivors(_matrix(batch.column("sa").to_pylist()), _matrix(batch.column("sb").to_pylist()), n, n, least)
        yield batch.select(["a", "b"]).take(pa.array(kept))


def _confirm(batches, percent: int = PERCENT):
    """Links among star pairs, on whole sets."""
    for batch in batches:
        sides = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
        good = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


_UNIT = ["bucket", "p", "q", "band", "side", "node", "root"]


def _units(batches, extra: list[str]):
    """Rows of one block pair at a time, as lists by column; rows come in order of (bucket, p, q)."""
    names, held, key = [*_UNIT, *extra], None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        for row in zip(*columns):
            if row[:3] != key:
                if held:
                    yield dict(zip(names, zip(*held)))
                held, key = [], row[:3]
            held.append(row)
    if held:
        yield dict(zip(names, zip(*held)))


def _candidates(unit: dict, least: list[int], rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of rows of a unit, of different components, in the first band that they share."""
    s, root, side = _matrix(unit["signature"]), np.array(unit["root"]), np.array(unit["side"])
    p, q, band = unit["p"][0], unit["q"][0], unit["band"][0]
    left = np.arange(len(s)) if p == q else np.flatnonzero(side == p)
    right = left if p == q else np.flatnonzero(side == q)
    found = [(left[:0], left[:0])]
    for k in range(0, len(left), 128):
        part = left[k : k + 128]
        apart = root[part][:, None] != root[right]
        if p == q:
            apart &= part[:, None] < right
        i, j = np.nonzero(apart)
        i, j = _survivors(s, s, part[i], right[j], least)
        shared = (s[i, : HASHES // rows * rows] == s[j, : HASHES // rows * rows]).reshape(len(i), HASHES // rows, rows).all(2)
        first = shared.argmax(1) == band
        found.append((i[first], j[first]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _rest(batches, percent: int = PERCENT, rows: int = ROWS):
    """Rows of units that have a candidate left."""
    least = least_matches(percent)
    for unit in _units(batches, ["signature"]):
        kept = np.unique(np.concatenate(_candidates(unit, least, rows))).tolist()
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([unit[c][k] for k in kept], pa.int64()) for c in _UNIT], _UNIT)


def _join_up(batches, percent: int = PERCENT, rows: int = ROWS):
    """Links that join components of a unit, confirmed on whole sets."""
    least = least_matches(percent)
    for unit in _units(batches, ["signature", "set"]):
        i, j = _candidates(unit, least, rows)
        if not len(i):
            continue
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.get(x, x) != x:
                x = above[x]
            return x

        sets = [np.frombuffer(x, np.uint64) for x in unit["set"]]
        size = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.cumsum(size) - size
        mark = np.zeros(int(codes.max()) + 1, np.int64)
        order = np.argsort(i, kind="stable")
        i, j, links = i[order], j[order], []
        bounds = np.flatnonzero(np.diff(i, prepend=-1))
        for start, stop in zip(bounds, [*bounds[1:], len(i)]):
            x = int(i[start])
            others = [y for y in j[start:stop].tolist() if top(unit["root"][y]) != top(unit["root"][x])]
            if not others:
                continue
            own = codes[at[x] : at[x] + size[x]]
            mark[own] = 1
            flat = np.concatenate([codes[at[y] : at[y] + size[y]] for y in others])
            shared = np.add.reduceat(mark[flat], np.cumsum([0, *size[others][:-1]]))
            mark[own] = 0
            for y in np.array(others)[100 * shared >= percent * (size[x] + size[others] - shared)].tolist():
                a, b = top(unit["root"][x]), top(unit["root"][y])
                if a != b:
                    above[max(a, b)] = min(a, b)
                    links.append((unit["node"][x], unit["node"][y]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])


def row_hash() -> Column:
    """Key of a document, from doc_id and text as this module reads them."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


class _Job:
    """Tables of one run: docs (row_hash, text), classes (node, rep, signature, n)."""

    def __init__(self, docs: DataFrame, scratch: Scratch, size: int, percent: int, rows: int):
        self.scratch, self.size, self.percent, self.per_band = scratch, size, percent, rows
        text_batches(docs.sparkSession)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row_hash"), F.col("text").cast("string").alias("text"))
        self.rows = scratch.save(self.docs.mapInArrow(partial(_signatures, size=size), "doc_id long, row_hash long, n_shingles long, node long, signature binary"), "signatures")
        self.classes = scratch.save(self.rows.where("node is not null").groupBy("node").agg(F.min("row_hash").alias("rep"), F.first("signature").alias("signature"), F.max("n_shingles").alias("n")), "classes")

    def sets_of(self, nodes: DataFrame, name: str) -> DataFrame:
        """node, set: whole sets of distinct nodes, from the text of one row of each class."""
        wanted = nodes.join(self.classes.select("node", "rep"), "node")
        texts = self.docs.join(wanted, F.col("row_hash") == F.col("rep")).select("node", "text")
        return self.scratch.save(texts.mapInArrow(partial(_whole_sets, size=self.size), "node long, set binary").dropDuplicates(["node"]), name)

    def star(self, members: DataFrame) -> DataFrame:
        """Confirmed links between classes and their buckets' least classes."""
        signatures = self.classes.select("node", "signature")
        pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        both = pairs.join(signatures.toDF("a", "sa"), "a").join(signatures.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        kept = self.scratch.save(both.mapInArrow(partial(_prune, percent=self.percent), "a long, b long"), "star_kept")
        sets = self.sets_of(kept.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "star_sets")
        found = kept.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        links = self.scratch.save(found.mapInArrow(partial(_confirm, percent=self.percent), "a long, b long"), "star_links")
        self.scratch.drop("star_kept", "star_sets")
        return links

    def across(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Confirmed links between components that share a bucket."""
        rooted = members.join(roots.toDF("node", "root"), "node", "left").select("bucket", "band", "node", "size", F.coalesce("root", "node").alias("root"))
        counts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
        main = F.struct("n", "s", "root")
        mixed = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(main).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        # the largest component's blocks meet all other blocks, but not each other
        n_blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES))
        whole, zero, big = n_blocks(F.col("n"), F.col("s")) <= 1, F.lit(0).cast("long"), F.col("main")
        rest = n_blocks(F.col("n") - big["n"], F.col("s") - big["s"])
        blocks = mixed.select("bucket", big["root"].alias("main"), F.when(whole, zero).otherwise(n_blocks(big["n"], big["s"])).alias("g"), F.when(whole, zero + 1).otherwise(rest).alias("o"))
        sided = rooted.join(blocks, "bucket").withColumn("large", (F.col("root") == F.col("main")) & (F.col("g") > 0))
        sided = sided.withColumn("side", F.when(F.col("large"), F.pmod(F.xxhash64("node"), F.greatest("g", zero + 1))).otherwise(F.col("g") + F.pmod(F.xxhash64("node"), F.col("o"))))
        paired = sided.withColumn("other", F.explode(F.sequence(F.when(F.col("large"), F.col("g")).otherwise(zero), F.col("g") + F.col("o") - 1)))
        units = paired.select("bucket", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), F.col("band").cast("long").alias("band"), "side", "node", "root")
        signed = units.join(self.classes.select("node", "signature"), "node").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
        left = self.scratch.save(signed.select(*_UNIT, "signature").mapInArrow(partial(_rest, percent=self.percent, rows=self.per_band), ", ".join(f"{c} long" for c in _UNIT)), "units_left")
        sets = self.sets_of(left.select("node").distinct(), "unit_sets")
        whole = left.join(self.classes.select("node", "signature"), "node").join(sets, "node").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
        links = self.scratch.save(whole.select(*_UNIT, "signature", "set").mapInArrow(partial(_join_up, percent=self.percent, rows=self.per_band), "a long, b long"), "unit_links")
        self.scratch.drop("units_left", "unit_sets")
        return links


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """One row per document (doc_id, text): doc_id, row_hash, n_shingles, component_id, kept, leads.

    ``leads`` marks the document that stands for its component, whether or not ids are null or shared: that of
    the smallest id (null last) and then hash; rows repeated whole lead together and have one ``row_hash``.
    Sets are shingles of ``size`` words, links reach ``percent`` of similarity, bands have ``rows`` hashes.
    """
    scratch = Scratch(docs.sparkSession)
    job = _Job(docs, scratch, size, percent, rows)
    bands = [F.xxhash64(F.lit(k), F.substring("signature", 4 * rows * k + 1, 4 * rows)) for k in range(HASHES // rows)]
    placed = job.classes.select("node", F.col("n").alias("size"), F.posexplode(F.array(*bands)).alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = scratch.save(placed.join(shared, "bucket"), "members")
    links = job.star(members)
    roots = connected_components(links, scratch, "star_roots")
    more = job.across(members, roots)
    # components of components: links among roots, then each node's root follows its first root
    upper = more.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = connected_components(upper, scratch, "all_roots")
    labelled = job.rows.join(roots.toDF("node", "r1"), "node", "left").withColumn("r1", F.coalesce("r1", "node")).join(tops.toDF("r1", "r2"), "r1", "left")
    labelled = scratch.save(labelled.select("doc_id", "row_hash", "n_shingles", F.coalesce("r2", "r1").alias("component")), "labelled")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    least = labelled.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(first)["row_hash"].alias("first"), F.count(F.lit(1)).alias("n"))
    alone = F.col("component").isNull()
    result = labelled.join(least, "component", "left").withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), alone | (F.col("n") == 1))
    leads = alone | (F.col("row_hash") == F.col("first"))
    result = scratch.save(result.select("doc_id", "row_hash", "n_shingles", "component_id", kept.alias("kept"), leads.alias("leads")), "result")
    scratch.drop("signatures", "classes", "members", "star_links", "unit_links", "labelled")
    return result


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: The same rows from all pairs that share a shingle, for tables of tests.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS pos FROM w WHERE len(words) > 2),
t AS (SELECT doc_id, a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM u),
s AS (SELECT DISTINCT doc_id, a || ' ' || b || ' ' || c AS shingle FROM t WHERE c IS NOT NULL UNION SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
k AS (SELECT m.a, m.b FROM m JOIN n p ON p.doc_id = m.a JOIN n q ON q.doc_id = m.b WHERE 100 * i >= 85 * (p.n + q.n - i)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) g ON g.node = d.doc_id
"""
