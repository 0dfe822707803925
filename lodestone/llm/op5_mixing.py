"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame and SQL only).

1. Each source's documents stand in one random order (of a hash), as a run of words that is cut into blocks.
   The mix draws whole runs as often as the target holds them, and of the last run as many blocks, in a
   permuted order, as the rest of the target needs; the last block drawn may be cut.
2. The number of blocks drawn from each source is its quota. A binary tree splits the quotas of all sources
   among the output shards: at each node the left half's counts by source are a multivariate-hypergeometric
   draw, made source by source by inversion. Each shard's block count is exact, each source's too.
3. A source's drawn blocks go to the shards in disjoint runs of the permuted order, by those counts. What a
   document gives is what the drawn blocks hold of it. Within a shard rows are shuffled by a hash.

A source is never gathered in one task: its order is by hash range, then within the range, so a running
sum needs one row per source and range, and a window sees one range. Ranges and shards follow the size of
the input. What is kept per source or per shard is small and joined by the planner's own choice of strategy;
the tree's nodes have one count for each source, and sources are ranked in one task, a row for each.

Defined cases: a null source is a source, the last in order; a null or empty text has size 0, takes no words
and no place in the order; equal rows stand next to each other and each counts; an empty table gives no rows;
other columns ride along in ``doc`` and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, quoted, table
from lodestone.scratch import Scratch

WEIGHTS, MOST, BLOCK_WORDS, SEED = (5, 2, 1), 3, 16384, 17
#: Output shards, a power of two: about ``SHARD_WORDS`` words each within these bounds. A shard is as many files as it needs.
LEAST_SHARDS, MOST_SHARDS, SHARD_WORDS = 16, 1024, 1 << 26
#: Rows of a hash range, on average.
RANGE_ROWS = 1000
#: Primes below 2**31, multipliers of the block permutation (fixed values).
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranged(docs: DataFrame, keep: list[str], ranges: int, seed: int) -> DataFrame:
    text_hash = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    source = F.col("source").cast("string")
    return docs.select(
        F.struct(*[F.col(quoted(c)) for c in keep]).alias("doc"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        words(F.col("text").cast("string")).alias("size"), text_hash.alias("hash"), F.pmod(text_hash, F.lit(ranges)).alias("range"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds ``target`` to one row per source (key, source, source_size).

    Targets share the sum of sizes by weight, none above ``most`` times its size: those are level * weight,
    at the level where targets and sizes have one sum. A source is at its cap if cap / weight is below the
    level, so the level follows from running sums in that order.
    """
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(alone) - 1).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    stepped = capped.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    found = stepped.withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "rank"))).over(everything))
    return found.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("key", "source", "source_size", "rank", "target")


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(n: str, total: str, draws: str, u: str) -> str:
    """SQL for the marked items among ``draws`` taken without return from ``total`` items, ``n`` marked, by inversion of ``u``.

    Probabilities follow from the most likely count by ratios, to where they vanish in double precision.
    """
    up = "(x.n - k) * (x.c - k) / ((k + 1D) * (x.t - x.n - x.c + k + 1))"
    down = "k * (x.t - x.n - x.c + k) / ((x.n - k + 1D) * (x.c - k + 1))"
    step = lambda seq, ratio, start: f"aggregate({seq}, {start}, (s, k) -> {_let('w', f's.w * {ratio}', 'struct(w AS w, s.cum + w AS cum, s.found AS found)')}, s -> s)"
    find = lambda seq, ratio, start, to: f"aggregate({seq}, {start}, (s, k) -> {_let('w', f's.w * {ratio}', f'struct(w AS w, s.cum + w AS cum, if(s.found is null and s.cum + w > r.at, {to}, s.found) AS found)')}, s -> s)"
    rising = "if(x.hi > x.mode, sequence(x.mode, x.hi - 1), array())"
    falling = "if(x.mode > x.lo, sequence(x.mode, x.lo + 1, -1), array())"
    start = "struct(1D AS w, 0D AS cum, cast(null AS bigint) AS found)"
    risen = "struct(1D AS w, 1D AS cum, cast(null AS bigint) AS found)"
    fallen = "struct(1D AS w, q.cum AS cum, cast(null AS bigint) AS found)"
    walk = _let("q", find(rising, up, risen, "k + 1"), f"coalesce(q.found, {find(falling, down, fallen, 'k - 1')}.found, x.mode)")
    drawn = _let("r", f"struct({u} * (1D + {step(rising, up, start)}.cum + {step(falling, down, start)}.cum) AS at)", f"if(r.at < 1D, x.mode, {walk})")
    reach = "cast(40 * sqrt(x.c * (x.n / greatest(x.t, 1D)) * (1 - x.n / greatest(x.t, 1D)) * ((x.t - x.c) / greatest(x.t - 1D, 1D))) + 40 AS bigint)"
    bounded = f"struct(x.n AS n, x.t AS t, x.c AS c, x.mode AS mode, greatest(0L, x.c - (x.t - x.n), x.mode - {reach}) AS lo, least(x.n, x.c, x.mode + {reach}) AS hi)"
    moded = "struct(x.n AS n, x.t AS t, x.c AS c, greatest(0L, x.c - (x.t - x.n), least(x.n, x.c, cast(floor((x.n + 1D) * (x.c + 1) / (x.t + 2)) AS bigint))) AS mode)"
    return _let("x", f"struct({n} AS n, {total} AS t, {draws} AS c)", _let("x", moded, _let("x", bounded, drawn)))


def split_tree(counts: DataFrame, shards: int = LEAST_SHARDS, seed: int = SEED) -> DataFrame:
    """Blocks of each source (rank, blocks) for each shard: shard, rank, quota.

    ``shards`` is a power of two; shard sizes differ by at most one block. Rows: one per node, each with an
    array of one count per source.
    """
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    nodes = counts.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("blocks").alias("n")))).alias("counts")).select(F.lit(0).cast("long").alias("node"), "counts")
    nodes = nodes.withColumn("total", F.expr("aggregate(counts, 0L, (s, x) -> s + x.n)"))
    for level in range(levels):
        width = shards >> level
        # shard k holds total * (k + 1) div shards - total * k div shards blocks; a node spans `width` shards
        left = f"(grand * (node * {width} + {width // 2}) div {shards} - grand * (node * {width}) div {shards})"
        u = f"(pmod(xxhash64({seed}, {level}, node, y.rank), 9007199254740992) / 9007199254740992D)"
        draw = hypergeometric("y.n", "s.t", "s.c", u)
        drawn = f"aggregate(counts, struct(total AS t, {left} AS c, cast(array() AS array<bigint>) AS got), (s, y) -> {_let('d', draw, 'struct(s.t - y.n AS t, s.c - d AS c, array_append(s.got, d) AS got)')}, s -> s.got)"
        if not level:
            nodes = nodes.withColumn("grand", F.col("total"))
        nodes = nodes.withColumn("got", F.expr(drawn))
        halves = F.expr("array(struct(2 * node AS node, zip_with(counts, got, (c, g) -> struct(c.rank AS rank, g AS n)) AS counts), struct(2 * node + 1 AS node, zip_with(counts, got, (c, g) -> struct(c.rank AS rank, c.n - g AS n)) AS counts))")
        nodes = nodes.select("grand", F.explode(halves).alias("half")).select("grand", "half.node", "half.counts").withColumn("total", F.expr("aggregate(counts, 0L, (s, x) -> s + x.n)"))
    return nodes.select(F.col("node").alias("shard"), F.explode("counts").alias("c")).select("shard", F.col("c.rank").alias("rank"), F.col("c.n").alias("quota"))


def _quotas(targets: DataFrame, block_words: int, draw: int) -> DataFrame:
    """Adds to sources what their draws need.

    size_blocks blocks, the last of ``short`` words; ``times`` whole runs and ``rest`` words of one more; in run
    c block b is drawn as number (b * factors[c] + offsets[c]) mod size_blocks; ``gap`` is the number of the
    short block in the last run, and ``blocks`` the quota: draws in all.
    """
    own = targets.withColumn("take", F.round("target").cast("long"))
    own = own.withColumn("times", F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0).cast("long")))
    own = own.withColumn("rest", F.col("take") - F.col("times") * F.col("source_size")).withColumn("size_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    own = own.withColumn("short", F.col("source_size") - (F.col("size_blocks") - 1) * block_words)
    n, primes = "greatest(size_blocks, 1L)", f"array({', '.join(f'{p}L' for p in PRIMES)})"
    factor = f"element_at({primes}, cast(pmod(xxhash64({draw}, key, c), {len(PRIMES)}) AS int) + 1) % {n}"
    own = own.withColumn("factors", F.expr(f"transform(sequence(0L, times), c -> greatest({factor}, 1L))")).withColumn("offsets", F.expr(f"transform(sequence(0L, times), c -> pmod(xxhash64({draw}, 1, key, c), {n}))"))
    own = own.withColumn("gap", F.expr(f"((size_blocks - 1) * element_at(factors, -1) + element_at(offsets, -1)) % {n}"))
    full, cut = F.ceil(F.col("rest") / block_words), F.ceil((F.col("rest") + block_words - F.col("short")) / block_words)
    last = F.when(F.col("rest") <= 0, F.lit(0)).when(full <= F.col("gap"), full).otherwise(cut)
    return own.withColumn("blocks", F.col("times") * F.col("size_blocks") + last.cast("long"))


def plan(docs: DataFrame, keep: list[str] | None = None, shards: int | None = None, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, whole: bool = False, draw: int | None = None) -> DataFrame:
    """One row per document: doc (struct of ``keep``, default all columns), size, source_size, target, hash, pieces.

    ``pieces`` has a struct (copy, begin, words, block, shard) for each drawn block that holds words of the
    document, for each time that it is drawn. With ``whole`` a document goes, uncut, with the block that holds
    its middle word. ``seed`` orders documents, ``draw`` (default ``seed``) permutes blocks and splits quotas.
    """
    scratch, draw = Scratch(docs.sparkSession), seed if draw is None else draw
    ranges = 1 << max(4, (docs.count() // RANGE_ROWS).bit_length())
    ranged = _ranged(docs, keep or docs.columns, ranges, seed)
    stats = scratch.save(ranged.groupBy("key", "range").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "ranges")
    sources = stats.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    drawn = scratch.save(_quotas(source_targets(sources, weights, most), block_words, draw), "targets")
    if shards is None:
        total = drawn.agg(F.coalesce(F.sum("take"), F.lit(0))).first()[0]
        shards = min(MOST_SHARDS, 1 << max(LEAST_SHARDS.bit_length() - 1, (total // SHARD_WORDS).bit_length()))
    upto = F.sum("quota").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ends = split_tree(drawn.select("rank", "blocks"), shards, draw).withColumn("upto", upto).groupBy("rank").agg(F.array_sort(F.collect_list("upto")).alias("ends"))
    per_source = drawn.join(ends, "rank").drop("source", "rank", "take", "blocks")
    before = F.sum("words").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    dims = scratch.save(stats.select("key", "range", before.alias("before")).join(per_source, "key"), "dims")
    inside = Window.partitionBy("key", "range").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    sized = ranged.where("size > 0").withColumn("running", F.sum("size").over(inside))
    placed = sized.join(dims, ["key", "range"]).withColumn("pos", F.col("before") + F.col("running") - F.col("size"))
    length = f"if(b = size_blocks - 1, short, {block_words}L)"
    left = f"greatest(0L, least({length}, rest - j * {block_words} + if(j > gap, {block_words} - short, 0L)))"
    number = "(b * element_at(factors, cast(c AS int) + 1) + element_at(offsets, cast(c AS int) + 1)) % size_blocks"
    if whole:
        span, begin = f"array((pos + size div 2) div {block_words})", "0L"
        words = f"if(pos + size div 2 - b * {block_words} < v, size, 0L)"
    else:
        span, begin = f"sequence(pos div {block_words}, (pos + size - 1) div {block_words})", f"greatest(0L, b * {block_words} - pos)"
        words = f"greatest(0L, least(pos + size, b * {block_words} + v) - greatest(pos, b * {block_words}))"
    piece = _let("j", number, _let("v", f"if(c < times, {length}, {left})", f"struct(c AS copy, {begin} AS begin, {words} AS words, b AS block, cast(size(filter(ends, e -> e <= c * size_blocks + j)) AS long) AS shard)"))
    # a draw beyond the last shard's quota is none
    pieces = f"filter(flatten(transform(sequence(0L, times), c -> transform({span}, b -> {piece}))), p -> p.words > 0 and p.shard < {shards})"
    result = ["doc", "size", "source_size", "target", "hash", "pieces"]
    taken = placed.withColumn("pieces", F.expr(pieces)).select(*result)
    none = F.array().cast(taken.schema["pieces"].dataType).alias("pieces")
    empty = ranged.where("size = 0").join(drawn.select("key", "source_size", "target"), "key").select(*result[:-1], none)
    return taken.unionByName(empty)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each piece that is drawn, shard by shard, shuffled within.

    A document drawn in part gives the words drawn, joined by spaces.
    """
    seed = options.get("seed", SEED)
    taken = plan(docs, **options).select("doc", "size", "hash", F.explode("pieces").alias("p"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0)), F.col("p.begin").cast("int") + 1, F.col("p.words").cast("int")), " ")
    text = F.when(F.col("p.words") < F.col("size"), cut).otherwise(F.col("doc.text"))
    order = F.xxhash64(F.lit(seed), F.col("p.shard"), F.col("p.copy"), F.col("p.block"), F.col("hash"))
    out = F.struct(*[(text if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns])
    rows = taken.select(F.col("p.shard").alias("shard"), order.alias("order"), out.alias("doc")).repartitionByRange("shard", "order").sortWithinPartitions("shard", "order")
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives, and the shards that get it."""
    planned = plan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    shards = F.array_join(F.array_sort(F.array_distinct(F.expr("transform(pieces, p -> p.shard)"))).cast("array<string>"), ",")
    return planned.select("doc.doc_id", "size", "source_size", "target", F.expr("aggregate(pieces, 0L, (s, p) -> s + p.words)").alias("taken"), F.size("pieces").cast("long").alias("n_pieces"), shards.alias("shards"))
