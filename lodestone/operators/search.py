"""Full-text, vector and hybrid ranking.

A document's terms are counted once, in the scan's own projection, and the counts are written: no posting
list of the corpus is shuffled, and corpus statistics and scores read numbers, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import cosine, tokens
from lodestone.scratch import Scratch

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """Computed columns that no later filter or projection computes again."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def bm25(rows: DataFrame, columns: dict[str, float], terms: list[str], keep: list[str], k1: float = K1, b: float = B, candidates: DataFrame | None = None) -> DataFrame:
    """``keep`` and ``score`` of rows that hold a term; lower is better.

    A term with spaces is a phrase; its occurrences are counted without overlap. Weights multiply term
    counts of a column; a row's length counts the tokens of all columns. Counting is by string replacement
    on the spaced-out tokens, so it stays in generated code. With ``candidates`` (their first column a column
    of ``keep``) only those rows are scored, by statistics of the whole corpus.
    """

    def spaced(c: str) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", "  "))

    def count(c: str, term: str) -> Column:
        wanted = " " + "  ".join(term.split()) + " "
        return ((F.length(f"_{c}") - F.length(F.replace(F.col(f"_{c}"), F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")

    def size(c: str) -> Column:
        return F.when(F.length(f"_{c}") > 2, (F.length(f"_{c}") - F.length(F.replace(F.col(f"_{c}"), F.lit("  "), F.lit("")))) / 2 + 1).otherwise(F.lit(0)).cast("int")

    kept = [F.col(c) for c in keep]
    cut = _once(rows, *kept, *[F.concat(F.lit(" "), spaced(c), F.lit(" ")).alias(f"_{c}") for c in columns])
    counts = [count(c, t).alias(f"_n{k}_{j}") for k, t in enumerate(terms) for j, c in enumerate(columns)]
    counted = Scratch(rows.sparkSession).save(_once(cut, *kept, sum((size(c) for c in columns), F.lit(0)).alias("_len"), *counts), "counts")
    hits = [sum((F.col(f"_n{k}_{j}") for j in range(len(columns))), F.lit(0)) for k in range(len(terms))]
    heavy = [sum((F.lit(float(w)) * F.col(f"_n{k}_{j}") for j, w in enumerate(columns.values())), F.lit(0.0)) for k in range(len(terms))]
    stats = counted.agg(F.count(F.lit(1)).alias("_N"), F.avg("_len").alias("_avg"), *[F.count_if(n > 0).alias(f"_d{k}") for k, n in enumerate(hits)])
    score = F.lit(0.0)
    for k, f in enumerate(heavy):
        score = score - _idf(F.col("_N"), F.col(f"_d{k}")) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    found = counted.where(sum(hits, F.lit(0)) > 0)
    if candidates is not None:
        found = found.join(candidates.select(candidates.columns[0]), candidates.columns[0], "left_semi")
    return found.crossJoin(F.broadcast(stats)).select(*keep, score.alias("score"))


def top_by(rows: DataFrame, score: str, ident: str, n: int, descending: bool = False) -> DataFrame:
    order = F.col(score).desc() if descending else F.col(score)
    return rows.orderBy(order, ident).limit(n)


def match_class(name: Column, term: str) -> Column:
    """exact, segment, substring or other; says nothing about rank."""
    low = F.lower(name)
    return F.when(low == term, F.lit("exact")).when(F.array_contains(tokens(name), term), F.lit("segment")).when(F.contains(low, F.lit(term)), F.lit("substring")).otherwise(F.lit("other"))


def cosine_to(rows: DataFrame, vector: str, target: DataFrame) -> DataFrame:
    """Adds ``similarity`` to the single vector of ``target`` (column q)."""
    return rows.crossJoin(F.broadcast(target.limit(1))).withColumn("similarity", cosine(F.col(vector), F.col("q"))).drop("q")


def fused(pool: DataFrame, ranks: dict[str, tuple[str, bool]], ident: str, constant: float = 60.0, coverage: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of dense ranks over a bounded pool.

    ``ranks`` maps a signal's column to (direction, required): a missing optional signal ranks behind all.
    ``coverage`` gives the least share of rows with the signal for it to count at all.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy())
    out, parts = pool, []
    for column, (direction, _) in ranks.items():
        rounded = F.round(F.col(column), 12)
        order = rounded.desc_nulls_last() if direction == "desc" else rounded.asc_nulls_last()
        rank = F.when(F.col(column).isNotNull(), F.dense_rank().over(Window.orderBy(order))).otherwise(size + 1)
        out = out.withColumn(f"rank_{column}", rank)
        term = 1.0 / (constant + F.col(f"rank_{column}"))
        if coverage and column in coverage:
            share = F.count(column).over(Window.partitionBy()) / size
            out = out.withColumn(f"covered_{column}", share >= coverage[column])
            term = F.when(F.col(f"covered_{column}"), term).otherwise(F.lit(0.0))
        parts.append(term)
    return out.withColumn("rrf", sum(parts, F.lit(0.0)))


#: Words that say nothing about content (fixed values).
STOP_WORDS = [
    "the", "and", "for", "that", "with", "this", "from", "have", "been",
    "will", "would", "could", "should", "about", "into", "when", "where",
    "which", "their", "there", "then", "than", "other", "some", "only",
    "also", "after", "before", "more", "most", "such", "each", "make",
    "like", "over", "very", "just", "does", "being", "used", "using",
    "because", "between", "through", "while", "these", "those", "what",
    "your", "they", "were", "are", "was", "not", "but", "can", "all",
]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def commonest_tokens(words: Column, stop: list[str], most: int = 8, least_bytes: int = 3) -> Column:
    """The commonest of an array of words as structs (token, n), ties by name; computed in the row, without a shuffle."""
    kept = F.array_sort(F.filter(words, lambda w: (F.octet_length(w) >= least_bytes) & (~w.isin(stop) if stop else F.lit(True))))

    def runs(w: Column) -> Column:  # of equal words in the sorted array: one starts where the word before differs
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda k: (k == 0) | (F.get(w, k) != F.get(w, k - 1)))
        spans = lambda s: F.transform(s, lambda a, k: F.struct((a - F.coalesce(F.get(s, k + 1), F.size(w))).alias("less"), F.get(w, a).alias("token")))
        return F.when(F.size(w) > 0, _let(starts, spans)).otherwise(F.array().cast("array<struct<less:int,token:string>>"))

    top = F.slice(F.array_sort(_let(kept, runs)), 1, most)
    return F.transform(top, lambda r: F.struct(r["token"].alias("token"), (-r["less"]).cast("long").alias("n")))


def content_words(text: Column) -> Column:
    """Whitespace words in lower case, without what is neither letter nor digit at their edges, by one pass over the text."""
    edges = r"(?<!\S)[^\p{L}\p{N}\s]++|(?<![^\p{L}\p{N}\s])[^\p{L}\p{N}\s]++(?!\S)"
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), edges, ""), r"\s+")


def content_tokens(rows: DataFrame, ident: str, text: str, stop: list[str] | None = None, most: int = 8, least_bytes: int = 3, words: Column | None = None) -> DataFrame:
    """Each row's ``most`` commonest content words, ties by name: ident, token, n, rank."""
    top = commonest_tokens(content_words(F.col(text)) if words is None else words, STOP_WORDS if stop is None else stop, most, least_bytes)
    return rows.select(ident, F.posexplode(top).alias("_at", "_t")).select(ident, "_t.token", "_t.n", (F.col("_at") + 1).alias("rank"))


def retrieval_quality(ranked: DataFrame, expected: DataFrame, case: str, item: str, k: int) -> DataFrame:
    """recall_at_k and mrr over cases: ranked has case, item, rank; expected has case, item."""
    hits = expected.join(ranked, [case, item], "left")
    per = hits.groupBy(case).agg(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("recall"), F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("rr"))
    return per.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("recall"), 6).alias("recall_at_k"), F.round(F.avg("rr"), 6).alias("mrr"))
