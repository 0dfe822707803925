"""Connected components of links in DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Node and smallest reachable node for each node of ``links`` (a, b; each link once, a <> b).

    Rounds follow the logarithm of the longest path. Each round is two aggregates with partial minima and
    two joins, which the engine can split at hub nodes; its links are written, so a round reads files only.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}_0")
    rounds, before = 0, None
    while True:
        # large star: a node's larger neighbours go to its smallest neighbour (or itself)
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        rounds += 1
        after = scratch.save(small, f"{name}_{rounds}")
        mark = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
        scratch.drop(f"{name}_{rounds - 1}")
        if mark == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges, before = after, mark
