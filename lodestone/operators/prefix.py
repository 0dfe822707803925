"""Running sums and row numbers over any number of rows, without a task that holds them all.

Rows are written in ranges of their order, so one small row per range gives what stands before it; inside a
range a window sees that range alone. The order must end in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import Scratch


def _split(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running(rows: DataFrame, value: str, order: list, keys: list[str] | None = None, name: str = "running") -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys up to and with the own one, in order.

    A key of any size is spread over ranges; per key and range one sum goes through a window.
    """
    keys, own = keys or [], _split(order)
    ranged = rows.repartitionByRange(*[F.col(k) for k in keys], *own).withColumn("_part", F.spark_partition_id())
    held = Scratch(rows.sparkSession).save(ranged, "ranges")
    sums = held.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")
    marks = [F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]
    before = sums.withColumn("_before", upto).select(*marks, F.col("_part").alias("_p"), "_before")
    match = F.col("_part") == F.col("_p")
    for n, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(*own).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_inside", inside).join(before, match).withColumn(name, F.col("_before") + F.col("_inside")).select(*rows.columns, name)


def numbered(rows: DataFrame, order: list, name: str, top: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: numbers from 1 on in order, above the number in the one row of ``top`` (column top) if given."""
    out = running(rows.withColumn("_one", F.lit(1).cast("long")), "_one", order, name=name).drop("_one")
    return out if top is None else out.crossJoin(F.broadcast(top)).withColumn(name, F.col(name) + F.col("top")).drop("top")


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], most: str = "most") -> DataFrame:
    """Exact percentiles of each key by interpolation, and the largest value; nulls do not count.

    Equal values are counted first, then numbered range by range, so no key is sorted in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running(counts, "_n", [value], [key], "_upto")
    total = counts.groupBy(key).agg(F.sum("_n").alias("_total"), F.max(value).alias(most))
    placed = upto.join(total, key)
    at = {name: (F.col("_total") - 1) * F.lit(float(share)) for name, share in shares.items()}
    # the value at place p (from 0) is the first whose count so far goes beyond it
    low = lambda p: F.min(F.when(F.col("_upto") > F.floor(p), F.col(value)))
    high = lambda p: F.min(F.when(F.col("_upto") > F.ceil(p), F.col(value)))
    parts = [F.struct(low(p).alias("low"), high(p).alias("high"), F.max(p - F.floor(p)).alias("w")).alias(name) for name, p in at.items()]
    grouped = placed.groupBy(key).agg(F.max(most).alias(most), *parts)
    return grouped.select(key, most, *[(F.col(n)["low"] + (F.col(n)["high"] - F.col(n)["low"]) * F.col(n)["w"]).alias(n) for n in shares])
