"""What several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.ship import ship

#: A word: a longest run of characters other than space, tab, line feed, VT, FF and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels no model may see: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quoted(name: str) -> str:
    """A column's name as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores after it until no column begins like it (names differ by more than case)."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


#: Rows of texts that pass between the JVM and Python at once; both sides hold a few batches for each task.
BATCH_ROWS = 2_000


def text_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most ``BATCH_ROWS`` rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mapped_texts(docs: DataFrame, keep: list[str], fields: list[T.StructField], arrow: Callable) -> DataFrame:
    """Columns ``keep`` of docs and new ``fields``, which ``arrow`` computes from batches of texts.

    Kept columns travel in one struct, so that their names cannot clash with those inside. ``arrow`` maps an
    Arrow array of texts (null for null) to one array per field.
    """
    import pyarrow as pa

    text_batches(docs.sparkSession)
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(quoted(c)) for c in keep], F.lit(0).alias(unused(keep, "pad"))).alias("doc"))
    names = [f"f{k}" for k in range(len(fields))]
    schema = T.StructType([packed.schema["doc"], *[T.StructField(n, f.dataType) for n, f in zip(names, fields)]])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrow(batch.column("text"))], ["doc", *names])

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("doc").getField(c).alias(c) for c in keep], *[F.col(n).alias(f.name) for n, f in zip(names, fields)])


def parts_of(spark: SparkSession, total_bytes: int, part_bytes: int, small: int = 8 << 20) -> int:
    """How many parts hold ``total_bytes`` at ``part_bytes`` each; for little data as many as there are shuffle partitions, of ``small`` bytes at least."""
    some = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // small))
    return max(1, -(-total_bytes // part_bytes), some)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], most_bytes: int = 1 << 20) -> DataFrame:
    """A bounded training sample: documents of the training fold with the label's value in column ``label``.

    Of each value at most ``most[value]`` doc_ids are taken, those with the smallest hashes; a doc_id labelled
    more than once has its largest label, and a null id or label does not count. A doc_id with several texts
    gives one of them, that with the smallest hash; a text of more than ``most_bytes`` is not trained on. So
    rows are bounded by the sum of ``most`` and bytes by ``most_bytes`` times that. The ids of the sample are
    the only side that is broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias(label))
    picked = None
    for value, n in most.items():
        part = known.where(F.col(label) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    return one_text(docs, picked, most_bytes, label)


def one_text(docs: DataFrame, picked: DataFrame, most_bytes: int, *more: str) -> DataFrame:
    """doc_id, text and columns ``more`` of a bounded set of ids: one text for each, none above ``most_bytes``."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).where(F.coalesce(F.octet_length(text), F.lit(0)) <= most_bytes).join(F.broadcast(picked), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    return rows.groupBy("doc_id", *more).agg(first).select("doc_id", F.col("t.text").alias("text"), *more)


def adam(params: list, gradient, steps: int, rate: float) -> list:
    """Adam on numpy arrays; ``gradient(params, step)`` gives one gradient per array."""
    import numpy as np

    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for k, g in enumerate(gradient(params, t)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return params
