"""Packing by power-of-two decomposition: each sequence is one piece of one document.

A document's ids and its end id are cut into as many pieces of the longest length as fit and one piece
for each set bit of the rest, longest first. Every piece is a sequence of its own whose length is a power
of two, so no sequence crosses documents and none needs padding; a trainer reads the bucket of one length
with a batch size that keeps the ids in a batch constant.

Encoding and cutting need no shuffle. Sequences are numbered bucket by bucket, shortest first: within a
bucket by task and order in the task, from one count per task and bucket.

Defined cases: a null or empty text is the end id alone, one piece of length 1; rows with one doc_id are
packed each; null doc_ids stay null; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table, text_batches
from lodestone.llm.tokens import default_path, encoder, slices
from lodestone.scratch import Scratch

LONGEST = 2048
END_ID = 1


def binary_pieces(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n ids: powers of two, falling, none above ``longest`` (itself one)."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cutter(path: str, longest: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("rank", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        from pyspark import TaskContext

        known, task, end = encoder(path), TaskContext.get().partitionId(), np.array([end_id], "<u4")
        seen = [0] * longest.bit_length()
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in slices(batch.column("text")):
                rows = []
                for doc_id, ids in zip(doc_ids[at:], known.encode(texts)):
                    ids, start = np.append(ids, end), 0
                    for length in binary_pieces(len(ids), longest):
                        b = length.bit_length() - 1
                        rows.append((doc_id, start, length, len(ids), task, seen[b], ids[start : start + length].tobytes()))
                        seen[b] += 1
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        known.forget()

    return cut


def decompose(docs: DataFrame, vocabulary: str | None = None, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents (doc_id, text): doc_id, start, length, doc_tokens, task, rank, ids (little-endian u32)."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest length must be a power of two")
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _cutter(vocabulary or default_path(), longest, end_id), "doc_id long, start long, length long, doc_tokens long, task long, rank long, ids binary"
    )


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to *written* pieces; at most one count per task and length is gathered."""
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("length", "task").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("length", "task", (F.sum("n").over(order) - F.col("n")).alias("before"))
    return pieces.join(before, ["length", "task"]).withColumn("sequence_id", F.col("before") + F.col("rank")).withColumn("offset", F.lit(0).cast("long")).drop("before")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences with their ids, one folder per length."""
    pieces.write.mode("overwrite").partitionBy("length").parquet(path)


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = decompose(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "task", "rank")
    written = Scratch(docs.sparkSession).save(pieces, "pieces")
    return number_sequences(written).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
