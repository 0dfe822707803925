"""Token ids as binary shards of patched frame-of-reference blocks.

Documents are dealt to shards by ranges of doc_id, of about ``SHARD_BYTES`` of text each, encoded, closed by
an end id and joined into one run of ids per shard, cut into blocks. A block keeps its minimum and, of each id, the low bits of its
distance from it, at the width that a chosen share of the block needs; ids that need more are
*exceptions*: their places and whole distances follow. A footer has each block's place in the file and
each document's first id, so a reader finds any document without decoding what stands before it.

Shard file, little-endian (a line feed follows each section; places count it)::

    header  "PFOR" u32 version, u64 shard number, u32 ids in a block, u32 zero
    blocks  u32 minimum, u32 ids, u32 width, u32 exceptions,
            width x (block / 64) u64 words, exceptions x u16 places, exceptions x u32 distances
    footer  documents x (i64 doc_id), documents x (u8 1 if doc_id is null), (documents + 1) x u64 first ids,
            blocks x u64 places, u64 documents, u64 blocks, u64 footer place, "PFOREND."

A block has block / 64 groups: ids k, k + block / 64, k + 2 * block / 64 ... are group k, whose 64 values
of ``width`` bits fill word k of each row of block / 64 words, the j-th from bit j * width on.

Shards are written by Spark's text writer, whose commit protocol makes a retried or lost task harmless;
memory is bounded by a batch of texts and a shard's footer. A reader takes a shard file whole, which its size
bounds, and decodes it by the block index, some blocks at a time. One number per shard goes through a window.

Defined cases: null and empty texts hold the end id alone; null doc_ids come first; rows with one doc_id
keep all their ids, ordered by a hash of the text, over several shards if they are many; rows repeated whole
share a shard; an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import parts_of, table
from lodestone.llm.tokens import default_path, encoder, slices
from lodestone.scratch import Scratch

BLOCK = 4096
#: An exception takes 48 bits, so one bit more for all pays if more than one id in 48 needs it.
PERCENTILE = 1 - 1 / 48
END_ID = 0
#: Bytes of text in a shard, on average.
SHARD_BYTES = 256 << 20
_HEADER, _BLOCK, _TAIL = "<4sIQII", "<4I", "<3Q8s"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Low ``width`` bits of (blocks, block) values as (blocks, width, block / 64) words."""
    lanes = (values.reshape(len(values), 64, -1) & np.uint32((1 << width) - 1)).astype(np.uint64)
    words = np.zeros((len(values), width, lanes.shape[2]), np.uint64)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        words[:, word] |= lanes[:, j] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - bit)
    return words


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """(blocks, width, groups) words back to (blocks, 64 * groups) values."""
    values, mask = np.empty((len(words), 64, words.shape[2]), np.uint32), np.uint64((1 << width) - 1)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        lane = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            lane |= words[:, word + 1] << np.uint64(64 - bit)
        values[:, j] = lane & mask
    return values.reshape(len(words), -1)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE, most_blocks: int = 128) -> list[bytes]:
    """Blocks of a run of ids; only the last may hold fewer than ``block`` ids."""
    out: list[bytes] = []
    kth = max(0, int(np.ceil(percentile * block)) - 1)
    for start in range(0, len(ids), most_blocks * block):
        part = ids[start : start + most_blocks * block]
        count = -(-len(part) // block)
        full = np.full(count * block, part[-1], np.uint32)
        full[: len(part)] = part
        full = full.reshape(count, block)
        least = full.min(1)
        rest = full - least[:, None]
        widths = np.ceil(np.log2(np.partition(rest, kth, 1)[:, kth].astype(np.float64) + 1)).astype(int)
        own: list[bytes] = [b""] * count
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            words = _pack(rest[at], width) if width else np.zeros((len(at), 0, block // 64), np.uint64)
            for k, packed in zip(at.tolist(), words):
                size = min(block, len(part) - k * block)
                odd = np.flatnonzero(rest[k, :size] >> np.uint32(width)) if width < 32 else np.empty(0, int)
                own[k] = struct.pack(_BLOCK, int(least[k]), size, width, len(odd)) + packed.tobytes() + odd.astype("<u2").tobytes() + rest[k][odd].astype("<u4").tobytes()
        out += own
    return out


def decode_blocks(data: bytes, places: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Ids of the blocks at ``places``, in order."""
    heads = [struct.unpack_from(_BLOCK, data, p) for p in places.tolist()]
    ids = np.empty((len(heads), block), np.uint32)
    widths = np.array([h[2] for h in heads], int)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        if width:
            words = [np.frombuffer(data, "<u8", width * block // 64, places[k] + struct.calcsize(_BLOCK)) for k in at]
            values = _unpack(np.stack(words).reshape(len(at), width, -1), int(width))
        else:
            values = np.zeros((len(at), block), np.uint32)
        for row, k in enumerate(at.tolist()):
            if odd := heads[k][3]:
                place = places[k] + struct.calcsize(_BLOCK) + int(width) * block // 8
                values[row, np.frombuffer(data, "<u2", odd, place)] = np.frombuffer(data, "<u4", odd, place + 2 * odd)
        ids[at] = values + np.array([heads[k][0] for k in at], np.uint32)[:, None]
    return ids.reshape(-1)[: sum(h[1] for h in heads)] if len(heads) else ids.reshape(-1)


def _shard_writer(path: str, block: int, percentile: float, end_id: int):
    def write(batches):
        from pyspark import TaskContext

        known, end = encoder(path), np.array([end_id], "<u4")
        at, left, doc_ids, nulls, sizes, places = 0, np.empty(0, "<u4"), [], [], [], []

        def section(*parts: bytes):
            nonlocal at
            at += sum(map(len, parts)) + 1
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])

        def blocks(ids: np.ndarray):
            own = encode_blocks(ids, block, percentile)
            places.extend((at + np.cumsum([0, *map(len, own[:-1])])).tolist())
            return section(*own)

        for batch in batches:
            for _, texts in slices(batch.column("text")):
                own = [np.append(x, end) for x in known.encode(texts)]
                sizes.extend(map(len, own))
                if not at:
                    yield section(struct.pack(_HEADER, b"PFOR", 1, TaskContext.get().partitionId(), block, 0))
                left = np.concatenate([left, *own])
                if full := len(left) // block * block:
                    yield blocks(left[:full])
                    left = left[full:]
            ids = batch.column("doc_id")
            nulls.append(ids.is_null().to_numpy(zero_copy_only=False).astype("u1"))
            doc_ids.append(ids.fill_null(0).to_numpy().astype("<i8"))
        if sizes:
            if len(left):
                yield blocks(left)
            tail = struct.pack(_TAIL, len(sizes), len(places), at, b"PFOREND.")
            yield section(np.concatenate(doc_ids).tobytes(), np.concatenate(nulls).tobytes(), np.cumsum([0, *sizes]).astype("<u8").tobytes(), np.array(places, "<u8").tobytes(), tail)

    return write


def write_token_shards(docs: DataFrame, path: str, vocabulary: str | None = None, block: int = BLOCK, percentile: float = PERCENTILE, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Write documents (doc_id, text) to shard files in ``path``, ids ascending by doc_id over all shards."""
    text = F.col("text").cast("string")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    order = ["doc_id", "hash"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    ordered = keyed.repartitionByRange(parts_of(docs.sparkSession, total, shard_bytes), *order).sortWithinPartitions(*order)
    sections = ordered.select("doc_id", "text").mapInArrow(_shard_writer(vocabulary or default_path(), block, percentile, end_id), "value binary")
    sections.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").text(path)


def parse_shard(data: bytes, most_blocks: int = 128):
    """(shard number, doc_ids with None for null, first ids, iterator of runs of decoded ids)."""
    magic, _, shard, block, _ = struct.unpack_from(_HEADER, data, 0)
    documents, blocks, footer, end = struct.unpack_from(_TAIL, data, len(data) - 1 - struct.calcsize(_TAIL))
    if magic != b"PFOR" or end != b"PFOREND.":
        raise ValueError("not a whole token shard")
    ids = np.frombuffer(data, "<i8", documents, footer)
    null = np.frombuffer(data, "u1", documents, footer + 8 * documents)
    first = np.frombuffer(data, "<u8", documents + 1, footer + 9 * documents).astype(np.int64)
    places = np.frombuffer(data, "<u8", blocks, footer + 17 * documents + 8).astype(np.int64)
    runs = (decode_blocks(data, places[k : k + most_blocks], block) for k in range(0, blocks, most_blocks))
    return shard, [None if n else i for i, n in zip(ids.tolist(), null.tolist())], first, runs


def _shard_reader(batches):
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for content in batch.column("content"):
            shard, doc_ids, first, runs = parse_shard(content.as_py())
            held, begin, k = np.empty(0, "<u4"), 0, 0
            for run in runs:
                held = np.concatenate([held, run])
                to = int(np.searchsorted(first, begin + len(held), "right")) - 1
                if to > k:
                    cuts = first[k : to + 1] - begin
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * (to - k)), pa.array(doc_ids[k:to], pa.int64()), pa.array(first[k:to]), pa.array(np.diff(cuts)), pa.array([held[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())], schema=schema)
                    held, begin, k = held[cuts[-1] :], int(first[to]), to


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: shard, doc_id, shard_start (ids before it in its shard), n_tokens, ids."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_shard_reader, "shard long, doc_id long, shard_start long, n_tokens long, ids binary")


def with_global_start(rows: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before, over the shards in order; one row per shard is summed."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    return rows.join(before, "shard").withColumn("start", F.col("before") + F.col("shard_start"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    write_token_shards(table(spark, sf_dir, "documents"), scratch.at("shards"))
    rows = read_token_shards(spark, scratch.at("shards")).select("shard", "doc_id", "shard_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_global_start(scratch.save(rows, "rows")).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")
