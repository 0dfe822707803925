import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import op4_token_output as P
from lodestone.llm import op9_packing as K
from lodestone.llm.tokens import default_path, encoder
from lodestone.scratch import Scratch


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z9'ésltr\n.,!| \t \x01<>") | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    known = encoder(default_path())
    assert [x.tolist() for x in known.encode(pa.array(texts, pa.string()))] == whole(texts)


def test_strings_of_special_tokens():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext", "plain"]
    found = [x.tolist() for x in encoder(default_path()).encode(pa.array(texts))]
    assert found == whole(texts) and found[0] == [64, 220, 50256, 275]


def test_a_memo_that_starts_anew_changes_nothing():
    from lodestone.llm.tokens import PieceEncoder

    small, texts = PieceEncoder(default_path(), generation=3), [f"a{k} b, c{k}.\nd 'll e{k}" for k in range(30)]
    assert [x.tolist() for t in texts for x in small.encode(pa.array([t]))] == whole(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), max_size=400), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, "<u4")
    blocks = P.encode_blocks(ids, 128, percentile, most_blocks=2)
    places = np.cumsum([0, *map(len, blocks[:-1])]) if blocks else np.empty(0, np.int64)
    assert P.decode_blocks(b"".join(blocks), places, 128).tolist() == ids.tolist()


def test_shards(spark, odd, none):
    scratch = Scratch(spark)
    P.write_token_shards(odd, scratch.at("s"), block=128)
    rows = P.with_global_start(scratch.save(P.read_token_shards(spark, scratch.at("s")), "r")).orderBy("start").collect()
    docs = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, (doc_id, text) in zip(rows, docs, strict=True):  # the rows of one id here are equal
        ids = np.array(whole([text])[0] + [0], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (doc_id, start, len(ids), ids.tobytes())
        start += len(ids)
    P.write_token_shards(none, scratch.at("e"))
    assert P.read_token_shards(spark, scratch.at("e")).count() == 0


def test_shards_follow_the_bytes(spark):
    docs = spark.range(60).selectExpr("cast(nullif(id % 30, 7) AS int) AS doc_id", "repeat(concat('w', id, ' '), 300) AS text")
    scratch = Scratch(spark)
    P.write_token_shards(docs, scratch.at("s"), shard_bytes=10_000)
    rows = P.with_global_start(scratch.save(P.read_token_shards(spark, scratch.at("s")), "r")).orderBy("start").collect()
    assert len({r.shard for r in rows}) >= 5 and [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(60)]


def test_binary_pieces():
    for n in (0, 1, 5, 2047, 2048, 2049, 10_000):
        pieces = K.binary_pieces(n)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces) and sorted(pieces, reverse=True) == pieces


def test_packing(odd, none):
    rows = K.pack(odd).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == max(r.sequence_id for r in rows) + 1 and {r.offset for r in rows} == {0}
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths)
    want = []
    for doc_id, text in ((r.doc_id, r.text) for r in odd.collect()):
        ids, start = np.array(whole([text])[0] + [1], "<u4"), 0
        for n in K.binary_pieces(len(ids)):
            want.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
            start += n
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows], key=key) == sorted(want, key=key)
    assert K.pack(none).count() == 0


def test_buckets_hold_ids(odd, spark):
    scratch = Scratch(spark)
    K.write_buckets(K.decompose(odd), scratch.at("b"))
    read = spark.read.parquet(scratch.at("b"))
    assert read.where(F.octet_length("ids") != 4 * F.col("length")).count() == 0 and read.count() == K.decompose(odd).count()


def test_the_memo_is_bounded_and_goes_with_its_task(spark):
    from lodestone.llm.tokens import PieceEncoder

    known = PieceEncoder(default_path())
    for k in range(10):
        known.encode(pa.array([" ".join(f"w{chr(97 + n % 26)}{'abcdefghij'[k]}{'xyzq'[n // 26 % 4]}{''.join('klmnopqrst'[int(c)] for c in str(n))}" for n in range(60_000))]))
    assert sum(map(len, known.memo)) <= 450_000 + 60_000
    docs = spark.createDataFrame([(k, f"word{k} other") for k in range(40)], "doc_id long, text string").coalesce(1)

    def left(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(encoder(default_path()).memo[0])])], ["n"])

    K.decompose(docs).count()
    assert all(r.n <= 2 for r in docs.mapInArrow(left, "n long").collect())


def test_texts_pass_in_small_batches(spark):
    from lodestone.llm.common import BATCH_ROWS, mapped_texts

    docs = spark.range(3 * BATCH_ROWS + 1, numPartitions=1).selectExpr("id as doc_id", "'a' as text")
    from pyspark.sql import types as T

    rows = mapped_texts(docs, ["doc_id"], [T.StructField("n", T.LongType())], lambda texts: [pa.array([len(texts)] * len(texts))])
    assert {r.n for r in rows.collect()} == {BATCH_ROWS, 1}
