import base64
import hashlib

import pytest
from oracle import connect, difference

from lodestone.llm import op1_warc as W
from lodestone.scratch import Scratch

PAGES = [(1, "http://a/ b", "<p>x</p>", 5), (2, None, "<p>x</p>", 5), (3, "http://c", None, 5), (4, "u", "", 5), (None, "n", "<p>x</p>", 5), (None, "m", "solo", 5), (7, "u", "same", 5), (7, "u", "same", 5), (8, "é", "ü" * 50_000, 5), (0, "z", "same", 5), (9, "s", W.SEPARATOR_FRAME * 3, 5)]


@pytest.mark.parametrize("dictionary", [None, b""])
def test_round_trip(spark, dictionary):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload_bytes int").repartition(3)
    scratch = Scratch(spark)
    W.write_warc(pages, scratch.at("w"), dictionary=dictionary)
    rows = W.read_warc(spark, scratch.at("w")).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest) for r in rows) == sorted((p is None, p or 0, len((h or "").encode()), digest(h)) for p, _, h, _ in PAGES)
    kinds = {(r.page_id, r.payload_digest): (r.record_type, r.refers_to) for r in rows if r.page_id != 7 and r.page_id is not None}
    assert kinds[1, digest("<p>x</p>")] == ("response", None) and kinds[2, digest("<p>x</p>")] == ("revisit", 1) and kinds[4, digest("")] == ("revisit", 3)
    assert sorted((r.record_type, r.refers_to) for r in rows if r.page_id == 7) == [("revisit", 0), ("revisit", 0)]
    assert {(r.record_type, r.refers_to) for r in rows if r.page_id is None} == {("revisit", 1), ("response", None)}
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h, _ in PAGES}


def test_small_payloads_are_not_deduplicated(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, x int")
    scratch = Scratch(spark)
    W.write_warc(pages, scratch.at("w"), min_revisit_bytes=6)
    assert W.read_warc(spark, scratch.at("w")).where("record_type = 'revisit'").count() == 2
    W.write_warc(pages.where("false"), scratch.at("e"))
    assert W.read_warc(spark, scratch.at("e")).count() == 0


def test_dictionary_leads_each_file_and_helps(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    dictionary = W.train_dictionary(pages)
    scratch = Scratch(spark)
    W.write_warc(pages, scratch.at("w"), dictionary=dictionary)
    W.write_warc(pages, scratch.at("p"), dictionary=b"")
    files = spark.read.format("binaryFile").load(scratch.at("w"))
    assert all(bytes(r.head) == W.DICTIONARY_MAGIC for r in files.selectExpr("substring(content, 1, 4) AS head").collect())
    size = lambda name: spark.read.format("binaryFile").load(scratch.at(name)).selectExpr("sum(length)").first()[0]
    assert len(dictionary) > 1000 and size("w") - files.count() * len(dictionary) < size("p")


def test_query(spark):
    con = connect("/root/testdata/sf0.001")
    assert difference(spark, con, W.op1_warc, W.ORACLE_SQL, "/root/testdata/sf0.001") is None


def test_files_follow_the_bytes(spark):
    pages = spark.range(64).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 20000) AS html")
    scratch = Scratch(spark)
    W.write_warc(pages, scratch.at("w"), dictionary=b"", file_bytes=100_000)
    files = spark.read.format("binaryFile").load(scratch.at("w"))
    assert files.count() >= 15 and W.read_warc(spark, scratch.at("w")).count() == 64
