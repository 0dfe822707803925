import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestone.llm import op3_near_dedup as D
from lodestone.scratch import Scratch


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns, scratch, counts = docs.columns, Scratch(spark), [docs.count()]
    for name, stage in P.STAGES:
        docs = scratch.save(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            bad = [q for i, q in labels.items() if i in ids and q == 0]
            assert len(bad) <= 2
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == docs.count() <= counts[-2]
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "mixing", "packing"]
    assert docs.where("length & (length - 1) <> 0 OR length > 2048").count() == 0


def test_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    for docs in (odd, none):
        for _, stage in P.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() >= 0


#: Names that the stages and operators use inside.
INSIDE = ["doc", "pad", "f0", "f1", "text_", "_text", "_quality", "quality_score", "line_kept", "line_", "_line_kept", "row_hash", "_row", "row", "node", "component", "kept", "leads", "key", "range", "hash", "size", "pieces", "shard", "_shard", "_order", "order", "block", "draw", "rank", "words", "h", "t", "a.b", "value"]


def test_clashing_columns_and_small_ids(spark, odd, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(k, f"the cat number {k} sat on the mat and looked at the moon tonight with care {k * 7}.", "en", "ab"[k % 2]) for k in range(6)] + [(9, "one two three " * 4 + "and four", "en", "a")] * 2
    base = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    docs = base.select("*", *[F.lit(k).alias(c) for k, c in enumerate(INSIDE)])
    want = [*range(len(INSIDE))]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns and out.schema["doc_id"].dataType.simpleString() == "int", name
        assert all(list(r)[4:] == want for r in got) and got, name
        assert {(r.doc_id, r.text) for r in got} <= {(r[0], r[1]) for r in rows}
        if name == "near_dedup":
            assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4, 5, 9]
    assert P.packing(spark, docs, str(tmp_path)).count() > 0


def test_one_row_of_each_group_stays(spark):
    """Null ids, one id with several texts, and rows repeated whole."""
    text = "the old river ran down past the mill and the long wall to the grey sea in the evening "
    rows = [(None, text)] * 3 + [(None, text + "end")] + [(4, text + "x " * k) for k in range(2)] + [(None, "w " * 9 + "alone here in the text now")] * 2
    out = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id int, text string"), "")
    assert sorted((r.doc_id is None, r.text.split()[0]) for r in out.collect()) == [(False, "the"), (True, "w")]


def test_near_dedup_takes_five_words_at_80_percent(spark):
    """A block appended that leaves 0.80 of five-word shingles and 0.803 of three-word ones; brute force over mixed copies."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(100)]
    pair = [(1, " ".join(base)), (2, " ".join(base + [word() for _ in range(24)]))]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert P.near_dedup(spark, docs(pair), "").count() == 1
    rows, sets = [], []
    for _ in range(40):
        own = [word() for _ in range(100)]
        rows += [(len(rows) + k, " ".join(own[: r.randint(75, 100)] + [word() for _ in range(k * r.randint(0, 12))])) for k in range(3)]
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root[x], root[y]))
                root = [a if k == b else k for k in root]
    kept = set(root)
    assert {x.doc_id for x in P.near_dedup(spark, docs(rows).repartition(3), "").collect()} == kept and len(kept) < len(rows)
    assert D.missed(P.PERCENT / 100, rows=P.ROWS) < 1e-7
