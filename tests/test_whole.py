"""Queries over whole tables: what their first forms leave out."""

from collections import Counter

from oracle import connect
from pyspark.sql import functions as F

from lodestone import catalogue
from lodestone.plans import views as V

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def test_blast_radius_has_rows(spark):
    rows = QUERIES["blast_radius"](spark, SF).collect()
    con = connect(SF)
    edited = {r[0] for r in con.execute("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 <> 0").fetchall()}
    assert {r.session_id for r in rows} == edited != set()
    users: dict[str, set] = {}
    for part, order in con.execute("SELECT l_partkey, l_orderkey FROM lineitem").fetchall():
        users.setdefault(f"src/f{part % 20}.rs", set()).add(f"src/o{order}.rs")
    assert all(r.n == len(users[r.file_path]) >= 3 and r.shown == ", ".join(sorted(users[r.file_path])[:3]) for r in rows)


def test_queries_that_must_find_something(spark):
    for name in ("dead_ends", "anti_patterns", "nudges", "broad_search", "rule_candidates", "consolidate", "rename_detection", "failure_pivots"):
        assert not QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty(), name
    kinds = {r.nudge for r in QUERIES["nudges"](spark, "/root/testdata/sf0.01").collect()}
    assert kinds == {"search", "blast_radius", "struggle"}
    reasons = {(r.stale_reason or "").split(" ")[0] for r in QUERIES["staleness_propagation"](spark, "/root/testdata/sf0.01").select("stale_reason").distinct().collect()}
    assert {"Signature", "Symbol", "Referenced"} <= reasons


def test_recall_expects_all_good_labels(spark):
    row = QUERIES["eval_recall_mrr"](spark, "/root/testdata/sf0.01").first()
    assert row.cases == 10 and 0 < row.recall_at_k <= 1


def test_neighbours_of_every_node(spark):
    found = {r.node: r.n for r in QUERIES["neighbours_capped"](spark, SF).groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
    degree = {r.target: r.n for r in V.edges(spark, SF).groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {k: min(n, 50) for k, n in degree.items()}
    assert {k // V.CUSTOMER * V.CUSTOMER for k in found} == {V.ORDER, V.PART, V.SUPPLIER, V.REGION} and max(degree.values()) > 50


def test_rules_merge_every_part(spark):
    old, new = {}, {}
    parts = connect(SF).execute("SELECT p_partkey, p_size FROM part").fetchall()
    for p, size in parts:
        key, state = (f"fp{p // 4}", "" if p % 2 else "main"), (0, 1, -1)[p % 3]
        if size <= 30:
            a, b = old.setdefault(key, {}).get(state, (0, 0))
            old[key][state] = (max(a, size), max(b, size % 6))
        if size > 20:
            a, b = new.get(key, (0, 0))
            new[key] = (max(a, size), max(b, size % 7))
    want = {}
    for key in old.keys() | new.keys():
        state = min(old[key]) if key in old else None
        support, sessions = new.get(key) or old[key][state]
        want[key] = (support, sessions, 0 if state is None else 1 if state == 0 and key in new and sessions >= 4 else state)
    got = {(r.fingerprint, r.branch): (r.support, r.sessions, r.is_active) for r in QUERIES["rule_merge"](spark, SF).collect()}
    assert got == want and len(got) == len({(p // 4, p % 2) for p, _ in parts})
    assert old.keys() & new.keys() and old.keys() - new.keys() and new.keys() - old.keys()


def test_pagerank_runs_a_hundred_rounds(spark, tmp_path):
    small = {"orders": "(0, 1), (0, 2), (1, 3) AS t(o_custkey, o_orderkey)", "lineitem": "(1, 5, 9), (2, 5, 9), (3, 6, 8), (3, 5, 8) AS t(l_orderkey, l_partkey, l_suppkey)", "nation": "(0, 0), (1, 0) AS t(n_nationkey, n_regionkey)"}
    for name, values in small.items():
        spark.sql(f"SELECT * FROM VALUES {values}").write.parquet(f"{tmp_path}/{name}.parquet")
    links = [(r.source, r.target) for r in V.edges(spark, str(tmp_path)).collect()]
    out = Counter(a for a, _ in links)
    rank = {k: 1 / len({x for e in links for x in e}) for e in links for k in e}
    for _ in range(100):
        loose = sum(v for k, v in rank.items() if k not in out)
        new = {k: (0.15 + 0.85 * loose) / len(rank) + 0.85 * sum(rank[a] / out[a] for a, b in links if b == k) for k in rank}
        rank = {k: v / sum(new.values()) for k, v in new.items()}
    got = {r.node: r["rank"] for r in QUERIES["pagerank_100"](spark, str(tmp_path)).collect()}
    assert got.keys() == rank.keys() and all(abs(got[k] - rank[k]) < 2e-9 for k in rank)
