import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.operators import brief as BR
from lodestone.operators import embed as E
from lodestone.operators import graph as G
from lodestone.operators import memory as M
from lodestone.operators import mining as MI
from lodestone.operators import search as S
from lodestone.operators import staleness as SA
from lodestone.operators import structure as ST


def test_bm25_equals_fts5(spark):
    rows = [(1, "get pod status", "reads the pod"), (2, "pod list", "get all of them"), (3, "status page", ""), (4, "nothing here", "at all"), (5, "watch events", "stream"), (6, "other thing", "x y z")]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT rowid, bm25(t, 10.0, 2.0) FROM t WHERE t MATCH 'pod OR status'"))
    got = {r.i: r.score for r in S.bm25(spark.createDataFrame(rows, "i long, a string, b string"), {"a": 10.0, "b": 2.0}, ["pod", "status"], ["i"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


EDGES = [(1, 2, "calls"), (2, 3, "calls"), (1, 4, "calls"), (4, 3, "extends"), (3, 1, "calls"), (5, 3, "calls"), (5, 3, "extends")]


def test_pagerank(spark):
    edges = spark.createDataFrame(EDGES, "source long, target long, kind string")
    nodes = spark.range(1, 7).toDF("node")
    rank = {k: 1 / 6 for k in range(1, 7)}
    for _ in range(20):
        new = {k: 0.15 / 6 + 0.85 * sum(rank[a] / sum(x[0] == a for x in EDGES) for a, b, _ in EDGES if b == k) + 0.85 * rank[6] / 6 for k in rank}
        rank = {k: v / sum(new.values()) for k, v in new.items()}
    got = {r.node: r["rank"] for r in G.page_rank(nodes, edges, 20).collect()}
    assert all(abs(got[k] - rank[k]) < 1e-12 for k in rank)
    assert {r["rank"] for r in G.page_rank(nodes, edges.where("false"), 3).collect()} == {0.0}


def test_impact_and_paths(spark):
    edges = spark.createDataFrame(EDGES, "source long, target long, kind string")
    found = {r.node: r.depth for r in G.impact(edges, spark.sql("SELECT 3L AS node"), ["calls", "extends"], 3).collect()}
    assert found == {2: 1, 4: 1, 5: 1, 1: 2}
    paths = [r.path for r in G.shortest_paths(edges, 1, 3, ["calls", "extends"]).collect()]
    assert paths == [[1, 2, 3], [1, 4, 3]]
    assert G.shortest_paths(edges, 1, 1, ["calls"]).first().path == [1] and G.shortest_paths(edges, 3, 6, ["calls"]).count() == 0
    walk = {r.node: r.direction for r in G.context_walk(edges, spark.sql("SELECT 2L AS node"), 1).collect()}
    assert walk == {3: "outbound", 1: "inbound"}


def observations(spark, rows):
    return spark.createDataFrame(rows, "obs_id long, session_id string, created_at long, kind string, content string, symbol_fqn string, file_path string, is_stale boolean, auto_generated boolean, confidence double, branch string, consolidated_into long, importance string")


def ob(i, at, kind="tool_call", auto=True, **k):
    return (i, k.get("s", "a"), at, kind, k.get("content", "x"), k.get("fqn"), k.get("file"), k.get("stale", False), auto, k.get("confidence"), k.get("branch"), None, k.get("importance", "medium"))


def test_confidence_at_the_boundary(spark):
    obs = observations(spark, [ob(1, 1000), ob(2, 1120), ob(3, 1241), ob(4, 1241, "file_change"), ob(5, 1000, s="b")])
    got = {r.obs_id: round(r.confidence, 6) for r in M.correlated_confidence(obs).collect()}
    assert got == {1: 0.7, 2: 0.7, 3: 0.6, 4: 0.7, 5: 0.5}
    past = {r.obs_id: round(r.confidence, 6) for r in M.correlated_confidence(obs, mode="as_inserted").collect()}
    assert past[1] == 0.5 and past[2] == 0.7


def test_score_clamps_the_future(spark):
    obs = observations(spark, [ob(1, 10_000, confidence=1.0), ob(2, 0, importance="low"), ob(3, 0, stale=True)])
    got = {r.obs_id: (round(r.relevance, 6), r.signal) for r in M.scored(obs, F.lit(0)).collect()}
    assert got == {1: (0.55, "recency"), 2: (0.475, "recency"), 3: (0.175, "stale")}


def test_bursts_and_dead_ends(spark):
    obs = observations(spark, [ob(i, 300 + i, "file_change", file="f") for i in range(4)] + [ob(9, 599, "file_change", file="g"), ob(10, 600, "file_change", file="g"), ob(11, 1, content="c"), ob(12, 2, content="c", s="z"), ob(13, 3, content="c", s="z")])
    assert [(r.file_path, r.n) for r in M.file_bursts(obs).collect()] == [("f", 4)]
    looked = observations(spark, [ob(1, 1, "context_retrieval", content="c"), ob(2, 2, "context_retrieval", content="c"), ob(3, 1, "context_retrieval", content="c", s="z"), ob(4, 2, "context_retrieval", content="c", s="z"), ob(5, 3, "insight"), ob(6, 1, "context_retrieval", False, content="m", s="y"), ob(7, 2, "context_retrieval", False, content="m", s="y")])
    assert [(r.session_id, r.n) for r in M.dead_ends(looked).collect()] == [("z", 2)]
    assert M.file_bursts(observations(spark, [ob(i, 300 + i, "file_change", False, file="f") for i in range(4)])).count() == 0


def test_rules_merge(spark):
    old = spark.createDataFrame([("p", None, 0, 3, 3), ("q", None, 0, 3, 4), ("r", None, -1, 9, 9)], "fingerprint string, branch string, is_active int, support int, sessions int")
    new = spark.createDataFrame([("p", None, 4, 3), ("r", None, 9, 9), ("s", "m", 5, 5)], "fingerprint string, branch string, support int, sessions int")
    assert {r.fingerprint: r.is_active for r in MI.merged_rules(old, new).collect()} == {"p": 0, "q": 0, "r": -1, "s": 0}
    again = new.unionByName(spark.createDataFrame([("q", None, 4, 4)], new.schema))
    assert {r.fingerprint: r.is_active for r in MI.merged_rules(old, again).collect()}["q"] == 1


def test_page_rank_in_parts_by_links(spark, monkeypatch):
    monkeypatch.setattr(G, "LINKS_PART", 3)
    links = [(a, b) for a in range(12) for b in range(12) if (a * b + b) % 5 == 1 and a % 4] + [(1, 6)]
    nodes = spark.createDataFrame([(k,) for k in range(12)], "node long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {r.node: r["rank"] for r in G.page_rank(nodes, spark.createDataFrame(links, "source long, target long"), 13, write_every=4).collect()}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    out, rank = {a: sum(x[0] == a for x in links) for a in range(12)}, {k: 1 / 12 for k in range(12)}
    for _ in range(13):
        loose = sum(rank[k] for k in rank if not out[k])
        rank = {k: 0.15 / 12 + 0.85 * (sum(rank[a] / out[a] for a, b in links if b == k) + loose / 12) for k in rank}
    assert all(abs(got[k] - rank[k]) < 1e-12 for k in rank)


def test_similar_pairs_equal_brute_force(spark):
    import random

    r = random.Random(4)
    bags = [(i, i % 2, r.sample("abcdefghij", r.randint(1, 6))) for i in range(60)]
    df = spark.createDataFrame(bags, "i long, s long, bag array<string>")
    for least, strict in ((0.4, True), (0.85, False), (0.5, False)):
        want = {(a[0], b[0]) for a in bags for b in bags if a[0] < b[0] and a[1] == b[1] and (lambda j: j > least if strict else j >= least)(len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])))}
        assert {(x.a, x.b) for x in MI.similar_pairs(df, "s", "i", "bag", least, strict).collect()} == want


def test_similar_links_have_the_components_of_pairs(spark):
    import random

    r = random.Random(9)
    bags = [(i, "xy"[i % 2] if i % 9 else None, r.sample("abcdefghijklmn", r.randint(1, 8))) for i in range(90)]
    df = spark.createDataFrame(bags, "i long, s string, bag array<string>")

    def components(links):
        root = {x[0]: x[0] for x in bags}
        for a, b in links:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
        return root

    for least, strict in ((0.4, True), (0.6, False)):
        pairs = [(x.a, x.b) for x in MI.similar_pairs(df, "s", "i", "bag", least, strict).collect()]
        assert components([(x.a, x.b) for x in MI.similar_links(df, "s", "i", "bag", least, strict).collect()]) == components(pairs)
    alike = spark.createDataFrame([(i, "x", [*"abcdefg", f"z{i}"]) for i in range(200)], "i long, s string, bag array<string>")
    assert MI.similar_links(alike, "s", "i", "bag", 0.6).count() == 199


def test_parts_of_edges_follow_the_tables(spark, monkeypatch):
    from lodestone.plans import structures, views

    monkeypatch.setattr(views, "EDGES_PART", 4096)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for frame in (views.edges(spark, "/root/testdata/sf0.001"), structures.dependency_cap10(spark, "/root/testdata/sf0.001")):
        assert frame.rdd.getNumPartitions() > few


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, id long, v string")
    new = spark.createDataFrame([("b", "z"), ("a", "x"), ("d", "w"), ("c", "w")], "k string, v string")
    got = {r.k: (r.id, r.action) for r in ST.upserted(old, new, "k", "id", ["v"]).collect()}
    assert got == {"a": (1, "unchanged"), "b": (2, "updated"), "c": (3, "inserted"), "d": (4, "inserted")}


def test_session_end_runs_once(spark):
    obs = observations(spark, [ob(1, 1, "context_retrieval", content="c"), ob(2, 2, "context_retrieval", content="c"), ob(3, 1, "tool_call", s="z", importance="high"), ob(4, 1, "tool_call", s="z"), *[ob(10 + i, 300 + i, "file_change", s="z", file="f") for i in range(4)]])
    sessions = spark.createDataFrame([("a", 0, None, False), ("z", 0, 7, False), ("k", 0, None, True)], "session_id string, started_at long, ended_at long, compressed boolean")
    ended = spark.createDataFrame([("a",), ("z",), ("k",)], "session_id string")
    kept, closed = M.session_end(obs, sessions, ended, F.lit(1000))
    rows = sorted((r.obs_id, r.kind, r.session_id, r.file_path) for r in kept.collect())
    assert rows == [(3, "tool_call", "z", None), (14, "anti_pattern", "a", None), (15, "anti_pattern", "z", "f")]
    assert sorted((r.session_id, r.ended_at, r.compressed) for r in closed.collect()) == [("a", 1000, True), ("k", None, True), ("z", 7, True)]
    again, _ = M.session_end(kept, closed, ended, F.lit(2000))
    assert sorted(r.obs_id for r in again.collect()) == [3, 14, 15]


def test_sessions_and_flags(spark):
    sessions = spark.createDataFrame([("a", 0, None, False, False), ("b", 0, 5, True, False)], "session_id string, started_at long, ended_at long, compressed boolean, nudge_sent boolean")
    started = spark.createDataFrame([("a", 9), ("c", 9), ("c", 9)], "session_id string, started_at long")
    assert sorted((r.session_id, r.started_at, r.compressed) for r in M.upserted_sessions(sessions, started).collect()) == [("a", 0, False), ("b", 0, True), ("c", 9, False)]
    ended = spark.createDataFrame([("a", 7), ("b", 9)], "session_id string, at long")
    assert {r.session_id: r.ended_at for r in M.ended_sessions(sessions, ended).collect()} == {"a": 7, "b": 5}
    flags = M.nudge_flags(sessions, ended.limit(0), spark.createDataFrame([("a", "tool_call"), ("b", "error")], "session_id string, kind string"))
    assert {r.session_id: r.nudge_sent for r in flags.collect()} == {"a": False, "b": True}
    obs = observations(spark, [ob(1, 1), ob(2, 2, file="x/.env"), ob(3, 3, fqn="a.pem::f")])
    assert [r.obs_id for r in M.for_session(obs, sessions, "a").collect()] == [1] and M.for_session(obs, sessions, "none") is None and M.for_session(obs, sessions, "b").count() == 0


def test_recommendations_at_their_thresholds(spark):
    columns = "total long, stale long, low long, noise long, recent boolean, recent_insights long, rules_stale long"
    rows = [(10, 5, 7, 6, False, 0, 0), (10, 6, 8, 7, True, 0, 2), (0, 0, 0, 9, True, 0, 0), (10, 0, 0, 0, True, 1, 0)]
    advice = [r.advice for r in M.recommendations(spark.createDataFrame(rows, columns)).collect()]
    assert advice[0] == advice[2] == advice[3] == [] and len(advice[1]) == 5 and advice[1][0].startswith("60% of observations are stale") and advice[1][4].startswith("2 stale rule(s)")
    assert M.recommendations(spark.createDataFrame(rows[1:2], columns), "main").first().advice[3].endswith("on main")


def test_changes_renames_and_sentence(spark):
    schema = "fqn string, kind string, signature string, source_hash string"
    old = spark.createDataFrame([("a.rs::keep", "function", "fn keep()", "1"), ("a.rs::sig", "function", "fn sig(a)", "1"), ("a.rs::gone", "function", "fn gone()", "1"), ("a.rs::was", "function", "fn x()", "1"), ("a.rs::body", "function", None, "1"), ("a.rs::T::m", "method", "fn m()", "1")], schema)
    new = spark.createDataFrame([("a.rs::keep", "function", "fn keep()", "1"), ("a.rs::sig", "function", "fn sig(b)", "2"), ("a.rs::now", "function", "fn x()", "9"), ("a.rs::body", "function", "fn body()", "2"), ("a.rs::U::m", "method", "fn m()", "1"), ("a.rs::new", "function", None, "1")], schema)
    changes = ST.symbol_changes(old, new)
    assert sorted((r.fqn, r.change, r.new_fqn) for r in changes.collect()) == [("a.rs::T::m", "renamed", "a.rs::U::m"), ("a.rs::body", "body_only", None), ("a.rs::gone", "removed", None), ("a.rs::new", "added", None), ("a.rs::sig", "signature_changed", None), ("a.rs::was", "renamed", "a.rs::now")]
    assert {(r.old_fqn, r.moved) for r in ST.renames(changes).collect()} == {("a.rs::T::m", True), ("a.rs::was", False)}
    assert ST.diff_sentence(changes).first().sentence == "Modified `a.rs`: added `new`, signature of `sig` changed from `fn sig(a)` to `fn sig(b)`, removed `gone`, moved `a.rs::T::m` → `a.rs::U::m`, renamed `was` → `now`"
    assert ST.diff_sentence(changes, 2).first().sentence.endswith("to `fn sig(b)`, and 3 more") and ST.diff_sentence(changes.where("change = 'body_only'")).count() == 0


def test_staleness_by_names_in_backticks(spark):
    changes = spark.createDataFrame([("a.rs::f", "removed", None, "x", None), ("a.rs::T::g", "signature_changed", None, "old", "new"), ("a.rs::h", "added", None, None, "x")], "fqn string, change string, new_fqn string, old_signature string, new_signature string")
    texts = ["see `f(a(b))` and `a.rs::T::g`", "see `h` or ``f``", "`nothing` `f", "`g`\n", "other file `f`"]
    obs = observations(spark, [ob(k, 1, content=c, file="b.rs" if k == 4 else "a.rs") for k, c in enumerate(texts)] + [ob(9, 1, fqn="a.rs::f"), ob(10, 1, fqn="a.rs::f", stale=True)]).withColumn("stale_reason", F.lit(None).cast("string"))
    got = {r.obs_id: (r.is_stale, r.stale_reason) for r in SA.propagated(obs, changes).collect()}
    assert got[0] == (True, "Referenced symbol 'a.rs::T::g' structurally changed (and 1 others)") and got[3] == (True, "Referenced symbol 'a.rs::T::g' structurally changed")
    assert got[1] == got[2] == got[4] == (False, None) and got[9] == (True, "Symbol no longer exists in index") and got[10] == (True, None)


def test_running_sums_over_ranges(spark):
    import random

    from lodestone.operators.prefix import numbered, percentiles, running

    r = random.Random(0)
    rows = [(i, r.choice("ab") if i % 3 else None, r.randint(0, 9), float(r.randint(0, 5))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, k string, v long, x double").repartition(5)
    want = {}
    for i, k, v, _ in sorted(rows):
        want[i] = want.get(k, 0) + v
        want[k] = want[i]
    assert all(x.running == want[x.i] for x in running(df, "v", ["i"], ["k"]).collect())
    assert sorted((x.n, x.i) for x in numbered(df, ["i"], "n").collect()) == [(i + 1, i) for i in range(400)]
    import numpy as np

    for x in percentiles(df, "k", "x", {"p10": 0.1, "p50": 0.5, "p95": 0.95}).collect():
        own = [c for _, k, _, c in rows if k == x.k]
        assert np.allclose([x.p10, x.p50, x.p95, x.most], [*np.percentile(own, [10, 50, 95]), max(own)])


def test_greedy_notes_equal_a_loop(spark):
    import random

    r = random.Random(1)
    rows = [(r.choice("abc"), i, r.choice([0, 1, 5, 30]), r.randint(0, 8)) for i in range(120)] + [("z", 999, 500, 1)]
    got = {x.k: (x.used, x.taken, x.noted) for x in BR.greedy_with_notes(spark.createDataFrame(rows, "k string, i long, c long, n long"), "c", "n", 60, "k", "i").collect()}
    for key in "abcz":
        used = taken = noted = 0
        for _, _, cost, note in sorted(x for x in rows if x[0] == key):
            if used + cost > 60:
                break
            used, taken = used + cost, taken + 1
            if used + note <= 60:
                used, noted = used + note, noted + 1
        assert got[key] == (used, taken, noted), key


def test_clusters_and_rules_equal_loops(spark):
    import random

    r = random.Random(5)
    rows = [(i, "s" + str(i % 2), sorted(r.sample("abcdefgh", r.randint(2, 4))), "u" + str(i % 4), r.choice([None, 0.2, 0.9]), r.randint(0, 50), r.choice([None, None, "m"])) for i in range(70)]
    df = spark.createDataFrame(rows, "i long, s string, bag array<string>, session_id string, confidence double, created_at long, branch string")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    root = {x[0]: x[0] for x in rows}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and jac(a[2], b[2]) > 0.6:
                old, new = sorted((root[a[0]], root[b[0]]))[::-1]
                root = {k: new if v == old else v for k, v in root.items()}
    groups = {}
    for x in rows:
        groups.setdefault(root[x[0]], []).append(x)
    found = MI.clusters(df, "s", "i", "bag", 0.6, strict=True)
    assert {(x.i, x.root) for x in found.collect()} == {(x[0], k) for k, g in groups.items() if len(g) > 1 for x in g}
    want = set()
    for g in groups.values():
        counts = {}
        for x in g:
            for token in x[2]:
                counts[token] = counts.get(token, 0) + 1
        centroid = [token for token, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:8]]
        near = [x for x in g if jac(x[2], centroid) > 0.3]
        if len(g) > 1 and len(near) >= 3 and len({x[3] for x in near}) >= 3 and len({x[6] for x in near}) == 1:
            best = max(near, key=lambda x: (x[4] or 0.0, x[5], x[0]))
            want.add((near[0][1], len(near), len({x[3] for x in near}), best[0], near[0][6]))
    got = {(x.s, x.support, x.sessions, x.representative, x.branch) for x in MI.rule_candidates(df, found, "s", "i", "bag").collect()}
    assert got == want


def test_shortest_paths_equal_brute_force(spark):
    import random

    r = random.Random(2)
    for trial in range(3):
        links = {(r.randrange(14), r.randrange(14)) for _ in range(34)}
        edges = spark.createDataFrame([(a, b, "calls") for a, b in links], "source long, target long, kind string")
        paths = [[0]]
        for _ in range(15):
            grown = [[*p, b] for p in paths for a, b in sorted(links) if a == p[-1] and b not in p]
            done = sorted(p for p in grown if p[-1] == 13)
            if done or not grown:
                break
            paths = grown
        assert [x.path for x in G.shortest_paths(edges, 0, 13, ["calls"], most_paths=3).collect()] == done[:3]
    capped = spark.createDataFrame([(0, k, "calls") for k in range(1, 5)] + [(4, 9, "calls")], "source long, target long, kind string")
    assert G.shortest_paths(capped, 0, 9, ["calls"], cap=3).count() == 0 and G.shortest_paths(capped, 0, 4, ["calls"], cap=4).first().capped is False and G.shortest_paths(capped, 0, 1, ["calls"], cap=3).first().capped is True


def test_embedding_tables(spark):
    model = E.ByteHashEmbedder(8)
    obs = observations(spark, [ob(1, 1, "insight", content="alpha", file="a.rs"), ob(2, 1), ob(3, 1, "decision", content="beta"), ob(4, 1, "insight", stale=True)])
    new = E.embedded(obs.where("obs_id in (1, 3)"), "obs_id", E.observation_text(), model, F.lit(5)).cache()
    assert {r.id: len(r.embedding) for r in new.collect()} == {1: 8, 3: 8}
    assert [r.obs_id for r in E.unembedded_observations(obs, new.where("id = 3"), model).collect()] == [1]
    assert E.unembedded_observations(obs, new, E.ByteHashEmbedder(8, model_rev="2")).count() == 2
    near = {r.obs_id: round(r.similarity, 6) for r in E.similarities(new, obs.select("obs_id"), "insight alpha a.rs", model, "obs_id").collect()}
    assert near[1] == 1.0 and abs(near[3]) < 1 and E.replaced(new, new.where("id = 1")).count() == 2 and E.cleared(new).count() == 0


def test_a_branch_has_its_own_merges(spark):
    content = "the cache must be cleared before every deploy of workers"
    obs = observations(spark, [ob(1, 100, "insight", content=content, file="f", branch="m"), ob(2, 200, "insight", content=content, file="f", branch="m"), ob(3, 300, "insight", content=content, file="f"), ob(4, 400, "insight", content=content, branch="m"), ob(5, 100, "insight", False, content=content, file="f", branch="m")]).withColumn("consolidation_count", F.lit(0))
    got = {r.obs_id: (r.consolidated_into, r.consolidation_count) for r in MI.consolidated(obs, F.lit(1000), "m").collect()}
    assert got == {1: (2, 0), 2: (None, 1), 3: (None, 0), 4: (None, 0), 5: (None, 0)}
