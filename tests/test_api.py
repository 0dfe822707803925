import pytest

from pyspark.sql import functions as F

from lodestone.api import REDACTED, Engine, symbol_table
from lodestone.sources import parse as P
from lodestone.sources import tree as T

SOURCE = {"src/a.ts": "export function loadPod(q: Pod) { return readPod(q); }\nexport class Pod { n: number; }\n", "src/b.ts": "export function readPod(q: Pod) { return 1; }\nexport function other() { return loadPod(1); }\n", "src/.env.ts": "export function secret() {}\n"}


@pytest.fixture(scope="module")
def engine(spark):
    parsed = P.parse(spark.createDataFrame(list(SOURCE.items()), "path string, text string")).cache()
    symbols = symbol_table(P.symbols_of(parsed)).cache()
    names = symbols.select("fqn", "name", "symbol_id")
    edges = P.edges_of(parsed).where("kind = 'calls'").join(names.toDF("source_fqn", "n", "s"), P.F.col("source") == P.F.col("source_fqn")).join(names.toDF("f", "target_name", "t"), P.F.col("target") == P.F.col("target_name")).select(F.col("s").alias("source"), F.col("t").alias("target"), "kind")
    files = spark.createDataFrame([(k, v, 50) for k, v in SOURCE.items()], "path string, text string, last_indexed_at long")
    obs = spark.createDataFrame([(1, "s1", 100, "insight", "loadPod retries the pod twice", "src/a.ts::loadPod", "src/a.ts", False, None, False, 0.9, None, None, "high"), (2, "s1", 120, "decision", "pods load lazily in this project", None, None, False, None, False, None, None, None, "medium"), (3, "s2", 130, "error", "readPod failed on load", None, "src/b.ts", True, "old", True, 0.1, "m", None, "medium")], "obs_id long, session_id string, created_at long, kind string, content string, symbol_fqn string, file_path string, is_stale boolean, stale_reason string, auto_generated boolean, confidence double, branch string, consolidated_into long, importance string")
    sessions = spark.createDataFrame([("s1", 90, None, False, False), ("s2", 125, None, False, False)], "session_id string, started_at long, ended_at long, compressed boolean, nudge_sent boolean")
    rules = spark.createDataFrame([(7, "always test pods", 1, 4, 4, 10, 20, None)], "rule_id long, content string, is_active int, support long, sessions long, updated_at long, last_seen_at long, branch string")
    links = spark.createDataFrame([(7, "src/a.ts::loadPod")], "rule_id long, symbol_fqn string")
    tables = {"symbols": symbols, "edges": edges.cache(), "files": files, "observations": obs, "sessions": sessions, "rules": rules, "rule_symbols": links, "rule_files": links.select("rule_id", F.col("symbol_fqn").alias("file_path"))}
    return Engine(spark, tables, {"deny": [{"path": "src/none*"}]})


def test_questions(engine):
    found = {r.fqn: r.depth for r in engine.impact_rows("src/b.ts::readPod").collect()}
    assert found == {"src/a.ts::loadPod": 1, "src/b.ts::other": 2}
    text = engine.get_impact("src/b.ts::readPod")
    assert "2 direct and transitive dependent(s) found (depth=3)" in text and "### Depth 2\n\n- other (calls) in src/b.ts" in text
    assert engine.pivots("zzz qqq").first().reason == "fallback" and engine.pivots("x", ["B.TS"]).first().reason == "file hint"
    assert engine.get_impact("src/.env.ts::secret").startswith("Symbol not found") and engine.get_impact("nope").startswith("Symbol not found")
    trace = engine.trace_flow("src/b.ts::other", "src/b.ts::readPod")
    assert "### Path 1 (2 hops)\n\n- `src/b.ts::other` (src/b.ts)\n- `src/a.ts::loadPod` (src/a.ts)" in trace and "No execution path" in engine.trace_flow("src/b.ts::readPod", "src/b.ts::other")
    assert engine.terms("get_pod") == ["get pod", "get", "pod"] or "get pod" in engine.terms("get_pod")


def test_briefs(engine):
    text = engine.get_context("fix loading of the pod", 200)
    assert text.startswith("# Context Brief: fix loading of the pod\nintent_mode: bug-fix\nintent_confidence: 1.00\nintent_signals: fix\n")
    for part in ("## Pivot Symbols\n\n## ", "export function loadPod(q: Pod) { return readPod(q); }", "## Supporting Symbols", "Why: ", "## Session Memory", "[insight] loadPod retries the pod twice", "## Project Rules\n\n- always test pods [4 obs · 4 sessions · last seen 3m ago]", "## Retrieval Notes\n- "):
        assert part in text, part
    assert "pods load lazily" in engine.get_context("pods lazily", 200) and "secret" not in text
    brief = engine.get_brief("fix loading of the pod", 200, "src/b.ts::readPod")
    assert "# Impact Analysis: src/b.ts::readPod" in brief and "\n---\n" in brief
    short = engine.get_brief("fix loading of the pod", 200, token_budget=1)
    assert "(response truncated to fit token_budget)" in short and len(short.split("\n## Retrieval Notes")[0].encode()) <= 400
    with pytest.raises(ValueError):
        engine.get_context(" ", 200)


def test_failures(engine):
    text = engine.analyze_failure("TypeError: boom\n    at loadPod (src/a.ts:1:5)\n    at other (src/b.ts:9:1)\n---- readPod stdout ----", 200)
    assert "**Error:** TypeError: boom" in text and "| 1 | src/a.ts | 1 | src/a.ts::loadPod | line |" in text and "| 2 | src/b.ts | 9 | src/b.ts::other | file |" in text and "| 3 | — | — | src/b.ts::readPod | name |" in text and "caller-supplied [bug-fix]" in text
    assert "bm25_r=" in engine.analyze_failure("something about readPod happened", 200)
    raw = engine.analyze_failure("zzzz qqqq\npassword = 4\n" + "\n".join(f"/home/u/x{k}" for k in range(120)), 200)
    assert "### Raw Trace\n```\nzzzz qqqq\n[redacted: sensitive content]\n<abs>/x0\n" in raw and "... (22 lines omitted) ..." in raw and raw.rstrip().endswith("```")
    python = [r.symbol_id for r in engine.failure_rows("Traceback (most recent call last):\n  at loadPod (src/a.ts:1:1)\n  at readPod (src/b.ts:1:1)").orderBy("place").collect()]
    assert python == [engine._id("src/b.ts::readPod"), engine._id("src/a.ts::loadPod")]
    with pytest.raises(ValueError):
        engine.analyze_failure(" ", 200)


def test_outlines(engine):
    text = engine.get_file_skeleton("a.ts")
    assert text.startswith("# File Skeleton: src/a.ts\n\n### loadPod (`src/a.ts::loadPod`)\nFile: `src/a.ts` lines 1-1\n") and "#### n: number" in text and "Dependencies: readPod (calls)" in text
    assert "not permitted" in engine.get_file_skeleton("x/.env") and engine.get_file_skeleton("zz.ts").startswith("No file found")
    hidden = Engine(engine.spark, engine.tables, {"redact": [{"fqn_prefix": "src/a.ts::loadPod"}]})
    assert f"### loadPod {REDACTED}" in hidden.get_file_skeleton("src/a.ts") and "return readPod" not in hidden.get_context("loadPod", 200, file_hints=["a.ts"])


def test_memory(engine):
    own = Engine(engine.spark, engine.tables)
    text = own.get_session_history(200)
    assert "## Session s2 (1970-01-01 00:02 UTC)" in text and "- ⚠ [STALE — old] [error] [score:" in text and "2 sessions, 3 observations (1 stale)" in text
    assert own.get_session_history(200, sort_mode="relevance", all_branches=True).splitlines()[2].startswith("1. [score: ") and "No observations" in own.get_session_history(200, file="none")
    assert "**Observations**: 3 total (1 stale — 33%)\n  - By kind: 1 decision, 1 error, 1 insight\n" in own.memory_health(200) and "**Rules**: 1 active" in own.memory_health(200)
    good = {"session_id": "s9", "kind": "decision", "content": " keep it "}
    for bad in ({}, {"kind": "nope"}, {"content": " "}, {"file_path": "a/.env"}, {"symbol_fqn": "k.pem::f"}, {"scope": "file"}, {"scope": "project", "file_path": "a.rs"}, {"scope": "project", "importance": "huge"}):
        with pytest.raises(ValueError):
            own.save_observation({**good, **bad}, 300)
    rows = own.save_observation({**good, "scope": "project"}, 300).where("obs_id = 4").collect()
    assert [(r.content, r.importance, r.created_at, r.is_stale) for r in rows] == [("keep it", "high", 300, False)]
    assert {r.session_id: r.nudge_sent for r in own.tables["sessions"].collect()}["s9"] is True


def test_undo(engine, tmp_path):
    root, store = tmp_path / "w", str(tmp_path / "s")
    root.mkdir()
    (root / "f.txt").write_text("one")
    first = T.snapshot(store, str(root), "f.txt", 1000)
    (root / "f.txt").write_text("two")
    own = Engine(engine.spark, engine.tables, root=str(root), store=store)
    assert f"  {first}  3 bytes  9 seconds ago" in own.list_restore_points("f.txt", 10_000) and own.list_restore_points("g.txt", 1).startswith("No restore points")
    assert own.undo_change("f.txt", first, "s1", 400) == f"Restored f.txt to snapshot {first}." and (root / "f.txt").read_text() == "one"
    assert own.tables["observations"].where("content like 'Reverted f.txt%'").count() == 1
    for path, ident in (("f.txt", "1-2-3"), ("f.txt", "../x"), ("../f", first), (".env", first)):
        with pytest.raises(ValueError):
            own.undo_change(path, ident, "s1", 400)


def test_members(engine):
    far = {"symbols": engine.tables["symbols"].withColumn("fqn", F.concat(F.lit("far/"), "fqn")), "edges": engine.tables["edges"], "files": engine.tables["files"]}
    own = Engine(engine.spark, engine.tables, members=[("far", far)])
    rows = own.federated_pivots("load pod", limit=5).collect()
    assert [r.member for r in rows][:2] == [0, 0] and 1 in {r.member for r in rows}
    text = own.get_context("load pod", 50 + 7200)
    assert "### [far] " in text and "- Remote member 'far' last indexed 2 hours ago (advisory)" in text
    assert own.doctor(50 + 90_000) == ["far: last indexed 25 hours ago"] and own.doctor(50) == []


def test_submitted_edges(engine, spark):
    a, b = engine._id("src/a.ts::Pod"), engine._id("src/b.ts::other")
    batch = spark.createDataFrame([(a, b, "calls"), (a, b, "calls"), (a, 5, "calls"), (a, b, "bogus"), (None, b, "calls")], "source long, target long, kind string")
    before = engine.tables["edges"].count()
    report = engine.submit_edges(batch).first()
    assert (report.submitted, report.malformed, report.invalid_kind, report.unresolved) == (5, 1, 1, 1) and engine.tables["edges"].count() == before + 1
