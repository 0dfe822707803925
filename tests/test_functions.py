from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import brief, logs, policy


def one(spark, expression, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in enumerate(values)))
    return df.select(expression(*[F.col(c) for c in df.columns])).first()[0]


def test_identifiers(spark):
    split = lambda s: one(spark, X.split_identifier, s)
    assert split("XMLParserGetPod_status-x") == ["xml", "parser", "get", "pod", "status", "x"]
    assert split("word") == [] and split("camelCase") == ["camel", "case"]
    assert one(spark, X.expanded_name, "getPod") == "get pod getpod"


def test_paths(spark):
    assert [one(spark, X.is_sensitive, p) for p in ("a/.env", "x/.ENV.local", "id_rsa.pub", "k/Server.PEM", "env", "a.pem/b.rs")] == [True, True, True, True, False, False]
    assert [one(spark, X.normalised_path, p) for p in ("./a//b/./c", "a/../b", "/a", "")] == ["a/b/c", None, None, None]
    assert one(spark, X.relative_to, "/w/src/a.rs", "/w") == "src/a.rs"
    assert one(spark, X.redacted, "cat .env now") == "cat <redacted> now"


def test_estimates_and_decay(spark):
    assert one(spark, X.token_estimate, "héé") == 2 and one(spark, X.token_estimate, "") == 0
    assert abs(one(spark, X.half_life, 7.0, 7.0) - 0.5) < 1e-12 and one(spark, X.half_life, -3.0, 7.0) == 1.0
    assert abs(one(spark, X.cosine, [1.0, 0.0], [1.0, 1.0]) - 2**-0.5) < 1e-12 and one(spark, X.cosine, [0.0], [1.0]) == 0.0 and one(spark, X.cosine, [1.0], [1.0, 2.0]) == 0.0


def test_policy_prefix_ends_at_a_segment(spark):
    rules = [{"fqn_prefix": "a.rs::S"}]
    hit = lambda f: one(spark, lambda p, q: policy.matches(p, q, rules), "a.rs", f)
    assert hit("a.rs::S") and hit("a.rs::S::m") and not hit("a.rs::Sx")
    assert not one(spark, lambda p: policy.matches(p, None, [{}]), "a.rs")


def test_intents(spark):
    cases = {"fix": ("bugfix", 5, 2, True, True), "fix crash": ("bugfix", 5, 2, True, True), "refactor and fix": ("balanced", 8, 2, False, False), "rename and extract it": ("refactor", 5, 3, True, False), "add a build step": ("impl", 5, 2, False, False), "look around": ("balanced", 8, 2, False, False), "the prefix is new": ("balanced", 8, 2, False, False)}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", *X.intent_profile(F.col("t")))
    got = rows.select("t", "intent", "dominant", "signals", *X.traversal_policy(F.col("n_bugfix"), F.col("n_refactor"), F.col("n_impl"))).collect()
    assert {r.t: (r.intent, r.pool, r.depth, r.inbound, r.inbound_first) for r in got} == cases
    assert {r.t: (r.dominant, r.signals) for r in got}["refactor and fix"] == ("bugfix", "fix, refactor")


def test_commands(spark):
    broad = lambda c: one(spark, logs.is_broad_search, c)
    for command in ("grep -rn needle .", "grep --recursive foo", "rg somepattern here | head", "grep -R foo src | wc", "rg -i 'needle in hay'", "grep foo src/a.rs | sort -r"):
        assert broad(command), command
    for command in ("rg x src/lib/abc", "grep -r x", "cargo test | grep -r foo", "rg --files src", "rg needle main.rs", "grep needle file.txt", "find . -name '*.rs'", "ripgrep needle here"):
        assert not broad(command), command


def test_frames(spark):
    cases = {
        '  File "a/b.py", line 12, in f': ("a/b.py", 12, "f"), "at src/x.rs:7:3": ("src/x.rs", 7, None), "at ./src/x.rs:7": ("src/x.rs", 7, None), "nothing": (None, None, None), "at Object.run (src/a.ts:3:14)": ("src/a.ts", 3, "Object.run"),
        "\tsrc/m.php(42)": ("src/m.php", 42, None), "/w/src/k.go:5 +0x1": ("src/k.go", 5, None), "/usr/lib/x.py:3": (None, None, None), "---- graph::tests::one stdout ----": (None, None, "graph::tests::one"), "FAIL  src/a.test.ts": ("src/a.test.ts", None, None), "FAILED tests/t.py::test_x - boom": ("tests/t.py", None, "test_x"), "mod::run()": (None, None, "mod::run"),
    }
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", *logs.frame_of(F.col("v"), "/w")).collect()
    assert {r.v: (r.file, r.line_no, r.symbol) for r in got} == cases


def test_traces_for_display(spark):
    shown = lambda v, p=None: one(spark, lambda c: logs.sanitised(c, p), v)
    for line in ("open .env failed", "key.pem here", "x.p12", "~/.ssh/id_rsa", "credential = 4", "API_TOKEN=1", "Password: x"):
        assert shown(line) == logs.HIDDEN, line
    assert shown("at /home/u/p/a.rs:3 and /srv/x") == "at <abs>/a.rs:3 and <abs>/x" and shown("C:\\Users\\u\\a.rs") == "<abs>\\a.rs" and shown("src/a.rs:3") == "src/a.rs:3"
    assert shown("at src/secret/a.rs:3", {"deny": [{"path": "src/secret/*"}]}) == logs.HIDDEN


def test_backticks_and_calls(spark):
    tokens = lambda v: one(spark, X.backtick_tokens, v)
    assert tokens("use `a::b` not ``c`` `d\ne` `f`") == ["a::b", " "]  # a span does not cross lines, so the next one opens after e
    assert tokens("``x `y` z`` `w`") == ["w"] and tokens("`` ` `") == [] and tokens("none") == []
    assert [one(spark, X.without_call, v) for v in ("f()", "f(a(b))", "f", "f(a)b", "g)", "T::m(x)(y)")] == ["f", "f", "f", "f(a)b", "g)", "T::m(x)"]


def test_tool_summaries(spark):
    say = lambda tool, args, n=None: spark.sql("SELECT 1").select(logs.tool_summary(F.lit(tool), F.lit(args), None if n is None else F.lit(n))).first()[0]
    assert say("get_brief", '{"intent": "x", "token_budget": 5}', 7) == "get_brief(intent=x, budget=5) → 7 chars" and say("get_file_skeleton", '{"file_path": "a/.env"}') == "get_file_skeleton(file=<redacted>)"
    assert say("trace_flow", '{"source_fqn": "a", "target_fqn": "b"}') == "trace_flow(from=a, to=b)" and say("memory_health", None) == "memory_health" and say("nope", "{}") == "nope(<unknown tool>)" and say("submit_lsp_edges", '{"edges": [1, 2]}') == "submit_lsp_edges(2 edges)"
    assert say("get_impact", '{"symbol_fqn": "%s"}' % ("é" * 90)) == f"get_impact(fqn={'é' * 80}…)"


def test_hard_cut():
    assert brief.hard_cut("short", 10) == "short"
    cut = brief.hard_cut("é" * 400, 50)
    assert cut.endswith(brief.CUT_NOTE) and len(cut.encode()) <= 200 and set(cut.removesuffix(brief.CUT_NOTE)) == {"é"}


def test_members_by_turns(spark):
    rows = [(0, k, 100 - k) for k in range(12)] + [(1, 100 + k, k) for k in range(3)] + [(2, 200, 7)]
    df = spark.createDataFrame(rows, "member int, ident long, score long")
    got = [(r.member, r.ident) for r in brief.interleaved(df, 8).collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 102), (2, 200), (1, 101), (1, 100)]
    assert len(brief.interleaved(df.where("member = 0"), 8).collect()) == 8 and [r.member for r in brief.interleaved(df, 1).collect()] == [1]


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=60), st.integers(0, 12))
def test_utf8_cut(text, budget):
    cut = brief.utf8_cut(text.encode("utf-8", "ignore").decode(), budget)
    assert len(cut.encode()) <= 4 * budget and text.encode("utf-8", "ignore").decode().startswith(cut)
