import pytest

from lodestone.sources import parse as P
from lodestone.sources import tree as T

SAMPLES = {
    "a.py": "import os\n\nclass A:\n    x: int\n\n    def __init__(self):\n        self.y = 1\n\n    def m(self):\n        return f()\n\n\ndef f():\n    return 1\n",
    "b.ts": "import { z } from './z';\nexport class B extends Base implements I {\n  n: number;\n  go(q: Thing) { return run(q); }\n}\ninterface I { go(q: Thing): void; }\nconst run = (q: Thing) => helper(q);\nenum E { One, Two }\n",
    "c.rs": "use std::fmt;\npub struct S { pub a: u8 }\nenum E { One, Two(u8) }\ntrait T { fn t(&self); }\nimpl S { pub fn new() -> S { S { a: 1 } } }\nimpl T for S { fn t(&self) {} }\nfn free() {}\n",
    "d.go": 'package d\nimport "fmt"\ntype S struct {\n\tA int\n}\ntype I interface {\n\tGo(x *S) error\n}\nfunc (s *S) Run(x []*Thing) (Other, error) { fmt.Println(help()) }\nconst C = 1\n',
    "e.php": "<?php\nnamespace App;\nclass K {\n  use Tr;\n  private $p;\n  public function m() { add_action('init', 'cb'); do_action('done'); }\n}\nfunction cb() {}\n",
}


def names(path):
    return {(s[0].split("::", 1)[1], s[2]) for s in P.parse_file(path, SAMPLES[path])[0]}


def test_python():
    assert names("a.py") == {("A", "class"), ("A::x", "field"), ("A::y", "field"), ("A::__init__", "method"), ("A::m", "method"), ("f", "function")}
    assert P.parse_file("bad.py", "def (") == ([], []) and P.parse_file("x.txt", "hello") == ([], [])


def test_other_languages():
    assert {("B", "class"), ("B::n", "field"), ("B::go", "method"), ("I", "interface"), ("I::go", "method"), ("run", "function"), ("E", "enum"), ("E::One", "enum_variant"), ("E::Two", "enum_variant")} <= names("b.ts")
    edges = {(t, k) for _, t, k in P.parse_file("b.ts", SAMPLES["b.ts"])[1]}
    assert {("Base", "extends"), ("I", "implements"), ("run", "calls"), ("helper", "calls"), ("Thing", "uses_type"), ("./z", "imports")} <= edges
    assert {("S", "struct"), ("S::a", "field"), ("E", "enum"), ("T", "trait"), ("T::t", "trait_method"), ("S::new", "method"), ("S::<T>::t", "method"), ("free", "function")} <= names("c.rs")
    assert {k for _, _, k in P.parse_file("c.rs", SAMPLES["c.rs"])[1]} == {"imports"}
    assert {("S", "class"), ("S::A", "field"), ("I", "interface"), ("I::Go", "method"), ("S::Run", "method"), ("C", "constant")} <= names("d.go")
    assert {("help", "calls"), ("Thing", "uses_type"), ("Other", "uses_type"), ("fmt", "imports")} <= {(t, k) for _, t, k in P.parse_file("d.go", SAMPLES["d.go"])[1]}
    assert {("App\\K", "class"), ("App\\K::p", "field"), ("App\\K::m", "method"), ("App\\cb", "function")} <= names("e.php")
    assert {("Tr", "uses_trait"), ("cb", "hooks_into"), ("done", "fires_hook")} <= {(t, k) for _, t, k in P.parse_file("e.php", SAMPLES["e.php"])[1]}


def test_scan_and_parse(spark, tmp_path):
    for name, text in {**SAMPLES, ".env": "x", "skip/g.py": "def g(): pass", "target/t.py": "x = 1", "README.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("skip\n")
    files = T.scan(spark, str(tmp_path))
    assert {r.path: r.language for r in files.collect()} == {"a.py": "python", "b.ts": "typescript", "c.rs": "rust", "d.go": "go", "e.php": "php"}
    parsed = P.parse(files)
    assert P.symbols_of(parsed).where("path = 'a.py'").count() == 6 and P.edges_of(parsed).where("kind = 'imports'").count() == 0


def test_ignore_files_of_all_folders(spark, tmp_path):
    kept = ["a.py", "lib/keep.py", "lib/sub/x.py", "docs/b.py", "other/build/c.py", "lib/q.py"]
    for name in [*kept, "lib/gen.py", "lib/sub/gen.py", "build/c.py", "docs/api/d.py", "lib/z1.py"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# no\n/build/\ndocs/**/d.py\nlib/*.py\n!lib/keep.py\n!lib/[a-q].py\n")
    (tmp_path / "lib/.gitignore").write_text("gen.py\n!q.py\n")
    (tmp_path / "id_rsa.py").write_text("secret = 1\n")
    assert sorted(r.path for r in T.scan(spark, str(tmp_path)).collect()) == sorted(kept)


def test_members_that_can_be_read(spark, tmp_path):
    import warnings

    spark.range(3).write.parquet(str(tmp_path / "m1/symbols"))
    spark.range(2).withColumnRenamed("id", "other").write.parquet(str(tmp_path / "m3/symbols"))
    members = [{"path": str(tmp_path / f"m{k}"), "label": f"m{k}"} for k in (1, 2, 3)]
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        found = T.member_tables(spark, members, "symbols", ["id"])
    assert sorted(map(tuple, found.collect())) == [(0, 1), (1, 1), (2, 1)] and len(said) == 2


def test_snapshots(spark, tmp_path):
    root, store = tmp_path / "w", str(tmp_path / "s")
    root.mkdir()
    (root / "f.txt").write_text("one")
    first = T.snapshot(store, str(root), "f.txt", 900)
    (root / "f.txt").write_text("two")
    T.snapshot(store, str(root), "./f.txt", 1000)
    second = T.snapshot(store, str(root), "f.txt", 1000)
    assert T.snapshot_at(spark, store, "f.txt", 1000) == second and T.snapshot_at(spark, store, "f.txt", 5) is None
    (tmp_path / "s" / "restores").joinpath(next((tmp_path / "s" / "restores").iterdir()).name, f"{second}.snap").unlink()
    assert [r.millis for r in T.snapshots(spark, store, "f.txt").collect()] == [1000, 900]
    T.restore(store, str(root), "f.txt", first)
    assert (root / "f.txt").read_text() == "one" and T.snapshot(store, str(root), "none.txt") is None
    for bad in ("../x", "/etc/passwd", ""):
        try:
            T.snapshot(store, str(root), bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert T.expire_snapshots(store, 8 * 86_400_000, 950) == 1


def test_config(tmp_path):
    (tmp_path / "p.toml").write_text('[[deny]]\npath = "a*"\n[[redact]]\nreason = "none"\n')
    assert T.load_policy(str(tmp_path / "p.toml")) == {"deny": [{"path": "a*"}], "redact": []}
    (tmp_path / "bad.toml").write_text("[")
    with pytest.warns(UserWarning):
        assert T.load_policy(str(tmp_path / "bad.toml")) == {"deny": [], "redact": []}
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/feature/x\n")
    assert T.git_branch(str(tmp_path)) == "feature/x"
