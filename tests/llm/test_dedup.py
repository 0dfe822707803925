import random
import re

from oracle import connect, difference

from lodestone.llm import op3_near_dedup as D

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[top(x)] = top(y)
    groups = {}
    for x, (i, _) in enumerate(sets):
        groups.setdefault(top(x), []).append(i)
    return sorted((len(sets[x][1]), min((i for i in groups[top(x)] if i is not None), default=-1), sets[x][0] if sets[x][0] is not None else -1) for x in range(len(sets)))


def test_odd_rows(odd, none):
    got = sorted((r.n_shingles, r.component_id if r.component_id is not None else -1, r.doc_id if r.doc_id is not None else -1) for r in D.near_duplicates(odd).collect())
    assert got == components([(r.doc_id, r.text) for r in odd.collect()])
    assert D.near_duplicates(none).count() == 0


def test_null_ids_and_small_ids(spark):
    rows = [(None, "a b c d e")] * 3 + [(7, "x y z")] * 2 + [(8, "X y z"), (None, "only one here"), (None, "")]
    for kind in ("int", "long"):
        got = [(r.doc_id, r.component_id, r.kept) for r in D.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()]
        assert sorted(got, key=str) == sorted([(None, None, False)] * 3 + [(7, 7, True)] * 2 + [(8, 7, False), (None, None, True), (None, None, True)], key=str)


def test_groups_of_near_copies(spark, monkeypatch):
    """Copies of a base with more or fewer words changed: many are linked only through others."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(6):
        base = [word() for _ in range(90)]
        for _ in range(25):
            own = base[:]
            for k in r.sample(range(90), r.randint(0, 6)):
                own[k] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, " ".join(word() for _ in range(60))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = components(rows)
    for block, shingles in ((2048, 1 << 22), (3, 1 << 22), (2048, 300)):
        monkeypatch.setattr(D, "BLOCK", block)
        monkeypatch.setattr(D, "BLOCK_SHINGLES", shingles)
        got = D.near_duplicates(docs).collect()
        assert sorted((x.n_shingles, x.component_id, x.doc_id) for x in got) == want
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_bounds():
    assert D.missed(0.85) < 1e-6
    least = D.least_matches()
    assert least == sorted(least) and least[-1] < 0.85 * D.HASHES
    assert len(D.shingle_hashes("a b c a b c")) == 3 and len(D.shingle_hashes("A b")) == 1 and len(D.shingle_hashes("")) == 0


def test_query(spark):
    con = connect("/root/testdata/sf0.001")
    assert difference(spark, con, D.op3_near_dedup, D.ORACLE_SQL, "/root/testdata/sf0.001") is None
