"""Catalogue: graph, containment, lookup, diff and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import failure as FA
from lodestone.operators import graph as G
from lodestone.operators import logs as L
from lodestone.operators import structure as ST
from lodestone.operators.prefix import numbered
from lodestone.plans.views import CUSTOMER, ORDER, PART, SUPPLIER, edges, ends, nodes, query, t
from lodestone.scratch import Scratch

IMPACT_KINDS, TRACE_KINDS = ["calls", "extends", "implements", "uses_type"], ["calls", "extends", "implements", "uses_type"]


def _pagerank_sql(rounds: int) -> str:
    steps = ["deg AS (SELECT source, count(*) AS o FROM edges GROUP BY source)", "cnt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes)", "r0 AS (SELECT node, o, 1.0 / n AS rank FROM nodes LEFT JOIN deg ON source = node CROSS JOIN cnt)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        steps += [f"f{k} AS (SELECT target, sum(rank / o) AS flow FROM edges JOIN {p} ON node = source GROUP BY target)", f"l{k} AS (SELECT coalesce(sum(rank) FILTER (WHERE o IS NULL), 0) AS loose FROM {p})", f"w{k} AS (SELECT node, o, 0.15 / n + 0.85 * (coalesce(flow, 0) + loose / n) AS raw FROM {p} LEFT JOIN f{k} ON target = node CROSS JOIN cnt CROSS JOIN l{k})", f"r{k} AS (SELECT node, o, raw / (SELECT sum(raw) FROM w{k}) AS rank FROM w{k})"]
    return "WITH " + ", ".join(steps) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


def _ranked(spark, d, rounds):
    """Edges are made distinct once and written; nodes are their ends."""
    held = Scratch(spark).save(edges(spark, d), "edges")
    return G.page_rank(ends(held), held, rounds)


@query("pagerank_10", _pagerank_sql(10))
def pagerank_10(spark, d):
    return _ranked(spark, d, 10).select("node", F.round("rank", 9).alias("rank"))


@query("pagerank_100")
def pagerank_100(spark, d):
    """The operator's own number of rounds; no SQL, since a hundred unrolled rounds are too many."""
    return _ranked(spark, d, 100).select("node", F.round("rank", 9).alias("rank"))


def _start(spark, node):
    return spark.sql(f"SELECT {node}L AS node")


_NEAR = "SELECT target AS node, source AS next, kind, row_number() OVER (PARTITION BY target ORDER BY source, kind) AS r FROM edges"


def _impact_sql(node: int, depth: int, cap: int) -> str:
    ctes = [f"near AS (SELECT *, count(*) OVER (PARTITION BY node) AS n FROM ({_NEAR}))", f"s0 AS (SELECT CAST({node} AS BIGINT) AS node)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM s{j}" for j in range(k))
        ctes.append(f"s{k} AS (SELECT next AS node, min(near.kind) AS kind, bool_or(n > {cap}) AS truncated FROM near JOIN s{k - 1} p ON p.node = near.node WHERE r <= {cap} AND next NOT IN ({seen}) GROUP BY next)")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT node, {k} AS depth, kind, truncated FROM s{k}" for k in range(1, depth + 1))


@query("impact_depth3", _impact_sql(SUPPLIER + 3, 3, 100))
def impact_depth3(spark, d):
    return G.impact(edges(spark, d), _start(spark, SUPPLIER + 3), IMPACT_KINDS, 3, 100)


_WALK = f"""WITH pl AS (SELECT DISTINCT source, target FROM edges), o AS (SELECT source AS node, target AS next, 0 AS way, row_number() OVER (PARTITION BY source ORDER BY target) AS r FROM pl),
  i AS (SELECT target AS node, source AS next, 1 AS way, row_number() OVER (PARTITION BY target ORDER BY source) AS r FROM pl), b AS (SELECT * FROM o WHERE r <= 20 UNION ALL SELECT * FROM i WHERE r <= 20),
  s1 AS (SELECT next AS node, min((way, node)) AS w FROM b WHERE node = {PART + 5} AND next <> {PART + 5} GROUP BY next),
  s2 AS (SELECT b.next AS node, min((b.way, b.node)) AS w FROM b JOIN s1 ON s1.node = b.node WHERE b.next <> {PART + 5} AND b.next NOT IN (SELECT node FROM s1) GROUP BY b.next),
  s AS (SELECT node, 1 AS depth, w FROM s1 UNION ALL SELECT node, 2, w FROM s2)
  SELECT node, depth, CASE w[1] WHEN 0 THEN 'outbound' ELSE 'inbound' END AS direction, w[2] AS via FROM s"""


@query("context_bfs", _WALK)
def context_bfs(spark, d):
    return G.context_walk(edges(spark, d), _start(spark, PART + 5), 2, 20)


@query("neighbours_capped", f"SELECT node, next, kind, n > 50 AS more FROM (SELECT *, count(*) OVER (PARTITION BY node) AS n FROM ({_NEAR})) WHERE r <= 50")
def neighbours_capped(spark, d):
    """Every node is in the frontier, hubs such as suppliers too."""
    return G.capped_neighbours(edges(spark, d, "target"), nodes(spark, d), "target", "source", 50)


@query("trace_paths", f"""WITH e AS (SELECT source, target FROM (SELECT DISTINCT source, target FROM edges) QUALIFY row_number() OVER (PARTITION BY source ORDER BY target) <= 50),
  p1 AS (SELECT [{CUSTOMER + 7}, target] AS path, target AS last FROM e WHERE source = {CUSTOMER + 7}), p2 AS (SELECT list_append(path, target) AS path, target AS last FROM p1 JOIN e ON source = last), p3 AS (SELECT list_append(path, target) AS path, target AS last FROM p2 JOIN e ON source = last)
  SELECT array_to_string(path, '>') AS path, 3 AS hops FROM p3 WHERE last = {SUPPLIER + 1} ORDER BY p3.path LIMIT 5""")  # noqa: E501
def trace_paths(spark, d):
    return G.shortest_paths(edges(spark, d, "source"), CUSTOMER + 7, SUPPLIER + 1, TRACE_KINDS).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "hops")


@query("outline_children", """WITH c AS (SELECT l_orderkey AS parent_id, l_linenumber AS child_id, min(l_partkey) AS part FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY child_id) AS r, count(*) OVER (PARTITION BY parent_id) AS n FROM c),
  g AS (SELECT parent_id, max(n) AS n, string_agg('p' || part, ',' ORDER BY child_id) FILTER (WHERE r <= 3) AS shown FROM r GROUP BY parent_id)
  SELECT o_orderkey AS parent_id, coalesce(n, 0) AS n_children, coalesce(shown, '') AS shown, greatest(coalesce(n, 0) - 3, 0) AS hidden FROM orders LEFT JOIN g ON parent_id = o_orderkey""")
def outline_children(spark, d):
    children = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("child_id")).agg(F.min("l_partkey").alias("part")).select("parent_id", "child_id", F.concat(F.lit("p"), F.col("part").cast("string")).alias("label"))
    return ST.outline(t(spark, d, "orders").select(F.col("o_orderkey").alias("parent_id")), children, 3)


@query("dependency_cap10", "SELECT source, target, kind, row_number() OVER (PARTITION BY source ORDER BY target, kind) AS rank FROM edges QUALIFY row_number() OVER (PARTITION BY source ORDER BY target, kind) <= 10")
def dependency_cap10(spark, d):
    return ST.capped(edges(spark, d, "source"), ["source"], 10, "target", "kind").select("source", "target", "kind", "rank")


_SPANS = "sp AS (SELECT l_orderkey AS path, l_partkey AS symbol_id, min(l_linenumber * 10) AS start_line, max(l_linenumber * 10 + CAST(l_quantity AS INTEGER)) AS end_line FROM lineitem GROUP BY ALL), pr AS (SELECT o_orderkey AS probe_id, o_orderkey AS path, CAST(o_custkey % 60 AS INTEGER) AS line FROM orders)"


def _spans(spark, d):
    spans = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("symbol_id")).agg(F.min(F.col("l_linenumber") * 10).alias("start_line"), F.max(F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end_line"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 60).cast("int").alias("line")), spans


@query("enclosing_span", f"WITH {_SPANS} SELECT probe_id, symbol_id, start_line, end_line FROM pr JOIN sp USING (path) WHERE start_line <= line AND line <= end_line QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY end_line - start_line, start_line, symbol_id) = 1")
def enclosing_span(spark, d):
    return ST.enclosing(*_spans(spark, d))


@query("nearest_span", f"WITH {_SPANS} SELECT probe_id, symbol_id, least(abs(start_line - line), abs(end_line - line)) AS gap FROM pr JOIN sp USING (path) QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY least(abs(start_line - line), abs(end_line - line)), start_line, symbol_id) = 1")
def nearest_span(spark, d):
    return ST.nearest(*_spans(spark, d))


@query("unique_name", "SELECT p_name || '/' || p_brand AS name, min(p_partkey) AS symbol_id FROM part GROUP BY ALL HAVING count(*) = 1")
def unique_name(spark, d):
    return ST.unique_names(t(spark, d, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("name"), F.col("p_partkey").alias("symbol_id")))


_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'interface' ELSE 'struct' END"


@query("edge_resolution", f"""WITH s AS (SELECT p_partkey AS symbol_id, p_brand || '::' || p_name || p_size AS fqn, p_name || p_size AS name, {_KIND} AS symbol_kind FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name, p_size ORDER BY p_partkey) = 1),
  r AS (SELECT p_partkey AS ref_id, CASE p_partkey % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'extends' ELSE 'imports' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN p_brand || '::' ELSE 'x::' END || p_name || p_size AS target FROM part),
  k AS (SELECT * FROM (VALUES ('calls', 'function'), ('calls', 'method'), ('extends', 'class'), ('extends', 'interface')) v(kind, symbol_kind)),
  n AS (SELECT kind, name, min(symbol_id) AS name_id FROM s JOIN k USING (symbol_kind) GROUP BY kind, name HAVING count(*) = 1)
  SELECT ref_id, r.kind, target, coalesce(s.symbol_id, name_id) AS target_id, CASE WHEN s.symbol_id IS NOT NULL THEN 'exact' WHEN name_id IS NOT NULL THEN 'name' ELSE 'unresolved' END AS how FROM r LEFT JOIN s ON fqn = target LEFT JOIN n ON n.kind = r.kind AND n.name = split_part(target, '::', 2)""")
def edge_resolution(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    name = F.concat("p_name", F.col("p_size").cast("string"))
    kind = F.when(k % 5 == 0, "function").when(k % 5 == 1, "method").when(k % 5 == 2, "class").when(k % 5 == 3, "interface").otherwise("struct")
    symbols = ST.first_by(p, ["p_brand", "p_name", "p_size"], "p_partkey").select(k.alias("symbol_id"), F.concat("p_brand", F.lit("::"), name).alias("fqn"), name.alias("name"), kind.alias("symbol_kind"))
    refs = p.select(k.alias("ref_id"), F.when(k % 3 == 0, "calls").when(k % 3 == 1, "extends").otherwise("imports").alias("kind"), F.concat(F.when(k % 4 == 0, F.concat("p_brand", F.lit("::"))).otherwise("x::"), name).alias("target"))
    return ST.resolved_edges(refs, symbols)


def snapshots_sql(file: str, name: str) -> str:
    """CTEs old and new: parts as symbols, the new ones with some renamed, changed and gone. ``file`` and ``name`` are SQL over p_partkey."""
    kind, changed = "CASE p_partkey % 2 WHEN 0 THEN 'function' ELSE 'class' END AS kind", "CASE WHEN p_partkey % 7 = 0 THEN '!' ELSE '' END"
    old = f"SELECT {file} || '::' || {name} AS fqn, {kind}, CASE WHEN p_partkey % 9 <> 0 THEN p_name || p_partkey END AS signature, p_type || p_size AS source_hash FROM part"
    new = f"SELECT {file} || '::' || CASE WHEN p_partkey % 11 = 0 THEN 'r' ELSE '' END || {name} AS fqn, {kind}, CASE WHEN p_partkey % 9 <> 0 THEN p_name || p_partkey || {changed} END AS signature, p_type || CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN 'x' ELSE '' END || p_size AS source_hash FROM part WHERE p_partkey % 13 <> 0"
    return f"old AS ({old}), new AS ({new})"


def part_snapshots(spark, d, file, name):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    kind, key = F.when(k % 2 == 0, "function").otherwise("class"), k.cast("string")
    old = p.select(F.concat(file, F.lit("::"), name).alias("fqn"), kind.alias("kind"), F.when(k % 9 != 0, F.concat("p_name", key)).alias("signature"), F.concat("p_type", F.col("p_size").cast("string")).alias("source_hash"))
    new = p.where(k % 13 != 0).select(F.concat(file, F.lit("::"), F.when(k % 11 == 0, "r").otherwise(""), name).alias("fqn"), kind.alias("kind"), F.when(k % 9 != 0, F.concat(F.col("p_name"), key, F.when(k % 7 == 0, "!").otherwise(""))).alias("signature"), F.concat(F.col("p_type"), F.when((k % 7 == 0) | (k % 5 == 0), "x").otherwise(""), F.col("p_size").cast("string")).alias("source_hash"))
    return old, new


_SNAPSHOTS = snapshots_sql("'f' || (p_partkey % 40)", "CAST(p_partkey AS VARCHAR)")


def _snapshots(spark, d):
    k = F.col("p_partkey")
    return part_snapshots(spark, d, F.concat(F.lit("f"), (k % 40).cast("string")), k.cast("string"))


#: CTE ch: changes between old and new, renames taken out of added and removed.
CHANGES_SQL = """ch0 AS (SELECT coalesce(o.fqn, n.fqn) AS fqn, coalesce(o.kind, n.kind) AS kind, o.signature AS old_signature, n.signature AS new_signature,
    CASE WHEN o.fqn IS NULL THEN 'added' WHEN n.fqn IS NULL THEN 'removed' WHEN o.source_hash <> n.source_hash AND o.signature <> n.signature THEN 'signature_changed' WHEN o.source_hash <> n.source_hash THEN 'body_only' END AS change FROM old o FULL JOIN new n ON o.fqn = n.fqn),
  pr AS (SELECT coalesce(old_signature, new_signature) AS sig, min(fqn) FILTER (WHERE change = 'removed') AS was, min(fqn) FILTER (WHERE change = 'added') AS is_now FROM ch0 WHERE change IN ('added', 'removed') AND coalesce(old_signature, new_signature) IS NOT NULL GROUP BY sig, kind HAVING count(*) FILTER (WHERE change = 'removed') = 1 AND count(*) FILTER (WHERE change = 'added') = 1),
  ch AS (SELECT fqn, change, CAST(NULL AS VARCHAR) AS new_fqn, old_signature, new_signature FROM ch0 WHERE change IS NOT NULL AND fqn NOT IN (SELECT was FROM pr) AND fqn NOT IN (SELECT is_now FROM pr) UNION ALL SELECT was, 'renamed', is_now, sig, sig FROM pr)"""


@query("structural_diff", f"WITH {_SNAPSHOTS}, {CHANGES_SQL} SELECT * FROM ch")
def structural_diff(spark, d):
    return ST.symbol_changes(*_snapshots(spark, d))


@query("rename_detection", f"WITH {_SNAPSHOTS}, {CHANGES_SQL} SELECT fqn AS old_fqn, new_fqn, split_part(fqn, '::', 2) = split_part(new_fqn, '::', 2) AS moved FROM ch WHERE change = 'renamed'")
def rename_detection(spark, d):
    return ST.renames(structural_diff(spark, d))


@query("diff_sentence", f"""WITH {_SNAPSHOTS}, {CHANGES_SQL},
  p AS (SELECT split_part(fqn, '::', 1) AS file, fqn, CASE change WHEN 'added' THEN 0 WHEN 'signature_changed' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END AS place, split_part(fqn, '::', 2) AS short, split_part(new_fqn, '::', 2) AS new_short,
    CASE change WHEN 'added' THEN 'added `' || short || '`' WHEN 'signature_changed' THEN 'signature of `' || short || '` changed from `' || old_signature || '` to `' || new_signature || '`' WHEN 'removed' THEN 'removed `' || short || '`' ELSE CASE WHEN short = new_short THEN 'moved `' || fqn || '` → `' || new_fqn || '`' ELSE 'renamed `' || short || '` → `' || new_short || '`' END END AS part FROM ch WHERE change <> 'body_only'),
  r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY place, fqn) AS r FROM p), g AS (SELECT file, count(*) AS n, string_agg(part, ', ' ORDER BY r) FILTER (WHERE r <= 5) AS s FROM r GROUP BY file)
  SELECT file, 'Modified `' || file || '`: ' || s || CASE WHEN n > 5 THEN ', and ' || (n - 5) || ' more' ELSE '' END AS sentence FROM g""")
def diff_sentence(spark, d):
    return ST.diff_sentence(structural_diff(spark, d))


@query("symbol_upsert", f"""WITH {_SNAPSHOTS}, o AS (SELECT row_number() OVER (ORDER BY fqn) AS symbol_id, * FROM old), f AS (SELECT fqn, row_number() OVER (ORDER BY fqn) + (SELECT max(symbol_id) FROM o) AS fresh FROM new WHERE fqn NOT IN (SELECT fqn FROM old))
  SELECT coalesce(symbol_id, fresh) AS symbol_id, n.fqn, n.signature, n.source_hash, CASE WHEN symbol_id IS NULL THEN 'inserted' WHEN n.signature IS NOT DISTINCT FROM o.signature AND n.source_hash IS NOT DISTINCT FROM o.source_hash THEN 'unchanged' ELSE 'updated' END AS action FROM new n LEFT JOIN o ON o.fqn = n.fqn LEFT JOIN f ON f.fqn = n.fqn""")
def symbol_upsert(spark, d):
    old, new = _snapshots(spark, d)
    return ST.upserted(numbered(old, ["fqn"], "symbol_id"), new, "fqn", "symbol_id", ["signature", "source_hash"])


@query("symbol_deletions", f"""WITH {_SNAPSHOTS} SELECT coalesce(o.fqn, n.fqn) AS fqn, CASE WHEN o.fqn IS NULL THEN 'inserted' WHEN n.fqn IS NULL THEN 'deleted' ELSE 'updated' END AS action FROM old o FULL JOIN new n ON o.fqn = n.fqn WHERE o.fqn IS NULL OR n.fqn IS NULL OR n.signature IS DISTINCT FROM o.signature OR n.source_hash IS DISTINCT FROM o.source_hash""")
def symbol_deletions(spark, d):
    """What an upsert changes, deleted symbols too."""
    old, new = _snapshots(spark, d)
    return ST.upserted(numbered(old, ["fqn"], "symbol_id"), new, "fqn", "symbol_id", ["signature", "source_hash"], deleted=True).where("action <> 'unchanged'").select("fqn", "action")


@query("unseen_symbols", "SELECT p_brand || '::' || p_partkey AS fqn FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 49)")
def unseen_symbols(spark, d):
    p = t(spark, d, "part")
    symbols = p.select(F.concat("p_brand", F.lit("::"), F.col("p_partkey").cast("string")).alias("fqn"), F.col("p_brand").alias("path"))
    return ST.unseen_symbols(symbols, p.where("p_size > 49").select(F.col("p_brand").alias("path")))


@query("embedding_upsert", "SELECT coalesce(e.vec_id, l.doc_id) AS vec_id, CASE WHEN e.vec_id IS NULL THEN 'inserted' ELSE 'replaced' END AS action FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id")
def embedding_upsert(spark, d):
    new = t(spark, d, "labels").select(F.col("doc_id").alias("vec_id"))
    old = t(spark, d, "embeddings").select("vec_id", F.lit(True).alias("_old"))
    return new.join(old, "vec_id", "left").select("vec_id", F.when(F.col("_old").isNull(), "inserted").otherwise("replaced").alias("action"))


@query("edge_insert", "WITH n AS (SELECT source, CASE WHEN target % 2 = 0 THEN target + 1 ELSE target END AS target, kind FROM edges WHERE kind = 'uses_type') SELECT DISTINCT n.source, n.target, n.kind FROM n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = n.source AND e.target = n.target AND e.kind = n.kind)")
def edge_insert(spark, d):
    e = edges(spark, d)
    new = e.where("kind = 'uses_type'").withColumn("target", F.when(F.col("target") % 2 == 0, F.col("target") + 1).otherwise(F.col("target")))
    return ST.inserted_edges(e, new).select("source", "target", "kind")


@query("lsp_edge_report", f"""WITH b AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_partkey + {PART} AS BIGINT) END AS source, CASE WHEN p_partkey % 7 = 0 THEN CAST(9999999999 AS BIGINT) ELSE CAST({SUPPLIER} + p_size % 10 AS BIGINT) END AS target, CASE WHEN p_partkey % 6 = 0 THEN 'bogus' ELSE 'implements' END AS kind FROM part),
  m AS (SELECT CASE WHEN b.source IS NULL THEN 'malformed' WHEN b.kind = 'bogus' THEN 'invalid_kind' WHEN b.source NOT IN (SELECT node FROM nodes) OR b.target NOT IN (SELECT node FROM nodes) THEN 'unresolved' WHEN EXISTS (SELECT 1 FROM edges e WHERE e.source = b.source AND e.target = b.target AND e.kind = b.kind) THEN 'already_existed' ELSE 'inserted' END AS status FROM b)
  SELECT count(*) AS submitted, count(*) FILTER (WHERE status = 'malformed') AS malformed, count(*) FILTER (WHERE status = 'invalid_kind') AS invalid_kind, count(*) FILTER (WHERE status = 'unresolved') AS unresolved, count(*) FILTER (WHERE status = 'already_existed') AS already_existed, count(*) FILTER (WHERE status = 'inserted') AS inserted, count(*) > 500 AS refused,
    (SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (SELECT DISTINCT n, CAST(n AS VARCHAR) AS x FROM (SELECT source AS n FROM b WHERE kind = 'implements' AND source IS NOT NULL UNION ALL SELECT target FROM b WHERE kind = 'implements' AND source IS NOT NULL) WHERE n NOT IN (SELECT node FROM nodes) ORDER BY n LIMIT 5)) AS unresolved_examples FROM m""")
def lsp_edge_report(spark, d):
    k = F.col("p_partkey")
    batch = t(spark, d, "part").select(F.when(k % 10 != 0, k + PART).cast("long").alias("source"), F.when(k % 7 == 0, F.lit(9999999999)).otherwise(F.col("p_size") % 10 + F.lit(SUPPLIER)).cast("long").alias("target"), F.when(k % 6 == 0, "bogus").otherwise("implements").alias("kind"))
    return ST.edge_report(batch, nodes(spark, d), edges(spark, d))


@query("incremental_files", "WITH o AS (SELECT page_id AS path, md5(html) AS h FROM pages WHERE page_id % 5 <> 0), n AS (SELECT page_id AS path, md5(CASE WHEN page_id % 3 = 0 THEN html || 'x' ELSE html END) AS h FROM pages WHERE page_id % 7 <> 0) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS action FROM o FULL JOIN n ON o.path = n.path")
def incremental_files(spark, d):
    p = t(spark, d, "pages")
    old = p.where("page_id % 5 <> 0").select(F.col("page_id").alias("path"), F.sha2("html", 256).alias("content_hash"))
    new = p.where("page_id % 7 <> 0").select(F.col("page_id").alias("path"), F.sha2(F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("content_hash"))
    return ST.incremental_files(old, new)


@query("path_resolution", "WITH f AS (SELECT 'src/' || source || '/d' || (doc_id % 300) || '.rs' AS path FROM documents GROUP BY ALL), q AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'd' || (doc_id % 300) || '.rs' ELSE 'src/' || source || '/d' || (doc_id % 300) || '.rs' END AS q FROM documents), m AS (SELECT q, path, CASE WHEN path = q THEN 0 ELSE 1 END AS stage FROM q JOIN f ON path = q OR ends_with(path, '/' || q)), g0 AS (SELECT q, stage, count(*) AS n, min(path) AS hit FROM m GROUP BY q, stage), g AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY stage) = 1) SELECT q, n, CASE WHEN n = 1 THEN hit END AS hit, (SELECT CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list(path))[1:5], ',') END FROM m WHERE m.q = g.q AND m.stage = g.stage) AS candidates FROM g")
def path_resolution(spark, d):
    docs = t(spark, d, "documents")
    short = F.concat(F.lit("d"), (F.col("doc_id") % 300).cast("string"), F.lit(".rs"))
    whole = F.concat(F.lit("src/"), "source", F.lit("/"), short)
    return ST.resolved_paths(docs.select(F.when(F.col("doc_id") % 2 == 0, short).otherwise(whole).alias("q")).distinct(), docs.select(whole.alias("path")).distinct())


_LINE = """CASE page_id % 7 WHEN 0 THEN '  at src/a' || page_id || '.rs:' || (page_id + 1) WHEN 1 THEN '  File "lib/m' || page_id || '.py", line ' || page_id || ', in f' WHEN 2 THEN 'see main.go:' || page_id || ' +0x1d' WHEN 3 THEN 'password=hunter' || page_id || ' /home/u/x/y' || page_id || '.txt'
  WHEN 4 THEN '---- mod::test_' || page_id || ' stdout ----' WHEN 5 THEN 'FAILED tests/t' || page_id || '.py::test_x' ELSE 'at run' || page_id || ' (/usr/lib/x.ts:3:4)' END"""


def _line():
    m, p = F.col("page_id") % 7, F.col("page_id").cast("string")
    c = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    lines = [c("  at src/a", p, ".rs:", (F.col("page_id") + 1).cast("string")), c('  File "lib/m', p, '.py", line ', p, ", in f"), c("see main.go:", p, " +0x1d"), c("password=hunter", p, " /home/u/x/y", p, ".txt"), c("---- mod::test_", p, " stdout ----"), c("FAILED tests/t", p, ".py::test_x"), c("at run", p, " (/usr/lib/x.ts:3:4)")]
    out = F.when(m == 0, lines[0])
    for k, line in enumerate(lines[1:], 1):
        out = out.when(m == k, line)
    return out


def _lines(spark, d):
    return t(spark, d, "pages").select("page_id", _line().alias("line"))


@query("line_frames", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'src/a' || page_id || '.rs' WHEN 1 THEN 'lib/m' || page_id || '.py' WHEN 2 THEN 'main.go' WHEN 5 THEN 'tests/t' || page_id || '.py' END AS file, CASE page_id % 7 WHEN 0 THEN page_id + 1 WHEN 1 THEN page_id WHEN 2 THEN page_id END AS line_no,
  CASE page_id % 7 WHEN 1 THEN 'f' WHEN 4 THEN 'mod::test_' || page_id WHEN 5 THEN 'test_x' WHEN 6 THEN 'run' || page_id END AS symbol FROM pages""")
def line_frames(spark, d):
    return _lines(spark, d).select("page_id", *L.frame_of(F.col("line")))


@query("trace_sanitise", f"SELECT page_id, CASE page_id % 7 WHEN 3 THEN '[redacted: sensitive content]' WHEN 5 THEN '[redacted: sensitive content]' WHEN 6 THEN 'at run' || page_id || ' (<abs>/x.ts:3:4)' ELSE {_LINE} END AS line FROM pages")
def trace_sanitise(spark, d):
    return _lines(spark, d).select("page_id", L.sanitised(F.col("line"), {"deny": [{"path": "tests/*"}]}).alias("line"))


#: Traces of three frames over a tree in which file k % 40 has a symbol of seven lines at each ten.
_TRACE_SYMBOLS = "sy AS (SELECT page_id AS symbol_id, 'src/a' || (page_id % 40) || '.rs' AS path, 'test_' || page_id AS name, (page_id // 40) * 10 + 1 AS start_line, (page_id // 40) * 10 + 7 AS end_line FROM pages)"


def _traces(spark, d):
    k = F.col("page_id")
    at = lambda m: F.concat(F.lit("at src/a"), (k % m).cast("string"), F.lit(".rs:"), (F.expr("page_id div 40") * 10 + k % 10).cast("string"))
    text = F.concat_ws("\n", F.lit("thread panicked"), at(40), F.concat(F.lit("---- test_"), (k + 1).cast("string"), F.lit(" stdout ----")), F.lit("boom()"))
    symbols = t(spark, d, "pages").select(k.alias("symbol_id"), F.concat(F.lit("src/a"), (k % 40).cast("string"), F.lit(".rs")).alias("path"), F.concat(F.lit("test_"), k.cast("string")).alias("name"), (F.expr("page_id div 40") * 10 + 1).alias("start_line"), (F.expr("page_id div 40") * 10 + 7).alias("end_line"))
    return t(spark, d, "pages").select(k.alias("trace_id"), text.alias("text")), symbols


_RESOLVED = f"""WITH {_TRACE_SYMBOLS}, f AS (SELECT page_id AS trace_id, 1 AS place, 'src/a' || (page_id % 40) || '.rs' AS file, (page_id // 40) * 10 + page_id % 10 AS line_no, CAST(NULL AS VARCHAR) AS symbol FROM pages
    UNION ALL SELECT page_id, 2, NULL, NULL, 'test_' || (page_id + 1) FROM pages UNION ALL SELECT page_id, 3, NULL, NULL, 'boom' FROM pages),
  a AS (SELECT trace_id, place, symbol_id FROM f JOIN sy ON path = file AND start_line <= line_no AND line_no <= end_line QUALIFY row_number() OVER (PARTITION BY trace_id, place ORDER BY end_line - start_line, start_line, symbol_id) = 1),
  b AS (SELECT trace_id, place, symbol_id FROM f JOIN sy ON path = file QUALIFY row_number() OVER (PARTITION BY trace_id, place ORDER BY least(abs(start_line - coalesce(line_no, 0)), abs(end_line - coalesce(line_no, 0))), start_line, symbol_id) = 1),
  c AS (SELECT name, min(symbol_id) AS symbol_id FROM sy GROUP BY name HAVING count(*) = 1 AND strlen(name) >= 4),
  r AS (SELECT f.*, coalesce(a.symbol_id, b.symbol_id, c.symbol_id) AS symbol_id, CASE WHEN a.symbol_id IS NOT NULL THEN 'line' WHEN b.symbol_id IS NOT NULL THEN 'file' WHEN c.symbol_id IS NOT NULL THEN 'name' ELSE 'unresolved' END AS tier
    FROM f LEFT JOIN a ON a.trace_id = f.trace_id AND a.place = f.place LEFT JOIN b ON b.trace_id = f.trace_id AND b.place = f.place LEFT JOIN c ON c.name = f.symbol)"""


@query("failure_frames", _RESOLVED + " SELECT * FROM r")
def failure_frames(spark, d):
    traces, symbols = _traces(spark, d)
    return FA.resolved_frames(FA.frames(traces), symbols)


@query("failure_pivots", _RESOLVED + " , m AS (SELECT trace_id, symbol_id, min(place) AS place FROM r WHERE symbol_id IS NOT NULL GROUP BY trace_id, symbol_id) SELECT trace_id, symbol_id, row_number() OVER (PARTITION BY trace_id ORDER BY place) AS rank FROM m")
def failure_pivots(spark, d):
    return FA.failure_pivots(failure_frames(spark, d))


@query("file_refresh", "WITH o AS (SELECT page_id, md5(html) AS h FROM pages WHERE page_id % 5 <> 0) SELECT p.page_id AS path, CASE WHEN p.page_id % 11 = 0 THEN 'failure: language' WHEN o.h IS NULL OR p.page_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome FROM pages p LEFT JOIN o USING (page_id)")
def file_refresh(spark, d):
    """What reading each file again comes to: unchanged, changed, or a file without a known language."""
    p = t(spark, d, "pages")
    old = p.where("page_id % 5 <> 0").select(F.col("page_id").alias("path"), F.sha2("html", 256).alias("old_hash"))
    text = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    new = p.select(F.col("page_id").alias("path"), F.when(F.col("page_id") % 11 != 0, "python").alias("language"), F.sha2(text, 256).alias("new_hash"))
    return ST.refresh_outcomes(old, new)


@query("index_status", "SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT max(created_at) FROM ev) AS last_at")
def index_status(spark, d):
    from lodestone.plans.views import events

    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(t(spark, d, "documents"), "files").crossJoin(n(t(spark, d, "part"), "symbols")).crossJoin(n(edges(spark, d), "edges")).crossJoin(events(spark, d).agg(F.max("created_at").alias("last_at")))


@query("delete_unseen", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def delete_unseen(spark, d):
    seen = t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(seen, "l_orderkey", "left_semi")
