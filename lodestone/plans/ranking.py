"""Catalogue: text, search, ranking and budget queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import brief as BR
from lodestone.operators import embed as E
from lodestone.operators import memory as M
from lodestone.operators import policy as P
from lodestone.operators import search as S
from lodestone.plans.views import now_of, obs, query, t

QUERY = ["tion", "heed", "the", "elle"]


def _bm25_sql(source: str, ident: str, cols: dict[str, float], terms: list[str], limit: int | None) -> str:
    """Explicit BM25 in SQL over tokens of the given columns; a term with a space is a phrase of two words."""
    n = lambda c, p: f"len(list_filter(w_{c}, lambda x: x = '{p}'))" if " " not in p else f"CAST((strlen(j_{c}) - strlen(replace(j_{c}, ' {p.replace(' ', '  ')} ', ''))) / {len(p) + 3} AS BIGINT)"
    split = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
    words = ", ".join(f"{split(c)} AS w_{c}, ' ' || array_to_string({split(c)}, '  ') || ' ' AS j_{c}" for c in cols)
    counts = ", ".join(f"{' + '.join(n(c, p) for c in cols)} AS n{k}, {' + '.join(f'{w} * {n(c, p)}' for c, w in cols.items())} AS f{k}" for k, p in enumerate(terms))
    stats = ", ".join(f"CAST(count(*) FILTER (WHERE n{k} > 0) AS DOUBLE) AS d{k}" for k in range(len(terms)))
    idf = lambda k: f"CASE WHEN ln((big + 0.5 - d{k}) / (d{k} + 0.5)) <= 0 THEN 0.000001 ELSE ln((big + 0.5 - d{k}) / (d{k} + 0.5)) END"
    score = " ".join(f"- ({idf(k)}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / mean))" for k in range(len(terms)))
    hit = " OR ".join(f"n{k} > 0" for k in range(len(terms)))
    tail = f"ORDER BY raw, {ident} LIMIT {limit}" if limit else ""
    return f"""WITH w AS (SELECT {ident}, {words} FROM {source}), c AS (SELECT {ident}, CAST({' + '.join(f'len(w_{c})' for c in cols)} AS DOUBLE) AS dl, {counts} FROM w),
      s AS (SELECT CAST(count(*) AS DOUBLE) AS big, avg(dl) AS mean, {stats} FROM c),
      r AS (SELECT {ident}, CAST(0 {score} AS DOUBLE) AS raw FROM c CROSS JOIN s WHERE {hit} {tail}) SELECT {ident}, round(raw, 6) AS score FROM r"""


def _top(df, ident, n=20):
    return S.top_by(df, "score", ident, n).select(ident, F.round("score", 6).alias("score"))


@query("bm25_topk", _bm25_sql("documents", "doc_id", {"text": 1.0}, QUERY, 20))
def bm25_topk(spark, d):
    return _top(S.bm25(t(spark, d, "documents"), {"text": 1.0}, QUERY, ["doc_id"]), "doc_id")


@query("bm25_weighted_columns", _bm25_sql("part", "p_partkey", {"p_name": 10.0, "p_brand": 5.0, "p_type": 2.0}, ["cold", "13", "promo"], 50))
def bm25_weighted_columns(spark, d):
    return _top(S.bm25(t(spark, d, "part"), {"p_name": 10.0, "p_brand": 5.0, "p_type": 2.0}, ["cold", "13", "promo"], ["p_partkey"]), "p_partkey", 50)


@query("bm25_phrase", _bm25_sql("documents", "doc_id", {"text": 1.0}, ["of the", "to be"], 20))
def bm25_phrase(spark, d):
    return _top(S.bm25(t(spark, d, "documents"), {"text": 1.0}, ["of the", "to be"], ["doc_id"]), "doc_id")


@query("match_class", "SELECT p_partkey, CASE WHEN lower(p_name) = 'rod' THEN 'exact' WHEN list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'rod') THEN 'segment' WHEN contains(lower(p_name), 'rod') THEN 'substring' ELSE 'other' END AS class FROM part")
def match_class(spark, d):
    return t(spark, d, "part").select("p_partkey", S.match_class(F.col("p_name"), "rod").alias("class"))


@query("cosine_topk", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS similarity FROM embeddings CROSS JOIN q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    e = t(spark, d, "embeddings")
    near = S.cosine_to(e.select("vec_id", "embedding"), "embedding", e.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return S.top_by(near, "similarity", "vec_id", 20, True).select("vec_id", F.round("similarity", 6).alias("similarity"))


def _pool(spark, d):
    docs = t(spark, d, "documents")
    pool = S.top_by(S.bm25(docs, {"text": 1.0}, QUERY, ["doc_id"]), "score", "doc_id", 100)
    e = t(spark, d, "embeddings")
    near = S.cosine_to(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "embedding", e.where("vec_id = 0").select(F.col("embedding").alias("q"))).select("doc_id", "similarity")
    return pool.join(docs.select("doc_id", F.col("n_chars").cast("double").alias("centrality")), "doc_id").join(near, "doc_id", "left")


_POOL_SQL = _bm25_sql("documents", "doc_id", {"text": 1.0}, QUERY, 100).rpartition(") SELECT")[0] + "), "


@query("rrf_hybrid", _POOL_SQL + """q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
  p AS (SELECT r.doc_id, raw, CAST(n_chars AS DOUBLE) AS centrality, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS sim FROM r JOIN documents USING (doc_id) CROSS JOIN q LEFT JOIN embeddings ON vec_id = doc_id),
  k AS (SELECT doc_id, dense_rank() OVER (ORDER BY round(raw, 12)) AS a, dense_rank() OVER (ORDER BY centrality DESC) AS b,
    CASE WHEN sim IS NOT NULL THEN dense_rank() OVER (ORDER BY round(sim, 12) DESC NULLS LAST) ELSE count(*) OVER () + 1 END AS c, count(sim) OVER () / CAST(count(*) OVER () AS DOUBLE) AS share FROM p)
  SELECT doc_id, round(1.0 / (60 + a) + 1.0 / (60 + b) + CASE WHEN share >= 0.5 THEN 1.0 / (60 + c) ELSE 0 END, 9) AS rrf FROM k ORDER BY rrf DESC, doc_id LIMIT 20""")
def rrf_hybrid(spark, d):
    f = S.fused(_pool(spark, d), {"score": ("asc", True), "centrality": ("desc", True), "similarity": ("desc", False)}, "doc_id", coverage={"similarity": 0.5})
    return f.select("doc_id", F.round("rrf", 9).alias("rrf")).orderBy(F.col("rrf").desc(), "doc_id").limit(20)


@query("identifier_tokens", r"""WITH n AS (SELECT s_suppkey, 'load' || replace(s_name, '#', 'HTTPGet_') AS name FROM supplier),
  p AS (SELECT s_suppkey, name, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS parts FROM n)
  SELECT s_suppkey, array_to_string(parts, ' ') || ' ' || lower(name) AS expanded, len(parts) AS n_parts FROM p""")
def identifier_tokens(spark, d):
    n = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("load"), F.replace(F.col("s_name"), F.lit("#"), F.lit("HTTPGet_"))).alias("name"))
    return n.select("s_suppkey", X.expanded_name(F.col("name")).alias("expanded"), F.size(X.split_identifier(F.col("name"))).cast("long").alias("n_parts"))


@query("content_tokens_top8", """WITH e AS (SELECT doc_id, unnest(words) AS token FROM dt), c AS (SELECT doc_id, token, count(*) AS n FROM e GROUP BY doc_id, token)
  SELECT doc_id, token, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) <= 8""")
def content_tokens_top8(spark, d):
    return S.content_tokens(t(spark, d, "documents"), "doc_id", "text")


#: Questions put behind the turns of conversations, so that their words occur.
ASKED = ["fix the crash", "refactor and fix", "rename and extract it", "add a build step, then fix", "implement this", "look around"]
_ASKED_SQL = "text || ' ' || CASE (conv_id + turn) % 6 " + " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(ASKED)) + " END"


def _asked(spark, d):
    which = F.element_at(F.array(*[F.lit(q) for q in ASKED]), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), which).alias("text"))


_BUGFIX, _REFACTOR, _IMPL = ["bug", "crash", "debug", "error", "fix"], ["extract", "refactor", "rename", "restructure"], ["add", "build", "create", "implement"]
_n_sql = lambda words: " + ".join(f"CAST(list_contains(w, '{x}') AS BIGINT)" for x in words)
_INTENT_SQL = f"""WITH w AS (SELECT conv_id, turn, string_split_regex(lower({_ASKED_SQL}), '[^\\p{{L}}\\p{{N}}]+') AS w FROM conversations),
  c AS (SELECT conv_id, turn, {_n_sql(_BUGFIX)} AS n_bugfix, {_n_sql(_REFACTOR)} AS n_refactor, {_n_sql(_IMPL)} AS n_impl, concat_ws(', ', {', '.join(f"CASE WHEN list_contains(w, '{x}') THEN '{x}' END" for x in _BUGFIX + _REFACTOR + _IMPL)}) AS signals FROM w),
  s AS (SELECT *, n_bugfix + n_refactor + n_impl AS total, greatest(n_bugfix, n_refactor, n_impl) AS top FROM c),
  k AS (SELECT *, CASE WHEN total = 0 THEN 'balanced' WHEN n_bugfix = top THEN 'bugfix' WHEN n_refactor = top THEN 'refactor' ELSE 'impl' END AS dominant, CASE WHEN total > 0 THEN top / CAST(total AS DOUBLE) ELSE 0 END AS share FROM s),
  i AS (SELECT conv_id, turn, n_bugfix, n_refactor, n_impl, round(share, 6) AS dominance, dominant, CASE WHEN share >= 0.6 THEN dominant ELSE 'balanced' END AS intent, signals FROM k)"""


@query("intent_profile", _INTENT_SQL + " SELECT * FROM i")
def intent_profile(spark, d):
    return _asked(spark, d).select("conv_id", "turn", *X.intent_profile(F.col("text")))


@query("traversal_policy", _INTENT_SQL + """ SELECT conv_id, turn, CASE WHEN share >= 0.6 THEN 5 ELSE 8 END AS pool, CASE WHEN share >= 0.6 AND n_refactor >= 0.5 * total THEN 3 ELSE 2 END AS depth,
  share >= 0.6 AND n_bugfix + n_refactor >= 0.35 * total AS inbound, share >= 0.6 AND n_bugfix + n_refactor >= 0.35 * total AND n_bugfix >= n_refactor AS inbound_first FROM k""")
def traversal_policy(spark, d):
    return intent_profile(spark, d).select("conv_id", "turn", *X.traversal_policy(F.col("n_bugfix"), F.col("n_refactor"), F.col("n_impl")))


@query("bm25_candidates", _bm25_sql("documents", "doc_id", {"text": 1.0}, ["tion", "heed"], None) + " WHERE doc_id IN (SELECT doc_id FROM labels)")
def bm25_candidates(spark, d):
    """Labelled documents alone are scored, by statistics of all."""
    scored = S.bm25(t(spark, d, "documents"), {"text": 1.0}, ["tion", "heed"], ["doc_id"], candidates=t(spark, d, "labels").select("doc_id"))
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


_PATH = "'src/' || source || '/' || CASE doc_id % 7 WHEN 0 THEN '.env' WHEN 1 THEN 'id_rsa.pub' WHEN 2 THEN 'Key.PEM' ELSE 'd' || doc_id || '.rs' END"


def _paths(spark, d):
    m = F.col("doc_id") % 7
    return t(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("src/"), "source", F.lit("/"), F.when(m == 0, ".env").when(m == 1, "id_rsa.pub").when(m == 2, "Key.PEM").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".rs")))).alias("path"))


@query("sensitive_paths", f"WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents) SELECT doc_id, path FROM p WHERE regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^(\\.env|id_rsa|\\.env\\..*|id_rsa\\..*|.*\\.(pem|key|p12))$')")
def sensitive_paths(spark, d):
    return _paths(spark, d).where(X.is_sensitive(F.col("path"))).select("doc_id", "path")


POLICY = {"deny": [{"path": "src/src1*"}, {"fqn_prefix": "src/src3/d4.rs::S"}], "redact": [{"path": "*/src2/*"}, {"path": "src/src1*"}]}


@query("policy_filter", f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents), f AS (SELECT doc_id, path, path || '::S::m' || doc_id AS fqn FROM p)
  SELECT doc_id, path, regexp_matches(path, '/src2/') AS redacted, CASE WHEN regexp_matches(path, '/src2/') THEN '[redacted]' ELSE 'body' END AS body FROM f
  WHERE NOT regexp_matches(path, '^src/src1') AND NOT (fqn = 'src/src3/d4.rs::S' OR starts_with(fqn, 'src/src3/d4.rs::S::'))""")
def policy_filter(spark, d):
    p = _paths(spark, d).withColumn("fqn", F.concat("path", F.lit("::S::m"), F.col("doc_id").cast("string"))).withColumn("body", F.lit("body"))
    return P.apply_policy(p, "path", "fqn", "body", POLICY).select("doc_id", "path", "redacted", "body")


@query("budget_prefix", "WITH c AS (SELECT source, doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS cost FROM documents), r AS (SELECT *, sum(cost) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM c) SELECT source, doc_id, cost, CAST(running AS BIGINT) AS running FROM r WHERE running <= 4000")
def budget_prefix(spark, d):
    c = t(spark, d, "documents").select("source", "doc_id", X.token_estimate(F.col("text")).alias("cost"))
    return BR.within_budget(c, "cost", 4000, "doc_id", keys=["source"]).select("source", "doc_id", "cost", "running")


@query("context_brief", """WITH c AS (SELECT doc_id, lang, n_chars AS rank, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE lang IN ('en', 'fr', 'de') AND text <> ''),
  s AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS place, CASE lang WHEN 'en' THEN 'pivots' WHEN 'fr' THEN 'skeletons' ELSE 'memory' END AS section, doc_id AS ident, rank, tokens,
    sum(tokens) OVER (PARTITION BY lang ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM c)
  SELECT place, section, ident, rank, tokens FROM s WHERE running <= CASE place WHEN 0 THEN 2800 WHEN 1 THEN 800 ELSE 400 END""")
def context_brief(spark, d):
    docs = t(spark, d, "documents").select("lang", F.col("doc_id").alias("ident"), F.col("n_chars").alias("rank"), F.col("text").alias("line"))
    return BR.brief({"pivots": docs.where("lang = 'en'"), "skeletons": docs.where("lang = 'fr'"), "memory": docs.where("lang = 'de'")}, 4000)


@query("greedy_notes")
def greedy_notes(spark, d):
    """A fold that depends on each step, which SQL cannot express plainly; tested against a loop."""
    rows = t(spark, d, "documents").select("source", F.col("doc_id").alias("ident"), X.token_estimate(F.col("text")).alias("cost"), (F.col("n_chars") % 200).alias("note"))
    return BR.greedy_with_notes(rows, "cost", "note", 6000, "source", "ident")


@query("federated_interleave", """WITH m AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS member, doc_id AS ident, n_chars AS score FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY score DESC, ident) AS rn FROM m)
  SELECT member, ident, score, rn FROM r WHERE (member = 0 AND rn <= 12) OR (member <> 0 AND rn <= 20) ORDER BY member <> 0, rn, member LIMIT 20""")
def federated_interleave(spark, d):
    member = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    return BR.interleaved(t(spark, d, "documents").select(member.alias("member"), F.col("doc_id").alias("ident"), F.col("n_chars").alias("score")), 20).select("member", "ident", "score", "rn")


@query("head_tail", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l) SELECT doc_id, pos, md5(line) AS line_md5, greatest(n - 8, 0) AS hidden FROM c WHERE pos <= 5 OR pos > n - 3""")
def head_tail(spark, d):
    cut = BR.head_and_tail(t(spark, d, "documents").select("doc_id", "text"), "text", 5, 3)
    return cut.select("doc_id", "pos", F.md5("line").alias("line_md5"), "hidden")


@query("eval_recall_mrr", _POOL_SQL + """k AS (SELECT doc_id, row_number() OVER (ORDER BY raw, doc_id) AS rank FROM r), x AS (SELECT doc_id % 10 AS tag, doc_id FROM labels WHERE quality = 1),
  h AS (SELECT tag, avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0 END) AS recall, coalesce(max(1.0 / rank), 0) AS rr FROM x LEFT JOIN k USING (doc_id) GROUP BY tag) SELECT count(*) AS cases, round(avg(recall), 6) AS recall_at_k, round(avg(rr), 6) AS mrr FROM h""")
def eval_recall_mrr(spark, d):
    """Every good label is expected, in ten cases by its id."""
    pool = S.top_by(S.bm25(t(spark, d, "documents"), {"text": 1.0}, QUERY, ["doc_id"]), "score", "doc_id", 100)
    ranked = pool.withColumn("rank", F.row_number().over(Window.orderBy("score", "doc_id")))
    expected = t(spark, d, "labels").where("quality = 1").select((F.col("doc_id") % 10).alias("tag"), "doc_id")
    return S.retrieval_quality(ranked.join(expected, "doc_id").select("tag", "doc_id", "rank"), expected, "tag", "doc_id", 20)


@query("relevance_with_text", """WITH q AS (SELECT obs_id, session_id, created_at, kind, content, confidence, importance, is_stale FROM obs WHERE consolidated_into IS NULL AND kind <> 'context_retrieval' AND file_path IN ('src/f3.rs', 'src/f7.rs') ORDER BY created_at DESC, obs_id DESC LIMIT 50),
  n AS (SELECT CAST(count(*) AS DOUBLE) AS big, CAST(count(*) FILTER (WHERE content LIKE 'error %') AS DOUBLE) AS d FROM obs),
  i AS (SELECT CASE WHEN ln((big + 0.5 - d) / (d + 0.5)) <= 0 THEN 0.000001 ELSE ln((big + 0.5 - d) / (d + 0.5)) END AS idf FROM n),
  r AS (SELECT q.*, CASE WHEN content LIKE 'error %' THEN -idf * 2.2 / 2.2 END AS raw, pow(0.5, (greatest(now - created_at, 0) / 86400.0) / CASE importance WHEN 'critical' THEN 365.0 WHEN 'high' THEN 14.0 WHEN 'medium' THEN 7.0 ELSE 3.5 END) AS recency FROM q CROSS JOIN i CROSS JOIN clock),
  v AS (SELECT *, coalesce(CASE WHEN min(raw) OVER () < 0 THEN raw / min(raw) OVER () END, 0) AS text FROM r)
  SELECT obs_id, round(least(greatest(0.35 * text + 0.4 * recency + 0.15 * coalesce(confidence, 0.5) - CASE WHEN is_stale THEN 0.3 ELSE 0 END, 0), 1), 6) AS relevance FROM v""")
def relevance_with_text(spark, d):
    """Observations of two files for a question: BM25 over all observations, as a share of the best here."""
    o = obs(spark, d)
    raw = S.bm25(o, {"content": 1.0}, ["error"], ["obs_id"])
    files = spark.sql("SELECT * FROM VALUES ('src/f3.rs'), ('src/f7.rs') AS t(path)")
    return M.scored_for_context(o, spark.sql("SELECT '' AS fqn WHERE false"), files, F.lit(now_of(spark, d)), raw).select("obs_id", F.round("relevance", 6).alias("relevance"))


@query("project_overlap", """WITH w AS (SELECT obs_id, list_distinct(list_filter(string_split(content || CASE WHEN obs_id % 2 = 0 THEN ' find' ELSE '' END, ' '), lambda x: strlen(x) >= 3)) AS words, symbol_fqn, file_path, kind, consolidated_into FROM obs)
  SELECT obs_id, CAST(len(list_filter(words, lambda x: x IN ('purchase', 'signup', 'find'))) AS INTEGER) AS shared FROM w WHERE symbol_fqn IS NULL AND file_path IS NULL AND kind <> 'context_retrieval' AND len(list_filter(words, lambda x: x IN ('purchase', 'signup', 'find'))) >= 2""")
def project_overlap(spark, d):
    o = obs(spark, d).withColumn("content", F.concat("content", F.when(F.col("obs_id") % 2 == 0, F.lit(" find")).otherwise(F.lit(""))))
    bag = F.transform(S.commonest_tokens(S.content_words(F.col("content")), S.STOP_WORDS), lambda w: w["token"])
    return M.project_overlap(o, bag, ["purchase", "signup", "find"]).select("obs_id", "shared")


@query("embedding_backfill", "SELECT obs_id FROM obs WHERE NOT is_stale AND kind NOT IN ('tool_call', 'file_change', 'context_retrieval') AND consolidated_into IS NULL AND obs_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def embedding_backfill(spark, d):
    """Observations worth a vector that have none of this model and revision."""
    model = E.ByteHashEmbedder()
    stored = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(model.model_id).alias("model_id"), F.when(F.col("label") % 2 == 0, model.model_rev).otherwise("0").alias("model_rev"), "embedding")
    return E.unembedded_observations(obs(spark, d), stored, model).select("obs_id")


@query("semantic_scores", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round((list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) + 1) / 2, 6) AS score FROM embeddings CROSS JOIN q WHERE vec_id IN (SELECT doc_id FROM labels)")
def semantic_scores(spark, d):
    """Cosines of stored vectors of some ids, as scores from 0 to 1."""
    e = t(spark, d, "embeddings")
    own = e.join(t(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = S.cosine_to(own.select("vec_id", "embedding"), "embedding", e.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return near.select("vec_id", F.round((F.col("similarity") + 1) / 2, 6).alias("score"))
