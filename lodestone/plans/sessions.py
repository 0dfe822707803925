"""Catalogue: session memory, mining, maintenance and activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import logs as L
from lodestone.operators import memory as M
from lodestone.operators import mining as MI
from lodestone.operators import staleness as SA
from lodestone.operators import structure as ST
from lodestone.operators.prefix import percentiles
from lodestone.operators.structure import capped, first_by
from lodestone.plans.structures import CHANGES_SQL, part_snapshots, snapshots_sql
from lodestone.plans.views import ORDER, PART, edges, events, now_of, obs, query, sessions, t

LIVE = "consolidated_into IS NULL AND kind <> 'context_retrieval'"


@query("live_observations", f"SELECT obs_id, session_id, kind, created_at FROM obs WHERE {LIVE} AND (branch = 'main' OR branch IS NULL) ORDER BY created_at DESC, obs_id DESC LIMIT 800")
def live_observations(spark, d):
    return M.observations(obs(spark, d), branch="main").select("obs_id", "session_id", "kind", "created_at")


@query("project_scoped", f"SELECT obs_id, session_id, kind FROM obs WHERE {LIVE} AND symbol_fqn IS NULL AND file_path IS NULL ORDER BY created_at DESC, obs_id DESC LIMIT 800")
def project_scoped(spark, d):
    return M.observations(obs(spark, d), scope="project").select("obs_id", "session_id", "kind")


@query("branch_visible", f"SELECT coalesce(branch, '-') AS branch, count(*) AS n FROM obs WHERE {LIVE} AND (branch = 'dev' OR branch IS NULL) GROUP BY branch")
def branch_visible(spark, d):
    return obs(spark, d).where(M.is_live() & M.visible_on("dev")).groupBy("branch").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("branch", F.lit("-")).alias("branch"), "n")


@query("context_observations", f"SELECT obs_id FROM obs WHERE {LIVE} AND (symbol_fqn IN ('src/f1.rs::s1', 'src/f7.rs::s7') OR file_path IN ('src/f3.rs')) ORDER BY created_at DESC, obs_id DESC LIMIT 50")
def context_observations(spark, d):
    fqns = spark.sql("SELECT * FROM VALUES ('src/f1.rs::s1'), ('src/f7.rs::s7') AS t(fqn)")
    return M.for_context(obs(spark, d), fqns, spark.sql("SELECT 'src/f3.rs' AS path")).select("obs_id")


_SCORED = """r AS (SELECT o.*, pow(0.5, (greatest(now - created_at, 0) / 86400.0) / CASE importance WHEN 'critical' THEN 365.0 WHEN 'high' THEN 14.0 WHEN 'medium' THEN 7.0 ELSE 3.5 END) AS recency FROM obs o CROSS JOIN clock),
  v AS (SELECT *, 0.4 * recency AS a, 0.15 * coalesce(confidence, 0.5) AS b FROM r),
  s AS (SELECT *, least(greatest(a + b - CASE WHEN is_stale THEN 0.3 ELSE 0 END, 0), 1) AS relevance, CASE WHEN is_stale THEN 'stale' WHEN b >= a THEN 'confidence' ELSE 'recency' END AS signal FROM v)"""


@query("composite_score", f"WITH {_SCORED} SELECT obs_id, round(relevance, 6) AS relevance, signal FROM s WHERE {LIVE}")
def composite_score(spark, d):
    return M.scored(obs(spark, d).where(M.is_live()), F.lit(now_of(spark, d))).select("obs_id", F.round("relevance", 6).alias("relevance"), "signal")


@query("history_relevance_top200", f"WITH {_SCORED} SELECT obs_id, round(relevance, 6) AS relevance, is_stale FROM s WHERE {LIVE} ORDER BY round(relevance, 9) DESC, is_stale, created_at DESC, obs_id DESC LIMIT 200")
def history_relevance_top200(spark, d):
    return M.by_relevance(M.scored(obs(spark, d).where(M.is_live()), F.lit(now_of(spark, d)))).select("obs_id", F.round("relevance", 6).alias("relevance"), "is_stale")


@query("confidence_window", """WITH f AS (SELECT *, CAST(auto_generated AND kind = 'tool_call' AS BIGINT) AS tc, CAST(auto_generated AND kind = 'file_change' AS BIGINT) AS fc FROM obs),
  w AS (SELECT *, sum(tc) OVER (PARTITION BY session_id ORDER BY created_at RANGE BETWEEN 7200 PRECEDING AND 7200 FOLLOWING) - tc AS nt, sum(fc) OVER (PARTITION BY session_id ORDER BY created_at RANGE BETWEEN 7200 PRECEDING AND 7200 FOLLOWING) - fc AS nf FROM f)
  SELECT obs_id, round(CASE WHEN auto_generated THEN 0.5 + CASE WHEN nt > 0 THEN 0.2 ELSE 0 END + CASE WHEN nf > 0 THEN 0.1 ELSE 0 END ELSE confidence END, 6) AS confidence FROM w""")
def confidence_window(spark, d):
    return M.correlated_confidence(obs(spark, d), 7200).select("obs_id", F.round("confidence", 6).alias("confidence"))


_S = "kind <> 'context_retrieval'"
_HEALTH = f"""h AS (SELECT count(*) FILTER (WHERE {_S}) AS total, count(*) FILTER (WHERE {_S} AND is_stale) AS stale, count(*) FILTER (WHERE NOT {_S}) AS retrievals, count(*) FILTER (WHERE kind IN ('tool_call', 'file_change', 'context_retrieval')) AS noise,
  count(*) FILTER (WHERE {_S} AND importance = 'critical') AS critical, count(*) FILTER (WHERE {_S} AND importance = 'high') AS high, count(*) FILTER (WHERE {_S} AND importance = 'medium') AS medium, count(*) FILTER (WHERE {_S} AND importance = 'low') AS low,
  count(*) FILTER (WHERE {_S} AND symbol_fqn IS NOT NULL AND file_path IS NULL) AS symbol_only, count(*) FILTER (WHERE {_S} AND symbol_fqn IS NULL AND file_path IS NOT NULL) AS file_only, count(*) FILTER (WHERE {_S} AND symbol_fqn IS NOT NULL AND file_path IS NOT NULL) AS both_anchors, count(*) FILTER (WHERE {_S} AND symbol_fqn IS NULL AND file_path IS NULL) AS project_scoped,
  CAST(floor((max(now) - min(created_at) FILTER (WHERE {_S})) / 86400) AS BIGINT) AS oldest_days, CAST(floor((max(now) - min(created_at) FILTER (WHERE {_S} AND NOT is_stale)) / 86400) AS BIGINT) AS oldest_fresh_days,
  count(*) FILTER (WHERE {_S} AND created_at >= now - 7 * 86400) > 0 AS recent, count(*) FILTER (WHERE kind IN ('insight', 'decision') AND created_at >= now - 7 * 86400) AS recent_insights FROM obs CROSS JOIN clock WHERE consolidated_into IS NULL)"""


@query("memory_health", f"WITH {_HEALTH} SELECT * FROM h")
def memory_health(spark, d):
    return M.health(obs(spark, d), F.lit(now_of(spark, d)))


_RULES = "ru AS (SELECT p_partkey AS rule_id, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS is_active, CASE WHEN p_partkey % 2 = 0 THEN 'main' END AS branch FROM part)"


def _rules(spark, d):
    k = F.col("p_partkey")
    state = F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(-1)
    return t(spark, d, "part").select(k.alias("rule_id"), state.alias("is_active"), F.when(k % 2 == 0, "main").alias("branch"), F.lit(None).cast("string").alias("stale_reason"), F.lit(0).cast("long").alias("updated_at"))


@query("rule_states", f"WITH {_RULES} SELECT count(*) FILTER (WHERE is_active = 1) AS rules_active, count(*) FILTER (WHERE is_active = 0) AS rules_pending, count(*) FILTER (WHERE is_active = -1) AS rules_stale FROM ru")
def rule_states(spark, d):
    return M.rule_states(_rules(spark, d))


@query("recommendations", f"""WITH {_HEALTH}, {_RULES}, x AS (SELECT *, stale / CAST(total AS DOUBLE) AS s, low / CAST(total AS DOUBLE) AS l, noise / CAST(total AS DOUBLE) AS n, (SELECT count(*) FROM ru WHERE is_active = -1) AS rs FROM h)
  SELECT total, stale, noise, concat_ws('; ', CASE WHEN s > 0.5 THEN CAST(round_even(s * 100, 0) AS INTEGER) || '% of observations are stale — consider reviewing outdated entries' END, CASE WHEN l > 0.7 THEN 'Over 70% of observations are low-importance — retention may need tuning' END,
    CASE WHEN n > 0.6 THEN 'Over 60% of observations are compression-eligible (tool_call, file_change, context_retrieval) — compression may be overdue' END, CASE WHEN recent AND recent_insights = 0 THEN 'No insights or decisions recorded in 7 days despite recent activity' END, CASE WHEN rs > 0 THEN rs || ' stale rule(s) detected — linked symbols may have changed' END) AS advice FROM x""")
def recommendations(spark, d):
    row = memory_health(spark, d).crossJoin(F.broadcast(rule_states(spark, d)))
    return M.recommendations(row).select("total", "stale", "noise", F.array_join("advice", "; ").alias("advice"))


@query("kind_counts", f"SELECT kind, importance, count(*) AS n FROM obs WHERE {LIVE} GROUP BY kind, importance")
def kind_counts(spark, d):
    return obs(spark, d).where(M.is_live()).groupBy("kind", "importance").agg(F.count(F.lit(1)).alias("n"))


@query("session_listing", f"WITH c AS (SELECT session_id, count(*) AS n FROM obs WHERE {LIVE} GROUP BY session_id) SELECT s.session_id, started_at, ended_at, coalesce(n, 0) AS n_obs FROM sess s LEFT JOIN c ON c.session_id = s.session_id ORDER BY started_at DESC, s.session_id DESC LIMIT 20")
def session_listing(spark, d):
    return M.session_listing(sessions(spark, d), obs(spark, d))


@query("recent_sessions", f"SELECT session_id, started_at FROM sess WHERE session_id IN (SELECT session_id FROM obs WHERE {LIVE} AND (branch = 'main' OR branch IS NULL)) ORDER BY started_at DESC, session_id DESC LIMIT 5")
def recent_sessions(spark, d):
    return M.recent_sessions(sessions(spark, d), obs(spark, d), "main").select("session_id", "started_at")


@query("session_totals", "SELECT count(*) AS total, count(*) FILTER (WHERE compressed) AS compressed, count(*) FILTER (WHERE ended_at IS NULL) AS open FROM sess")
def session_totals(spark, d):
    return sessions(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if("compressed").alias("compressed"), F.count_if(F.col("ended_at").isNull()).alias("open"))


@query("compress_sessions", "SELECT o.obs_id FROM obs o CROSS JOIN clock LEFT JOIN sess s ON s.session_id = o.session_id AND s.ended_at IS NOT NULL AND s.ended_at < now - 43200 AND NOT s.compressed WHERE s.session_id IS NULL OR kind NOT IN ('tool_call', 'file_change', 'context_retrieval') OR importance IN ('critical', 'high')")
def compress_sessions(spark, d):
    return M.compressed_observations(obs(spark, d), sessions(spark, d), F.lit(now_of(spark, d)), 43200).select("obs_id")


@query("purge_sessions", "SELECT session_id FROM sess CROSS JOIN clock WHERE ended_at IS NOT NULL AND ended_at < now - 7200 AND session_id NOT IN (SELECT session_id FROM obs WHERE importance = 'high' AND k = 7)")
def purge_sessions(spark, d):
    marked = obs(spark, d).withColumn("importance", F.when((F.col("importance") == "high") & (F.col("content") == "purchase 7"), "critical").otherwise(F.col("importance")))
    return M.purgeable_sessions(sessions(spark, d), marked, F.lit(now_of(spark, d)), 7200).select("session_id")


#: Sessions of a user and two hours, so that some are unproductive.
_SHORT = "so AS (SELECT *, session_id * 100000 + created_at // 7200 % 100000 AS sid, CASE WHEN kind = 'context_retrieval' THEN 'view' ELSE content END AS c FROM obs)"


def _short_sessions(spark, d):
    sid = F.col("session_id") * 100000 + F.expr("created_at div 7200") % 100000
    return obs(spark, d).withColumn("session_id", sid).withColumn("content", F.when(F.col("kind") == "context_retrieval", "view").otherwise(F.col("content")))


_DEAD = f"{_SHORT}, de AS (SELECT sid AS session_id, c AS content, count(*) AS n FROM so WHERE kind = 'context_retrieval' AND auto_generated AND sid NOT IN (SELECT sid FROM so WHERE kind IN ('insight', 'decision', 'file_change')) GROUP BY ALL HAVING count(*) >= 2)"


@query("dead_ends", f"WITH {_DEAD} SELECT * FROM de")
def dead_ends(spark, d):
    return M.dead_ends(_short_sessions(spark, d))


@query("anti_patterns", f"""WITH {_DEAD}, th AS (SELECT sid, file_path, created_at // 300 AS b, count(*) AS n FROM so WHERE kind = 'file_change' AND auto_generated AND file_path IS NOT NULL GROUP BY ALL HAVING count(*) >= 4)
  SELECT session_id, CAST(NULL AS VARCHAR) AS file_path, 'Dead-end exploration: same context retrieved multiple times without producing insight, decision, or file changes. Repeated: ' || string_agg(content || ' (×' || n || ')', ', ' ORDER BY content) AS content, 'medium' AS importance FROM de GROUP BY session_id
  UNION ALL SELECT sid, file_path, 'File thrashing detected: ' || file_path || ' modified ' || max(n) || ' times in 5 minutes', 'medium' FROM th GROUP BY sid, file_path""")
def anti_patterns(spark, d):
    o = _short_sessions(spark, d)
    return M.anti_patterns(o, o.select("session_id").distinct(), F.lit(now_of(spark, d))).select("session_id", "file_path", "content", "importance")


@query("session_end", f"""WITH {_DEAD}, op AS (SELECT DISTINCT sid FROM so WHERE sid % 2 = 0), k AS (SELECT kind FROM so WHERE sid % 2 <> 0 OR kind NOT IN ('tool_call', 'file_change', 'context_retrieval') OR importance IN ('critical', 'high')
    UNION ALL SELECT 'anti_pattern' FROM (SELECT DISTINCT session_id FROM de WHERE session_id % 2 = 0)
    UNION ALL SELECT 'anti_pattern' FROM (SELECT DISTINCT sid, file_path FROM (SELECT sid, file_path, created_at // 300 AS b FROM so WHERE sid % 2 = 0 AND kind = 'file_change' AND auto_generated AND file_path IS NOT NULL GROUP BY ALL HAVING count(*) >= 4)))
  SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def session_end(spark, d):
    """Observations by kind once every second session is over: anti-patterns written, ephemeral ones gone."""
    o = _short_sessions(spark, d)
    every = o.groupBy("session_id").agg(F.min("created_at").alias("started_at"), F.lit(None).cast("long").alias("ended_at")).withColumn("compressed", F.lit(False))
    kept, _ = M.session_end(o, every, every.where("session_id % 2 = 0"), F.lit(now_of(spark, d)))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_BUCKETS = "b AS (SELECT session_id, file_path, created_at // 86400 AS bucket, count(*) AS n FROM obs WHERE kind = 'file_change' AND auto_generated AND file_path IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"


@query("file_thrashing", f"WITH {_BUCKETS} SELECT session_id, file_path, max(n) AS n FROM b GROUP BY session_id, file_path")
def file_thrashing(spark, d):
    return M.file_bursts(obs(spark, d), 86400, 2)


@query("struggle", f"WITH {_BUCKETS} SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY bucket DESC, n DESC, file_path) = 1")
def struggle(spark, d):
    return M.struggle(obs(spark, d), 86400, 2)


@query("recent_files", "WITH l AS (SELECT session_id, file_path, max(created_at) AS last_at FROM obs WHERE kind = 'file_change' AND file_path IS NOT NULL GROUP BY session_id, file_path) SELECT session_id, file_path, last_at, row_number() OVER (PARTITION BY session_id ORDER BY last_at DESC, file_path) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY last_at DESC, file_path) <= 5")
def recent_files(spark, d):
    return M.recent_files(obs(spark, d))


#: Files of an edge's ends as ``obs`` names them: a part is a symbol of one of twenty files, an order is a file of its own.
_DEPENDENTS = f"l AS (SELECT DISTINCT 'src/f' || ((target - {PART}) % 20) || '.rs' AS file_path, 'src/o' || (source - {ORDER}) || '.rs' AS dependent FROM edges WHERE kind = 'uses_type')"
_RADIUS = f"""{_DEPENDENTS}, p AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS n, row_number() OVER (PARTITION BY file_path ORDER BY dependent) AS place FROM l), d AS (SELECT file_path, n, string_agg(dependent, ', ' ORDER BY dependent) AS shown FROM p WHERE place <= 3 AND n >= 3 GROUP BY file_path, n),
  r AS (SELECT session_id, file_path, row_number() OVER (PARTITION BY session_id ORDER BY max(created_at) DESC, file_path) AS rank FROM obs WHERE kind = 'file_change' AND auto_generated AND file_path IS NOT NULL GROUP BY session_id, file_path),
  br AS (SELECT session_id, r.file_path, n, shown FROM r JOIN d ON d.file_path = r.file_path WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rank) = 1)"""


@query("blast_radius", f"WITH {_RADIUS} SELECT * FROM br")
def blast_radius(spark, d):
    """Of a session's latest files the first that at least three others depend on, and the first three of those."""
    file = lambda name, key: F.concat(F.lit(f"src/{name}"), key.cast("string"), F.lit(".rs"))
    links = edges(spark, d).where("kind = 'uses_type'").select(file("f", (F.col("target") - F.lit(PART)) % 20).alias("file_path"), file("o", F.col("source") - F.lit(ORDER)).alias("dependent"))
    return M.blast_radius(M.recent_files(obs(spark, d)), links)


#: A command for each event, in seven forms; the first two and the last search the whole tree.
_COMMAND = "CASE event_id % 7 WHEN 0 THEN 'grep -rn needle' || k || ' .' WHEN 1 THEN 'rg some_pattern' || k WHEN 2 THEN 'rg thing' || k || ' src/dir' WHEN 3 THEN 'cargo build | grep -r x' || k WHEN 4 THEN 'rg --files thing' || k WHEN 5 THEN 'rg thing' || k || ' main.rs' ELSE 'grep needle' || k || ' src/a.rs | sort -r' END"


def _commands(spark, d):
    m, k = F.col("event_id") % 7, F.col("k").cast("string")
    c = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    forms = [c("grep -rn needle", k, " ."), c("rg some_pattern", k), c("rg thing", k, " src/dir"), c("cargo build | grep -r x", k), c("rg --files thing", k), c("rg thing", k, " main.rs"), c("grep needle", k, " src/a.rs | sort -r")]
    out = F.when(m == 0, forms[0])
    for j, form in enumerate(forms[1:], 1):
        out = out.when(m == j, form)
    return events(spark, d).select("event_id", F.col("user_id").alias("session_id"), out.alias("command"))


_BROAD = f"c AS (SELECT event_id, user_id AS session_id, {_COMMAND} AS command FROM ev), cr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS r, event_id % 7 IN (0, 1, 6) AS broad FROM c), bs AS (SELECT session_id, count(*) FILTER (WHERE broad) AS hits FROM cr WHERE r <= 10 GROUP BY session_id HAVING count(*) FILTER (WHERE broad) >= 3)"


@query("broad_search", f"WITH {_BROAD} SELECT * FROM bs")
def broad_search(spark, d):
    last = capped(_commands(spark, d), ["session_id"], 10, F.col("event_id").desc())
    return last.where(L.is_broad_search(F.col("command"))).groupBy("session_id").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 3")


@query("command_classes", f"SELECT event_id, {_COMMAND} AS command, event_id % 7 IN (0, 1, 6) AS broad FROM ev")
def command_classes(spark, d):
    return _commands(spark, d).select("event_id", "command", L.is_broad_search(F.col("command")).alias("broad"))


@query("nudges", f"""WITH {_BROAD}, {_RADIUS}, {_BUCKETS}, st AS (SELECT session_id, file_path FROM b QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY bucket DESC, n DESC, file_path) = 1),
  op AS (SELECT session_id FROM sess WHERE session_id % 5 <> 0 AND session_id NOT IN (SELECT session_id FROM obs WHERE kind IN ('insight', 'decision', 'error') AND k < 10)),
  j AS (SELECT op.session_id, hits, br.file_path AS f, br.n AS n, shown, st.file_path AS s FROM op LEFT JOIN bs ON bs.session_id = op.session_id AND op.session_id % 2 = 0 LEFT JOIN br ON br.session_id = op.session_id AND op.session_id % 3 = 0 LEFT JOIN st ON st.session_id = op.session_id)
  SELECT session_id, CASE WHEN hits IS NOT NULL THEN 'search' WHEN f IS NOT NULL THEN 'blast_radius' ELSE 'struggle' END AS nudge,
    CASE WHEN hits IS NOT NULL THEN 'repo-wide search used ' || hits || ' times' WHEN f IS NOT NULL THEN '`' || f || '` has ' || n || ' downstream dependents. Verify: ' || shown ELSE 'Multiple edits to `' || s || '` in the last 5 minutes without saving an insight' END AS text
  FROM j WHERE coalesce(CAST(hits AS VARCHAR), f, s) IS NOT NULL""")
def nudges(spark, d):
    """One nudge a session by priority; a fifth were nudged before, and few observations count as valuable here."""
    every = sessions(spark, d).withColumn("nudge_sent", F.col("session_id") % 5 == 0)
    o = obs(spark, d).withColumn("k", F.split("content", " ")[1].cast("int"))
    return M.nudges(every, o.where("k < 10"), broad_search(spark, d).where("session_id % 2 = 0"), blast_radius(spark, d).where("session_id % 3 = 0"), M.struggle(obs(spark, d), 86400, 2).select("session_id", "file_path"))


@query("activity_tail", "SELECT event_id, event_type FROM ev WHERE event_id > 100 AND is_error ORDER BY event_id LIMIT 50")
def activity_tail(spark, d):
    return L.events_after(events(spark, d), 100, 50, errors_only=True).select("event_id", "event_type")


@query("activity_last", "SELECT event_id, event_type FROM (SELECT * FROM ev ORDER BY event_id DESC LIMIT 25)")
def activity_last(spark, d):
    return L.tail(events(spark, d), 25).select("event_id", "event_type")


@query("activity_retention", "SELECT event_id FROM ev CROSS JOIN clock WHERE created_at >= now - 86400")
def activity_retention(spark, d):
    return L.retained(events(spark, d), F.lit(now_of(spark, d)), 86400).select("event_id")


@query("relative_age", "SELECT event_id, CASE WHEN s < 60 THEN s || ' seconds ago' WHEN s < 3600 THEN (s // 60) || ' minutes ago' WHEN s < 86400 THEN (s // 3600) || ' hours ago' ELSE (s // 86400) || ' days ago' END AS age FROM (SELECT event_id, now - created_at AS s FROM ev CROSS JOIN clock)")
def relative_age(spark, d):
    return events(spark, d).select("event_id", X.relative_age(F.lit(now_of(spark, d)) - F.col("created_at")).alias("age"))


@query("clock_texts", "SELECT event_id, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M UTC') AS minute, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%H:%M:%S') AS clock, CASE WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS label FROM (SELECT event_id, created_at, now - created_at AS s FROM ev CROSS JOIN clock)")
def clock_texts(spark, d):
    at = F.col("created_at")
    return events(spark, d).select("event_id", X.utc_minute(at).alias("minute"), X.clock_time(at).alias("clock"), X.age_label(F.lit(now_of(spark, d)) - at).alias("label"))


@query("hook_events", """SELECT event_id, user_id AS session_id, CASE event_type WHEN 'click' THEN 'tool_call' ELSE 'file_change' END AS kind, CASE WHEN event_type <> 'click' THEN 'src/f' || k || '.rs' END AS file_path,
  CASE event_type WHEN 'error' THEN 'Edited src/f' || k || '.rs: replaced ' || strlen('old' || k) || ' chars' WHEN 'signup' THEN 'Wrote src/f' || k || '.rs: ' || strlen('né' || k) || ' bytes' ELSE 'Ran command: ' || left('make test-' || k || repeat('x', 200), 120) END AS content FROM ev WHERE event_type IN ('error', 'click', 'signup')""")
def hook_events(spark, d):
    e, k = events(spark, d), F.col("k").cast("string")
    tool = F.when(F.col("event_type") == "error", "Edit").when(F.col("event_type") == "click", "Bash").when(F.col("event_type") == "signup", "Write").otherwise("Read")
    path = F.concat(F.lit("/w/src/f"), k, F.lit(".rs")).alias("file_path")
    arg = F.when(F.col("event_type") == "error", F.to_json(F.struct(path, F.concat(F.lit("old"), k).alias("old_string")))).when(F.col("event_type") == "signup", F.to_json(F.struct(path, F.concat(F.lit("né"), k).alias("content")))).otherwise(F.to_json(F.struct(F.concat(F.lit("make test-"), k, F.repeat(F.lit("x"), 200)).alias("command"))))
    lines = e.select(F.to_json(F.struct(F.concat(F.col("event_id").cast("string"), F.lit("/"), F.col("user_id").cast("string")).alias("session_id"), F.lit("/w").alias("cwd"), tool.alias("tool_name"), arg.alias("tool_input"))).alias("value"))
    found = L.hook_observations(L.parsed_hooks(lines))
    return found.select(F.split("session_id", "/")[0].cast("long").alias("event_id"), F.split("session_id", "/")[1].cast("long").alias("session_id"), "kind", "file_path", "content")


@query("tool_summaries", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'get_brief(intent=look at ' || k || ', budget=' || (k + 100) || ')' WHEN event_type = 'view' THEN 'get_file_skeleton(file=' || CASE WHEN k % 2 = 0 THEN '<redacted>' ELSE 'src/f' || k || '.rs' END || ')' WHEN event_type = 'purchase' THEN 'save_observation(kind=insight)' WHEN event_type = 'signup' THEN 'index_status' ELSE 'analyze_failure(<trace>)' END || CASE WHEN event_type <> 'error' THEN ' → ' || k || ' chars' ELSE '' END AS summary FROM ev""")
def tool_summaries(spark, d):
    k, kind = F.col("k").cast("string"), F.col("event_type")
    tool = F.when(kind == "click", "get_brief").when(kind == "view", "get_file_skeleton").when(kind == "purchase", "save_observation").when(kind == "signup", "index_status").otherwise("analyze_failure")
    file = F.when(F.col("k") % 2 == 0, F.concat(F.lit("src/"), k, F.lit("/.env"))).otherwise(F.concat(F.lit("src/f"), k, F.lit(".rs")))
    args = F.when(kind == "click", F.to_json(F.struct(F.concat(F.lit("look at "), k).alias("intent"), (F.col("k") + 100).alias("token_budget")))).when(kind == "view", F.to_json(F.struct(file.alias("file_path")))).when(kind == "purchase", F.lit('{"kind": "insight"}'))
    return events(spark, d).select("event_id", L.tool_summary(tool, args, F.when(kind != "error", F.col("k"))).alias("summary"))


@query("near_duplicates", """WITH c AS (SELECT doc_id, source, token, count(*) AS n FROM (SELECT doc_id, source, unnest(words) AS token FROM dt) GROUP BY ALL),
  b AS (SELECT doc_id, source, token FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) <= 8), z AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id),
  p AS (SELECT x.source, x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM b x JOIN b y ON x.source = y.source AND x.token = y.token AND x.doc_id < y.doc_id GROUP BY ALL)
  SELECT p.source, p.a, p.b, round(i / CAST(u.n + v.n - i AS DOUBLE), 6) AS jaccard FROM p JOIN z u ON u.doc_id = p.a JOIN z v ON v.doc_id = p.b WHERE i / CAST(u.n + v.n - i AS DOUBLE) >= 0.6""")
def near_duplicates(spark, d):
    bags = MI.bags(t(spark, d, "documents"), "source", "doc_id", "text")
    return MI.similar_pairs(bags, "source", "doc_id", "bag", 0.6).select("source", "a", "b", F.round("jaccard", 6).alias("jaccard"))


_CLUSTERS = """WITH RECURSIVE c AS (SELECT doc_id, source, token, count(*) AS n FROM (SELECT doc_id, source, unnest(words) AS token FROM dt) GROUP BY ALL),
  b AS (SELECT doc_id, source, token FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) <= 8), z AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM b x JOIN b y ON x.source = y.source AND x.token = y.token AND x.doc_id <> y.doc_id GROUP BY ALL),
  l AS (SELECT p.a, p.b FROM p JOIN z u ON u.doc_id = p.a JOIN z v ON v.doc_id = p.b WHERE i / CAST(u.n + v.n - i AS DOUBLE) >= 0.6),
  w(node, reach) AS (SELECT DISTINCT a, a FROM l UNION SELECT w.node, l.b FROM w JOIN l ON l.a = w.reach),"""


@query("consolidate", _CLUSTERS + """ g AS (SELECT node AS doc_id, min(reach) AS root FROM w GROUP BY node), m AS (SELECT g.doc_id, root, n_chars AS created_at FROM g JOIN documents USING (doc_id)),
  s AS (SELECT *, first_value(doc_id) OVER (PARTITION BY root ORDER BY created_at DESC, doc_id DESC) AS survivor, count(*) OVER (PARTITION BY root) AS n FROM m)
  SELECT doc_id, survivor, n, CASE WHEN doc_id <> survivor THEN survivor END AS consolidated_into FROM s""")
def consolidate(spark, d):
    docs = t(spark, d, "documents")
    found = MI.clusters(MI.bags(docs, "source", "doc_id", "text"), "source", "doc_id", "bag", 0.6)
    return MI.survivors(docs.select("doc_id", F.lit(None).cast("double").alias("confidence"), F.col("n_chars").alias("created_at")), found, "doc_id")


@query("rule_candidates")
def rule_candidates(spark, d):
    """Several passes over clusters; tested against loops."""
    docs = t(spark, d, "documents").withColumn("session_id", F.col("doc_id") % 7).withColumn("confidence", F.lit(None).cast("double")).withColumn("created_at", F.col("n_chars"))
    bags = MI.bags(docs, "lang", "doc_id", "text").join(docs.select("doc_id", "session_id", "confidence", "created_at"), "doc_id")
    found = MI.clusters(bags, "lang", "doc_id", "bag", 0.4, strict=True)
    return MI.rule_candidates(bags, found, "lang", "doc_id", "bag")


@query("rule_merge", """WITH o0 AS (SELECT 'fp' || (p_partkey // 4) AS fingerprint, CASE WHEN p_partkey % 2 = 0 THEN 'main' ELSE '' END AS branch, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS state, max(p_size) AS os, max(p_size % 6) AS osn FROM part WHERE p_size <= 30 GROUP BY ALL), o AS (SELECT * FROM o0 QUALIFY row_number() OVER (PARTITION BY fingerprint, branch ORDER BY state) = 1),
  c AS (SELECT 'fp' || (p_partkey // 4) AS fingerprint, CASE WHEN p_partkey % 2 = 0 THEN 'main' ELSE '' END AS branch, max(p_size) AS s, max(p_size % 7) AS sn FROM part WHERE p_size > 20 GROUP BY ALL)
  SELECT coalesce(o.fingerprint, c.fingerprint) AS fingerprint, coalesce(o.branch, c.branch) AS branch, coalesce(s, os) AS support, coalesce(sn, osn) AS sessions, CASE WHEN state IS NULL THEN 0 WHEN state = 0 AND sn >= 4 THEN 1 ELSE state END AS is_active FROM o FULL JOIN c ON o.fingerprint = c.fingerprint AND o.branch = c.branch""")
def rule_merge(spark, d):
    """Old rules and candidates from the whole part table, split by size: keys on both sides and on one only."""
    p, fingerprint = t(spark, d, "part"), F.concat(F.lit("fp"), F.expr("p_partkey div 4").cast("string")).alias("fingerprint")
    branch = F.when(F.col("p_partkey") % 2 == 0, "main").alias("branch")
    state = F.when(F.col("p_partkey") % 3 == 0, 0).when(F.col("p_partkey") % 3 == 1, 1).otherwise(-1).alias("is_active")
    old = p.where("p_size <= 30").groupBy(fingerprint, branch, state).agg(F.max("p_size").alias("support"), F.max(F.col("p_size") % 6).alias("sessions"))
    old = first_by(old, ["fingerprint", "branch"], "is_active")
    new = p.where("p_size > 20").groupBy(fingerprint, branch).agg(F.max("p_size").alias("support"), F.max(F.col("p_size") % 7).alias("sessions"))
    return MI.merged_rules(old, new)


@query("rule_counts", "SELECT l_partkey AS rule_id, count(DISTINCT o.obs_id) AS support, count(DISTINCT session_id) AS sessions FROM lineitem JOIN obs o ON o.obs_id = l_orderkey WHERE consolidated_into IS NULL GROUP BY l_partkey")
def rule_counts(spark, d):
    links = t(spark, d, "lineitem").select(F.col("l_partkey").alias("rule_id"), F.col("l_orderkey").alias("observation_id"))
    return MI.rule_counts(links, obs(spark, d))


@query("active_rules", """WITH r AS (SELECT p_partkey AS rule_id, p_size AS support, p_partkey % 9 AS updated_at FROM part WHERE p_partkey % 3 = 1),
  a AS (SELECT l_partkey AS rule_id, count(*) AS m FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP BY l_partkey), b AS (SELECT l_partkey AS rule_id, count(*) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
  SELECT r.rule_id, coalesce(a.m, 0) + coalesce(b.m, 0) AS matches FROM r LEFT JOIN a USING (rule_id) LEFT JOIN b USING (rule_id) WHERE coalesce(a.m, 0) + coalesce(b.m, 0) > 0 ORDER BY matches DESC, support DESC, updated_at DESC, rule_id LIMIT 5""")
def active_rules(spark, d):
    rules = t(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_size").alias("support"), (F.col("p_partkey") % 9).alias("updated_at"), F.when(F.col("p_partkey") % 3 == 1, 1).otherwise(0).alias("is_active"))
    lines = t(spark, d, "lineitem")
    symbols, files = spark.sql("SELECT * FROM VALUES (1L), (2L), (3L) AS t(symbol_fqn)"), spark.sql("SELECT 'R' AS file_path")
    return MI.rules_for_context(rules, lines.select(F.col("l_partkey").alias("rule_id"), F.col("l_suppkey").alias("symbol_fqn")), lines.select(F.col("l_partkey").alias("rule_id"), F.col("l_returnflag").alias("file_path")), symbols, files).select("rule_id", "matches")


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM ev GROUP BY event_type")
def latency_percentiles(spark, d):
    return percentiles(events(spark, d), "event_type", "value", {"p50": 0.5, "p95": 0.95}).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "most")


@query("unembedded_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def unembedded_ids(spark, d):
    done = t(spark, d, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("doc_id"))
    return t(spark, d, "documents").select("doc_id").join(done, "doc_id", "left_anti")


_OF_FILES = snapshots_sql("'src/f' || (p_partkey % 20) || '.rs'", "'s' || p_partkey")
_REASONS = f"""{_OF_FILES}, {CHANGES_SQL}, why AS (SELECT fqn, CASE change WHEN 'signature_changed' THEN 'Signature of symbol ' || chr(39) || split_part(fqn, '::', 2) || chr(39) || ' changed: `' || old_signature || '` → `' || new_signature || '`' WHEN 'removed' THEN 'Symbol no longer exists in index' ELSE 'Symbol renamed to ' || chr(39) || new_fqn || chr(39) END AS reason,
    CASE change WHEN 'signature_changed' THEN 'Linked symbol signature changed' WHEN 'removed' THEN 'Linked symbol removed' ELSE 'Linked symbol renamed' END AS rule_reason FROM ch WHERE change IN ('signature_changed', 'removed', 'renamed'))"""


def _file_changes(spark, d):
    k = F.col("p_partkey")
    return ST.symbol_changes(*part_snapshots(spark, d, F.concat(F.lit("src/f"), (k % 20).cast("string"), F.lit(".rs")), F.concat(F.lit("s"), k.cast("string"))))


@query("staleness_propagation", f"""WITH {_REASONS}, n AS (SELECT obs_id, file_path || '::s' || (k + 20) AS whole, file_path || '::s' || k AS short FROM obs WHERE symbol_fqn IS NULL AND file_path IS NOT NULL AND NOT is_stale),
  m AS (SELECT obs_id, w.fqn AS a, s.fqn AS b FROM n LEFT JOIN why w ON w.fqn = whole LEFT JOIN why s ON s.fqn = short)
  SELECT o.obs_id, is_stale OR why.fqn IS NOT NULL OR coalesce(a, b) IS NOT NULL AS is_stale, CASE WHEN NOT is_stale THEN CASE WHEN why.fqn IS NOT NULL THEN reason WHEN coalesce(a, b) IS NOT NULL THEN 'Referenced symbol ' || chr(39) || coalesce(a, b) || chr(39) || ' structurally changed' || CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN ' (and 1 others)' ELSE '' END END END AS stale_reason
  FROM obs o LEFT JOIN why ON symbol_fqn = why.fqn LEFT JOIN m ON m.obs_id = o.obs_id""")
def staleness_propagation(spark, d):
    """Changes of all parts, on observations of their symbols and on texts that name them in backticks."""
    k = F.split("content", " ")[1].cast("int")
    text = F.concat(F.lit("see `"), F.col("file_path"), F.lit("::s"), (k + 20).cast("string"), F.lit("(a(b))` and `s"), k.cast("string"), F.lit("()` not ``s1``"))
    return SA.propagated(obs(spark, d).withColumn("content", F.coalesce(text, "content")), _file_changes(spark, d)).select("obs_id", "is_stale", "stale_reason")


@query("rule_invalidation", f"""WITH {_RULES}, {_REASONS}, l AS (SELECT p_partkey AS rule_id, 'src/f' || (p_partkey % 20) || '.rs::s' || p_partkey AS fqn FROM part)
  SELECT ru.rule_id, CASE WHEN why.fqn IS NOT NULL AND is_active <> -1 AND branch IS NOT NULL THEN -1 WHEN why.fqn IS NOT NULL AND is_active <> -1 THEN -1 ELSE is_active END AS is_active, CASE WHEN why.fqn IS NOT NULL AND is_active <> -1 THEN rule_reason END AS stale_reason FROM ru JOIN l ON l.rule_id = ru.rule_id LEFT JOIN why ON why.fqn = l.fqn""")
def rule_invalidation(spark, d):
    k = F.col("p_partkey")
    links = t(spark, d, "part").select(k.alias("rule_id"), F.concat(F.lit("src/f"), (k % 20).cast("string"), F.lit(".rs::s"), k.cast("string")).alias("symbol_fqn"))
    return SA.invalidated_rules(_rules(spark, d), links, _file_changes(spark, d), F.lit(now_of(spark, d))).select("rule_id", "is_active", "stale_reason")
