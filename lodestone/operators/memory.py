"""Session memory: visibility, correlation, decay scoring, health, maintenance. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import file_component, half_life, is_sensitive
from lodestone.operators.prefix import numbered

#: Days after which an observation's weight halves, by importance (fixed values).
HALF_LIFE_DAYS = {"critical": 365.0, "high": 14.0, "medium": 7.0, "low": 3.5}

#: Importance of a new observation by kind (fixed values); any other is medium.
IMPORTANCE_OF_KIND = {"decision": "high", "anti_pattern": "medium", "file_change": "low", "tool_call": "low", "context_retrieval": "low"}

#: Score weights without and with vectors (fixed values).
WEIGHTS = {"fts": 0.35, "recency": 0.40, "confidence": 0.15}
WEIGHTS_WITH_VECTORS = {"fts": 0.20, "semantic": 0.25, "recency": 0.35, "confidence": 0.10}
STALE_PENALTY, DEFAULT_CONFIDENCE = 0.30, 0.5

NOISE_KINDS = ["tool_call", "file_change", "context_retrieval"]


def _case(column: Column, values: dict, default) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def default_importance(kind: Column) -> Column:
    return _case(kind, IMPORTANCE_OF_KIND, "medium")


def visible_on(branch: str | None) -> Column:
    """Own branch or none; everything for None."""
    return F.lit(True) if branch is None else (F.col("branch") == branch) | F.col("branch").isNull()


def is_live() -> Column:
    return F.col("consolidated_into").isNull() & (F.col("kind") != "context_retrieval")


def observations(obs: DataFrame, branch: str | None = None, symbol: str | None = None, file: str | None = None, sessions: DataFrame | None = None, scope: str = "all", limit: int = 800) -> DataFrame:
    """Live observations that the filters let through, newest first; sensitive files never."""
    out = obs.where(is_live() & visible_on(branch) & ~is_sensitive(F.coalesce("file_path", F.lit(""))))
    if symbol is not None:
        out = out.where(F.col("symbol_fqn") == symbol)
    if file is not None:
        out = out.where(F.col("file_path") == file)
    if sessions is not None:
        out = out.join(sessions.select("session_id"), "session_id", "left_semi")
    unanchored = F.col("symbol_fqn").isNull() & F.col("file_path").isNull()
    if scope != "all":
        out = out.where(unanchored if scope == "project" else ~unanchored)
    return out.orderBy(F.col("created_at").desc(), F.col("obs_id").desc()).limit(limit)


def for_context(obs: DataFrame, symbols: DataFrame, files: DataFrame, limit: int = 50) -> DataFrame:
    """Live observations anchored to one of the symbols (fqn) or files (path)."""
    by_symbol = obs.join(symbols.select(F.col("fqn").alias("symbol_fqn")), "symbol_fqn", "left_semi").select(*obs.columns)
    by_file = obs.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(*obs.columns)
    return by_symbol.unionByName(by_file).where(is_live()).dropDuplicates(["obs_id"]).orderBy(F.col("created_at").desc(), F.col("obs_id").desc()).limit(limit)


def correlated_confidence(obs: DataFrame, seconds: int = 120, mode: str = "symmetric") -> DataFrame:
    """Confidence from neighbours in time within a session: 0.5, 0.2 more beside an automatic tool call, 0.1 beside a file change.

    ``as_inserted`` sees only the past.
    """
    frame = Window.partitionBy("session_id").orderBy("created_at").rangeBetween(-seconds, seconds if mode == "symmetric" else 0)
    near = lambda kind: F.sum(F.when(F.col("auto_generated") & (F.col("kind") == kind), 1).otherwise(0)).over(frame) - F.when(F.col("auto_generated") & (F.col("kind") == kind), 1).otherwise(0)
    score = 0.5 + F.when(near("tool_call") > 0, 0.2).otherwise(0.0) + F.when(near("file_change") > 0, 0.1).otherwise(0.0)
    return obs.withColumn("confidence", F.when(F.col("auto_generated"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).otherwise(F.col("confidence")))


def scored(obs: DataFrame, now: Column, bm25: Column | None = None, semantic: Column | None = None) -> DataFrame:
    """Adds recency, relevance (0 to 1), the signal that contributes most (the later one on ties) and the weighted parts as ``breakdown``."""
    w = WEIGHTS if semantic is None else WEIGHTS_WITH_VECTORS
    recency = half_life(F.greatest(now - F.col("created_at"), F.lit(0)) / 86400.0, _case(F.col("importance"), HALF_LIFE_DAYS, 7.0))
    values = {"fts": F.coalesce(bm25, F.lit(0.0)) if bm25 is not None else F.lit(0.0), "recency": recency, "confidence": F.coalesce(F.col("confidence"), F.lit(DEFAULT_CONFIDENCE))}
    if semantic is not None:
        values = {"fts": values["fts"], "semantic": F.coalesce(semantic, F.lit(0.0)), "recency": recency, "confidence": values["confidence"]}
    shares = {k: w[k] * v for k, v in values.items()}
    total = sum(shares.values(), F.lit(0.0)) - F.when(F.col("is_stale"), STALE_PENALTY).otherwise(0.0)
    top = F.greatest(*shares.values())
    signal = F.coalesce(*[F.when(v == top, F.lit(k)) for k, v in reversed(shares.items())])
    return obs.withColumn("recency", recency).withColumn("relevance", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))).withColumn("signal", F.when(F.col("is_stale"), F.lit("stale")).otherwise(signal)).withColumn("breakdown", F.struct(*[v.alias(k) for k, v in {"semantic": F.lit(0.0), **shares}.items()], F.when(F.col("is_stale"), -STALE_PENALTY).otherwise(0.0).alias("stale")))


def scored_for_context(obs: DataFrame, symbols: DataFrame, files: DataFrame, now: Column, raw: DataFrame | None = None, similarity: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Observations on symbols or files, scored and the most relevant first.

    ``raw`` has BM25 scores (obs_id, score: lower is better, statistics of the whole corpus), taken as shares
    of the best among these rows; ``similarity`` has cosines (obs_id, similarity) and brings the other weights.
    """
    rows = for_context(obs, symbols, files, limit)
    text = semantic = None
    if raw is not None:
        rows = rows.join(raw.select("obs_id", F.col("score").alias("_raw")), "obs_id", "left")
        best = F.min("_raw").over(Window.partitionBy())
        text = F.when(best < 0, F.coalesce(F.col("_raw") / best, F.lit(0.0))).otherwise(F.lit(0.0))
        rows, text = rows.withColumn("_text", text), F.col("_text")
    if similarity is not None:
        rows = rows.join(similarity.select("obs_id", ((F.col("similarity") + 1) / 2).alias("_semantic")), "obs_id", "left")
        semantic = F.col("_semantic")
    return by_relevance(scored(rows, now, text, semantic), limit)


def by_relevance(rows: DataFrame, n: int = 200) -> DataFrame:
    return rows.orderBy(F.round("relevance", 9).desc(), "is_stale", F.col("created_at").desc(), F.col("obs_id").desc()).limit(n)


def health(obs: DataFrame, now: Column, recent_days: int = 7) -> DataFrame:
    """One row of conditional counts, ages in days and recency over observations that are not consolidated."""
    shown, anchored, filed = F.col("kind") != "context_retrieval", F.col("symbol_fqn").isNotNull(), F.col("file_path").isNotNull()
    since = now - recent_days * 86400
    n = lambda c, name: F.count_if(c).alias(name)
    days = lambda c, name: F.floor((F.max(now) - F.min(F.when(c, F.col("created_at")))) / 86400).cast("long").alias(name)
    return obs.where(F.col("consolidated_into").isNull()).agg(
        n(shown, "total"), n(shown & F.col("is_stale"), "stale"), n(~shown, "retrievals"), n(F.col("kind").isin(NOISE_KINDS), "noise"),
        *[n(shown & (F.col("importance") == level), level) for level in HALF_LIFE_DAYS],
        n(shown & anchored & ~filed, "symbol_only"), n(shown & ~anchored & filed, "file_only"), n(shown & anchored & filed, "both_anchors"), n(shown & ~anchored & ~filed, "project_scoped"),
        days(shown, "oldest_days"), days(shown & ~F.col("is_stale"), "oldest_fresh_days"), (F.count_if(shown & (F.col("created_at") >= since)) > 0).alias("recent"),
        n(F.col("kind").isin("insight", "decision") & (F.col("created_at") >= since), "recent_insights"),
    )


def rule_states(rules: DataFrame) -> DataFrame:
    """Counts of active, pending and stale rules, one row."""
    return rules.agg(*[F.count_if(F.col("is_active") == state).alias(name) for name, state in (("rules_active", 1), ("rules_pending", 0), ("rules_stale", -1))])


#: Advice on a health row by its shares (fixed values).
STALE_SHARE, LOW_SHARE, NOISE_SHARE = 0.50, 0.70, 0.60


def recommendations(health_row: DataFrame, branch: str | None = None) -> DataFrame:
    """Adds ``advice``: sentences on ratios above their thresholds, in fixed order. ``rules_stale`` counts if it is there."""
    some, total = F.col("total") > 0, F.greatest(F.col("total"), F.lit(1))
    share = F.col("stale") / total
    lately = "No insights or decisions recorded in 7 days despite recent activity" + (f" on {branch}" if branch else "")
    stale_rules = F.col("rules_stale") if "rules_stale" in health_row.columns else F.lit(0)
    advice = [
        F.when(some & (share > STALE_SHARE), F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("% of observations are stale — consider reviewing outdated entries"))),
        F.when(some & (F.col("low") / total > LOW_SHARE), F.lit("Over 70% of observations are low-importance — retention may need tuning")),
        F.when(some & (F.col("noise") / total > NOISE_SHARE), F.lit("Over 60% of observations are compression-eligible (tool_call, file_change, context_retrieval) — compression may be overdue")),
        F.when(some & F.col("recent") & (F.col("recent_insights") == 0), F.lit(lately)),
        F.when(stale_rules > 0, F.concat(stale_rules.cast("string"), F.lit(" stale rule(s) detected — linked symbols may have changed"))),
    ]
    return health_row.withColumn("advice", F.array_compact(F.array(*advice)))


def session_listing(sessions: DataFrame, obs: DataFrame, n: int = 20) -> DataFrame:
    """Latest sessions with their count of live observations, zero included."""
    counts = obs.where(is_live()).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_obs"))
    return sessions.join(counts, "session_id", "left").select("session_id", "started_at", "ended_at", F.coalesce("n_obs", F.lit(0)).alias("n_obs")).orderBy(F.col("started_at").desc(), F.col("session_id").desc()).limit(n)


def recent_sessions(sessions: DataFrame, obs: DataFrame, branch: str | None, n: int = 5) -> DataFrame:
    """Latest sessions with at least one live observation visible on the branch."""
    some = obs.where(is_live() & visible_on(branch)).select("session_id")
    return sessions.join(some, "session_id", "left_semi").orderBy(F.col("started_at").desc(), F.col("session_id").desc()).limit(n)


def compressed_observations(obs: DataFrame, sessions: DataFrame, now: Column, idle_seconds: int = 3600) -> DataFrame:
    """Observations left once ephemeral kinds of long-ended, uncompressed sessions are gone; critical and high ones stay."""
    return compressed_sessions(obs, sessions.where(F.col("ended_at").isNotNull() & (F.col("ended_at") < now - idle_seconds) & ~F.col("compressed")))


def purgeable_sessions(sessions: DataFrame, obs: DataFrame, now: Column, age_seconds: int = 90 * 86400) -> DataFrame:
    """Sessions ended long ago without a critical observation."""
    old = sessions.where(F.col("ended_at").isNotNull() & (F.col("ended_at") < now - age_seconds))
    return old.join(obs.where(F.col("importance") == "critical").select("session_id"), "session_id", "left_anti")


def dead_ends(obs: DataFrame, least: int = 2, productive: tuple[str, ...] = ("insight", "decision", "file_change")) -> DataFrame:
    """What an unproductive session looked up again and again: session_id, content, n."""
    repeated = obs.where((F.col("kind") == "context_retrieval") & F.col("auto_generated")).groupBy("session_id", "content").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return repeated.join(obs.where(F.col("kind").isin(*productive)).select("session_id"), "session_id", "left_anti")


def _automatic_changes() -> Column:
    return (F.col("kind") == "file_change") & F.col("auto_generated") & F.col("file_path").isNotNull()


def file_bursts(obs: DataFrame, seconds: int = 300, least: int = 4) -> DataFrame:
    """Changes of a file in one tumbling window of a session, the largest per session and file: session_id, file_path, n."""
    changed = obs.where(_automatic_changes())
    buckets = changed.groupBy("session_id", "file_path", F.expr(f"created_at div {seconds}").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return buckets.groupBy("session_id", "file_path").agg(F.max("n").alias("n"))


def struggle(obs: DataFrame, seconds: int = 300, least: int = 3) -> DataFrame:
    """Per session the file of the latest window with at least ``least`` changes."""
    changed = obs.where(_automatic_changes())
    buckets = changed.groupBy("session_id", "file_path", F.expr(f"created_at div {seconds}").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("session_id").orderBy(F.col("bucket").desc(), F.col("n").desc(), "file_path")
    return buckets.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def recent_files(obs: DataFrame, n: int = 5) -> DataFrame:
    """Per session the latest ``n`` distinct files: session_id, file_path, last_at, rank."""
    last = obs.where(_automatic_changes()).groupBy("session_id", "file_path").agg(F.max("created_at").alias("last_at"))
    order = Window.partitionBy("session_id").orderBy(F.col("last_at").desc(), "file_path")
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def anti_patterns(obs: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Observations of kind anti_pattern that sessions (session_id) give: dead ends of a session, and each thrashed file."""
    own = obs.join(sessions.select("session_id"), "session_id", "left_semi")
    each = dead_ends(own).select("session_id", "content", F.concat("content", F.lit(" (×"), F.col("n").cast("string"), F.lit(")")).alias("part"))
    listed = each.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("content", "part"))), lambda x: x["part"]), ", ").alias("parts"))
    ends = listed.select("session_id", F.lit(None).cast("string").alias("file_path"), F.concat(F.lit("Dead-end exploration: same context retrieved multiple times without producing insight, decision, or file changes. Repeated: "), "parts").alias("content"))
    thrashed = file_bursts(own).select("session_id", "file_path", F.concat(F.lit("File thrashing detected: "), "file_path", F.lit(" modified "), F.col("n").cast("string"), F.lit(" times in 5 minutes")).alias("content"))
    return ends.unionByName(thrashed).select("session_id", now.cast("long").alias("created_at"), F.lit("anti_pattern").alias("kind"), "content", "file_path", F.lit(True).alias("auto_generated"), F.lit("medium").alias("importance"))


def compressed_sessions(obs: DataFrame, over: DataFrame) -> DataFrame:
    """Observations left once ephemeral kinds of the sessions ``over`` are gone; critical and high ones stay."""
    marked = obs.join(over.select("session_id", F.lit(True).alias("_over")), "session_id", "left")
    gone = F.coalesce("_over", F.lit(False)) & F.col("kind").isin(NOISE_KINDS) & ~F.col("importance").isin("critical", "high")
    return marked.where(~gone).select(*obs.columns)


def session_end(obs: DataFrame, sessions: DataFrame, ended: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Next observations and sessions once the sessions ``ended`` (session_id) are over.

    Sessions that are compressed already are left alone, so a second run changes nothing: anti-patterns are
    written, ephemeral observations go, and the sessions are closed and flagged. New rows have ids above the
    largest, in order of session and content.
    """
    open_ones = sessions.where(~F.col("compressed")).join(ended.select("session_id"), "session_id", "left_semi").select("session_id")
    found = anti_patterns(obs, open_ones, now)
    new = numbered(found, ["session_id", "content"], "obs_id", obs.agg(F.coalesce(F.max("obs_id"), F.lit(0)).alias("top")))
    kept = compressed_sessions(obs, open_ones).unionByName(inserted(new, obs, now), allowMissingColumns=True)
    flagged = sessions.join(open_ones.withColumn("_now_over", F.lit(True)), "session_id", "left")
    done = F.coalesce("_now_over", F.lit(False))
    closed = flagged.withColumn("ended_at", F.when(done, F.coalesce("ended_at", now)).otherwise(F.col("ended_at"))).withColumn("compressed", F.col("compressed") | done)
    return kept.select(*obs.columns), closed.select(*sessions.columns)


def inserted(rows: DataFrame, obs: DataFrame, now: Column) -> DataFrame:
    """New observations with every column of ``obs``: defaults for those that ``rows`` lacks."""
    defaults = {"created_at": now, "is_stale": F.lit(False), "auto_generated": F.lit(False), "consolidation_count": F.lit(0), "importance": default_importance(F.col("kind"))}
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in obs.schema])


def upserted_sessions(sessions: DataFrame, started: DataFrame) -> DataFrame:
    """Sessions with those of ``started`` (session_id, started_at, ...) that are not there yet; one there stays as it is."""
    fresh = started.join(sessions.select("session_id"), "session_id", "left_anti").dropDuplicates(["session_id"])
    return sessions.unionByName(fresh.withColumn("compressed", F.lit(False)) if "compressed" not in fresh.columns else fresh, allowMissingColumns=True)


def ended_sessions(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    """Sessions with ``ended_at`` set from ``ended`` (session_id, at) where it is not set."""
    at = ended.groupBy("session_id").agg(F.min("at").alias("_at"))
    return sessions.join(at, "session_id", "left").withColumn("ended_at", F.coalesce("ended_at", "_at")).select(*sessions.columns)


def flagged_compressed(sessions: DataFrame, now: Column, idle_seconds: int = 3600) -> DataFrame:
    """Sessions ended long enough ago, flagged as compressed; flags that are set stay."""
    over = F.col("ended_at").isNotNull() & (F.col("ended_at") < now - idle_seconds)
    return sessions.withColumn("compressed", F.col("compressed") | F.coalesce(over, F.lit(False)))


def for_session(obs: DataFrame, sessions: DataFrame, session_id) -> DataFrame | None:
    """A session's observations in order of time, none on sensitive files; None if there is no such session."""
    if sessions.where(F.col("session_id") == session_id).isEmpty():
        return None
    hidden = is_sensitive(F.coalesce("file_path", F.lit(""))) | is_sensitive(file_component(F.coalesce("symbol_fqn", F.lit(""))))
    return obs.where((F.col("session_id") == session_id) & ~hidden).orderBy("created_at", "obs_id")


def displayed_range(rows: DataFrame) -> DataFrame:
    """Least and largest relevance, stale rows and sessions of displayed rows."""
    return rows.agg(F.count(F.lit(1)).alias("shown"), F.count_if("is_stale").alias("stale"), F.round(F.min("relevance"), 6).alias("least"), F.round(F.max("relevance"), 6).alias("most"), F.countDistinct("session_id").alias("sessions"))


def project_overlap(obs: DataFrame, content: Column, intent_tokens: list[str]) -> DataFrame:
    """Observations without anchors that share enough tokens with a question: two, or one if it has fewer than two. Adds ``shared``."""
    shared = F.size(F.array_intersect(content, F.array(*[F.lit(t) for t in intent_tokens]).cast("array<string>")))
    rows = obs.where(is_live() & F.col("symbol_fqn").isNull() & F.col("file_path").isNull()).withColumn("shared", shared)
    return rows.where(F.col("shared") >= (1 if len(intent_tokens) < 2 else 2))


#: Kinds that end nudging of a session (fixed values).
VALUABLE_KINDS = ["insight", "decision", "error"]


def nudges(sessions: DataFrame, obs: DataFrame, searches: DataFrame, radius: DataFrame, struggles: DataFrame) -> DataFrame:
    """One nudge a session, if it had none and holds nothing valuable: searches, then blast radius, then struggle.

    searches: session_id, hits; radius: session_id, file_path, n, shown; struggles: session_id, file_path.
    """
    open_ones = sessions.where(~F.col("nudge_sent")).join(obs.where(F.col("kind").isin(VALUABLE_KINDS)).select("session_id"), "session_id", "left_anti").select("session_id")
    s = searches.select("session_id", F.concat(F.lit("repo-wide search used "), F.col("hits").cast("string"), F.lit(" times")).alias("by_search"))
    r = radius.select("session_id", F.concat(F.lit("`"), "file_path", F.lit("` has "), F.col("n").cast("string"), F.lit(" downstream dependents. Verify: "), "shown").alias("by_radius"))
    t = struggles.select("session_id", F.concat(F.lit("Multiple edits to `"), "file_path", F.lit("` in the last 5 minutes without saving an insight")).alias("by_struggle"))
    joined = open_ones.join(s, "session_id", "left").join(r, "session_id", "left").join(t, "session_id", "left")
    kind = F.when(F.col("by_search").isNotNull(), "search").when(F.col("by_radius").isNotNull(), "blast_radius").otherwise("struggle")
    return joined.select("session_id", kind.alias("nudge"), F.coalesce("by_search", "by_radius", "by_struggle").alias("text")).where("text is not null")


def nudge_flags(sessions: DataFrame, sent: DataFrame, saved: DataFrame) -> DataFrame:
    """Sessions flagged once a nudge was ``sent`` or something valuable ``saved`` (session_id, kind)."""
    done = sent.select("session_id").unionByName(saved.where(F.col("kind").isin(VALUABLE_KINDS)).select("session_id")).distinct().withColumn("_sent", F.lit(True))
    return sessions.join(done, "session_id", "left").withColumn("nudge_sent", F.col("nudge_sent") | F.coalesce("_sent", F.lit(False))).select(*sessions.columns)


def blast_radius(recent: DataFrame, links: DataFrame, least: int = 3, shown: int = 3) -> DataFrame:
    """Per session the latest file that at least ``least`` others depend on: session_id, file_path, n, shown.

    recent: as ``recent_files``; links: file_path, dependent. Dependents are counted, and only the first
    ``shown`` gathered; sensitive files do not count.
    """
    own = links.where((F.col("file_path") != F.col("dependent")) & ~is_sensitive(F.col("dependent"))).distinct()
    many = own.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy("dependent"))
    first = own.withColumn("_r", rank).where(F.col("_r") <= shown).groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list("dependent")), ", ").alias("shown"))
    found = recent.join(many, "file_path").join(first, "file_path")
    best = F.row_number().over(Window.partitionBy("session_id").orderBy("rank"))
    return found.withColumn("_r", best).where("_r = 1").select("session_id", "file_path", "n", "shown")


def marked_stale(obs: DataFrame, reasons: DataFrame) -> DataFrame:
    """Observations with is_stale and stale_reason set by symbol (fqn, reason, priority); a reason already there stays."""
    best = reasons.groupBy("fqn").agg(F.min_by("reason", F.struct("priority", "reason")).alias("_reason"))
    joined = obs.join(best, F.col("symbol_fqn") == F.col("fqn"), "left")
    hit = ~F.col("is_stale") & F.col("_reason").isNotNull()
    return joined.withColumn("stale_reason", F.when(hit, F.col("_reason"))).withColumn("is_stale", F.col("is_stale") | hit).drop("fqn", "_reason")
