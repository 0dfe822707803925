"""One object over the engine's tables, with the argument bounds of its public calls.

Calls named ``..._rows`` and the pivots return tables; the others render them as text. Writing calls replace
a table of the engine by its next snapshot; the caller stores it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import render as R
from lodestone.functions.text import INTENT_WORDS, intent_profile, is_sensitive, query_terms, relative_age, split_identifier, token_estimate, traversal_policy, utc_minute
from lodestone.operators import brief as BR
from lodestone.operators import embed as E
from lodestone.operators import failure as FA
from lodestone.operators import graph as G
from lodestone.operators import memory as M
from lodestone.operators import mining as MI
from lodestone.operators import policy as P
from lodestone.operators import search as S
from lodestone.operators import structure as ST
from lodestone.sources import tree as T

#: Bounds of arguments (fixed values).
BUDGET, MOST_BUDGET, LEAST_BUDGET, FAILURE_BUDGET = 4000, 1_000_000, 100, 10_000
DEPTH, MOST_DEPTH, SESSIONS, MOST_SESSIONS, PATHS, MOST_PATHS = 3, 10, 5, 50, 5, 20
KINDS = ["insight", "decision", "error", "tool_call", "file_change", "anti_pattern"]
IMPORTANCES = ["critical", "high", "medium", "low"]
COLUMN_WEIGHTS = {"name_tokens": 10.0, "fqn": 5.0, "signature": 2.0, "docstring": 1.0}
IMPACT_KINDS, TRACE_KINDS = ["calls", "extends", "implements", "uses_type"], ["calls", "extends", "implements"]
REDACTED = "[redacted by policy]"


def _clamp(value: int | None, default: int, least: int, most: int) -> int:
    return default if value is None else max(least, min(most, int(value)))


class Engine:
    """Tables by name; missing ones are needed only where used.

    symbols: symbol_id, fqn, path, name, name_tokens, kind, start_line, end_line, signature, docstring,
    centrality, parent_id; edges: source, target, kind by symbol_id; files: path, text, last_indexed_at;
    observations, sessions, rules, rule_symbols, rule_files, symbol_vectors, observation_vectors as operators
    take them. ``members`` are (label, tables) of other repositories, read only.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], policy: dict | None = None, embedder: E.Embedder | None = None, members: list[tuple[str, dict[str, DataFrame]]] | None = None, root: str = "", store: str | None = None):
        self.spark, self.tables, self.policy, self.embedder = spark, dict(tables), policy or {}, embedder
        self.members, self.root, self.store = members or [], root, store

    # symbols

    def _visible(self, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        s = (tables or self.tables)["symbols"]
        return s.where(~P.denied(F.col("path"), F.col("fqn"), self.policy) & ~is_sensitive(F.col("path")))

    def _id(self, fqn: str) -> int:
        row = self._visible().where(F.col("fqn") == fqn).select("symbol_id").first()
        if row is None:
            raise ValueError(f"unknown symbol: {fqn}")
        return row[0]

    def terms(self, text: str) -> list[str]:
        """Terms of a question, at least two bytes each; a name with underscores is the phrase of its parts."""
        row = self.spark.sql("SELECT :t AS t", args={"t": text}).select(query_terms(F.col("t"), 2)).first()
        parts = ["".join(c if c.isalnum() else " " for c in t).split() for t in row[0]]
        return list(dict.fromkeys(" ".join(p) for p in parts if p))

    def profile(self, intent: str):
        """The question's profile and the walk that follows from it, one row."""
        rows = self.spark.sql("SELECT :t AS t", args={"t": intent}).select(*intent_profile(F.col("t")))
        return rows.select("*", *traversal_policy(*[F.col(f"n_{k}") for k in INTENT_WORDS])).first()

    def pivots(self, intent: str, file_hints: list[str] | None = None, limit: int = 5, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """Symbols to begin with: those of hinted files, else by keywords, else the first by id.

        symbol_id, fqn, place, reason, hint, and the ranks of the keyword search.
        """
        tables = tables or self.tables
        visible = self._visible(tables)
        top = visible.where("parent_id IS NULL")
        blank = {"hint": "string", "match_class": "string", "rank_score": "int", "rank_centrality": "int", "rank_similarity": "int", "rrf": "double", "score": "double"}
        shaped = lambda rows: rows.select("symbol_id", "fqn", F.col("place").cast("long").alias("place"), "reason", *[F.col(c).cast(k) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in blank.items()])
        if file_hints:
            each = [top.where(F.contains(F.lower("path"), F.lit(h.lower()))).orderBy(F.col("start_line") - F.col("end_line"), "symbol_id").limit(10).select("symbol_id", "fqn", F.lit(h).alias("hint"), F.lit(k).alias("_h"), (F.col("start_line") - F.col("end_line")).alias("_span")) for k, h in enumerate(file_hints)]
            first = ST.first_by(reduce(DataFrame.unionByName, each), ["symbol_id"], "_h")  # ten a hint at most
            hinted = first.withColumn("place", F.row_number().over(Window.orderBy("_h", "_span", "symbol_id"))).withColumn("reason", F.lit("file hint"))
            if not hinted.isEmpty():
                return shaped(hinted)
        if terms := self.terms(intent):
            ranked = self.ranked(intent, terms, limit, tables)
            if not ranked.isEmpty():
                return shaped(ranked)
        few = visible.orderBy("symbol_id").limit(limit)
        return shaped(few.withColumn("place", F.row_number().over(Window.orderBy("symbol_id"))).withColumn("reason", F.lit("fallback")))

    def ranked(self, intent: str, terms: list[str], limit: int, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """The best symbols for terms by text, centrality and, where half of the pool has one, vectors."""
        tables = tables or self.tables
        scored = S.bm25(tables["symbols"], COLUMN_WEIGHTS, terms, ["symbol_id"])
        top = self._visible(tables).where("parent_id IS NULL").select("symbol_id", "fqn", "name", "centrality")
        pool = S.top_by(scored.join(top, "symbol_id"), "score", "symbol_id", max(20 * limit, 100))
        signals = {"score": ("asc", True), "centrality": ("desc", True)}
        if self.embedder is not None and "symbol_vectors" in tables:
            near = E.similarities(tables["symbol_vectors"], pool.select("symbol_id"), intent, self.embedder, "symbol_id")
            pool, signals = pool.join(near, "symbol_id", "left"), {**signals, "similarity": ("desc", False)}
        fused = S.fused(pool, signals, "symbol_id", coverage={"similarity": 0.5})
        best = fused.orderBy(F.col("rrf").desc(), "symbol_id").limit(limit)
        matched = F.array_min(F.array(*[F.struct(F.when(c == "exact", 0).when(c == "segment", 1).when(c == "substring", 2).otherwise(3).alias("k"), c.alias("c")) for c in (S.match_class(F.col("name"), t) for t in terms)]))["c"]
        return best.withColumn("match_class", matched).withColumn("place", F.row_number().over(Window.orderBy(F.col("rrf").desc(), "symbol_id"))).withColumn("reason", F.lit("keyword"))

    def federated_pivots(self, intent: str, file_hints: list[str] | None = None, limit: int = 5) -> DataFrame:
        """Pivots of all members by turns: member (0 is this one), and columns of ``pivots``."""
        out = self.pivots(intent, file_hints, limit).withColumn("member", F.lit(0))
        for k, (_, tables) in enumerate(self.members, 1):
            out = out.unionByName(self.pivots(intent, file_hints, limit, tables).withColumn("member", F.lit(k)))
        chosen = BR.interleaved(out.select("member", F.col("symbol_id").alias("ident"), (-F.col("place")).alias("score")), limit)
        return out.join(chosen.select("member", F.col("ident").alias("symbol_id"), "rn"), ["member", "symbol_id"]).orderBy(F.col("member") != 0, "rn", "member")

    # briefs

    def _with_dependencies(self, rows: DataFrame, most: int = 10) -> DataFrame:
        """Adds ``deps``: the first targets of each symbol by name and kind."""
        names = self.tables["symbols"].select(F.col("symbol_id").alias("target"), F.col("name").alias("_n"))
        links = self.tables["edges"].join(rows.select(F.col("symbol_id").alias("source")), "source", "left_semi").join(names, "target")
        first = ST.capped(links, ["source"], most, "target", "kind").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("_n", F.lit(" ("), "kind", F.lit(")")).alias("t")))), lambda x: x["t"]), ", ").alias("deps"))
        return rows.join(first.withColumnRenamed("source", "symbol_id"), "symbol_id", "left")

    def _sources(self, rows: DataFrame) -> DataFrame:
        """Adds ``source``: the symbol's lines, its signature where there are none or the policy hides bodies."""
        hidden = P.matches(F.col("path"), F.col("fqn"), self.policy.get("redact", []))
        files = self.tables.get("files")
        body = F.lit(None)
        if files is not None and "text" in files.columns:
            rows = rows.join(files.select("path", F.col("text").alias("_text")), "path", "left")
            body = F.nullif(T.slice_lines(F.col("_text"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), F.lit(""))
        shown = F.when(hidden, F.concat(F.coalesce("signature", F.lit("(signature unavailable)")), F.lit(f"\n  {REDACTED}"))).otherwise(F.coalesce(body, "signature", F.lit("(source unavailable)")))
        return rows.withColumn("source", shown)

    def context_rows(self, pivots: DataFrame, walk, intent: str, budget: int, now: int, branch: str | None = None) -> DataFrame:
        """Entries of a brief within their budgets: section, place, entry, symbol_id. ``walk`` has depth, inbound, inbound_first."""
        symbols = self._visible()
        chosen = self._sources(symbols.join(pivots.select("symbol_id", "place"), "symbol_id"))
        found = G.context_walk(self.tables["edges"], pivots.select(F.col("symbol_id").alias("node")), walk.depth, inbound=walk.inbound, inbound_first=walk.inbound_first)
        near = self._with_dependencies(symbols.join(found.select(F.col("node").alias("symbol_id"), "depth", "direction"), "symbol_id"))
        scope = chosen.select("fqn", "path").unionByName(near.select("fqn", "path"))
        rules = self._rules(scope, branch)
        parts = BR.budgets(budget, rules is not None)
        own = lambda rows, name, cost: BR.first_within(rows.withColumn("tokens", token_estimate(F.col("entry"))), "tokens", cost, "place", "symbol_id").select(F.lit(name).alias("section"), "place", "entry", "symbol_id")
        out = own(chosen.select("place", R.pivot_entry(F.col("source")).alias("entry"), "symbol_id"), "pivots", parts["pivots"])
        why = F.concat(R.text(R.symbol_head(), "\n"), F.lit("Why: "), R.walk_reason(), F.lit("\n"))
        out = out.unionByName(own(near.select((F.col("depth") * 10 + (F.col("direction") == "inbound").cast("int") * (-1 if walk.inbound_first else 1)).cast("long").alias("place"), why.alias("entry"), "symbol_id"), "skeletons", parts["skeletons"]))
        if "observations" in self.tables:
            seen = self.tables["observations"].where(M.visible_on(branch))
            raw = S.bm25(seen, {"content": 1.0}, terms, ["obs_id"]) if (terms := self.terms(intent)) else None
            near_text = E.similarities(self.tables["observation_vectors"], seen.select("obs_id"), intent, self.embedder, "obs_id") if self.embedder is not None and "observation_vectors" in self.tables else None
            scored = M.scored_for_context(self._shown(seen), scope.select("fqn"), scope.select("path"), F.lit(now), raw, near_text)
            ranked = scored.withColumn("place", F.row_number().over(Window.orderBy(F.round("relevance", 9).desc(), "is_stale", F.col("created_at").desc(), F.col("obs_id").desc())).cast("long"))
            out = out.unionByName(own(ranked.select("place", R.memory_entry().alias("entry"), F.col("obs_id").alias("symbol_id")), "memory", parts["memory"]))
            words = [r[0] for r in self.spark.sql("SELECT :t AS t", args={"t": intent}).select(F.explode(S.commonest_tokens(S.content_words(F.col("t")), S.STOP_WORDS))).select("col.token").collect()]
            bag = F.transform(S.commonest_tokens(S.content_words(F.col("content")), S.STOP_WORDS), lambda w: w["token"])
            project = M.project_overlap(seen, bag, words).orderBy(F.col("created_at").desc(), F.col("obs_id").desc()).limit(20)
            project = project.withColumn("place", F.row_number().over(Window.orderBy(F.col("shared").desc(), F.col("created_at").desc(), F.col("obs_id").desc())).cast("long"))
            out = out.unionByName(own(project.select("place", R.project_entry().alias("entry"), F.col("obs_id").alias("symbol_id")), "project", parts["project"]))
        if rules is not None:
            ranked = rules.withColumn("place", F.row_number().over(Window.orderBy(F.col("matches").desc(), F.col("support").desc(), F.col("updated_at").desc(), "rule_id")).cast("long"))
            out = out.unionByName(own(ranked.select("place", R.rule_entry(F.lit(now)).alias("entry"), F.col("rule_id").alias("symbol_id")), "rules", parts["rules"]))
        return out

    def _shown(self, obs: DataFrame) -> DataFrame:
        """Observations that neither the policy nor sensitive paths hide."""
        path, fqn = F.coalesce("file_path", F.lit("")), F.coalesce("symbol_fqn", F.lit(""))
        return obs.where(~P.denied(path, fqn, self.policy) & ~is_sensitive(path) & ~is_sensitive(F.substring_index(fqn, "::", 1)))

    def _rules(self, scope: DataFrame, branch: str | None) -> DataFrame | None:
        if "rules" not in self.tables:
            return None
        found = MI.rules_for_context(self.tables["rules"].where(M.visible_on(branch)), self.tables["rule_symbols"], self.tables["rule_files"], scope.select(F.col("fqn").alias("symbol_fqn")), scope.select(F.col("path").alias("file_path")))
        return None if found.isEmpty() else found

    def _brief(self, pivots: DataFrame, header: str, walk, intent: str, budget: int, now: int, branch: str | None, label: str) -> tuple[str, str]:
        """Text of a brief and the notes on how its pivots were found."""
        if pivots.isEmpty():
            return header + "\nNo symbols found.\n", ""
        rows = self.context_rows(pivots, walk, intent, budget, now, branch).orderBy("place", "symbol_id").collect()
        of = lambda *names: "".join(r.entry for r in rows if r.section in names)
        memory = of("memory") + of("project")
        out = header + "\n## Pivot Symbols\n\n" + of("pivots")
        for title, text in (("Supporting Symbols", of("skeletons")), ("Session Memory", memory), ("Project Rules", of("rules"))):
            out += f"## {title}\n\n{text}" if text else ""
        shown = {r.symbol_id for r in rows if r.section == "pivots"}
        notes = pivots.select("symbol_id", "place", R.pivot_note(label).alias("note")).orderBy("place").collect()
        text = "".join(r.note for r in notes if r.symbol_id in shown)
        omitted = sum(r.symbol_id not in shown for r in notes)
        return out, "\n## Retrieval Notes\n" + text + (f"({omitted} pivots omitted: budget/sensitive-path)\n" if omitted else "")

    def get_context(self, intent: str, now: int, token_budget: int | None = None, file_hints: list[str] | None = None, branch: str | None = None) -> str:
        """Brief of a question: pivots, what supports them, memory and rules, and how it was found."""
        if not intent.strip():
            raise ValueError("intent must not be empty")
        out, notes = self._context(intent, now, BUDGET if token_budget is None else token_budget, file_hints, branch)
        return out + self.freshness_warnings(now) + notes

    def _context(self, intent: str, now: int, budget: int, file_hints: list[str] | None, branch: str | None) -> tuple[str, str]:
        walk = self.profile(intent)
        header, label = R.intent_header(intent, walk), {"bugfix": "bug-fix", "impl": "implementation"}.get(walk.intent, walk.intent)
        if not self.members:
            return self._brief(self.pivots(intent, file_hints, walk.pool), header, walk, intent, budget, now, branch, label)
        found = self.federated_pivots(intent, file_hints, walk.pool)
        local = found.where("member = 0").drop("member", "rn")
        out, notes = self._brief(local, header, walk, intent, budget, now, branch, label)
        far, spent = found.where("member <> 0").select("member", "symbol_id", "rn", R.pivot_note(label).alias("note")), -(-len(out.encode()) // 4)
        for k, (name, tables) in enumerate(self.members, 1):
            rows = self._visible(tables).join(far.where(F.col("member") == k), "symbol_id").withColumn("entry", R.text("### [", F.lit(name), "] ", F.col("name"), " (`", F.col("fqn"), "`)\n", F.coalesce(F.concat(F.col("signature"), F.lit("\n")), F.lit("")), "\n"))
            for r in rows.orderBy("rn").collect():
                if (cost := -(-len(r.entry.encode()) // 4)) + spent <= budget:
                    out, spent, notes = out + r.entry, spent + cost, notes + r.note
        return out, notes

    def get_brief(self, intent: str, now: int, symbol_fqn: str | None = None, token_budget: int | None = None, depth: int | None = None, file_hints: list[str] | None = None, branch: str | None = None) -> str:
        """Context on four fifths of the budget and the impact of a symbol, cut to the budget; warnings and notes come on top."""
        budget = _clamp(token_budget, BUDGET, LEAST_BUDGET, MOST_BUDGET)
        context, notes = self._context(intent, now, budget * 80 // 100, file_hints, branch)
        impact = self.get_impact(symbol_fqn, depth) if symbol_fqn else "No primary symbol specified — provide symbol_fqn for impact analysis.\n"
        out = BR.hard_cut(f"{context}\n---\n{impact}", budget)
        return out + ("\n_Impact analysis: local repo only. Memory: local repo only._\n" if self.members else "") + self.freshness_warnings(now) + notes

    # graph

    def impact_rows(self, fqn: str, depth: int | None = None) -> DataFrame:
        """Dependents of a symbol by depth; denied ones are walked through but not shown."""
        start = self.spark.sql(f"SELECT {self._id(fqn)}L AS node")
        found = G.impact(self.tables["edges"], start, IMPACT_KINDS, _clamp(depth, DEPTH, 1, MOST_DEPTH))
        return found.join(self._visible().select(F.col("symbol_id").alias("node"), "fqn", "name", "path"), "node").select("fqn", "name", "path", "depth", F.col("kind").alias("kind"), "truncated")

    def get_impact(self, fqn: str, depth: int | None = None) -> str:
        try:
            rows = self.impact_rows(fqn, depth).orderBy("depth", "fqn").collect()
        except ValueError:
            return f"Symbol not found: {fqn}\n"
        out = f"# Impact Analysis: {fqn}\n\n{len(rows)} direct and transitive dependent(s) found (depth={_clamp(depth, DEPTH, 1, MOST_DEPTH)})\n\n"
        for d in sorted({r.depth for r in rows}):
            out += f"### Depth {d}\n\n" + "".join(f"- {r.name} ({r.kind}) in {r.path}\n  FQN: {r.fqn}\n" for r in rows if r.depth == d) + "\n"
        out += "" if rows else "No dependents found.\n"
        return out + ("⚠ Results truncated: ≥100 dependents per hop — use a narrower symbol or reduce depth\n" if any(r.truncated for r in rows) else "")

    def trace_rows(self, source: str, target: str, max_paths: int | None = None) -> DataFrame:
        """Shortest paths without hidden nodes: path (ids), hops, capped, nodes (fqn and path in order)."""
        paths = G.shortest_paths(self.tables["edges"], self._id(source), self._id(target), TRACE_KINDS, most_paths=_clamp(max_paths, PATHS, 1, MOST_PATHS))
        steps = paths.select("path", "hops", "capped", F.posexplode("path").alias("at", "symbol_id")).join(self._visible().select("symbol_id", "fqn", F.col("path").alias("file")), "symbol_id", "left")
        named = steps.groupBy("path", "hops", "capped").agg(F.array_sort(F.collect_list(F.struct("at", "fqn", "file"))).alias("nodes"))
        return named.where(~F.exists("nodes", lambda n: n["fqn"].isNull()))

    def trace_flow(self, source: str, target: str, max_paths: int | None = None) -> str:
        try:
            rows = self.trace_rows(source, target, max_paths).orderBy("path").collect()
        except ValueError as error:
            return f"Symbol not found: {str(error).removeprefix('unknown symbol: ')}\n"
        out = f"# Trace Flow: {source} → {target}\n\n" + (f"{len(rows)} path(s) found\n\n" if rows else "No execution path found between these symbols.\n\n")
        for k, r in enumerate(rows, 1):
            out += f"### Path {k} ({r.hops} hop{'' if r.hops == 1 else 's'})\n\n" + "".join(f"- `{n.fqn}` ({n.file})\n" for n in r.nodes) + "\n"
        return out + ("⚠ Neighbor cap (50) hit on at least one node — some paths may not have been explored\n" if any(r.capped for r in rows) else "")

    def skeleton_rows(self, path: str, most: int = 50) -> DataFrame:
        """Top-level symbols of a file with their nested entries: children by parent, then methods of a type named in their fqn."""
        own = self._visible().where(F.col("path") == path)
        hidden = P.matches(F.col("path"), F.col("fqn"), self.policy.get("redact", []))
        own = self._with_dependencies(own.withColumn("redacted", hidden))
        title = F.when(F.col("redacted"), F.concat("name", F.lit(f" {REDACTED}"))).otherwise(F.coalesce(F.nullif("signature", F.lit("")), "name"))
        types = own.where(F.col("parent_id").isNull() & F.col("kind").isin(ST.TYPE_KINDS)).groupBy(F.col("name").alias("_group")).agg(F.min("symbol_id").alias("_type"))
        group = F.regexp_extract("fqn", r"^[^:]*::([^:<]+)::", 1)
        methods = own.where(F.col("parent_id").isNull()).withColumn("_group", group).join(types, "_group")
        nested = own.where("parent_id is not null").select(F.col("parent_id").alias("owner"), F.lit(0).alias("_k"), "start_line", "symbol_id", title.alias("title"), F.lit(None).cast("string").alias("deps"))
        nested = nested.unionByName(methods.select(F.col("_type").alias("owner"), F.lit(1).alias("_k"), "start_line", "symbol_id", title.alias("title"), F.when(~F.col("redacted"), F.col("deps")).alias("deps")))
        ranked = ST.capped(nested, ["owner"], most, "_k", "start_line", "symbol_id")
        entry = R.text("#### ", F.col("title"), "\n", F.coalesce(F.concat(F.lit("Dependencies: "), "deps", F.lit("\n")), F.lit("")))
        shown = ranked.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), "").alias("inner"))
        counts = nested.groupBy("owner").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more"))
        parents = own.where("parent_id is null").join(methods.select("symbol_id"), "symbol_id", "left_anti")
        joined = parents.join(shown, F.col("symbol_id") == F.col("owner"), "left").drop("owner").join(counts, F.col("symbol_id") == F.col("owner"), "left")
        tail = F.when(F.col("more") > 0, R.text("... and ", F.col("more").cast("string"), " more\n")).otherwise(F.lit(""))
        whole = F.when(F.col("redacted"), R.text("### ", F.col("name"), f" {REDACTED}\n\n")).otherwise(R.text(R.symbol_head(), F.coalesce("inner", F.lit("")), tail, "\n"))
        return joined.select("symbol_id", "start_line", whole.alias("entry"), F.coalesce("more", F.lit(0)).alias("hidden"))

    def get_file_skeleton(self, path: str) -> str:
        """Outline of a file, found by its path or the end of it."""
        if not path.strip():
            raise ValueError("file_path must not be empty")
        asked = self.spark.sql("SELECT :p AS q", args={"p": path.strip()})
        if asked.where(is_sensitive(F.col("q"))).count():
            return f"Access to sensitive file '{path}' is not permitted.\n"
        found = ST.resolved_paths(asked, self._visible().select("path").distinct()).first()
        if found is None:
            return f"No file found matching: {path}\n"
        if found.hit is None:
            return f"Multiple files match '{path}':\n" + "".join(f"  {x}\n" for x in found.candidates.split(",")) + "Provide a more specific path.\n"
        return f"# File Skeleton: {found.hit}\n\n" + "".join(R.lines_of(self.skeleton_rows(found.hit), "entry", "start_line", "symbol_id"))

    # failures

    def failure_rows(self, trace: str) -> DataFrame:
        """Frames of a trace with the symbol each resolves to, and how."""
        traces = self.spark.sql("SELECT 0 AS trace_id, :t AS text", args={"t": trace})
        return FA.resolved_frames(FA.frames(traces, self.root), self._visible())

    def analyze_failure(self, trace: str, now: int, token_budget: int | None = None, branch: str | None = None) -> str:
        """Brief of a failure: by its frames, else by its words, else its text made fit for display."""
        if not trace.strip():
            raise ValueError("trace is empty")
        budget, summary = _clamp(token_budget, FAILURE_BUDGET, LEAST_BUDGET, MOST_BUDGET), FA.summary(trace)
        intent, frames = f"fix error: {summary}", self.failure_rows(trace).cache()
        walk = self.profile(intent)
        named = frames.join(self._visible().select("symbol_id", "fqn"), "symbol_id", "left").orderBy("place").collect()
        table = "".join(f"| {r.place} | {r.file or '—'} | {r.line_no or '—'} | {r.fqn or '—'} | {r.tier} |\n" for r in named)
        head = f"## Failure Analysis\n\n**Error:** {summary}\n\n" + (f"### Frame Resolution\n| # | Path | Line | Resolved Symbol | Method |\n|-|-|-|-|-|\n{table}\n" if table else "")
        first = FA.failure_pivots(frames)
        pivots = self._visible().join(first, "symbol_id").select("symbol_id", "fqn", F.col("rank").cast("long").alias("place"), F.lit("caller").alias("reason"), *[F.lit(None).cast(k).alias(c) for c, k in (("hint", "string"), ("match_class", "string"), ("rank_score", "int"), ("rank_centrality", "int"), ("rank_similarity", "int"), ("rrf", "double"), ("score", "double"))])
        if pivots.isEmpty():
            words = FA.keywords(self.spark, trace)
            ranked = self.ranked(intent, words, 5) if words else None
            if ranked is None or ranked.isEmpty():
                shown = FA.shown_trace(self.spark.sql("SELECT 0 AS trace_id, :t AS text", args={"t": trace}), self.policy).orderBy("pos").collect()
                cut = next((k for k, r in enumerate(shown) if r.hidden and r.pos > k + 1), len(shown))
                lines = [r.line for r in shown[:cut]] + ([f"... ({shown[0].hidden} lines omitted) ..."] if cut < len(shown) else []) + [r.line for r in shown[cut:]]
                return BR.hard_cut(head + "Could not resolve input to indexed code.\nThe raw input is preserved below.\n\n### Raw Trace\n```\n" + "\n".join(lines) + "\n```\n", budget)
            pivots = ranked.withColumn("hint", F.lit(None).cast("string"))
            pivots = pivots if "rank_similarity" in pivots.columns else pivots.withColumn("rank_similarity", F.lit(None).cast("int"))
        text, notes = self._brief(pivots, R.intent_header(intent, walk), walk, intent, budget, now, branch, {"bugfix": "bug-fix"}.get(walk.intent, walk.intent))
        return BR.hard_cut(head + text, budget) + notes

    # memory

    def save_observation(self, row: dict, now: int | None = None) -> DataFrame:
        """Observations with one more, checked: kind, content, scope and importance; its session is opened and, for valuable kinds, not nudged."""
        clean = {k: (v.strip() or None if isinstance(v, str) else v) for k, v in row.items()}
        if not clean.get("content"):
            raise ValueError("content must not be empty")
        if clean.get("kind") not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        scope, anchored = clean.pop("scope", None), bool(clean.get("symbol_fqn") or clean.get("file_path"))
        if scope not in (None, "project"):
            raise ValueError("the only scope is project")
        if scope == "project" and anchored:
            raise ValueError("a project observation has no anchors")
        if scope is None and not anchored:
            raise ValueError("symbol_fqn or file_path is needed, or scope project")
        for path in (clean.get("file_path"), (clean.get("symbol_fqn") or "").split("::")[0]):
            if path and self.spark.sql("SELECT :p AS p", args={"p": path}).where(is_sensitive(F.col("p"))).count():
                raise ValueError("the path is sensitive")
        default = ("high" if clean["kind"] == "decision" else "medium") if scope else M.IMPORTANCE_OF_KIND.get(clean["kind"], "medium")
        clean["importance"] = (clean.get("importance") or default).lower()
        if clean["importance"] not in IMPORTANCES:
            raise ValueError(f"importance must be one of {IMPORTANCES}")
        obs = self.tables["observations"]
        if clean.get("obs_id") is None:
            clean["obs_id"] = (obs.agg(F.max("obs_id")).first()[0] or 0) + 1
        fields = [f for f in obs.schema if clean.get(f.name) is not None]
        new = self.spark.createDataFrame([tuple(clean[f.name] for f in fields)], type(obs.schema)(fields))
        self.tables["observations"] = obs.unionByName(M.inserted(new, obs, F.lit(now if now is not None else clean.get("created_at"))))
        if "sessions" in self.tables and clean.get("session_id") is not None:
            sessions = M.upserted_sessions(self.tables["sessions"], new.select("session_id", F.lit(now).cast("long").alias("started_at")))
            if "nudge_sent" in sessions.columns:
                sessions = M.nudge_flags(sessions.fillna(False, ["nudge_sent"]), new.select("session_id").limit(0), new.select("session_id", "kind"))
            self.tables["sessions"] = sessions
        return self.tables["observations"]

    def history_rows(self, now: int, sessions: int | None = None, branch: str | None = None, symbol: str | None = None, file: str | None = None, scope: str = "all") -> DataFrame:
        """Scored observations of the latest sessions; those hidden by the policy are left out."""
        if scope not in ("project", "anchored", "all"):
            raise ValueError("scope must be project, anchored or all")
        recent = M.recent_sessions(self.tables["sessions"], self.tables["observations"], branch, _clamp(sessions, SESSIONS, 1, MOST_SESSIONS))
        return M.scored(M.observations(self._shown(self.tables["observations"]), branch, symbol, file, recent, scope), F.lit(now))

    def get_session_history(self, now: int, sessions: int | None = None, branch: str | None = None, sort_mode: str = "session", symbol: str | None = None, file: str | None = None, scope: str = "all", all_branches: bool = False) -> str:
        """Up to 200 observations by session or by relevance, their range of scores below."""
        if sort_mode not in ("session", "relevance"):
            raise ValueError("sort_mode must be session or relevance")
        rows = self.history_rows(now, sessions, branch, symbol, file, scope).cache()
        total = rows.count()
        if not total:
            return "No observations found matching the given filters."
        by_relevance = sort_mode == "relevance"
        shown = (M.by_relevance(rows) if by_relevance else rows.orderBy(F.col("created_at").desc(), F.col("obs_id").desc()).limit(200)).cache()
        facts = M.displayed_range(shown).first()
        if by_relevance:
            order = Window.orderBy(F.round("relevance", 9).desc(), "is_stale", F.col("created_at").desc(), F.col("obs_id").desc())
            entries = R.lines_of(shown.withColumn("place", F.row_number().over(order)).withColumn("entry", R.history_entry(True, all_branches)), "entry", "place")
            out = f"# Session History — Relevance Ranked (from {facts.sessions} sessions)\n\n" + "".join(entries)
            out += f"\n{facts.shown} observations" + (f" ({facts.stale} stale)" if facts.stale else "") + "\n"
        else:
            started = self.tables["sessions"].select("session_id", utc_minute(F.col("started_at")).alias("at"))
            listed = shown.withColumn("entry", R.history_entry(False, all_branches)).join(started, "session_id", "left").orderBy(F.col("created_at").desc(), F.col("obs_id").desc()).select("session_id", "at", "entry").collect()
            groups: dict = {}
            for r in listed:
                groups.setdefault((r.session_id, r.at), []).append(r.entry)
            out = f"# Session History (last {facts.sessions} sessions)\n" + "".join(f"\n## Session {s} ({at or 'unknown'})\n\n" + "".join(e) for (s, at), e in groups.items())
            out += f"\n{len(groups)} sessions, {facts.shown} observations" + (f" ({facts.stale} stale)" if facts.stale else "") + "\n"
        out += f"Relevance: {facts.least:.2f}–{facts.most:.2f}\n"
        return out + (f"\n(Showing 200 of {total} observations. Use filters to narrow results.)\n" if total > 200 else "")

    def health_row(self, now: int, branch: str | None = None):
        """Health, rules, sessions, kinds and advice, one row."""
        obs = self.tables["observations"].where(M.visible_on(branch))
        row = M.health(obs, F.lit(now))
        kinds = obs.where(M.is_live()).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["kind"])), ", ").alias("kinds"))
        rules = M.rule_states(self.tables["rules"].where(M.visible_on(branch))) if "rules" in self.tables else self.spark.sql("SELECT 0L AS rules_active, 0L AS rules_pending, 0L AS rules_stale")
        sessions = self.tables["sessions"].agg(F.count(F.lit(1)).alias("sessions"), F.count_if("compressed").alias("compressed"))
        return M.recommendations(row.crossJoin(kinds).crossJoin(rules).crossJoin(sessions), branch).first()

    def memory_health(self, now: int, branch: str | None = None) -> str:
        return R.health_text(self.health_row(now, branch), branch)

    def end_sessions(self, ended: DataFrame, now: int, branch: str | None = None) -> None:
        """What happens when sessions (session_id) end: anti-patterns, compression, merging, rules of all observations."""
        obs, self.tables["sessions"] = M.session_end(self.tables["observations"], self.tables["sessions"], ended, F.lit(now))
        self.tables["observations"] = MI.consolidated(obs, F.lit(now), branch)
        rows = MI.rule_inputs(self.tables["observations"], F.lit(now), branch)
        self.tables["rule_candidates"] = MI.rule_candidates(rows, MI.clusters(rows, "scope", "obs_id", "bag", 0.4, strict=True), "scope", "obs_id", "bag")

    def submit_edges(self, batch: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        """Outcome counts of a batch; accepted edges join the table, with origin lsp where it has origins."""
        edges, nodes = self.tables["edges"], self._visible().select(F.col("symbol_id").alias("node"))
        report = ST.edge_report(batch, nodes, edges, kinds)
        if not report.first().refused:
            sound = ST.edge_status(batch, nodes, edges, kinds).where("status = 'inserted'").select("source", "target", "kind")
            if "source_origin" in edges.columns:
                sound = sound.withColumn("source_origin", F.lit("lsp"))
            self.tables["edges"] = edges.select(*sound.columns).unionByName(sound)
        return report

    # files

    def _path(self, path: str) -> str:
        if self.spark.sql("SELECT :p AS p", args={"p": path}).where(is_sensitive(F.col("p"))).count():
            raise ValueError("the path is sensitive")
        return path.removeprefix(self.root.rstrip("/") + "/") if self.root else path

    def list_restore_points(self, path: str, now_millis: int) -> str:
        rel = self._path(path)
        age = relative_age(F.expr(f"({now_millis}L - millis) div 1000"))
        lines = T.snapshots(self.spark, self.store, rel).select(R.text("  ", F.col("id"), "  ", F.col("size").cast("string"), " bytes  ", age, "\n").alias("line"), "millis", "seq")
        found = R.lines_of(lines, "line", F.col("millis").desc(), F.col("seq").desc())
        return f"Restore points for {rel} ({len(found)} available):\n" + "".join(found) if found else f"No restore points available for {rel}"

    def undo_change(self, path: str, snapshot_id: str, session_id, now: int) -> str:
        """Put a snapshot back and remember that as a decision."""
        rel = self._path(path)
        try:
            T.restore(self.store, self.root, rel, snapshot_id)
        except FileNotFoundError:
            known = R.lines_of(T.snapshots(self.spark, self.store, rel), "id", F.col("millis").desc())
            raise ValueError(f"Snapshot '{snapshot_id}' not found. Available: {', '.join(known) or 'none'}") from None
        self.save_observation({"session_id": session_id, "kind": "decision", "content": f"Reverted {rel} — restore point {snapshot_id} applied", "file_path": rel, "importance": "medium"}, now)
        return f"Restored {rel} to snapshot {snapshot_id}."

    # status

    def index_status(self) -> DataFrame:
        """Counts of the tables that are there, one row, and when files were last read."""
        one = lambda name: self.tables[name].agg(F.count(F.lit(1)).alias(name))
        out = reduce(DataFrame.crossJoin, [one(n) for n in ("files", "symbols", "edges", "observations") if n in self.tables])
        files = self.tables.get("files")
        return out if files is None or "last_indexed_at" not in files.columns else out.crossJoin(files.agg(F.max("last_indexed_at").alias("last_indexed_at")))

    def member_rows(self, now: int, warn_hours: int = 1) -> DataFrame:
        """Members with the hours since their files were read and whether that is too long."""
        rows = None
        for k, (label, tables) in enumerate(self.members, 1):
            own = tables["files"].agg(F.max("last_indexed_at").alias("last")).select(F.lit(k).alias("member"), F.lit(label).alias("label"), F.floor((now - F.col("last")) / 3600).cast("long").alias("hours"))
            rows = own if rows is None else rows.unionByName(own)
        return self.spark.sql("SELECT 0 AS member, '' AS label, 0L AS hours, false AS old WHERE false") if rows is None else rows.withColumn("old", F.col("hours") >= warn_hours)

    def freshness_warnings(self, now: int) -> str:
        members = [(label, tables) for label, tables in self.members if "last_indexed_at" in getattr(tables.get("files"), "columns", [])]
        if not members:
            return ""
        old = Engine(self.spark, {}, members=members).member_rows(now).where("old").orderBy("member").collect()
        return "\n## Workspace Warnings\n" + "".join(f"- Remote member '{r.label}' last indexed {r.hours} hour{'' if r.hours == 1 else 's'} ago (advisory)\n" for r in old) if old else ""

    def doctor(self, now: int) -> list[str]:
        """What is wrong with members: no symbols, or files read more than a day ago."""
        out = [f"{label}: no symbols" for label, tables in self.members if "symbols" not in tables]
        whole = [(label, tables) for label, tables in self.members if "files" in tables]
        old = Engine(self.spark, {}, members=whole).member_rows(now, 25).where("old").orderBy("member").collect()
        return out + [f"{r.label}: last indexed {r.hours} hours ago" for r in old]


def symbol_table(parsed_symbols: DataFrame) -> DataFrame:
    """The engine's symbol table from parsed symbols: ids by hash of the fqn, parents resolved within the file."""
    s = parsed_symbols.withColumn("symbol_id", F.xxhash64("fqn")).withColumn("name_tokens", F.concat_ws(" ", split_identifier(F.col("name")), F.lower("name"))).withColumn("centrality", F.lit(0.0))
    return s.withColumn("parent_id", F.when(F.col("parent_fqn").isNotNull(), F.xxhash64("parent_fqn"))).withColumn("tokens", token_estimate(F.col("signature")))
