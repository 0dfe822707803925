"""Rows to text: entries of briefs, outlines, histories and reports, as columns, and their assembly.

An entry is one string column, so budgets are cut on rows; only what is shown comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import age_label, short_name


def _s(column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def text(*parts) -> Column:
    """Strings and columns one after the other; nulls are empty. Plain strings that are not columns are given by ``F.lit``."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def importance_tag() -> Column:
    return F.when(F.col("importance") == "medium", F.lit("")).otherwise(text("[", _s("importance"), "] "))


def breakdown_text() -> Column:
    """Weighted parts of a score that matter, as "[rec=0.31 conf=0.08]"."""
    b = F.col("breakdown")
    names = [("fts", "bm25"), ("semantic", "sem"), ("recency", "rec"), ("confidence", "conf")]
    parts = [F.when(b[f] > 0.001, text(f"{name}=", F.format_string("%.2f", b[f]))) for f, name in names]
    stale = F.when(b["stale"] < -0.001, text("stale=", F.format_string("%.2f", b["stale"])))
    joined = F.concat_ws(" ", *parts, stale)
    return F.when(joined != "", text("[", joined, "]")).otherwise(F.lit(""))


def memory_entry() -> Column:
    """A scored observation as a line of a brief, its anchors below."""
    confidence = F.coalesce("confidence", F.lit(0.5))
    age = F.when(F.col("relevance") >= 0.5, F.lit("recent")).otherwise(F.lit("aged"))
    trust = F.when((confidence >= 0.7) & (age == "recent"), F.lit(" · high confidence")).when(confidence < 0.4, F.lit(" · low confidence")).otherwise(F.lit(""))
    signal = F.when(F.col("is_stale"), F.lit("(stale)")).otherwise(text("(", age, trust, ")"))
    mark = F.when(F.col("is_stale"), text("⚠ [STALE — ", F.coalesce("stale_reason", F.lit("unknown reason")), "] ")).otherwise(F.lit(""))
    line = F.concat_ws(" ", text("- ", mark, importance_tag(), "[", _s("kind"), "] ", _s("content")), signal, F.when(breakdown_text() != "", breakdown_text()))
    return text(line, "\n", anchors())


def anchors() -> Column:
    return text(F.when(F.col("symbol_fqn").isNotNull(), text("  Symbol: ", _s("symbol_fqn"), "\n")).otherwise(""), F.when(F.col("file_path").isNotNull(), text("  File: ", _s("file_path"), "\n")).otherwise(""))


def history_entry(numbered: bool = False, branches: bool = False) -> Column:
    """A scored observation as a line of a session history."""
    branch = F.when(F.col("branch").isNotNull(), text("[", _s("branch"), "] ")).otherwise(F.lit("")) if branches else F.lit("")
    score = text("[score: ", F.format_string("%.2f", "relevance"), " · ", _s("signal"), "] ")
    mark = F.when(F.col("is_stale"), text("⚠ [STALE — ", F.coalesce("stale_reason", F.lit("unknown reason")), "] ")).otherwise(F.lit(""))
    tags = text(branch, importance_tag(), "[", _s("kind"), "] ")
    line = text(_s("place"), ". ", score, mark, tags, _s("content")) if numbered else text("- ", mark, tags, score, _s("content"))
    return text(line, "\n", anchors())


def project_entry() -> Column:
    return text("- [project] [", _s("kind"), "] ", _s("content"), " (", F.when(F.col("is_stale"), F.lit("stale")).otherwise(F.lit("active")), ")\n")


def rule_entry(now: Column) -> Column:
    return text("- ", _s("content"), " [", _s("support"), " obs · ", _s("sessions"), " sessions · last seen ", age_label(now - F.col("last_seen_at")), "]\n")


def pivot_entry(source: Column) -> Column:
    return text("## ", _s("name"), " (`", _s("fqn"), "`)\nFile: `", _s("path"), "` lines ", _s("start_line"), "-", _s("end_line"), "\n\n```\n", source, "\n```\n\n")


def symbol_head() -> Column:
    """Name, place, signature, documentation and dependencies (column deps) of a symbol."""
    optional = lambda c, *parts: F.when(F.coalesce(F.col(c), F.lit("")) != "", text(*parts)).otherwise(F.lit(""))
    return text("### ", _s("name"), " (`", _s("fqn"), "`)\nFile: `", _s("path"), "` lines ", _s("start_line"), "-", _s("end_line"), "\n", optional("signature", "Signature: `", _s("signature"), "`\n"), optional("docstring", _s("docstring"), "\n"), optional("deps", "Dependencies: ", _s("deps"), "\n"))


def walk_reason() -> Column:
    """Why a supporting symbol is there, from its direction and depth."""
    what = F.when(F.col("direction") == "inbound", F.lit("inbound caller")).otherwise(F.lit("outbound dependency"))
    return F.when(F.col("depth") == 1, text(what, " of pivot")).otherwise(text(what, " (depth ", _s("depth"), ")"))


def pivot_note(label: str) -> Column:
    """How a pivot was found."""
    ranks = text(_s("match_class"), " bm25_r=", _s("rank_score"), " cent_r=", _s("rank_centrality"), F.when(F.col("rank_similarity").isNotNull(), text(" emb_r=", _s("rank_similarity"))).otherwise(F.lit("")), " rrf=", F.format_string("%.4f", "rrf"), " bm25=", F.format_string("%.2f", "score"))
    how = F.when(F.col("reason") == "keyword", ranks).when(F.col("reason") == "file hint", text("file-hint \"", _s("hint"), "\"")).when(F.col("reason") == "caller", F.lit("caller-supplied")).otherwise(F.lit("fallback"))
    return text("- ", short_name(F.col("fqn")), " (", _s("fqn"), "): ", how, f" [{label}]\n")


def lines_of(rows: DataFrame, column: str, *order) -> list[str]:
    """A column of rows that are few, in order."""
    return [r[0] for r in rows.orderBy(*order).select(column).collect()]


def intent_header(intent: str, row) -> str:
    """Head of a brief from a question and its profile."""
    names = {"bugfix": "bug-fix", "refactor": "refactor", "impl": "implementation", "balanced": "balanced"}
    counts = [row.n_bugfix, row.n_refactor, row.n_impl]
    shares = [c / max(1, sum(counts)) for c in counts]
    out = f"# Context Brief: {intent}\nintent_mode: {names[row.intent]}\nintent_confidence: {row.dominance:.2f}\nintent_signals: {row.signals or 'none'}\n"
    if row.dominance >= 0.60 and sorted(shares)[1] > 0.20:
        out += f"intent_mix: bug-fix={shares[0]:.2f},refactor={shares[1]:.2f},implementation={shares[2]:.2f}\n"
    if row.intent == "balanced" and row.dominant != "balanced":
        out += "intent_fallback_reason: low confidence\n"
    return out


def health_text(row, branch: str | None) -> str:
    """Report of a health row with rule and session counts."""
    label = f"branch: {branch}" if branch else "all branches"
    out = f"## Memory Health ({label})\n\n"
    if not row.total:
        out += "**Observations**: No observations stored.\n" + (f"  - Retrieval traffic (context_retrieval): {row.retrievals}\n" if row.retrievals else "") + "\n"
    else:
        out += f"**Observations**: {row.total} total ({row.stale} stale — {100 * row.stale / row.total:.0f}%)\n"
        if row.kinds:
            out += f"  - By kind: {row.kinds}\n"
        out += f"  - By importance: {row.critical} critical, {row.high} high, {row.medium} medium, {row.low} low\n  - By scope: {row.symbol_only} symbol, {row.file_only} file, {row.both_anchors} both, {row.project_scoped} project\n"
        out += f"  - Retrieval traffic (context_retrieval): {row.retrievals}\n  - Noise (compression-eligible): {row.noise}\n\n"
    out += f"**Rules**: {row.rules_active} active, {row.rules_pending} pending, {row.rules_stale} stale\n\n**Sessions** (all branches): {row.sessions} total ({row.compressed} compressed)\n\n"
    if row.oldest_days is not None:
        out += f"**Age**: oldest observation {row.oldest_days} days, oldest non-stale {'n/a' if row.oldest_fresh_days is None else row.oldest_fresh_days} days\n\n"
    return out + ("### Recommendations\n" + "".join(f"- {x}\n" for x in row.advice) if row.advice else "")


def health_line(row) -> str:
    return f"Memory: {row.total} obs ({100 * row.stale / max(1, row.total):.0f}% stale), {row.rules_active} active rules, {row.sessions} sessions"
