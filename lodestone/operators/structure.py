"""Symbols in files: containment, span lookup, reference resolution, structural diff and snapshot updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.prefix import numbered

#: Kinds that a reference of each kind may name by its short name (fixed values).
TARGET_KINDS = {
    "calls": ["function", "method"], "uses_type": ["class", "interface", "type_alias", "enum"], "extends": ["class", "interface"], "implements": ["interface"],
    "hooks_into": ["function", "method"], "fires_hook": ["function", "method"], "uses_trait": ["class"],
}
TYPE_KINDS = ["struct", "enum", "trait", "class", "interface"]


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def capped(rows: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def enclosing(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each probe (probe_id, path, line) the symbol (path, symbol_id, start_line, end_line) with the narrowest span around it."""
    found = probes.join(symbols, "path").where((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")))
    return first_by(found, ["probe_id"], F.col("end_line") - F.col("start_line"), "start_line", "symbol_id").select("probe_id", "symbol_id", "start_line", "end_line")


def nearest(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each probe the symbol of its path whose span begins or ends nearest to its line."""
    gap = F.least(F.abs(F.col("start_line") - F.col("line")), F.abs(F.col("end_line") - F.col("line")))
    return first_by(probes.join(symbols, "path").withColumn("gap", gap), ["probe_id"], "gap", "start_line", "symbol_id").select("probe_id", "symbol_id", "gap")


def unique_names(symbols: DataFrame, name: str = "name", ident: str = "symbol_id") -> DataFrame:
    """Names that exactly one symbol has."""
    return symbols.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.min(ident).alias(ident)).where("_n = 1").drop("_n")


def resolved_edges(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Reference targets: an exact fqn first, else the only symbol with that short name and a kind that fits.

    references: ref_id, kind, target; symbols: symbol_id, fqn, name, symbol_kind. Adds target_id, how.
    """
    spark = references.sparkSession
    exact = references.join(symbols.select(F.col("fqn").alias("target"), F.col("symbol_id").alias("exact_id")), "target", "left")
    pairs = [(k, v) for k, vs in TARGET_KINDS.items() for v in vs]
    fits = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + " AS t(kind, symbol_kind)")
    by_name = symbols.join(F.broadcast(fits), "symbol_kind").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("_n"), F.min("symbol_id").alias("name_id")).where("_n = 1").select("kind", F.col("name").alias("_short"), "name_id")
    named = exact.withColumn("_short", F.substring_index("target", "::", -1)).join(by_name, ["kind", "_short"], "left")
    how = F.when(F.col("exact_id").isNotNull(), F.lit("exact")).when(F.col("name_id").isNotNull(), F.lit("name")).otherwise(F.lit("unresolved"))
    return named.select("ref_id", "kind", "target", F.coalesce("exact_id", "name_id").alias("target_id"), how.alias("how"))


def outline(parents: DataFrame, children: DataFrame, most: int = 50) -> DataFrame:
    """For each parent its first children as text and how many are hidden. children: parent_id, child_id, label."""
    ranked = children.withColumn("_r", F.row_number().over(Window.partitionBy("parent_id").orderBy("child_id")))
    shown = ranked.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("n_children"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("child_id", "label")))), lambda x: x["label"]), ",").alias("shown"),
    )
    return parents.join(shown, "parent_id", "left").select("parent_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("shown", F.lit("")).alias("shown"), F.greatest(F.coalesce("n_children", F.lit(0)) - most, F.lit(0)).alias("hidden"))


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between snapshots (fqn, kind, signature, source_hash): fqn, change, new_fqn, old_signature, new_signature.

    added, removed, signature_changed (hash and both signatures differ), body_only, or renamed: the only
    removed and the only added symbol with one signature and kind, which are then neither added nor removed.
    """
    o = old.select("fqn", F.col("kind").alias("old_kind"), F.col("signature").alias("old_signature"), F.col("source_hash").alias("old_hash"), F.lit(True).alias("_old"))
    n = new.select("fqn", "kind", F.col("signature").alias("new_signature"), F.col("source_hash").alias("new_hash"), F.lit(True).alias("_new"))
    differs = F.col("old_hash") != F.col("new_hash")
    signed = F.col("old_signature").isNotNull() & F.col("new_signature").isNotNull() & (F.col("old_signature") != F.col("new_signature"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(differs & signed, "signature_changed").when(differs, "body_only")
    both = o.join(n, "fqn", "full_outer").withColumn("change", change).where("change is not null")
    one_sided = F.col("change").isin("added", "removed")
    # a removed and an added symbol pair up by signature and kind, if each is the only one
    signature, kind = F.coalesce("old_signature", "new_signature"), F.coalesce("old_kind", "kind")
    sides = both.where(one_sided & signature.isNotNull()).groupBy(signature.alias("_s"), kind.alias("_kind"))
    fqn_of = lambda side: F.min(F.when(F.col("change") == side, F.col("fqn")))
    pairs = sides.agg(F.count_if(F.col("change") == "removed").alias("_r"), F.count_if(F.col("change") == "added").alias("_a"), fqn_of("removed").alias("old_fqn"), fqn_of("added").alias("new_fqn")).where("_r = 1 and _a = 1")
    renamed = pairs.select(F.col("old_fqn").alias("fqn"), F.lit("renamed").alias("change"), "new_fqn", F.col("_s").alias("old_signature"), F.col("_s").alias("new_signature"))
    gone = pairs.select(F.explode(F.array("old_fqn", "new_fqn")).alias("fqn")).distinct()
    rest = both.join(gone, "fqn", "left_anti").select("fqn", "change", F.lit(None).cast("string").alias("new_fqn"), "old_signature", "new_signature")
    return rest.unionByName(renamed)


def renames(changes: DataFrame) -> DataFrame:
    """Renamed symbols of ``symbol_changes``: old_fqn, new_fqn, moved (the name is the same, its place is not)."""
    same = F.substring_index("fqn", "::", -1) == F.substring_index("new_fqn", "::", -1)
    return changes.where("change = 'renamed'").select(F.col("fqn").alias("old_fqn"), "new_fqn", same.alias("moved"))


def diff_sentence(changes: DataFrame, most: int = 5) -> DataFrame:
    """One sentence per file from ``symbol_changes``: its first parts and how many more there are; none for bodies alone.

    Added symbols come first, then signatures, removed and renamed ones, each by fqn. Only the first parts are
    gathered.
    """
    short = lambda c: F.substring_index(c, "::", -1)
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    moved = short("fqn") == short("new_fqn")
    part = (
        F.when(F.col("change") == "added", F.concat(F.lit("added "), tick(short("fqn"))))
        .when(F.col("change") == "signature_changed", F.concat(F.lit("signature of "), tick(short("fqn")), F.lit(" changed from "), tick(F.col("old_signature")), F.lit(" to "), tick(F.col("new_signature"))))
        .when(F.col("change") == "removed", F.concat(F.lit("removed "), tick(short("fqn"))))
        .when(moved, F.concat(F.lit("moved "), tick(F.col("fqn")), F.lit(" → "), tick(F.col("new_fqn"))))
        .otherwise(F.concat(F.lit("renamed "), tick(short("fqn")), F.lit(" → "), tick(short("new_fqn"))))
    )
    place = F.when(F.col("change") == "added", 0).when(F.col("change") == "signature_changed", 1).when(F.col("change") == "removed", 2).otherwise(3)
    rows = changes.where("change <> 'body_only'").select(F.substring_index("fqn", "::", 1).alias("file"), place.alias("place"), "fqn", part.alias("part"))
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    shown = capped(rows, ["file"], most, "place", "fqn").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]).alias("parts"))
    more = F.when(F.col("n") > most, F.array(F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return counts.join(shown, "file").select("file", F.concat(F.lit("Modified "), tick(F.col("file")), F.lit(": "), F.array_join(F.concat("parts", more), ", ")).alias("sentence"))


def upserted(old: DataFrame, new: DataFrame, key: str, ident: str, fields: list[str], deleted: bool = False) -> DataFrame:
    """Next snapshot with ids kept on equal keys, new ids above the largest, and the action of each row.

    New rows are numbered in order of the key, range by range. With ``deleted`` rows that went are listed too.
    """
    fresh = new.join(old.select(key), key, "left_anti").select(key)
    fresh = numbered(fresh, [key], "_id", old.agg(F.coalesce(F.max(ident), F.lit(0)).alias("top")))
    o = old.select(key, ident, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = new.withColumn("_there", F.lit(True)).join(o, key, "full_outer" if deleted else "left").join(fresh, key, "left")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(F.col("_there").isNull(), "deleted").when(F.col(ident).isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return joined.select(F.coalesce(ident, "_id").alias(ident), key, *fields, action.alias("action"))


def inserted_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (source, target, kind) of ``new`` that ``old`` lacks, once each."""
    return new.dropDuplicates(["source", "target", "kind"]).join(old.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti")


#: Kinds that submitted edges may have (fixed values).
SUBMITTED_KINDS = ["calls", "extends", "implements", "uses_type"]


def edge_status(batch: DataFrame, known: DataFrame, old: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Submitted edges (source, target, kind) with ``status`` and the ends that no known ``node`` has as ``unknown``."""
    malformed = F.col("source").isNull() | F.col("target").isNull() | F.col("kind").isNull()
    seen = batch.join(known.select(F.col("node").alias("source"), F.lit(1).alias("_s")), "source", "left").join(known.select(F.col("node").alias("target"), F.lit(1).alias("_t")), "target", "left")
    seen = seen.join(old.select("source", "target", "kind", F.lit(1).alias("_e")).distinct(), ["source", "target", "kind"], "left")
    lost = F.array_compact(F.array(F.when(F.col("_s").isNull(), F.col("source")), F.when(F.col("_t").isNull(), F.col("target"))))
    again = F.row_number().over(Window.partitionBy("source", "target", "kind").orderBy("source")) > 1
    sound = ~malformed & F.col("kind").isin(kinds or SUBMITTED_KINDS)
    status = F.when(malformed, "malformed").when(~sound, "invalid_kind").when(F.size(lost) > 0, "unresolved").when(F.col("_e").isNotNull() | again, "already_existed").otherwise("inserted")
    return seen.select("source", "target", "kind", status.alias("status"), F.when(sound, lost).alias("unknown"))


def edge_report(batch: DataFrame, known: DataFrame, old: DataFrame, kinds: list[str] | None = None, most: int = 500, examples: int = 5) -> DataFrame:
    """Counts of a batch of submitted edges by outcome and the first unknown ends, one row; a batch above ``most`` is refused whole."""
    marked = edge_status(batch, known, old, kinds)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = marked.agg(F.count(F.lit(1)).alias("submitted"), *[n(s) for s in ("malformed", "invalid_kind", "unresolved", "already_existed", "inserted")])
    some = marked.where("status = 'unresolved'").select(F.explode("unknown").alias("node")).distinct().orderBy("node").limit(examples)
    listed = some.agg(F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), ",").alias("unresolved_examples"))
    return counts.crossJoin(listed).withColumn("refused", F.col("submitted") > most)


def incremental_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, action of each file by content hash: new, changed, unchanged or deleted."""
    o, n = old.select("path", F.col("content_hash").alias("_old")), new.select("path", F.col("content_hash").alias("_new"))
    action = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return o.join(n, "path", "full_outer").select("path", action.alias("action"))


def resolved_paths(queries: DataFrame, files: DataFrame, shown: int = 5) -> DataFrame:
    """Path of each query (q): an exact file, else the file that ends with it; n says how many match best.

    With several matches ``hit`` is null and ``candidates`` lists the first ``shown``.
    """
    exact = queries.join(files.select(F.col("path").alias("q"), F.col("path").alias("hit")), "q").withColumn("stage", F.lit(0))
    name = F.substring_index("path", "/", -1)
    ends = queries.withColumn("_base", F.substring_index("q", "/", -1)).join(files.select("path", name.alias("_base")), "_base").where(F.expr("endswith(path, concat('/', q))")).select("q", F.col("path").alias("hit"), F.lit(1).alias("stage"))
    found = exact.select("q", "hit", "stage").unionByName(ends)
    counts = found.groupBy("q", "stage").agg(F.count(F.lit(1)).alias("n")).groupBy("q").agg(F.min(F.struct("stage", "n")).alias("b")).select("q", "b.stage", "b.n")
    first = capped(found, ["q", "stage"], shown, "hit").groupBy("q", "stage").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    joined = counts.join(first, ["q", "stage"])
    return joined.select("q", "n", F.when(F.col("n") == 1, F.element_at("hits", 1)).alias("hit"), F.when(F.col("n") > 1, F.array_join("hits", ",")).alias("candidates"))


def refresh_outcomes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Outcome of reading files again: path, outcome (unchanged, changed, or a soft failure and why).

    old: path, old_hash; new: path, language, new_hash, and where a text was not read or did not parse ``failed``
    ("io" or "parse"). A failure changes nothing that is stored.
    """
    failed = F.col("failed") if "failed" in new.columns else F.lit(None)
    why = F.coalesce(failed, F.when(F.col("language").isNull(), F.lit("language")))
    outcome = F.when(why.isNotNull(), F.concat(F.lit("failure: "), why)).when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return new.join(old, "path", "left").select("path", outcome.alias("outcome"))


def unseen_symbols(symbols: DataFrame, seen: DataFrame) -> DataFrame:
    """fqn of symbols whose file (path) was not seen in a scan; all of them if nothing was."""
    return symbols.join(seen.select("path").distinct(), "path", "left_anti").select("fqn")


def deleted_files(files: DataFrame, symbols: DataFrame, edges: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, symbols and edges left when files not seen (path) go with their symbols and those symbols' edges."""
    kept = files.join(seen.select("path").distinct(), "path", "left_semi")
    inside = symbols.join(kept.select("path"), "path", "left_semi")
    nodes = inside.select("symbol_id")
    left = edges.join(nodes.withColumnRenamed("symbol_id", "source"), "source", "left_semi").join(nodes.withColumnRenamed("symbol_id", "target"), "target", "left_semi")
    return kept, inside, left.select(*edges.columns)


def backfilled_tokens(symbols: DataFrame, tokens: Column) -> DataFrame:
    """Symbols whose searchable name was never written get it now."""
    return symbols.withColumn("name_tokens", F.when(F.coalesce("name_tokens", F.lit("")) == "", tokens).otherwise(F.col("name_tokens")))
