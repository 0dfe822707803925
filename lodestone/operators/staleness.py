"""What changes of symbols mean for observations and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import backtick_tokens, short_name, without_call
from lodestone.operators.memory import marked_stale
from lodestone.operators.mining import stale_rules


def reasons(changes: DataFrame) -> DataFrame:
    """fqn, reason, rule_reason, priority of ``symbol_changes`` that make observations stale; the least priority counts."""
    name = short_name(F.col("fqn"))
    reason = (
        F.when(F.col("change") == "signature_changed", F.concat(F.lit("Signature of symbol '"), name, F.lit("' changed: `"), "old_signature", F.lit("` → `"), "new_signature", F.lit("`")))
        .when(F.col("change") == "removed", F.lit("Symbol no longer exists in index"))
        .when(F.col("change") == "renamed", F.concat(F.lit("Symbol renamed to '"), "new_fqn", F.lit("'")))
    )
    rule = F.when(F.col("change") == "signature_changed", "Linked symbol signature changed").when(F.col("change") == "removed", "Linked symbol removed").otherwise("Linked symbol renamed")
    priority = F.when(F.col("change") == "signature_changed", 0).when(F.col("change") == "removed", 1).otherwise(2)
    return changes.select("fqn", reason.alias("reason"), rule.alias("rule_reason"), priority.alias("priority")).where("reason is not null")


def references(obs: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed symbols (fqn) that observations name in backticks: obs_id, fqn, phase.

    A name in full (phase 1) counts before a short name (phase 2); a token that is some changed symbol in full
    is no short name of another. Calls are read without their brackets.
    """
    each = obs.select("obs_id", F.explode(backtick_tokens(F.col("content"))).alias("token")).select("obs_id", without_call(F.rtrim("token", F.lit("\r"))).alias("token")).where("token <> ''").distinct()
    names = changed.select("fqn").distinct()
    whole = each.join(names.withColumn("token", F.col("fqn")), "token").select("obs_id", "token", "fqn", F.lit(1).alias("phase"))
    short = each.join(whole.select("obs_id", "token"), ["obs_id", "token"], "left_anti").join(names.withColumn("token", short_name(F.col("fqn"))), "token").select("obs_id", "token", "fqn", F.lit(2).alias("phase"))
    return whole.unionByName(short).groupBy("obs_id", "fqn").agg(F.min("phase").alias("phase"))


def propagated(obs: DataFrame, changes: DataFrame) -> DataFrame:
    """Observations marked stale by changes: by their symbol, and on a changed file by symbols they name in backticks.

    The first reason stays. ``changes`` are those of ``symbol_changes``.
    """
    why = reasons(changes)
    direct = marked_stale(obs, why)
    files = why.select(F.substring_index("fqn", "::", 1).alias("file_path"), "fqn")
    loose = direct.where(F.col("symbol_fqn").isNull() & F.col("file_path").isNotNull() & ~F.col("is_stale")).join(files.select("file_path").distinct(), "file_path", "left_semi")
    own = loose.select("obs_id", "file_path", "content")
    named = references(own, why).join(own.select("obs_id", "file_path"), "obs_id").where(F.substring_index("fqn", "::", 1) == F.col("file_path"))
    first = named.groupBy("obs_id").agg(F.min(F.struct("phase", "fqn"))["fqn"].alias("_first"), F.count(F.lit(1)).alias("_n"))
    more = F.when(F.col("_n") > 1, F.concat(F.lit(" (and "), (F.col("_n") - 1).cast("string"), F.lit(" others)"))).otherwise(F.lit(""))
    joined = direct.join(first, "obs_id", "left")
    hit = F.col("_first").isNotNull()
    text = F.concat(F.lit("Referenced symbol '"), "_first", F.lit("' structurally changed"), more)
    return joined.withColumn("stale_reason", F.when(hit, text).otherwise(F.col("stale_reason"))).withColumn("is_stale", F.col("is_stale") | hit).select(*direct.columns)


def invalidated_rules(rules: DataFrame, rule_symbols: DataFrame, changes: DataFrame, now, branch: str | None = None) -> DataFrame:
    """Rules after changes of the symbols they are linked to."""
    return stale_rules(rules, rule_symbols, reasons(changes).select("fqn", F.col("rule_reason").alias("reason"), "priority"), now, branch)
