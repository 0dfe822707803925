"""Content policy: rules that deny or redact by path glob or fqn prefix, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import file_component, glob_pattern


def matches(path: Column, fqn: Column | None, rules: list[dict]) -> Column:
    """Whether a rule (path glob, fqn_prefix) matches; a prefix ends at a segment. Empty rules match nothing."""
    hit = F.lit(False)
    for rule in rules:
        if rule.get("path"):
            hit = hit | F.coalesce(path.rlike(glob_pattern(rule["path"])), F.lit(False))
        if rule.get("fqn_prefix") and fqn is not None:
            hit = hit | F.coalesce((fqn == rule["fqn_prefix"]) | fqn.startswith(rule["fqn_prefix"] + "::"), F.lit(False))
    return hit


def denied(path: Column, fqn: Column | None, policy: dict) -> Column:
    own = matches(path, fqn, policy.get("deny", []))
    return own | matches(file_component(fqn), fqn, policy.get("deny", [])) if fqn is not None else own


def apply_policy(rows: DataFrame, path: str, fqn: str | None, body: str, policy: dict) -> DataFrame:
    """Denied rows go; redacted ones keep everything but the body."""
    f = F.col(fqn) if fqn else None
    hidden = matches(F.col(path), f, policy.get("redact", []))
    return rows.where(~denied(F.col(path), f, policy)).withColumn("redacted", hidden).withColumn(body, F.when(hidden, F.lit("[redacted]")).otherwise(F.col(body)))
