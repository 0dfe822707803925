"""Scalar functions over columns: identifiers, tokens, paths, redaction. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-case ASCII letters-and-digits runs, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def split_identifier(name: Column) -> Column:
    """Sub-words of camelCase, PascalCase, ACRONYMCase, snake_case and kebab-case names; a single word has none."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def expanded_name(name: Column) -> Column:
    """Sub-words and the whole name in lower case, as one searchable string."""
    return F.concat_ws(" ", split_identifier(name), F.lower(name))


def query_terms(text: Column, least_bytes: int = 4) -> Column:
    """Distinct terms of a question: whitespace words, their punctuation-free parts and identifier sub-words, long enough."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    atoms = F.flatten(F.transform(words, lambda w: F.array_union(F.filter(F.split(F.lower(w), "[^a-z0-9_]+"), lambda a: a != ""), split_identifier(w))))
    return F.array_distinct(F.filter(atoms, lambda a: F.octet_length(a) >= least_bytes))


def has_word(text: Column, word: str) -> Column:
    """Case-insensitive whole-word test; a word is a run of letters and digits."""
    return F.array_contains(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), word.lower())


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def truncated(text: Column, most: int) -> Column:
    """Cut to ``most`` characters with an ellipsis if the text has more bytes than that."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def short_name(fqn: Column) -> Column:
    return F.substring_index(fqn, "::", -1)


def file_component(fqn: Column) -> Column:
    return F.substring_index(fqn, "::", 1)


#: Names of files that hold secrets (fixed values).
SENSITIVE = r"^(\.env|id_rsa|\.env\..*|id_rsa\..*|.*\.(pem|key|p12))$"


def is_sensitive(path: Column) -> Column:
    return F.coalesce(F.lower(F.substring_index(path, "/", -1)).rlike(SENSITIVE), F.lit(False))


def redacted(text: Column, most: int = 120) -> Column:
    """Whitespace tokens that name sensitive files are hidden, then the text is cut."""
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.when(is_sensitive(w), F.lit("<redacted>")).otherwise(w))
    return truncated(F.array_join(words, " "), most)


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a case-sensitive glob whose star crosses slashes."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob.replace("**", "*")) + "$"


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays taken as sets; zero if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def normalised_path(path: Column) -> Column:
    """Relative path without dots; null if it is empty, absolute or climbs."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    bad = path.startswith("/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def relative_to(path: Column, root: Column) -> Column:
    prefix = F.concat(F.rtrim(root), F.lit("/"))
    return F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def relative_age(seconds: Column) -> Column:
    """"n seconds ago" and so on, the largest unit that fits."""
    s = F.greatest(seconds, F.lit(0))
    step = lambda unit, name: F.concat(F.floor(s / unit).cast("string"), F.lit(f" {name} ago"))
    return F.when(s < 60, step(1, "seconds")).when(s < 3600, step(60, "minutes")).when(s < 86400, step(3600, "hours")).otherwise(step(86400, "days"))


def age_label(seconds: Column) -> Column:
    """"5m ago", "3h ago", "2d ago"."""
    step = lambda unit, name: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{name} ago"))
    return F.when(seconds < 3600, step(60, "m")).when(seconds < 86400, step(3600, "h")).otherwise(step(86400, "d"))


def utc_minute(epoch: Column) -> Column:
    """Epoch seconds as "YYYY-MM-DD HH:MM UTC", in a session in UTC."""
    return F.concat(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def clock_time(epoch: Column) -> Column:
    """Epoch seconds as time of day, "HH:MM:SS"."""
    return F.date_format(F.timestamp_seconds(epoch), "HH:mm:ss")


def half_life(age_days: Column, half_life_days: Column) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life_days)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double; zero for unlike lengths, empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def backtick_tokens(text: Column) -> Column:
    """Contents of single-backtick spans that stay on one line; longer runs of backticks and what they hold are passed over."""
    free = F.regexp_replace(text, r"(?<!`)(`{2,})(?!`)(?:[^\n]*?[^`\n])?\1(?!`)|(?<!`)`{2,}[^\n]*", "")
    return F.filter(F.regexp_extract_all(free, F.lit(r"`([^`\n]*)`"), F.lit(1)), lambda t: t != "")


def without_call(token: Column) -> Column:
    """A token without its last balanced pair of brackets, if it ends in one: ``f(a(b))`` is ``f``."""
    # from the end: +1 for a closing, -1 for an opening bracket; the first place where the sum is 0 opens the pair
    chars = F.reverse(F.split(token, ""))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("cut"))

    def step(s, c):
        depth = s["depth"] + F.when(c == ")", 1).when(c == "(", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(s["cut"].isNull() & (c == "(") & (depth == 0), s["at"] + 1).otherwise(s["cut"]).alias("cut"))

    cut = F.aggregate(chars, start, step, lambda s: s["cut"])
    return F.when(token.endswith(")"), F.substring(token, F.lit(1), F.length(token) - F.coalesce(cut, F.lit(0)))).otherwise(token)


#: Words that mark each kind of intent (fixed values), in the order that settles ties.
INTENT_WORDS = {
    "bugfix": ["bug", "crash", "debug", "error", "fix"],
    "refactor": ["extract", "refactor", "rename", "restructure"],
    "impl": ["add", "build", "create", "implement"],
}

#: Least dominance of an intent, and shares from which a walk goes deeper or also backwards (fixed values).
LOW_CONFIDENCE, REFACTOR_DEPTH, INBOUND_BLEND = 0.60, 0.50, 0.35
#: Pivots looked for, and with low confidence (fixed values).
POOL, WIDE_POOL = 5, 8


def intent_profile(text: Column, words: dict[str, list[str]] | None = None, dominance: float = LOW_CONFIDENCE) -> list[Column]:
    """Columns n_<kind>, dominance, dominant, intent, signals.

    ``dominant`` is the kind with most marking words, ``intent`` that or balanced below ``dominance``, and
    ``signals`` the words found, kind by kind.
    """
    words = words or INTENT_WORDS
    counts = {k: sum((has_word(text, w).cast("int") for w in ws), F.lit(0)) for k, ws in words.items()}
    total, top = sum(counts.values(), F.lit(0)), F.greatest(*counts.values())
    share = F.when(total > 0, top / total).otherwise(F.lit(0.0))
    kind = F.when(total > 0, F.coalesce(*[F.when(c == top, F.lit(k)) for k, c in counts.items()])).otherwise(F.lit("balanced"))
    signals = F.concat_ws(", ", *[F.when(has_word(text, w), F.lit(w)) for ws in words.values() for w in ws])
    columns = [c.cast("long").alias(f"n_{k}") for k, c in counts.items()]
    return [*columns, F.round(share, 6).alias("dominance"), kind.alias("dominant"), F.when(share >= dominance, kind).otherwise(F.lit("balanced")).alias("intent"), signals.alias("signals")]


def traversal_policy(bugfix: Column, refactor: Column, impl: Column) -> list[Column]:
    """Columns pool, depth, inbound, inbound_first from the counts of marking words.

    Without a dominant kind: a wide pool, two steps, outward only. Else three steps if refactoring has half of
    the words, and backwards too if it and bug fixing have enough; backwards first if bug fixing leads.
    """
    total = bugfix + refactor + impl
    sure = (total > 0) & (F.greatest(bugfix, refactor, impl) >= LOW_CONFIDENCE * total)
    inbound = sure & (bugfix + refactor >= INBOUND_BLEND * total)
    return [F.when(sure, POOL).otherwise(WIDE_POOL).alias("pool"), F.when(sure & (refactor >= REFACTOR_DEPTH * total), 3).otherwise(2).alias("depth"), inbound.alias("inbound"), (inbound & (bugfix >= refactor)).alias("inbound_first")]
