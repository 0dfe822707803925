"""Token-budgeted results: prefix budgets, sections, federation, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate
from lodestone.operators.prefix import running

#: Shares of a brief's budget, without rules (fixed values); with rules memory falls to 5 % and rules get the other 5 %.
SHARES = {"pivots": 0.70, "skeletons": 0.20, "memory": 0.10}


def within_budget(rows: DataFrame, cost: str, budget: float, *order, keys: list[str] | None = None) -> DataFrame:
    """Rows in order while their running cost fits; the first that does not ends the list. ``running`` is the cost so far.

    Running sums go range by range, so no key is gathered in one task.
    """
    return running(rows, cost, list(order), keys).where(F.col("running") <= budget)


def first_within(rows: DataFrame, cost: str, budget: int, *order: str, keys: list[str] | None = None, least_cost: int = 1) -> DataFrame:
    """``within_budget`` for rows that cost at least ``least_cost``: only budget / least_cost + 1 rows of a key can matter.

    Those come from a limit that is applied before the shuffle too, so a key's rows are never gathered.
    """
    most = budget // least_cost + 1
    rank = F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(*order))
    if keys:
        few = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
    else:
        few = rows.orderBy(*order).limit(most).withColumn("_rank", rank)
    frame = Window.partitionBy(*(keys or [])).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    return few.withColumn("running", F.sum(cost).over(frame)).where(F.col("running") <= budget).drop("_rank")


def greedy_with_notes(rows: DataFrame, cost: str, note: str, budget: int, key: str, *order: str) -> DataFrame:
    """Like a prefix budget, but each row's optional note is charged only where it still fits; one array fold per key.

    Notes only add to what rows cost, so rows beyond the plain prefix (and the one that ends it) cannot count:
    the fold sees at most that many.
    """
    few = first_within(rows.withColumn("_cost", F.greatest(F.col(cost).cast("long"), F.lit(1))), "_cost", budget, *order, keys=[key])
    items = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(cost).cast("long").alias("c"), F.col(note).cast("long").alias("n")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.lit(0).alias("taken"), F.lit(0).alias("noted"))

    def step(s, x):
        fits = ~s["full"] & (s["used"] + x["c"] <= budget)
        noted = fits & (s["used"] + x["c"] + x["n"] <= budget)
        used = s["used"] + F.when(fits, x["c"]).otherwise(0) + F.when(noted, x["n"]).otherwise(0)
        return F.struct(used.cast("long").alias("used"), (~fits).alias("full"), (s["taken"] + fits.cast("int")).alias("taken"), (s["noted"] + noted.cast("int")).alias("noted"))

    folded = items.select(key, F.aggregate("items", start, step).alias("s")).select(key, "s.used", "s.taken", "s.noted")
    return rows.select(key).distinct().join(folded, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("used", "taken", "noted")])


def brief(sections: dict[str, DataFrame], budget: int, shares: dict[str, float] | None = None) -> DataFrame:
    """Sections of ranked lines (ident, rank, line), each cut to its share: section, ident, rank, tokens."""
    out = None
    for k, (name, rows) in enumerate(sections.items()):
        own = first_within(rows.withColumn("tokens", token_estimate(F.col("line"))).where("tokens > 0"), "tokens", int(budget * (shares or SHARES)[name]), "rank", "ident")
        own = own.select(F.lit(k).alias("place"), F.lit(name).alias("section"), "ident", "rank", "tokens")
        out = own if out is None else out.unionByName(own)
    return out


def budgets(budget: int, rules: bool) -> dict[str, int]:
    """Tokens of each section of a brief; with rules memory has half, and rules the rest up to 300. A fifth of memory, up to 200, is for the project."""
    memory = budget * 5 // 100 if rules else budget * 10 // 100
    project = min(memory * 20 // 100, 200)
    return {"pivots": budget * 70 // 100, "skeletons": budget * 20 // 100, "memory": memory - project, "project": project, "rules": min(budget * 5 // 100, 300) if rules else 0}


def interleaved(members: DataFrame, limit: int, local: int = 0, percent: int = 60) -> DataFrame:
    """Federated ranking (member, ident, score): local rows first, then other members by turns.

    With rows of other members, local ones have ``percent`` of the places and never the last; without, all.
    ``rn`` is a row's place in its member. Local and other rows are limited apart, before they meet.
    """
    place = F.row_number().over(Window.partitionBy("member").orderBy(F.col("score").desc(), "ident"))
    own = members.where(F.col("member") == local).orderBy(F.col("score").desc(), "ident").limit(limit)
    others = members.where(F.col("member") != local).withColumn("rn", place).where(F.col("rn") <= limit).orderBy("rn", "member").limit(limit)
    few = own.withColumn("rn", place).unionByName(others)
    remote, some = F.col("member") != local, F.count_if(F.col("member") != local).over(Window.partitionBy())
    kept = few.withColumn("_some", some).where(remote | (F.col("_some") == 0) | (F.col("rn") <= min(limit * percent // 100, max(limit - 1, 0))))
    return kept.orderBy(remote, "rn", "member").limit(limit).drop("_some")


def head_and_tail(texts: DataFrame, text: str, head: int = 80, tail: int = 20) -> DataFrame:
    """First and last lines of each text, a row for each: pos (from 1), line, hidden (lines between). No shuffle."""
    lines, other = F.split(F.col(text), "\n"), [c for c in texts.columns if c != text]
    cut = texts.withColumn("_lines", lines).withColumn("hidden", F.greatest(F.size("_lines") - head - tail, F.lit(0)))
    first = F.slice("_lines", 1, F.when(F.col("hidden") > 0, F.lit(head)).otherwise(F.greatest(F.size("_lines"), F.lit(1))))
    last = F.when(F.col("hidden") > 0, F.slice("_lines", F.size("_lines") - tail + 1, F.lit(tail))).otherwise(F.array().cast("array<string>"))
    each = cut.select(*other, "hidden", F.posexplode(F.concat(first, last)).alias("_at", "line"))
    pos = (F.col("_at") + 1 + F.when(F.col("_at") >= head, F.col("hidden")).otherwise(0)).cast("long")
    return each.select(*other, pos.alias("pos"), "line", "hidden")


def utf8_cut(text: str, budget_tokens: int) -> str:
    """Text cut to four bytes a token, at a character boundary."""
    return text.encode()[: 4 * budget_tokens].decode(errors="ignore")


#: What follows a text that was cut (a fixed value).
CUT_NOTE = "\n(response truncated to fit token_budget)\n"


def hard_cut(text: str, budget_tokens: int) -> str:
    """A text within its budget, or its start and a note that it was cut, together within it."""
    raw = text.encode()
    if len(raw) <= 4 * budget_tokens:
        return text
    return raw[: max(0, 4 * budget_tokens - len(CUT_NOTE.encode()))].decode(errors="ignore") + CUT_NOTE
