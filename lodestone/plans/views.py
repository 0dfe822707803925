"""Engine tables built from the star-schema tables, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.memory import default_importance
from lodestone.operators.search import STOP_WORDS

REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    """Register a query with its SQL; tables of ``PREFIX`` may be used there."""

    def add(f):
        REGISTRY[name] = (f, with_tables(sql) if sql else None)
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def events(spark, d) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"), "user_id", "event_type", "value", _k().alias("k"), (F.col("event_type") == "error").alias("is_error"))


def obs(spark, d) -> DataFrame:
    e, k = events(spark, d), F.col("k")
    kind = F.when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "view", "context_retrieval").when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "signup", "insight").otherwise("file_change")
    file = F.when(k % 5 != 0, F.concat(F.lit("src/f"), (k % 20).cast("string"), F.lit(".rs")))
    return e.select(
        F.col("event_id").alias("obs_id"), F.col("user_id").alias("session_id"), "created_at", kind.alias("kind"), F.concat("event_type", F.lit(" "), k.cast("string")).alias("content"), file.alias("file_path"),
        F.when(k % 3 != 0, F.concat(file, F.lit("::s"), k.cast("string"))).alias("symbol_fqn"), F.when(k % 4 == 1, "main").when(k % 4 == 2, "dev").alias("branch"), F.when(k % 7 != 0, F.least(F.col("value") / 100, F.lit(1.0))).alias("confidence"),
        (F.col("value") < 1).alias("is_stale"), F.col("event_type").isin("click", "view", "error").alias("auto_generated"), F.lit(None).cast("long").alias("consolidated_into"), F.lit(0).alias("consolidation_count"), F.lit(None).cast("string").alias("stale_reason"),
    ).withColumn("importance", default_importance(F.col("kind")))


def sessions(spark, d) -> DataFrame:
    g = events(spark, d).groupBy(F.col("user_id").alias("session_id")).agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("last_at"))
    return g.select("session_id", "started_at", F.when(F.col("session_id") % 10 != 0, F.col("last_at")).alias("ended_at"), (F.col("session_id") % 3 == 0).alias("compressed"))


def now_of(spark, d) -> int:
    """The latest event's second: the injected clock of the catalogue."""
    return events(spark, d).agg(F.max("created_at")).first()[0]


CUSTOMER, ORDER, PART, SUPPLIER, NATION, REGION = (k * 1_000_000_000 for k in range(1, 7))


#: Estimated bytes of edges that one task makes distinct and sorts.
EDGES_PART = 32 << 20


def edges(spark, d, by: str | None = None) -> DataFrame:
    """Distinct edges, in parts that grow in number with the tables; a caller that goes on by one end names it in ``by``."""
    orders, lines = t(spark, d, "orders"), t(spark, d, "lineitem")
    e = lambda df, a, b, kind: df.select(a.cast("long").alias("source"), b.cast("long").alias("target"), F.lit(kind).alias("kind"))
    parts = [
        e(orders, F.col("o_custkey") + CUSTOMER, F.col("o_orderkey") + ORDER, "calls"), e(lines, F.col("l_orderkey") + ORDER, F.col("l_partkey") + PART, "uses_type"),
        e(lines, F.col("l_partkey") + PART, F.col("l_suppkey") + SUPPLIER, "implements"), e(t(spark, d, "nation"), F.col("n_nationkey") + F.lit(NATION).cast("long"), F.col("n_regionkey") + F.lit(REGION).cast("long"), "extends"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    size = int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // EDGES_PART))
    return out.repartition(parts, *([by] if by else out.columns)).distinct()


def nodes(spark, d) -> DataFrame:
    return ends(edges(spark, d))


def ends(e: DataFrame) -> DataFrame:
    return e.select(F.col("source").alias("node")).union(e.select("target")).distinct()


TABLES = {
    "ev": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type = 'error' AS is_error FROM events",
    "obs0": """SELECT event_id AS obs_id, user_id AS session_id, created_at,
      CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'context_retrieval' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'insight' ELSE 'file_change' END AS kind,
      event_type || ' ' || k AS content, CASE WHEN k % 5 <> 0 THEN 'src/f' || (k % 20) || '.rs' END AS file_path, k,
      CASE WHEN k % 4 = 1 THEN 'main' WHEN k % 4 = 2 THEN 'dev' END AS branch, CASE WHEN k % 7 <> 0 THEN least(value / 100, 1.0) END AS confidence,
      value < 1 AS is_stale, event_type IN ('click', 'view', 'error') AS auto_generated, CAST(NULL AS BIGINT) AS consolidated_into FROM ev""",
    "obs": """SELECT *, CASE WHEN k % 3 <> 0 AND file_path IS NOT NULL THEN file_path || '::s' || k END AS symbol_fqn,
      CASE kind WHEN 'decision' THEN 'high' WHEN 'insight' THEN 'medium' ELSE 'low' END AS importance FROM obs0""",
    "sess": "SELECT user_id AS session_id, min(created_at) AS started_at, CASE WHEN user_id % 10 <> 0 THEN max(created_at) END AS ended_at, user_id % 3 = 0 AS compressed FROM ev GROUP BY user_id",
    "clock": "SELECT max(created_at) AS now FROM ev",
    "edges": f"""SELECT CAST(o_custkey + {CUSTOMER} AS BIGINT) AS source, CAST(o_orderkey + {ORDER} AS BIGINT) AS target, 'calls' AS kind FROM orders
      UNION SELECT l_orderkey + {ORDER}, l_partkey + {PART}, 'uses_type' FROM lineitem UNION SELECT l_partkey + {PART}, l_suppkey + {SUPPLIER}, 'implements' FROM lineitem
      UNION SELECT CAST(n_nationkey AS BIGINT) + {NATION}, CAST(n_regionkey AS BIGINT) + {REGION}, 'extends' FROM nation""",
    "nodes": "SELECT source AS node FROM edges UNION SELECT target FROM edges",
    "dt": f"SELECT doc_id, source, lang, list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda x: strlen(x) >= 3 AND x NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})) AS words FROM documents",
}
_NEEDS = {"obs0": ["ev"], "obs": ["ev", "obs0"], "sess": ["ev"], "clock": ["ev"], "nodes": ["edges"]}


def with_tables(sql: str) -> str:
    """SQL with the tables it names put in front; ``sql`` may begin with its own WITH [RECURSIVE] list."""
    import re

    used: list[str] = []
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            used += [x for x in [*_NEEDS.get(name, []), name] if x not in used]
    order = [n for n in TABLES if n in used]
    front = ", ".join(f"{n} AS ({TABLES[n]})" for n in order)
    body = sql.strip()
    m = re.match(r"WITH (RECURSIVE )?", body)
    if m:
        return f"WITH {m[1] or ''}{front}{', ' if front else ''}{body[m.end():]}"
    return f"WITH {front} {body}" if front else body
