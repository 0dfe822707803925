"""Catalogue: streaming queries, drained over what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.views import query
from lodestone.scratch import Scratch
from lodestone.streaming import activity as A


def _events(spark, d):
    return A.event_stream(spark, f"{d}/events.parquet")


def _drained(stream, name):
    return A.run_to_table(stream, Scratch(stream.sparkSession).at(name))


@query("stream_filter", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' AND value >= 100")
def stream_filter(spark, d):
    return _drained(A.filtered(_events(spark, d), "error", 100.0).select("event_id", "event_type", "value"), "filter")


@query("stream_tumbling", "WITH b AS (SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_at, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM b WHERE n >= 4 AND start_at + 86400 <= (SELECT floor(epoch(max(ts))) - 600 FROM events)")
def stream_tumbling(spark, d):
    out = _drained(A.tumbling_counts(_events(spark, d), ["user_id"], "1 day", 4), "tumbling")
    return out.select("user_id", F.unix_timestamp("start").alias("start_at"), "n")


@query("stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(spark, d):
    e = _events(spark, d)
    return _drained(A.first_seen(e.unionByName(e), ["event_id"]).select("event_id"), "dedup").agg(F.count(F.lit(1)).alias("n"))


@query("stream_nudge", """WITH o AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS p, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT user_id, CAST(n AS BIGINT) AS n, event_id FROM o WHERE event_type = 'error' AND n = 2 AND p = 0""")
def stream_nudge(spark, d):
    return _drained(A.once_per_session(_events(spark, d), 2), "nudge").select("user_id", "n", "event_id")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_at, bool_or(event_type = 'purchase') AS explicit FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""")
def stream_sessions(spark, d):
    out = _drained(A.ended_sessions(_events(spark, d), "user_id", "purchase"), "sessions")
    return out.select("user_id", F.unix_timestamp("start").alias("start_at"), "explicit")


@query("stream_correlated", "SELECT a.event_id AS a, b.event_id AS b, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 7200 SECONDS")
def stream_correlated(spark, d):
    return _drained(A.correlated(_events(spark, d), "error", "click", 7200), "correlated")
