"""Streaming forms of the activity and hook operators. Event time with a watermark of ten minutes by default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of events (a folder, or one file of it) as a stream, one file a trigger; ``ts`` has a zone."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), str(at.getParent())
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def filtered(events: DataFrame, event_type: str | None = None, least_value: float | None = None) -> DataFrame:
    """Stateless tail filter."""
    out = events if event_type is None else events.where(F.col("event_type") == event_type)
    return out if least_value is None else out.where(F.col("value") >= least_value)


def tumbling_counts(events: DataFrame, keys: list[str], window: str = "5 minutes", least: int = 4, watermark: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling window that reach ``least``; late rows beyond the watermark are dropped."""
    counted = events.withWatermark("ts", watermark).groupBy(F.window("ts", window), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least).select(F.col("window.start").alias("start"), *keys, "n")


def session_spans(events: DataFrame, key: str, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Sessions by gap: start, end, key, n."""
    spans = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return spans.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_seen(events: DataFrame, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    """Rows whose keys have not been seen within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def once_per_session(events: DataFrame, least: int = 3, trigger: str = "error", suppress: tuple[str, ...] = ("purchase",), idle_minutes: int = 24 * 60) -> DataFrame:
    """One alert per user at the ``least``-th trigger event, never after a suppressing event: user_id, event_id, at, n.

    Rows of one trigger are taken in order of time, as columns. ``idle_minutes`` is the watermark: later rows are
    dropped, and a user without events for that long is forgotten, so state is bounded by the users of that time.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = ["user_id", "event_id", "at", "n"]

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        n, closed = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        counts = n + (rows["event_type"] == trigger).cumsum()
        stopped = rows["event_type"].isin(suppress).cumsum() > 0
        hit = rows[(counts == least) & (rows["event_type"] == trigger) & ~stopped] if not closed else rows[:0]
        state.update((int(counts.iloc[-1]), bool(closed or stopped.any() or len(hit))))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + idle_minutes * 60_000)
        yield pd.DataFrame({"user_id": key[0], "event_id": hit["event_id"], "at": hit["ts"], "n": least}, columns=names)

    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("n", T.LongType())])
    held = T.StructType([T.StructField("n", T.LongType()), T.StructField("closed", T.BooleanType())])
    timed = events.withWatermark("ts", f"{idle_minutes} minutes").groupBy("user_id")
    return timed.applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def ended_sessions(events: DataFrame, key: str, end: str, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Sessions that an ``end`` event or the gap closes, once each: key, start, at, explicit."""
    spans = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), key).agg(F.min(F.when(F.col("event_type") == end, F.col("ts"))).alias("ended"))
    return spans.select(key, F.col("session_window.start").alias("start"), F.coalesce("ended", F.col("session_window.end")).alias("at"), F.col("ended").isNotNull().alias("explicit"))


def retained(events: DataFrame, period: str = "1 hour") -> DataFrame:
    """Events that are not older than ``period`` at the time of the latest one seen before (the watermark drops the rest)."""
    return events.withWatermark("ts", period).dropDuplicatesWithinWatermark(["event_id"])


def tail_batches(events: DataFrame, show, last: int, most: int = 100):
    """Writer of a live tail: ``show`` gets rows in order, the ``last`` ones of the first batch, then at most ``most`` new ones at a time.

    The checkpoint is the cursor; what a batch has beyond ``most`` is shown in further calls.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch if batch_id else batch.orderBy(F.col("event_id").desc()).limit(last)
        for k, row in enumerate(rows.orderBy("event_id").toLocalIterator()):
            held = each.held
            held.append(row)
            if len(held) == most:
                show(list(held))
                held.clear()
        if each.held:
            show(list(each.held))
            each.held.clear()

    each.held = []
    return events.writeStream.foreachBatch(each)


class TailBuffer:
    """The latest rows of a tail, up to ``most``; how many were dropped is told once. Paused, it takes rows but shows none."""

    def __init__(self, most: int = 2000):
        from collections import deque

        self.rows, self.dropped, self.paused = deque(maxlen=most), 0, False

    def add(self, rows: list) -> None:
        self.dropped += max(0, len(self.rows) + len(rows) - self.rows.maxlen)
        self.rows.extend(rows)

    def take(self) -> tuple[list, int]:
        if self.paused:
            return [], 0
        out, dropped = list(self.rows), self.dropped
        self.rows.clear()
        self.dropped = 0
        return out, dropped


def routed_hooks(lines: DataFrame, routes: dict, value: str = "value"):
    """Writer that sends hook payloads (JSON lines) by event name: ``routes`` maps a name to a function of the rows."""
    from lodestone.operators.logs import parsed_hooks

    def each(batch: DataFrame, _: int) -> None:
        hooks = parsed_hooks(batch, value).persist()
        for name, handle in routes.items():
            handle(hooks.where(F.col("hook_event_name") == name))
        hooks.unpersist()

    return lines.writeStream.foreachBatch(each)


def correlated(events: DataFrame, left: str, right: str, seconds: int = 120, watermark: str = "10 minutes") -> DataFrame:
    """Pairs of a left event and an earlier right event of one user within ``seconds``: a stream-stream interval join."""
    a = events.where(F.col("event_type") == left).select(F.col("event_id").alias("a"), "user_id", F.col("ts").alias("ta")).withWatermark("ta", watermark)
    b = events.where(F.col("event_type") == right).select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("ts").alias("tb")).withWatermark("tb", watermark)
    return a.join(b, F.expr(f"user_id = ub AND tb <= ta AND tb >= ta - INTERVAL {seconds} SECONDS")).select("a", "b", "user_id")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drain a stream of what there is into Parquet in the shared folder; return the table."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
