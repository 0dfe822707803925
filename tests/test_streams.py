from pyspark.sql import functions as F

from lodestone.scratch import Scratch
from lodestone.streaming import activity as A

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark, folder, batches):
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string").select("event_id", F.timestamp_seconds("at").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        df.coalesce(1).write.mode("append").parquet(folder)
    return A.event_stream(spark, folder)


def test_one_alert_over_several_batches(spark, tmp_path):
    batches = [[(1, 10, 1, "error"), (2, 11, 2, "error"), (3, 12, 2, "purchase")], [(4, 20, 1, "error"), (5, 21, 2, "error")], [(6, 30, 1, "error"), (7, 30, 1, "error")]]
    out = A.run_to_table(A.once_per_session(stream(spark, str(tmp_path / "e"), batches), 2), Scratch(spark).at("n"))
    got = [(r.user_id, r.event_id, r.n) for r in out.collect()]
    assert len(got) == 1 and got[0][0] == 1 and got[0][2] == 2


def test_tail_and_buffer(spark, tmp_path):
    seen = []
    events = stream(spark, str(tmp_path / "e"), [[(k, k, 1, "error") for k in range(7)]])
    A.tail_batches(events, seen.append, last=5, most=3).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [[r.event_id for r in rows] for rows in seen] == [[2, 3, 4], [5, 6]]
    stream(spark, str(tmp_path / "e"), [[(k, k, 1, "error") for k in range(10, 14)]])
    again = []
    A.tail_batches(A.event_stream(spark, str(tmp_path / "e")), again.append, last=5, most=3).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for rows in again for r in rows) == [10, 11, 12, 13] and max(map(len, again)) <= 3
    buffer = A.TailBuffer(3)
    buffer.add([1, 2])
    buffer.paused = True
    assert buffer.take() == ([], 0)
    buffer.add([3, 4])
    buffer.paused = False
    assert buffer.take() == ([2, 3, 4], 1) and buffer.take() == ([], 0)


def test_hooks_are_routed(spark, tmp_path):
    lines = ['{"session_id": "s", "cwd": "/w", "hook_event_name": "Stop"}', '{"session_id": "s", "cwd": "/w", "hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_input": {"command": "ls"}}', '{"cwd": "/w"}', "no json"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "l"))
    got: dict = {}
    route = lambda name: lambda rows: got.setdefault(name, []).extend(r.tool_input for r in rows.collect())
    A.routed_hooks(spark.readStream.text(str(tmp_path / "l")), {n: route(n) for n in ("Stop", "PostToolUse")}).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert got == {"Stop": [None], "PostToolUse": ['{"command":"ls"}']}
