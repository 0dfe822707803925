"""SparkSession factory with the settings that every plan here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results if they differ; all others only change speed.
SEMANTIC_CONF = {"spark.sql.session.timeZone": "UTC"}

SPEED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(app: str = "lodestone", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC, AQE, Arrow and the RocksDB state store; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **SPEED_CONF, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
