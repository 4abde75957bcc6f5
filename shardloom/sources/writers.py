"""Sinks: resume states, metric snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from . import versions


def write_state(states: DataFrame, path: str) -> None:
    """Appends resume states; the commit protocol makes each append atomic."""
    states.write.mode("append").partitionBy("config_name").parquet(path)


def save_newest_state(states: DataFrame, path: str, time: str = "saved_at", keep: int = 2) -> None:
    """Keeps one state per config, the newest: each call replaces what it must and no more, and a reader never sees none."""
    versions.upsert_newest(versions.Versions(states.sparkSession, path, keep), states, ("config_name",), (time,))


def read_newest_state(spark: SparkSession, path: str) -> DataFrame:
    """A row per config."""
    store = versions.Versions(spark, path)
    return store.read(store.live()).drop("part")


def write_snapshots(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Windowed metrics of a stream as Parquet, exactly once, for all that has arrived."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
