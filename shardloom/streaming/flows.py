"""Streams built from the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics, scaling
from ..sources import versions


def snapshot_stream(reports: DataFrame, subs: list[tuple[str, str]], period: str = metrics.PERIOD, watermark: str = "1 minute") -> DataFrame:
    """Reports to windowed snapshots per subscriber and type; rows later than the watermark are dropped."""
    valid, _ = metrics.reject_duplicate_tags(reports)
    return metrics.window_snapshot(metrics.subscribe_small(metrics.explode_metrics(valid), subs), period, watermark)


def status_stream(updates: DataFrame) -> DataFrame:
    """The last status of each task; update mode."""
    return scaling.latest_status(updates)


CACHE = "holder long, shard long, step long, n_bytes long, arrival long"


def upsert_latest_cache(writes: DataFrame, path: str, checkpoint: str, keep: int = 2, n_parts: int = 16) -> StreamingQuery:
    """Keeps the last version per holder and shard as a table in versions (``sources.versions``).

    Each batch rewrites the parts that its keys hash to and commits a manifest under the batch's number, so
    that a batch that runs again after a failure gives the same rows.  The last ``keep`` versions stay.
    Read it with ``read_latest_cache``, also while a batch runs.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        store = versions.Versions(batch.sparkSession, path, keep)
        rows = batch.select("holder", "shard", "step", "n_bytes", "arrival")
        versions.upsert_newest(store, rows, ("holder", "shard"), ("arrival", "step"), n_parts, batch_id)

    return writes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest_cache(spark: SparkSession, path: str) -> DataFrame:
    """The newest version: holder, shard, step, n_bytes, arrival."""
    store = versions.Versions(spark, path)
    live = store.live()
    return store.read(live, CACHE).drop("part") if live else spark.createDataFrame([], CACHE)
