"""Slices handed out on a stream against the batch form."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from shardloom.operators import scaling, slices
from shardloom.plans import fixtures
from shardloom.plans.registry import Tables
from shardloom.streaming import dispatch, stateful


def tables(spark):
    t = Tables(spark, DATA)
    requests = fixtures.requests(t).withColumns({"job": F.lit("j"), "ts": F.col("ts").cast("timestamp")})
    control = fixtures.control(t).withColumns({"job": F.lit("j"), "ts": F.col("ts").cast("timestamp")})
    plan = spark.range(150).select(F.lit("j").alias("job"), F.col("id").alias("rank"), (F.col("id") * 10).alias("slice_id"))
    return requests, control, plan


@pytest.mark.parametrize("patience", [None, 60, 7_200])
def test_stream_equals_batch_over_restarts(spark, tmp_path, patience):
    requests, control, plan = tables(spark)
    batch = slices.dispatch_outcomes(requests, control, plan.select(F.col("rank").alias("pos"), "slice_id"), patience)
    times = [r["ts"] for r in requests.orderBy("ts").collect()]
    edges = [None, times[len(times) // 3], times[2 * len(times) // 3], None]
    asked, told = requests.select("job", "ts", "request_id", "task"), control.select("job", "ts", "control_id", "action")
    closing = told.orderBy(F.col("ts").desc()).limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 3 days"), "control_id": F.lit(10**9), "action": F.lit("stop"), "job": F.lit("other")})  # moves the watermark on

    def part(df, name, low, high):
        kept = df.where(F.lit(True) if low is None else F.col("ts") > F.lit(low)).where(F.lit(True) if high is None else F.col("ts") <= F.lit(high))
        kept.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    for low, high in zip(edges, edges[1:], strict=False):  # the stream is started anew for each part
        part(asked, "asked", low, high)
        part(told, "told", low, high)
        if high is None:
            closing.write.mode("append").parquet(str(tmp_path / "told"))
        for _ in range(2):  # the second run finds nothing new but what timers bring
            stream = dispatch.dispatch_stream(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "asked")), spark.readStream.schema(told.schema).parquet(str(tmp_path / "told")), plan, patience)
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert rows(found.select("request_id", "task", "status", "slice_id")) == rows(batch)
    given = [r["slice_id"] for r in found.where("slice_id is not null").collect()]
    assert len(given) == len(set(given)) == 150


def test_patience(spark):
    ts = lambda s: F.timestamp_seconds(F.lit(s))
    asked = spark.range(6).select(F.col("id").alias("request_id"), F.lit("t").alias("task"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    told = spark.range(1).select(ts(5).alias("ts"), F.lit(1).cast("long").alias("control_id"), F.lit("start").alias("action"))
    told = told.unionByName(told.select(ts(15).alias("ts"), F.lit(2).cast("long").alias("control_id"), F.lit("stop").alias("action")))
    told = told.unionByName(told.limit(1).select(ts(40).alias("ts"), F.lit(3).cast("long").alias("control_id"), F.lit("start").alias("action")))
    plan = spark.range(3).select(F.col("id").alias("pos"), F.col("id").alias("slice_id"))
    found = {r["request_id"]: (r["status"], r["slice_id"]) for r in slices.dispatch_outcomes(asked, told, plan, 10).collect()}
    assert found == {0: ("UNAVAILABLE", None), 1: ("OK", 0), 2: ("RETRY_LATER", None), 3: ("OK", 1), 4: ("OK", 2), 5: ("OUT_OF_RANGE", None)}


def test_presence_stream_equals_batch_over_restarts(spark, tmp_path):
    updates = Tables(spark, DATA).events.select(F.concat(F.lit("t"), F.col("user_id") % 25).alias("task"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 7 > 0, F.floor(F.col("event_id") / 300).cast("string")).alias("uid"))
    closing = updates.orderBy(F.col("ts").desc()).limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 30 days"), "task": F.lit("other")})
    every = updates.unionByName(closing)
    cut = [r["ts"] for r in updates.orderBy("ts").collect()]
    cut = [cut[len(cut) // 3], cut[2 * len(cut) // 3]]
    kinds = F.when(F.col("ts") <= F.lit(cut[0]), 0).when(F.col("ts") <= F.lit(cut[1]), 1).otherwise(2)
    for i in range(3):
        every.where(kinds == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            stream = stateful.task_presence_stream(spark.readStream.schema(every.schema).parquet(str(tmp_path / "in")), 40_000)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    batch = scaling.task_presence(every, 40_000)
    assert {r["change"] for r in batch.select("change").distinct().collect()} == {"added", "lost", "returned", "replaced"}
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)) == rows(batch)
