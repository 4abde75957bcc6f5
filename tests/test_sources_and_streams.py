"""Readers and writers on small files; streams against the batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from shardloom import sources
from shardloom.operators import backup, metrics, scaling
from shardloom.plans import fixtures, metric_queries
from shardloom.plans.registry import Tables
from shardloom.streaming import flows, stateful


def test_listing_manifests_lines_and_slices(spark, tmp_path):
    for d, names in (("a", ["f1", "f +0%", "_hidden"]), ("b", ["g0"])):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(f"{d}/{n} 1\n{d}/{n} 2\n")
    dirs = [str(tmp_path / d) for d in "ab"]
    listing = sources.list_files(spark, dirs)
    assert rows(listing.select("dir_ord", "name")) == [(0, "f +0%"), (0, "f1"), (1, "g0")]
    cases = {"ok": {"FileCount": 2, "FileDir": dirs[0], "FileList": ["f +0%", "f1"]}, "no FileCount": {"FileList": ["f0"]}, "no FileList": {"FileCount": 1}, "count differs": {"FileCount": 3, "FileDir": dirs[0], "FileList": ["f0"]}, "files missing": {"FileCount": 1, "FileDir": dirs[1], "FileList": ["zz"]}}
    paths = []
    for i, body in enumerate(cases.values()):
        paths.append(str(tmp_path / f"m{i}.json"))
        (tmp_path / f"m{i}.json").write_text(json.dumps(body))
    manifests, files = sources.read_file_manifest(spark, paths)
    status = sources.check_manifests(manifests, listing)
    assert [r["status"] for r in status.orderBy("manifest").collect()] == list(cases)
    assert files.count() == 5
    assert sources.read_lines(spark, dirs[0]).count() == 4
    chosen = spark.createDataFrame([(7, 0, f"{dirs[0]}/f1"), (8, 0, f"{dirs[1]}/g0"), (9, 1, f"{dirs[0]}/f +0%")], "slice_id long, epoch int, path string")
    found = sources.read_slices(spark, chosen, dirs)
    assert rows(found.select("slice_id", "value")) == [(7, "a/f1 1"), (7, "a/f1 2"), (8, "b/g0 1"), (8, "b/g0 2"), (9, "a/f +0% 1"), (9, "a/f +0% 2")]


def test_samples(spark, tmp_path):
    (tmp_path / "s.csv").write_text("1," + ",".join(["0.5"] * 13) + "," + ",".join("abcdefghijklmnopqrstuvwxyz") + "\n" + "," * 39 + "\n")
    df = sources.read_samples_csv(spark, str(tmp_path / "s.csv"))
    empty = df.where("clicked = 0").first()
    assert (empty["clicked"], empty["I1"], empty["C1"]) == (0, 0.0, " ") and df.count() == 2
    df.write.parquet(str(tmp_path / "p"))
    assert rows(sources.read_samples_parquet(spark, str(tmp_path / "p"))) == rows(df)


def test_states_and_variables(spark, tmp_path):
    states = spark.createDataFrame([("c", 1, 2, 3)], "config_name string, epoch_index long, slice_index long, shuffle_seed long")
    for _ in range(2):
        sources.write_state(states, str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "st")).count() == 2
    (tmp_path / "v.json").write_text('{"name": "w", "shape": [3, 4], "dtype": "float"}\n')
    assert tuple(sources.read_variable_manifest(spark, str(tmp_path / "v.json")).first()) == ("w", [3, 4], "float")


def files_of(df, path, n=1):
    df.repartition(n).write.json(str(path))
    return str(path)


def run(stream, name, mode, tmp_path):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start().awaitTermination()


def test_snapshots_stream_equals_batch(spark, tmp_path):
    t = Tables(spark, DATA)
    reports = fixtures.reports(t).drop("event_id")
    closing = reports.orderBy(F.col("ts").desc()).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 1 day"))  # closes the last window
    path = files_of(reports.unionByName(closing).orderBy("ts").coalesce(1), tmp_path / "in")
    stream = flows.snapshot_stream(sources.read_metric_stream(spark, path), metric_queries.SUBS, watermark="1 minute")
    query = sources.write_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    batch = metrics.window_snapshot(metric_queries.subscribed(t))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)) == rows(batch)


def test_status_stream(spark, tmp_path):
    t = Tables(spark, DATA)
    updates = metric_queries.status_updates(t)
    path = files_of(updates, tmp_path / "u", 3)
    run(flows.status_stream(spark.readStream.schema(updates.schema).json(path)), "status", "complete", tmp_path)
    assert rows(spark.table("status")) == rows(scaling.latest_status(updates))


def test_controller_stream(spark, tmp_path):
    t = Tables(spark, DATA)
    events = metric_queries.control_events(t).where("job in ('job-1', 'job-2', 'job-3')")
    path = files_of(events.orderBy("event_id").coalesce(1), tmp_path / "e")
    run(stateful.scaling_controller_stream(spark.readStream.schema(events.schema).json(path), 86_400), "controller", "append", tmp_path)
    assert rows(spark.table("controller")) == rows(scaling.scaling_controller(events, 86_400))


def test_periodic_stream_over_batches(spark, tmp_path):
    data = spark.range(60).select((F.col("id") % 2).cast("string").alias("task"), F.col("id").alias("step"))
    for i in range(3):
        data.where(f"step >= {20 * i} and step < {20 * (i + 1)}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).json(str(tmp_path / "in"))
    run(stateful.every_n_steps_stream(stream, 7), "periodic", "append", tmp_path)
    assert rows(spark.table("periodic")) == rows(scaling.every_n_steps(data, 7))


def test_latest_cache_stream(spark, tmp_path):
    writes = fixtures.ckpt_writes(Tables(spark, DATA))
    for i in range(2):
        writes.where(f"step % 2 = {i}").coalesce(1).write.mode("append").json(str(tmp_path / "w"))
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "w"))
    flows.upsert_latest_cache(stream, str(tmp_path / "c"), str(tmp_path / "ck")).awaitTermination()
    assert rows(flows.read_latest_cache(spark, str(tmp_path / "c")).select("holder", "shard", "step", "n_bytes")) == rows(backup.latest_cache(writes))


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_driver_contract(spark, name):
    import __spark_entry__ as e

    found = getattr(e, name)(spark) if name == "entry" else getattr(e, name)()
    assert found.count() > 0 if name == "entry" else found
    assert set(e.oracle_sql()) <= set(e.queries())
