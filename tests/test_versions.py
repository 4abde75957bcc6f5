"""Tables in versions: readers beside writers, commits that die or run again, shards that don't change."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from shardloom import sources
from shardloom.operators import backup, reshard
from shardloom.plans import fixtures
from shardloom.plans.registry import Tables
from shardloom.sources.versions import Versions, upsert_newest
from shardloom.streaming import flows

KEYS, ORDER = ("holder", "shard"), ("arrival", "step")


def writes(spark):
    return fixtures.ckpt_writes(Tables(spark, DATA))


def latest(store):
    return rows(store.read(store.live()).select("holder", "shard", "step", "n_bytes"))


def test_reader_beside_a_writer_sees_whole_versions(spark, tmp_path, monkeypatch):
    store, w = Versions(spark, f"file://{tmp_path}/t"), writes(spark)
    upsert_newest(store, w.where("step % 2 = 0"), KEYS, ORDER, 3)
    first, reader = latest(store), store.read(store.live())
    seen, commit = [], Versions.commit

    def late(self, parts, number=None):
        seen.append(latest(self))  # all of the batch is written, the manifest isn't
        return commit(self, parts, number)

    monkeypatch.setattr(Versions, "commit", late)
    upsert_newest(store, w.where("step % 2 = 1"), KEYS, ORDER, 3)
    assert seen == [first] and latest(store) == rows(backup.latest_cache(w))
    assert rows(reader.select("holder", "shard", "step", "n_bytes")) == first  # the version before is still there


def test_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store, w = Versions(spark, str(tmp_path / "t")), writes(spark)
    upsert_newest(store, w.where("step % 2 = 0"), KEYS, ORDER, 3)
    before = latest(store)
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            upsert_newest(store, w.where("step % 2 = 1"), KEYS, ORDER, 3)
    assert latest(store) == before
    upsert_newest(store, w.where("step % 2 = 1"), KEYS, ORDER, 3)
    assert latest(store) == rows(backup.latest_cache(w))


def test_batch_that_runs_again_starts_from_the_version_before(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"))
    row = lambda *r: spark.createDataFrame(list(r), "holder long, shard long, step long, n_bytes long, arrival long")
    upsert_newest(store, row((0, 0, 5, 1, 10)), KEYS, ORDER, 2, 0)
    for _ in range(2):  # the same number twice, the second time with less: what the first wrote doesn't count
        upsert_newest(store, row((0, 0, 9, 1, 30), (1, 1, 1, 1, 1)) if _ == 0 else row((0, 0, 7, 1, 20)), KEYS, ORDER, 2, 1)
    assert latest(store) == [(0, 0, 7, 1)]


def test_old_versions_go_and_untouched_parts_stay(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"), keep=2)
    row = lambda k, v: spark.createDataFrame([(k, v)], "k long, v long")
    for k in range(40):
        if k < 8 or k % 4 == 0:
            upsert_newest(store, row(k % 8, k), ("k",), ("v",), 4)
    parts = store.live()
    upsert_newest(store, row(0, 99), ("k",), ("v",), 4)
    changed = [p for p in parts if store.live()[p] != parts[p]]
    assert len(changed) == 1 and len(store.manifests()) == 2
    there = {f"{c.name}/{p.name}" for c in (tmp_path / "t/data").iterdir() for p in c.glob("part=*")}
    assert there == set(parts.values()) | set(store.live().values())
    assert rows(store.read(store.live()).select("k", "v")) == sorted([(0, 99), (4, 36), *((k, k) for k in (1, 2, 3, 5, 6, 7))], key=repr)


def test_stream_of_upserts_and_its_reader(spark, tmp_path):
    w = writes(spark)
    for i in range(3):
        w.where(f"step % 3 = {i}").coalesce(1).write.mode("append").json(str(tmp_path / "w"))
    assert flows.read_latest_cache(spark, str(tmp_path / "c")).count() == 0
    stream = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "w"))
    flows.upsert_latest_cache(stream, str(tmp_path / "c"), str(tmp_path / "ck"), n_parts=5).awaitTermination()
    assert rows(flows.read_latest_cache(spark, str(tmp_path / "c")).select("holder", "shard", "step", "n_bytes")) == rows(backup.latest_cache(w))
    assert len({n for n, _ in Versions(spark, str(tmp_path / "c")).manifests()}) == 2


def test_one_state_per_config(spark, tmp_path):
    for i in range(5):
        sources.save_newest_state(spark.createDataFrame([("a", i, i), (f"b{i}", 7, i)], "config_name string, slice_index long, saved_at long"), str(tmp_path / "s"))
    sources.save_newest_state(spark.createDataFrame([("a", 99, 0)], "config_name string, slice_index long, saved_at long"), str(tmp_path / "s"))  # older
    found = sources.read_newest_state(spark, str(tmp_path / "s"))
    assert rows(found.where("config_name = 'a'").select("slice_index")) == [(4,)] and found.count() == 6


def stored(spark, tmp_path):
    keys = [k for k in range(60) if k % 12 not in (5, 7, 9)]  # of 4 shards and of 6, shard 1 has the same keys
    table = spark.createDataFrame([("v", k, [float(k)] * 4, 0, 0, k % 4) for k in keys], "var string, key long, value array<float>, version long, freq long, part int")
    slot = table.where("key % 2 = 0").select("var", "key", "part", F.col("value").alias("acc"))
    store = Versions(spark, str(tmp_path / "emb"))
    reshard.store_tables(store, table, {"adagrad": slot})
    return store, table, slot


def files(store, name, part):
    return {r[0] for r in reshard.stored_table(store, name).where(f"part = {part}").select(F.input_file_name()).distinct().collect()}


def test_reshard_stored_writes_changed_shards_only(spark, tmp_path):
    store, table, slot = stored(spark, tmp_path)
    before = files(store, "primary", 1)
    changed = reshard.reshard_stored(store, 6)
    assert 1 not in changed and before == files(store, "primary", 1) != set()
    assert rows(reshard.stored_table(store, "primary").select("key", "part", "value")) == rows(reshard.reshard(table, 6).select("key", "part", "value"))
    assert rows(reshard.stored_table(store, "adagrad").select("key", "part", "acc")) == rows(slot.select("key", (F.col("key") % 6).cast("int").alias("part"), "acc"))
    assert reshard.reshard_stored(store, 6) == []
    reshard.reshard_stored(store, 2)
    assert rows(reshard.stored_table(store, "primary").select("part").distinct()) == [(0,), (1,)]
    assert reshard.stored_table(store, "primary").count() == table.count()


def test_reshard_killed_between_slots_and_primary(spark, tmp_path, monkeypatch):
    store, table, slot = stored(spark, tmp_path)
    write, done = Versions.write, []

    def dies(self, df, part="part"):
        if done:
            raise OSError("killed")
        done.append(1)
        return write(self, df, part)

    with monkeypatch.context() as m:
        m.setattr(Versions, "write", dies)
        with pytest.raises(OSError, match="killed"):
            reshard.reshard_stored(store, 6)
    assert done and rows(reshard.stored_table(store, "primary").select("key", "part")) == rows(table.select("key", "part"))
    assert reshard.stored_table(store, "adagrad").count() == slot.count()
    reshard.reshard_stored(store, 6)
    assert rows(reshard.stored_table(store, "primary").select("key", "part")) == rows(reshard.reshard(table, 6).select("key", "part"))
    assert reshard.stored_table(store, "adagrad").count() == slot.count()


def test_import_keeps_the_newest_of_repeated_keys(spark):
    schema = "var string, key long, value array<float>, version long, freq long, part int"
    table = spark.createDataFrame([("v", 1, [0.0], 0, 0, 0)], schema)
    moved = spark.createDataFrame([("v", 3, [float(i)], i, 0, 0, 1) for i in range(5)], schema + ", to_part int")
    assert rows(reshard.reshard_import(table, moved).select("key", "version", "part", "value")) == [(1, 0, 0, [0.0]), (3, 4, 1, [4.0])]


def test_large_blobs_come_back_as_bytes(spark):
    blob = bytes(range(256)) * 20_000
    df = spark.createDataFrame([(1, blob), (2, b""), (3, b"x" * 1000)], "id long, blob binary")
    assert {r["id"]: bytes(r["blob"]) for r in backup.assemble_blobs(backup.chunk_blobs(df, 1000)).collect()} == {1: blob, 2: b"", 3: b"x" * 1000}
