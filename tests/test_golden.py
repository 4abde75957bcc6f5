"""Fixed expectations and properties of the operators."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from shardloom.functions import indexing, scalars
from shardloom.functions.indexing import as_of, global_index
from shardloom.operators import backup, capacity, evaluation, features, gradients, metrics, reshard, scaling, slices
from shardloom.sources import readers

MB = 1024 * 1024


def emb(spark, n, parts, dim=8):
    data = [("v", k, [1.0] * dim, 0, 0, k % parts) for k in range(n)]
    return spark.createDataFrame(data, "var string, key long, value array<float>, version long, freq long, part int")


@pytest.mark.parametrize(("n_old", "n_new", "before", "after"), [(2, 3, [3, 3], [2, 2, 2]), (3, 2, [2, 2, 2], [3, 3])])
def test_embedding_rows_per_shard(spark, n_old, n_new, before, after):
    table = emb(spark, 6, n_old)
    assert [r[1] for r in rows(reshard.shard_sizes(table))] == before
    moved = reshard.reshard_export(table, n_new)
    once = reshard.reshard_import(table, moved)
    assert [r[1] for r in rows(reshard.shard_sizes(once))] == after
    assert rows(reshard.reshard_import(once, moved).select("key", "part")) == rows(once.select("key", "part"))
    assert rows(once.select("key", "part")) == rows(reshard.reshard(table, n_new).select("key", "part"))


def test_reshard_twice_is_reshard_once(spark):
    table = emb(spark, 50, 4)
    twice = reshard.reshard(reshard.reshard(table, 7), 3)
    assert rows(twice.select("key", "part")) == rows(reshard.reshard(table, 3).select("key", "part"))


@pytest.mark.parametrize(("parts", "ids", "touched"), [(2, [0, 1, 2, 5, 6, 9], [0, 1, 3, 6, 8, 10]), (3, range(6), [0, 1, 4, 5, 8, 9]), (2, range(6), [0, 1, 2, 6, 7, 8])])
def test_adagrad_on_mod_layout(spark, parts, ids, touched):
    rows_ = spark.createDataFrame([(i,) for i in ids], "id long").select(reshard.dense_mod_layout(F.col("id"), 12, parts).alias("key"), F.array(F.lit(2.0)).alias("grad"))
    table = spark.range(12).select(F.col("id").alias("key"), F.array(F.lit(1.0)).alias("value"))
    slot = table.select("key", F.array(F.lit(0.1)).alias("acc"))
    found = {r["key"]: r["value"][0] for r in gradients.apply_adagrad(table, slot, rows_, 0.1).collect()}
    assert sorted(k for k, v in found.items() if v != 1.0) == touched
    assert all(abs(found[k] - 0.90122706) < 1e-6 for k in touched)


@pytest.mark.parametrize(("n", "cuts"), [(3, [(0, 4), (4, 4), (8, 4)]), (2, [(0, 6), (6, 6)]), (5, [(0, 3), (3, 3), (6, 2), (8, 2), (10, 2)])])
def test_part_sizes_are_prefix_sums(spark, n, cuts):
    found = reshard.part_sizes(spark.createDataFrame([("v", 12)], "var string, num_rows long"), n)
    assert [(r["start"], r["length"]) for r in found.orderBy("part").collect()] == cuts
    split = reshard.dense_split(spark.range(12).select(F.col("id").alias("row_id")), 12, n)
    assert sorted({(r["part_offset"], r["part_length"]) for r in split.collect()}) == cuts
    assert rows(reshard.dense_gather(split.select("part", "local_row")).select("row_id")) == [(i,) for i in sorted(range(12), key=lambda i: repr((i,)))]


@given(st.integers(0, 39), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_div_rule_tiles(total, n):
    base, extras = divmod(total, n)
    shard = lambda i: max(i // (base + 1), (i - extras) // base) if base else i
    sizes = [sum(shard(i) == p for i in range(total)) for p in range(n)]
    assert sizes == [base + (p < extras) for p in range(n)]


def test_manifest_text(spark):
    found = reshard.shape_and_slice(spark.createDataFrame([("v", [30, 16])], "var string, dims array<long>"), 2)
    assert [r["shape_and_slice"] for r in found.orderBy("part").collect()] == ["30 16 0,15:0,16", "30 16 15,15:0,16"]


def test_stitch_inverts_partition(spark):
    bags = spark.createDataFrame([(1, [5, 3, 5, 8]), (2, [0]), (3, [7, 7])], "row_id long, ids array<long>")
    assert rows(reshard.dynamic_stitch(reshard.dynamic_partition(bags, 3))) == rows(bags)


@pytest.mark.parametrize(
    ("old", "memory", "new", "action"),
    [
        (4, [0.85, 0.5, 0.5, 0.5], 6, "SCALING_UP"), (4, [0.65, 0.65, 0.5, 0.5], 8, "SCALING_UP"), (10, [0.65] * 5 + [0.5] * 5, 12, "SCALING_UP"), (90, [0.65] * 45 + [0.5] * 45, 100, "SCALING_UP"),
        (4, [0.3] * 3 + [0.5], 2, "SCALING_DOWN"), (3, [0.3, 0.3, 0.5], 2, "SCALING_DOWN"), (4, [0.3, 0.3, 0.5, 0.5], 4, "NORMAL"), (4, [0.5] * 4, 4, "NORMAL"), (7, [], 7, "NORMAL"),
    ],
)
def test_decision_table(spark, old, memory, new, action):
    data = [("j", f"ps#{i}", 1, m * 100) for i, m in enumerate(memory)]
    snapshot = spark.createDataFrame(data, "job string, task string, ts long, value double")
    found = scaling.scaling_decision(scaling.classify_servers(snapshot, 100 * MB), spark.createDataFrame([("j", old)], "job string, old_n long"))
    assert rows(found) == [("j", old, new, action)]


def test_servers_acted_on_may_still_go_down(spark):
    snapshot = spark.createDataFrame([("j", "ps#0", 1, 90.0), ("j", "ps#1", 1, 10.0)], "job string, task string, ts long, value double")
    already = snapshot.select("job", "task")
    assert [r[3] for r in rows(scaling.classify_servers(snapshot, 100 * MB, already))] == ["fit", "down"]


def test_controller_cooldown_and_second_scale_down():
    c = scaling.Controller()
    step = lambda kind, ts, action=None, n=None, clear=True: c.step(kind, ts, n, action, ("ps#1",), 300, clear)
    assert step("decision", 0, "SCALING_DOWN", 2) == "PENDING"
    assert step("decision", 299, "SCALING_DOWN", 2) == "WAITING"
    assert step("decision", 300, "SCALING_DOWN", 2) == "FIRED"
    assert (c.phase, c.pending_down) == ("SCALING", False)
    assert step("decision", 301, "SCALING_UP", 4) == "IGNORED"
    assert step("closed", 400) == "CLOSED"
    assert step("decision", 500, "SCALING_UP", 4) == "WAITING"
    assert step("decision", 700, "SCALING_UP", 4) == "FIRED"
    assert (c.phase, c.target, c.acted) == ("ACQUIRE_RESOURCE", 4, {"ps#1"})
    assert step("acquired", 701) == "ACQUIRED"


def test_uncleared_flag_is_an_option():
    c = scaling.Controller(pending_down=True)
    c.step("decision", 0, 2, "SCALING_DOWN", (), 300, False)
    assert c.pending_down


def test_batch_controller_equals_a_loop(spark):
    events = spark.createDataFrame([("a", i, float(i * 100), "decision", 3, "SCALING_DOWN" if i % 2 else "NORMAL", []) for i in range(12)], "job string, event_id long, t double, kind string, new_n long, action string, servers array<string>")
    found = scaling.scaling_controller(events.withColumn("ts", F.timestamp_seconds("t")).drop("t"))
    c = scaling.Controller()
    wanted = [c.step("decision", i * 100.0, 3, "SCALING_DOWN" if i % 2 else "NORMAL", (), 300, True) for i in range(12)]
    assert [r["outcome"] for r in found.orderBy("event_id").collect()] == wanted


def test_every_n_steps_equals_a_loop(spark):
    steps = [0, 3, 4, 5, 9, 10, 14, 15, 30]
    found = scaling.every_n_steps(spark.createDataFrame([("t", s) for s in steps], "task string, step long"), 5)
    last, wanted = None, []
    for s in steps:
        if last is None or s - last >= 5:
            last = s
            wanted.append(("t", s))
    assert rows(found) == sorted(wanted, key=repr)


def test_epochs_are_permutations_and_resume_covers_once(spark):
    files = spark.createDataFrame([(f"d{i % 3}", i % 3, f"f{i:03d}") for i in range(35)], "prefix string, dir_ord int, name string")
    made = slices.make_slices(files, 4)
    sizes = [r["size"] for r in made.orderBy("slice_id").collect()]
    assert sizes == [4, 4, 4] * 3 or sum(sizes) == 35
    plan = slices.shuffle_epochs(slices.expand_epochs(made, 3), 7).cache()
    assert rows(plan) == rows(slices.shuffle_epochs(slices.expand_epochs(made, 3), 7))
    for e in range(3):
        assert sorted(r["slice_id"] for r in plan.where(f"epoch = {e}").collect()) == list(range(len(sizes)))
    for cut in (0, 5, len(sizes), 3 * len(sizes)):
        done = plan.where(f"pos < {cut}")
        state = slices.data_state(done, plan).first()
        left = slices.resume_plan(plan, state["epoch_index"], state["slice_index"])
        assert sorted(r["pos"] for r in done.unionByName(left).collect()) == list(range(3 * len(sizes)))
    assert tuple(slices.data_state(plan, plan).first()) == (3, 0, 0)
    assert tuple(slices.data_state(plan.where("false"), plan).first())[:2] == (0, 0)


def test_given_seeds_replace_derived_ones(spark):
    plan = slices.expand_epochs(spark.range(5).select(F.col("id").alias("slice_id")), 2)
    found = slices.shuffle_epochs(plan, 1, spark.createDataFrame([(1, 99)], "epoch int, seed long"))
    assert {r["seed"] for r in found.where("epoch = 1").collect()} == {99}


def test_dispatch_statuses(spark):
    plan = spark.createDataFrame([(0, 10), (1, 11)], "pos long, slice_id long")
    t = "timestamp '2024-01-01 00:00:{:02d}'".format
    req = spark.sql(" union all ".join(f"select {i}L request_id, 't' task, {t(s)} ts" for i, s in enumerate((1, 3, 5, 7, 9))))
    ctl = spark.sql(f"select {t(2)} ts, 1L control_id, 'ready' action union all select {t(4)}, 2L, 'stop' union all select {t(6)}, 3L, 'start'")
    found = {r["request_id"]: (r["status"], r["slice_id"]) for r in slices.dispatch_outcomes(req, ctl, plan).collect()}
    assert found == {0: ("UNAVAILABLE", None), 1: ("OK", 10), 2: ("RETRY_LATER", None), 3: ("OK", 11), 4: ("OUT_OF_RANGE", None)}


def test_global_index_with_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (5,), (3,), (5,)], "x long")
    assert sorted(r["i"] for r in global_index(df, [F.col("x")], "i", bucket=F.floor(F.col("x") / 4)).collect()) == [0, 1, 2, 3]
    assert global_index(df.where("false"), [F.col("x")], "i").count() == 0


def test_as_of_carries_over_buckets(spark):
    left = spark.sql("select timestamp '2024-03-01 12:00:00' ts, 1 id union all select timestamp '2024-01-01 00:00:00', 2")
    right = spark.sql("select timestamp '2024-01-01 00:00:00' ts, 'a' v, 1L k union all select timestamp '2024-01-01 00:00:00', 'b', 2L")
    assert rows(as_of(left, right, "v", "found", tie="k").select("id", "found")) == [(1, "b"), (2, "b")]


def test_bloom_never_undercounts(spark):
    ids = spark.createDataFrame([(i % 40,) for i in range(500)] + [(1000 + i,) for i in range(60)], "id long")
    found = {r["id"]: r["estimate"] for r in features.bloom_counter_filter(ids, 1, 50, 0.2).collect()}
    assert all(found[i] >= 12 for i in range(40)) and len(found) == 100


def test_counters_merge_and_equal_the_shuffled_form(spark, monkeypatch):
    ids = spark.range(3_000).select(F.when(F.col("id") % 11 > 0, F.col("id") % 97).alias("id"))
    monkeypatch.setattr(features, "CHUNK", 16)
    monkeypatch.setattr(features, "REMEMBERED", 10)
    m, k = features.bloom_sizes(98, 0.05)
    halves = [features.counting_cells(ids.where(f"coalesce(id, 0) % 2 = {i}"), m, k) for i in range(2)]
    merged = rows(features.estimated(ids, features.merged_cells(*halves), m, k, 1))
    assert merged == rows(features.bloom_counter_filter(ids, 1, 98, 0.05))
    counts = {r["id"]: r["count"] for r in ids.groupBy("id").count().collect()}
    assert len(merged) == 98 and all(n >= counts[x] for x, n in merged)
    monkeypatch.setattr(features, "MOST_CELLS", 1)
    assert merged == rows(features.bloom_counter_filter(ids, 1, 98, 0.05))
    with pytest.raises(ValueError, match="at most"):
        features.counting_cells(ids, m, k)


def test_lookup_sparse_shuffles_no_vectors(spark, monkeypatch):
    table = spark.range(50).select(F.col("id").alias("key"), F.array(*(F.col("id").cast("float") + i for i in range(8))).alias("value"))
    bags = spark.range(500).select((F.col("id") % 40).alias("row_id"), F.when(F.col("id") % 9 > 0, F.col("id") % 60).alias("id"), (F.col("id") % 7).cast("double").alias("weight"))
    shown = lambda df: df.select("row_id", F.transform("value", lambda x: F.round(x, 9)))
    found = {c: features.embedding_lookup_sparse(bags, table, 8, c, 0.5) for c in ("mean", "sum", "sqrtn")}
    plan = found["mean"]._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning(row_id" in line and "ENSURE_REQUIREMENTS" in line and "key" not in line for line in plan.splitlines())
    monkeypatch.setattr(features, "MOST_NUMBERS", 0)
    for c, df in found.items():
        assert rows(shown(df)) == rows(shown(features.embedding_lookup_sparse(bags, table, 8, c, 0.5)))


def test_batches_merge_beyond_the_most_cells(spark, monkeypatch):
    from shardloom.plans.catalog import QUERIES
    from conftest import DATA

    wanted = rows(QUERIES["B14_merged_counters"](spark, DATA))
    monkeypatch.setattr(features, "MOST_CELLS", 100)
    assert wanted and rows(QUERIES["B14_merged_counters"](spark, DATA)) == wanted
    ids = spark.createDataFrame([(None,), (None,), (3,)], "id long")
    halves = [features.batch_cells(ids.where(w), 500, 3) for w in ("id is null", "id = 3")]
    assert rows(features.estimated(ids, features.merged_cells(*halves), 500, 3, 2)) == [(None, 2)]
    assert features.bloom_sizes(0, 0.01) == features.bloom_sizes(1, 0.01)


@pytest.mark.parametrize(("combiner", "expected"), [("mean", 1.75), ("sum", 7.0), ("sqrtn", 7.0 / math.sqrt(10))])
def test_lookup_sparse(spark, combiner, expected):
    table = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "key long, value array<float>")
    bags = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0)], "row_id long, id long, weight double")
    assert abs(features.embedding_lookup_sparse(bags, table, 1, combiner).first()["value"][0] - expected) < 1e-9
    with pytest.raises(ValueError, match="combiner"):
        features.embedding_lookup_sparse(bags, table, 1, "max")


def test_known_and_unknown_width_give_the_same(spark):
    grads = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "key long, grad array<double>")
    assert rows(gradients.combine_gradients(grads)) == rows(gradients.combine_gradients(grads, 2)) == [(1, [4.0, 6.0]), (2, [5.0, 6.0])]


def test_eviction_and_repeat(spark):
    table = spark.createDataFrame([(1, [3.0, 4.0], 10), (2, [0.1, 0.1], 5000)], "key long, value array<float>, version long")
    assert [r["key"] for r in features.evict_by_step(table, 5000).collect()] == [2]
    assert [r["key"] for r in features.evict_by_l2(table).collect()] == [1]
    assert features.repeat(table, 3).count() == 6 and features.repeat(table, 0).count() == 0


def test_auc_and_accuracy(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.85)], "y int, p double")
    assert evaluation.auc(df, "y", "p").first()[0] == 0.75
    assert evaluation.accuracy(df, "y", "p").first()[0] == 0.75
    assert evaluation.auc(df.where("y = 1"), "y", "p").first()[0] is None


def test_metric_lists_cut_to_the_shorter_and_duplicates(spark):
    body = ['{"MetricType": ["a", "b", "c"], "MetricValue": [1.0, 2.0]}', '{"MetricType": ["a", "a"], "MetricValue": [1.0, 2.0]}', '{"MetricType": ["", ""], "MetricValue": [1.0, 2.0]}', "{}", None]
    reports = spark.createDataFrame([(i, "ps", 0, b) for i, b in enumerate(body)], "ts long, task_name string, task_index int, options string")
    good, bad = metrics.reject_duplicate_tags(reports)
    assert [r["ts"] for r in bad.collect()] == [1]
    assert rows(metrics.explode_metrics(good).select("ts", "type", "value")) == [(0, "a", 1.0), (0, "b", 2.0), (2, "", 1.0), (2, "", 2.0)]


def test_first_cpu_sample_is_zero(spark):
    df = spark.createDataFrame([("t", 10, 100), ("t", 12, 300)], "task string, ts long, cpu_ticks long").withColumn("ts", F.timestamp_seconds("ts"))
    assert [r["cpu_percent"] for r in metrics.cpu_usage(df).orderBy("ts").collect()] == [0.0, 100.0]


def test_tags_of_other_length_are_null(spark):
    df = spark.createDataFrame([("sys/mem/job_ps/replica_0/task_0/device_CPU_0",), ("a/b/c/d/e",)], "t string")
    found = [r["x"] for r in df.select(metrics.parse_metric_tag(F.col("t")).alias("x")).collect()]
    assert found[0]["job"] == "job_ps" and found[1] is None


def test_resource_listing(spark):
    listing = spark.createDataFrame([(1, "a:1048576@b:-1@"), (2, "")], "id long, listing string")
    sizes = spark.createDataFrame([("b", 2097152)], "name string, n_bytes long")
    assert rows(metrics.resource_total(listing, sizes)) == [(1, 3.0)]


def test_placement(spark):
    shards = spark.createDataFrame([(i, 3) for i in range(3)], "shard long, num_shards long")
    assert rows(backup.replica_placement(shards, 1)) == [(0, 0, 1), (1, 0, 2), (2, 0, 0)]
    assert backup.replica_placement(shards, 3).count() == 0 and backup.replica_placement(shards, 0).count() == 0


def test_checkpoint_names(spark):
    df = spark.createDataFrame([("model.ckpt-100", 1, 3)], "p string, s int, n int")
    r = df.select(backup.ckpt_key(F.col("p"), F.col("s"), F.col("n")).alias("k"), backup.ckpt_filenames(F.col("p"), F.col("s"), F.col("n")).alias("f")).first()
    assert r["k"] == "100:00001-00003" and r["f"]["data_file"] == "model.ckpt-100.data-00001-of-00003" and r["f"]["index_file"] == "model.ckpt-100.index" and r["f"]["base"] == "model.ckpt"
    bad = spark.createDataFrame([("x:1-2",), (None,)], "k string").select(backup.parse_ckpt_key(F.col("k")).alias("v"))
    assert [x["v"] for x in bad.collect()] == [None, None]


def test_last_write_wins_over_greater_step(spark):
    writes = spark.createDataFrame([(0, 0, 9, 1, 1), (0, 0, 4, 1, 2)], "holder long, shard long, step long, n_bytes long, arrival long")
    cache = backup.latest_cache(writes)
    assert rows(cache.select("step")) == [(4,)]
    assert rows(backup.superseded_files(writes).select("step")) == [(9,)]


def test_conflate(spark):
    puts = spark.createDataFrame([("b", 1, 1), ("b", 2, 2), ("b", 5, 3)], "buffer string, ts long, put_id long")
    takes = spark.createDataFrame([("b", 0, 10), ("b", 3, 11), ("b", 4, 12), ("b", 6, 13)], "buffer string, ts long, take_id long")
    assert rows(backup.conflate(puts, takes)) == [("b", 10, None, 0), ("b", 11, 2, 1), ("b", 12, None, 0), ("b", 13, 3, 0)]


def test_blobs_round_trip(spark):
    df = spark.createDataFrame([(1, bytearray(range(256)) * 5), (2, bytearray(b""))], "id long, blob binary")
    chunks = backup.chunk_blobs(df, 100)
    assert chunks.groupBy("id").count().orderBy("id").collect()[0][1] == 13
    assert rows(backup.assemble_blobs(chunks)) == rows(df)


def test_scalars(spark):
    df = spark.createDataFrame([("6Gi",), ("512Mi",), ("7",), (None,), ("1Ki",)], "m string")
    assert [r[0] for r in df.select(scalars.parse_memory(F.col("m"))).collect()] == [6 << 30, 512 << 20, -1, -1, -1]
    globs = spark.createDataFrame([("a*", "abc", True), ("a?c", "abc", True), ("[!a]*", "abc", False), ("a.c", "abc", False), ("[ab]bc", "abc", True), ("a(b", "a(b", True)], "g string, s string, yes boolean")
    assert all(r[0] == r[1] for r in globs.select("yes", F.expr("s rlike g2") if False else F.regexp_like(F.col("s"), scalars.glob_to_regex(F.col("g")))).collect())


def test_capacity(spark):
    manifest = spark.createDataFrame([("emb/part_0-keys", [10], "int64"), ("w", [2, 3], "float"), ("s", [], "double")], "name string, shape array<long>, dtype string")
    assert tuple(capacity.model_size(manifest).first()) == (80 + 24 + 8, True)
    assert [r[0] for r in spark.createDataFrame([(100, 10), (100, 0)], "b long, l long").select(capacity.required_servers(F.col("b"), F.col("l"), F.lit(3))).collect()] == [17, 3]


def test_tasks(spark):
    specs = spark.createDataFrame([("j", 2, 1, 0, 0, 0)], "job string, ps int, master int, worker int, chief int, evaluator int")
    status = spark.createDataFrame([("j", "ps#0")], "job string, task string")
    assert rows(scaling.missing_tasks(specs, status)) == [("j", "master#0"), ("j", "ps#1")]
    before = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "task string, uid long")
    after = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "task string, uid long")
    assert rows(scaling.task_changes(before, after)) == [("a", "running"), ("b", "replaced"), ("c", "deleted"), ("d", "added")]


def test_globs_never_fail(spark):
    import fnmatch

    globs = ["[abc", "[", "[]", "[]a]", "[!]", "[!]a]", "[z-a]", "[!z-a]", "[a-", "a[b-]c", "[*]", "[?]x", "[a^b]", "[^a]", "[a\\]", "a\\*", "[[]", "[a&&b]", "x{2}", "a|b", "", "*\n*", "[a-cx-z]?"]
    texts = ["[abc", "[", "[]", "]", "a", "b", "c", "z", "abc", "ab-c", "a-c", "*", "?x", "^", "\\", "a\\b", "&", "x{2}", "a|b", "", "l\nm", "yy", "[!]", "[a-"]
    pairs = spark.createDataFrame([(g, t, fnmatch.fnmatchcase(t, g)) for g in globs for t in texts], "g string, s string, yes boolean")
    found = pairs.where(F.regexp_like(F.col("s"), scalars.glob_to_regex(F.col("g"))) != F.col("yes")).collect()
    assert not found


def test_local_time_has_the_offset_of_its_day(spark):
    times = ["2024-01-15 23:30:00", "2024-07-15 23:30:00", "2024-03-31 01:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    at = lambda zone: [r[0] for r in df.select(scalars.utc_to_local(F.col("t"), zone)).collect()]
    assert at("Europe/Berlin") == ["2024-01-16T00:30:00+01:00", "2024-07-16T01:30:00+02:00", "2024-03-31T03:00:00+02:00"]
    assert at("America/St_Johns")[0] == "2024-01-15T20:00:00-03:30" and at("Asia/Shanghai")[0] == "2024-01-16T07:30:00+08:00"


def test_layout_needs_parts_of_one_length(spark):
    with pytest.raises(ValueError, match="one length"):
        reshard.dense_mod_layout(F.col("id"), 10, 4)


def test_label_stands_apart(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "y int, a double, b string")
    found = features.split_label(df, "y")
    assert found.columns == ["label", "features"] and found.select("label", "features.*").first().asDict() == {"label": 1, "a": 2.0, "b": "x"}


def test_many_subscriptions_join(spark, monkeypatch):
    data = spark.createDataFrame([("sys/mem/a", 1.0), ("sys/cpu/a", 2.0), ("other", 3.0)], "type string, value double")
    subs = spark.createDataFrame([("u", "sys/*"), ("u", "*mem*"), ("v", "*"), ("w", "none")], "subscriber string, pattern string")
    listed = rows(metrics.subscribe(data, subs).select("subscriber", "type", "value"))
    monkeypatch.setattr(metrics, "MOST_PATTERNS", 2)
    assert listed == rows(metrics.subscribe(data, subs).select("subscriber", "type", "value")) and len(listed) == 5
    monkeypatch.undo()
    assert metrics.subscribe(data, subs.where("false")).count() == 0


def test_task_actions_in_order(spark):
    reports = spark.createDataFrame([("ps", 0, s, f"o{s}") for s in (86_400 * 3, 5, 90_000, 7)], "task_name string, task_index int, s long, options string").withColumn("ts", F.timestamp_seconds("s"))
    asked = spark.createDataFrame([("ps#0",), ("ps#1",)], "task string")
    assert rows(metrics.task_actions(reports, asked).select("task", "status", "seq", "options")) == [("ps#0", "OK", 0, "o5"), ("ps#0", "OK", 1, "o7"), ("ps#0", "OK", 2, "o90000"), ("ps#0", "OK", 3, "o259200"), ("ps#1", "NOT_FOUND", None, None)]


def test_state_is_carried_over_batches(spark):
    """Histories that are longer than a batch."""
    events = spark.createDataFrame([(f"j{i % 2}", i, 100 * i, "decision", 4, ("SCALING_UP", "NORMAL", "SCALING_DOWN")[i % 3], [f"ps#{i}"]) for i in range(60)], "job string, event_id long, t long, kind string, new_n long, action string, servers array<string>")
    events = events.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    steps = spark.createDataFrame([(t, s) for t in ("a", "b", None) for s in range(0, 70, 3)], "task string, step long")
    whole = rows(scaling.scaling_controller(events)), rows(scaling.every_n_steps(steps, 7))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert whole == (rows(scaling.scaling_controller(events)), rows(scaling.every_n_steps(steps, 7)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole[0]) == 60 and {r[1] for r in whole[1] if r[0] is None} == set(range(0, 70, 9))


@pytest.mark.parametrize("rows_each", [2, 5, 10_000])
def test_hot_keys_cut_into_time_buckets(spark, monkeypatch, rows_each):
    """A key with many rows gives the same rows before and running sums as one window over it."""
    from pyspark.sql import Window

    monkeypatch.setattr(indexing, "BUCKET_ROWS", rows_each)
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 > 0, F.col("id").cast("string"))  # a third of the rest has no key
    df = spark.range(300).select("id", key.alias("k"), F.timestamp_seconds(F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(400)))).alias("ts"), (F.col("id") % 7).alias("x"))
    w = Window.partitionBy("k").orderBy("ts", "id")
    wanted = df.select("id", F.lag("x").over(w).alias("last"), F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sum"))
    got = indexing.sum_before(indexing.row_before(df, F.col("x"), ("ts", "id"), "before", ("k",)), "x", ("ts", "id"), "sum", ("k",))
    assert rows(got.select("id", F.col("before.value").alias("last"), "sum")) == rows(wanted)


def test_list_files_of_directories_given_twice(spark, tmp_path):
    for name in ("b", "a=1", "c d"):
        spark.range(2).selectExpr("cast(id as string)").repartition(2).write.text(f"file://{tmp_path}/{name}")
    dirs = [f"{tmp_path}/b", f"file://{tmp_path}/a=1/", f"{tmp_path}/b", f"{tmp_path}/c d"]
    found = readers.list_files(spark, dirs).groupBy("dir_ord", "prefix").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    assert rows(found) == [(i, d, 2, 4) for i, d in enumerate(dirs)]
