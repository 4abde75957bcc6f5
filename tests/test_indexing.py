"""Split points: parts stay even whatever the data, and cut groups give what one window gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from shardloom.functions import indexing
from shardloom.operators import metrics, scaling, slices


def sizes(df, by, order):
    """Rows of each part, smallest first."""
    cut = indexing.parted(df, by, order, df.count())
    return sorted(r["count"] for r in cut.groupBy("__key.__part").count().collect())


def even(found, n):
    assert sum(found) == n
    assert found[-1] <= 2 * found[len(found) // 2]


def test_one_stray_time_stamp(spark):
    n = 1_000_001
    ts = F.timestamp_seconds(F.when(F.col("id") == 0, 0).otherwise(1_700_000_000 + F.col("id") % 86_400))
    found = sizes(spark.range(n).select("id", ts.alias("ts")), (), [F.col("ts")])
    even(found, n)
    assert found[-1] <= 400_000


def test_one_hot_beginning_of_names(spark):
    n = 1_000_000
    name = F.when(F.col("id") % 20_000 == 0, F.concat(F.lit("rare-"), F.col("id"))).otherwise(F.concat(F.lit("s3://bucket/a/very/long/beginning/part-"), F.lpad(F.col("id").cast("string"), 9, "0")))
    found = sizes(spark.range(n).select(name.alias("name"), F.lit("d").alias("prefix")), ("prefix",), [F.col("name")])
    even(found, n)


def test_one_hot_value_and_one_hot_group(spark):
    n = 600_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(7).alias("x"))
    even(sizes(df, ("k",), [F.col("x")]), n)  # rows alike in the order, too, are split


def test_a_key_of_one_day_beside_one_of_a_year(spark, monkeypatch):
    monkeypatch.setattr(indexing, "BUCKET_ROWS", 1_000)
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 4).alias("at"), "id")
    cold = spark.range(2_000).select(F.lit("cold").alias("k"), (F.col("id") * 15_000).alias("at"), "id")
    even(sizes(hot.unionByName(cold), ("k",), [F.col("at")]), 22_000)


@pytest.fixture
def table(spark):
    """Nulls and ties in keys and order, a third of the rows under one key, columns of awkward names."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 30 != 1, (F.col("id") % 20).cast("string"))
    ts = F.timestamp_seconds(F.when(F.col("id") % 40 > 0, F.pmod(F.xxhash64("id"), F.lit(300))))
    return spark.range(900).select("id", key.alias("k"), ts.alias("ts"), (F.col("id") % 7).alias("x"), F.lit(1).alias("a.b")).repartition(7)


@pytest.mark.parametrize("most", [1, 10, 250, 100_000])
def test_positions_equal_one_window(spark, table, monkeypatch, most):
    monkeypatch.setattr(indexing, "BUCKET_ROWS", most)
    monkeypatch.setattr(indexing, "MOST_PARTS", 50)
    for by in ((), ("k",)):
        wanted = table.select("id", (F.row_number().over(Window.partitionBy(*by).orderBy("ts", "id")) - 1).cast("long").alias("pos"))
        assert rows(indexing.global_index(table, [F.col("ts"), F.col("id")], "pos", by).select("id", "pos")) == rows(wanted)


@pytest.mark.parametrize("most", [1, 30, 100_000])
def test_as_of_equals_one_window(spark, monkeypatch, most):
    monkeypatch.setattr(indexing, "BUCKET_ROWS", most)
    monkeypatch.setattr(indexing, "MOST_PARTS", 40)
    at = lambda n: F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(n)))
    left = spark.range(400).select("id", (F.col("id") % 3).alias("g"), at(500).alias("ts"))
    right = spark.range(1000, 1060).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"), at(400).alias("ts"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    joined = left.join(right.select(F.col("g").alias("rg"), F.col("ts").alias("rts"), "k", "v"), (F.col("g") == F.col("rg")) & (F.col("rts") <= F.col("ts")), "left")
    wanted = joined.groupBy("id").agg(F.max_by(F.struct("v"), F.struct("rts", "k")).alias("m")).select("id", "m.v")
    assert rows(indexing.as_of(left, right, "v", "v", by=("g",), tie="k").select("id", "v")) == rows(wanted)


def test_operators_over_many_parts(spark, monkeypatch):
    files = spark.range(500).select(F.when(F.col("id") % 5 > 0, "a").otherwise("b").alias("prefix"), (F.col("id") % 5 == 0).cast("int").alias("dir_ord"), F.format_string("f%05d", "id").alias("name"))
    found = slices.make_slices(files, 7)
    plan = found.select(F.col("slice_id").alias("pos"), "slice_id")
    asked = spark.range(60).select(F.col("id").alias("request_id"), F.lit("t").alias("task"), F.timestamp_seconds(F.col("id") % 9).alias("ts"))
    metric = spark.range(300).select(F.timestamp_seconds("id").alias("ts"), F.lit("s").alias("subscriber"), (F.col("id") % 2).cast("string").alias("type"), F.lit(1.0).alias("value"))
    small = rows(found), rows(slices.assign_slices(plan, asked)), rows(metrics.metric_sequence(metric, ["ts"]))
    monkeypatch.setattr(indexing, "BUCKET_ROWS", 16)
    assert small == (rows(slices.make_slices(files, 7)), rows(slices.assign_slices(plan, asked)), rows(metrics.metric_sequence(metric, ["ts"])))


def fired(values, n):
    out, last = [], None
    for x in sorted(values):
        if last is None or x >= last + n:
            out.append(x)
            last = x
    return out


@pytest.mark.parametrize(("n", "most"), [(1, 5), (7, 1), (7, 40), (300, 10), (5_000, 3), (7, None)])
def test_firings_of_a_hot_task_equal_the_loop(spark, monkeypatch, n, most):
    monkeypatch.setattr(indexing, "MOST_PARTS", 60)
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 6 == 0, F.lit("cold"))  # the rest has no task
    step = F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(4_000)) + F.when(F.col("id") > 600, 9_007_199_254_740_993).otherwise(0))
    df = spark.range(900).select(key.alias("task"), step.alias("step"))
    wanted = {}
    for r in df.where("step is not null").collect():
        wanted.setdefault(r["task"], []).append(r["step"])
    assert rows(scaling.every_n_steps(df, n, most=most)) == sorted(((k, x) for k, v in wanted.items() for x in fired(v, n)), key=repr)


def test_firings_of_a_million_rows_run_in_parts(spark):
    df = spark.range(1_000_000).select(F.lit("t").alias("task"), F.timestamp_seconds(F.col("id") * 3).alias("ts"))
    found = scaling.every_n_secs(df, 10)
    assert found.count() == 250_000 and rows(found.agg(F.max("ts"))) == rows(df.where("ts = timestamp_seconds(2999988)").select("ts"))


def test_nulls_and_steps_beyond_doubles(spark):
    big = 9_007_199_254_740_993
    df = spark.createDataFrame([("t", None), ("t", big), ("t", big + 1), ("t", None), ("t", big + 2), ("u", None)], "task string, step long")
    assert rows(scaling.every_n_steps(df, 2)) == [("t", big), ("t", big + 2)]
    assert rows(scaling.every_n_steps(df, 0)) == [("t", big), ("t", big + 1), ("t", big + 2)]


def test_small_parts_take_no_tasks_of_their_own(spark):
    df = spark.range(6_000).select(F.lit("hot").alias("task"), F.floor(F.col("id") / 3).alias("step"))
    cut = indexing.parted(df.distinct(), ("task",), [F.col("step")], 6_000, 20)
    assert len({r["__key"]["__part"] for r in cut.select("__key").distinct().collect()}) >= 100 and len(cut.inputFiles()) <= 8
    assert sorted(r["step"] for r in scaling.every_n_steps(df, 7, most=20).collect()) == list(range(0, 2000, 7))


def test_offsets_move_no_rows(spark, monkeypatch):
    monkeypatch.setattr(indexing, "BUCKET_ROWS", 100)
    found = indexing.global_index(spark.range(1_000).select((F.col("id") * 7 % 1_000).alias("id")), [F.col("id")], "pos")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(r["id"] == r["pos"] for r in found.collect())
