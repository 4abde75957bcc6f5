"""Many subscriptions without a product of types and patterns."""

import fnmatch
import random

from conftest import rows
from shardloom.operators import metrics


def test_parts_find_what_each_pattern_finds(spark, monkeypatch):
    draw = random.Random(1)
    part = lambda: draw.choice(["sys", "mem", "cpu", "task_", "a", "[", "x]", "é", ".", "net/in", ""]) + draw.choice(["", "/", "1", "12", "345"])
    types = {"".join(part() for _ in range(draw.randrange(1, 7))) for _ in range(150)}
    wild = lambda: draw.choice(["*", "?", "[a-m]", "[!0-3]", "*", ""])
    patterns = {"".join(part() + wild() for _ in range(draw.randrange(1, 4))) for _ in range(250)} | {"*", "?", "", "*a*", "[", "a[b", "*sys*mem*", "[!]]*"}
    subs = spark.createDataFrame([(f"s{i % 40}", p) for i, p in enumerate(sorted(patterns))] + [("none", None)], "subscriber string, pattern string")
    monkeypatch.setattr(metrics, "MOST_PATTERNS", 7)
    found = metrics.matching_types(spark.createDataFrame([(t,) for t in types], "type string"), subs)
    from shardloom.functions.scalars import glob_to_regex
    from pyspark.sql import functions as F

    every = spark.createDataFrame([(t,) for t in types], "type string").join(subs.withColumn("regex", glob_to_regex(F.col("pattern"))), F.expr("type rlike regex"))
    assert rows(found) == rows(every.select("type", "subscriber").distinct())
    simple = [p for p in patterns if "[" not in p]
    names = dict(zip(sorted(patterns), range(len(patterns)), strict=True))
    plain = {(t, f"s{names[p] % 40}") for p in simple for t in types if fnmatch.fnmatchcase(t, p)}
    assert plain <= {tuple(r) for r in rows(found)}


def test_ten_thousand_patterns_take_no_nested_loop(spark):
    types = spark.range(10_000).selectExpr("concat('sys/mem/job/task_', id, '/device') as type")
    subs = spark.range(10_000).selectExpr("concat('s', id) as subscriber", "concat('sys/*/task_', id, '/*') as pattern")
    found = metrics.subscribe(types.selectExpr("type", "1 as value"), subs)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert found.count() == 10_000


def test_a_pattern_of_many_subscribers_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CELL", 10)
    types = spark.range(55).selectExpr("concat('sys/', id) as type")
    subs = spark.range(130).selectExpr("if(id > 120, null, concat('s', id % 100)) as subscriber", "if(id < 100, '*', 'sys/1*') as pattern")
    found = metrics.matching_types(types, subs)
    wanted = {(f"sys/{t}", f"s{i}") for t in range(55) for i in range(100)} | {(f"sys/{t}", None) for t in range(55) if str(t)[0] == "1"}
    assert rows(found) == sorted(wanted, key=repr)
    assert found.rdd.getNumPartitions() > 8
