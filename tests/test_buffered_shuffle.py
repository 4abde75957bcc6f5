"""The buffered shuffle against a loop over one row at a time."""

import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shardloom.operators import features


def drawn(seed, stream, step):
    return int(hashlib.md5(f"{seed}:{'' if stream is None else stream}:{step}".encode()).hexdigest()[:15], 16)


def loop(items, seed, stream, buffer):
    """The items in the order in which they leave the buffer."""
    slots, out = [], []
    for step, item in enumerate(items):
        h = drawn(seed, stream, step)
        if step < buffer:
            slots.append((h, step, item))
        else:
            out.append(slots[h % buffer][2])
            slots[h % buffer] = (h, step, item)
    return out + [item for _, _, item in sorted(slots, key=lambda x: x[:2])]


@pytest.mark.parametrize("buffer", [1, 7, 50, 1000])
@pytest.mark.parametrize("batch_rows", [3, 64, 10_000])
def test_equals_the_loop(spark, buffer, batch_rows):
    streams = {0: 200, 1: 1, 2: 49, 3: 51, None: 120, 9: 50}
    data = [(s, i, f"{s}-{i}", None if i % 3 else i) for s, n in streams.items() for i in range(n)]
    df = spark.createDataFrame(data, "stream long, step long, item string, pos long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        got = features.buffered_shuffle(df, 3, "stream", "step", buffer).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s, n in streams.items():
        mine = sorted((r["pos"], r["item"], r["step"]) for r in got if r["stream"] == s)
        assert [x[0] for x in mine] == list(range(n))
        assert [x[1] for x in mine] == loop([f"{s}-{i}" for i in range(n)], 3, s, buffer)
        assert all(pos > step - buffer for pos, _, step in mine)


def test_partitions_as_streams(spark):
    """Each partition is a stream; nothing moves between tasks, and rows come in the order of pos."""
    df = spark.range(0, 3000, 1, 3)
    found = features.buffered_shuffle_partitions(df, 8, 100)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.withColumn("part", F.spark_partition_id()).collect()
    for part in range(3):
        mine = [(r["pos"], r["id"]) for r in got if r["part"] == part]
        assert [p for p, _ in mine] == list(range(1000))
        assert [x for _, x in mine] == loop(range(1000 * part, 1000 * part + 1000), 8, part, 100)
    assert rows(found) == rows(features.buffered_shuffle_partitions(df, 8, 100))
    assert rows(features.buffered_shuffle_partitions(df, 9, 100)) != rows(found)


def test_empty(spark):
    none = spark.createDataFrame([], "stream long, step long, x string")
    assert features.buffered_shuffle(none, 1, "stream", "step").collect() == []
    assert features.buffered_shuffle_partitions(none, 1).columns == ["stream", "step", "x", "pos"]
