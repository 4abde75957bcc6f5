"""What one Python worker takes beside its batches: workers are reused and keep the most that they ever took."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardloom.llm import common, quality, token_files, wide_simhash

from .test_wide_simhash import groups, kept

MB = 1 << 20


class Frame:
    """Stands for a DataFrame: gives the function that a task would run over its batches."""

    schema = None
    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def mapInArrow(self, run, schema):
        return run


def batch(n_bytes):
    draw = np.random.default_rng(3)
    words = np.array([f"word{x}" for x in range(5000)])
    texts = [" ".join(words[draw.integers(0, 5000, 250)]) for _ in range(n_bytes // 2200)]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "text"])


def run_of(monkeypatch, stage):
    if stage == "quality":
        weight = np.random.default_rng(4).normal(0, 1, quality.BUCKETS).astype(np.float32)
        return quality.accepted(Frame(), quality.Model(weight, 0.0))
    monkeypatch.setattr(wide_simhash, "_source", lambda docs: docs)
    return wide_simhash.signatures(Frame(), wide_simhash.blocks_of(51_282))


@pytest.mark.parametrize("stage", ["quality", "near_duplicates"])
def test_a_step_takes_little_beside_its_batch(monkeypatch, stage):
    run, rows = run_of(monkeypatch, stage), batch(3 * MB)
    tracemalloc.start()
    for _ in run(iter([rows])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * MB, peak / MB


def test_a_stage_bounds_its_batches_and_keeps_what_is_set(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.repeat(F.lit("some words "), 300), "id").alias("text"))
        corpus_pipeline.drop_near_duplicates(spark, docs.limit(2), "")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
        assert max(r["n"] for r in sizes) < 1.1 * common.BATCH_BYTES, sizes
        spark.conf.set(key, "20k")  # cells of a family come in many batches
        draw = np.random.default_rng(6)
        base, texts = [f"w{i}" for i in range(500)], []
        for i in range(60):
            words = list(base)
            for at in draw.choice(96, 7, False):
                words[at * 5 + 2] = f"x{i}"
            texts.append((i, " ".join(words)))
        assert kept(spark, [x for _, x in texts]) == sorted(set(groups([x for _, x in texts])))
        assert spark.conf.get(key) == "20k"
    finally:
        spark.conf.set(key, before)


def test_scores_do_not_depend_on_the_steps():
    rows = batch(MB)
    model = quality.Model(np.random.default_rng(4).normal(0, 1, quality.BUCKETS).astype(np.float32), 0.0)
    texts = rows.column("text")
    alone = np.concatenate([model.scores(texts.slice(i, 1)) for i in range(len(texts))])
    assert (model.scores(texts) == alone).all()


def test_a_table_of_pieces_grows_with_what_it_holds():
    table = token_files.PieceTable(token_files.PIECES)
    assert table.keys.nbytes + table.values.nbytes <= 2 * MB
    draw = np.random.default_rng(5)
    known = np.unique(draw.integers(1, 2**63, 200_000, dtype=np.uint64))
    for part in np.array_split(known, 7):
        table.add(part, [[int(k % 1000), 7] for k in part.tolist()], [k.tobytes() for k in part])
    assert table.mask + 1 <= 4 * len(known)
    at = table.find(known)
    assert (table.flat[table.start[at]] == known % np.uint64(1000)).all() and (table.length[at] == 2).all()
    assert (table.find(known + np.uint64(1))[~np.isin(known + np.uint64(1), known)] == -1).all()
