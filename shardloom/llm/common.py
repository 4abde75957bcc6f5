"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that one vectorised step works on, in bytes; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: The same where a step's arrays take a hundred times its text: workers are reused and keep what they once took.
SMALL_STEP_BYTES = 1 << 18
#: Rows of a lookup table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 50_000
#: Bytes of rows that an executor and its Python worker hand each other at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs in one process (tests) a temporary one is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when each of them ends; their results are written tables."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have about ``BATCH_BYTES`` at most; another size that a user has set stays.

    By default they have 10,000 rows up to 64 MB, and each task holds several, in the executor and in its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_text(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(id_text(column)) % modulus


def ascii_lower(column: Column) -> Column:
    """A-Z to lower case, all else unchanged."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*parts: Column) -> Column:
    """A reproducible number in [0, 1): 52 bits of the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def filtered(df: DataFrame, keep: Callable[[pa.Array], np.ndarray], column: str = "text") -> DataFrame:
    """The rows whose texts ``keep`` holds for, with all their columns; a null counts as empty.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, column, SMALL_STEP_BYTES):
                yield part.filter(pa.array(keep(pc.fill_null(part.column(column), ""))))

    return df.mapInArrow(run, df.schema)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = STEP_BYTES) -> DataFrame:
    """``fn`` on each slice of the rows, of at most ``limit`` bytes of text or one row; ``df`` must have a column ``text`` without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, limit=limit):
                yield fn(part)

    return df.mapInArrow(run, schema)


def with_text_hash(docs: DataFrame) -> DataFrame:
    """``docs`` with text_hash: with doc_id it tells rows apart, but for rows that repeat both."""
    return docs.withColumn("text_hash", F.xxhash64(text_of()))


def best_rows(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows (doc_id, text_hash, key) of each key the one with the smallest doc_id (null last), then text_hash.

    key, none, id, hash, rows (how many repeat both).
    """
    repeats = rows.groupBy(key, "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "rows"))
    return repeats.groupBy(key).agg(best.alias("best")).select(key, "best.*")


def one_row_each(docs: DataFrame, best: DataFrame) -> DataFrame:
    """One row of ``docs`` per root of ``best`` (root, none, id, hash, rows), with its own columns.

    It is the one with the smallest doc_id, null last; of several texts under it the one with the
    smallest XXH64; of rows that repeat both, any one.
    """
    kept = best.groupBy("root").agg(F.min(F.struct("none", "id", "hash", "rows")).alias("best"))
    kept = written(kept.select("best.id", "best.hash", "best.rows"), "kept")
    # The rows travel as one column, so that no name of theirs clashes.  Shuffled at every size: the table of kept documents grows with the input.
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(text_of()).alias("own_hash"))
    out = packed.join(kept.hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")))
    if kept.where("rows > 1").limit(1).count():
        again = out.where("rows > 1").dropDuplicates(["id", "hash"])
        out = out.where("rows = 1").unionByName(again)
    return out.select("row.*")
