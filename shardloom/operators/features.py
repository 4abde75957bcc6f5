"""Sample preparation: shuffling, batching, feature columns, embedding lookups, filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60, seeded_hash, top_bits
from ..functions.indexing import global_index
from ..functions.vectors import sum_vectors

#: Counters of a shuffled row, counters that a task holds at most, and ids whose positions it remembers.
CHUNK, MOST_CELLS, REMEMBERED = 4_096, 1 << 23, 200_000
#: Numbers of vectors that are broadcast at most (16 MB as floats).
MOST_NUMBERS = 1 << 22


def split_label(df: DataFrame, label: str) -> DataFrame:
    """Per row the label, and the other columns as the struct ``features``."""
    return df.select(F.col(label).alias("label"), F.struct(*(F.col(c) for c in df.columns if c != label)).alias("features"))


def repeat(df: DataFrame, n: int) -> DataFrame:
    """The rows ``n`` times, with the number of the round as ``repeat_no``."""
    return df.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn("repeat_no", F.lit(0)).where("false")


def shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Adds ``pos``, a reproducible random order: a full permutation by hash, ties by key."""
    hashed = df.withColumn("__hash", seeded_hash(F.lit(seed), F.col(key)))
    return global_index(hashed, [F.col("__hash"), F.col(key)], "pos", bucket=top_bits(F.col("__hash"))).drop("__hash")


def _through_buffer(buffer: int):
    """Rows (row, __step, __hash), each stream from step 0 on, to (row, pos) in the order in which they leave the buffer."""

    def left(held: pa.Table | None, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if held is not None and len(held):
            step = np.asarray(held["__step"])
            at = np.lexsort((step, np.asarray(held["__hash"])))
            yield from placed(held, at, step.max() + 1 - len(held) + np.arange(len(held)))

    def placed(rows: pa.Table, at: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = rows.select(["row"]).take(pa.array(at)).append_column("pos", pa.array(pos.astype(np.int64)))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = None, np.zeros(buffer, np.int64)  # the waiting rows, and where each slot's row is among them
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column("__step")) == 0).tolist()
            for a, b in zip(sorted({0, *starts}), [*(x for x in starts if x), batch.num_rows]):
                if a == b:
                    continue
                if a in starts:
                    yield from left(held, place)
                    held = None
                new = pa.Table.from_batches([batch.slice(a, b - a)])
                old = len(held) if held is not None else 0
                pool = pa.concat_tables([held, new]) if old else new
                step = np.asarray(new["__step"])
                slot = np.where(step < buffer, step, np.asarray(new["__hash"]) % buffer)
                by_slot = np.argsort(slot, kind="stable")
                same = np.zeros(len(slot), bool)  # whether the row before in by_slot has the slot, too
                same[1:] = slot[by_slot[1:]] == slot[by_slot[:-1]]
                before = place[slot]  # the row that each new one drives out
                before[by_slot[1:][same[1:]]] = old + by_slot[:-1][same[1:]]
                out = np.flatnonzero(step >= buffer)
                if len(out):
                    yield from placed(pool, before[out], step[out] - buffer)
                place[slot[by_slot]] = old + by_slot  # of several rows of a slot the last stays
                full = min(buffer, int(step[-1]) + 1)
                held = pool.take(pa.array(place[:full])).combine_chunks()
                place[:full] = np.arange(full)
        yield from left(held, place)

    return run


def _buffered(df: DataFrame, seed: int, stream: Column, step: Column, buffer: int) -> DataFrame:
    row = F.struct(*(f"`{c}`" for c in df.columns if c != "pos"))
    drawn = seeded_hash(F.lit(seed), F.concat_ws(":", F.coalesce(stream.cast("string"), F.lit("")), step.cast("string")))
    rows = df.select(row.alias("row"), step.cast("long").alias("__step"), drawn.alias("__hash"))
    return rows.mapInArrow(_through_buffer(buffer), f"row {rows.schema['row'].dataType.simpleString()}, pos long").select("row.*", "pos")


def buffered_shuffle(df: DataFrame, seed: int, stream: str, step: str, buffer: int = 20_000) -> DataFrame:
    """Adds ``pos``, the place of each row in its stream behind a shuffle buffer of ``buffer`` rows, the cheap form of ``shuffle``.

    The rows of a stream (``step``: 0, 1, ... in each) fill the buffer; from then on each row takes a
    slot that is drawn by hash of seed, stream and step, and the row that waited there leaves.  At the end the
    waiting rows leave in the order of their hashes.  So no row leaves ``buffer`` or more places early, and a stream that
    is no longer than the buffer is wholly permuted.  A stream is one task's sequence, with the buffer's rows in memory; cut a
    long input into streams of bounded length (files, slices, spans of positions).
    """
    return _buffered(df.repartition(F.col(stream)).sortWithinPartitions(stream, step), seed, F.col(stream), F.col(step), buffer)


def buffered_shuffle_partitions(df: DataFrame, seed: int, buffer: int = 20_000) -> DataFrame:
    """As ``buffered_shuffle``, with each partition of ``df`` as a stream, in its own order: no row is shuffled between tasks.

    Reproducible as long as the partitions and their order are: over files, or rows sorted within partitions.
    """
    at = F.monotonically_increasing_id()
    marked = df.withColumn("__at", at)
    found = _buffered(marked, seed, F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)), buffer)
    return found.drop("__at")


def batch(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Adds the batch number and the place in the batch; the last batch may be short."""
    return df.withColumns({"batch_no": F.floor(F.col(pos) / size), "batch_pos": F.col(pos) % size})


def stack_features(df: DataFrame, cols: list[str], label: str | None = None) -> DataFrame:
    """The columns as one vector ``features``; the label is cast to int."""
    out = df.withColumn("features", F.array(*(F.col(c).cast("double") for c in cols)))
    return out.withColumn(label, F.col(label).cast("int")) if label else out


def numeric_column(col: Column) -> Column:
    """A float feature of width 1."""
    return F.array(col.cast("float"))


def embedding_lookup(ids: DataFrame, table: DataFrame, dim: int, init: float = 0.0, key: str = "key") -> DataFrame:
    """Adds ``value``, the vector of each id; an id that the table lacks gets the initial value."""
    found = ids.join(table.select(key, F.col("value").alias("__value")), key, "left")
    return found.withColumn("value", F.coalesce("__value", F.array_repeat(F.lit(init).cast("float"), dim))).drop("__value")


def embedding_lookup_sparse(bags: DataFrame, table: DataFrame, dim: int, combiner: str = "mean", init: float = 0.0) -> DataFrame:
    """One vector per bag (row_id): the weighted mean, sum or sqrtn of its ids' vectors.

    ``bags``: row_id, id, optional weight.  Up to ``MOST_NUMBERS`` numbers of asked vectors go to every task: a bag's ids are first
    made distinct, so that a large bag has no more rows than vectors are asked, and no vector is shuffled.  Beyond, ids join their vectors, and sums are
    combined per bag before the shuffle.
    """
    if combiner not in ("mean", "sum", "sqrtn"):
        raise ValueError(f"unknown combiner {combiner}")
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in bags.columns else F.lit(1.0)
    ids = bags.select("row_id", F.col("id").alias("key"), weight.alias("weight"))
    asked = table.select("key", "value").join(ids.select("key").distinct(), "key", "left_semi")
    ids = ids.withColumn("square", F.col("weight") * F.col("weight"))
    if asked.limit(MOST_NUMBERS // max(1, dim) + 1).count() * dim <= MOST_NUMBERS:
        once = ids.groupBy("row_id", "key").agg(F.sum("weight").alias("weight"), F.sum("square").alias("square"))
        ids, table = once.repartition("row_id"), F.broadcast(asked)
    found = embedding_lookup(ids, table, dim, init)
    norms = (F.sum("weight").alias("w"), F.sum("square").alias("w2"))
    sums = sum_vectors(found, "row_id", F.col("value"), dim, F.col("weight"), norms)
    by = {"mean": F.col("w"), "sqrtn": F.sqrt("w2"), "sum": F.lit(1.0)}[combiner]
    return sums.select("row_id", by.alias("by"), "value").select("row_id", F.transform("value", lambda x: x / F.col("by")).alias("value"))


def input_layer(df: DataFrame, columns: list[str], name: str = "input") -> DataFrame:
    """The vectors of ``columns`` side by side."""
    return df.withColumn(name, F.concat(*(F.col(c).cast("array<double>") for c in columns)))


def fm_second_order(vectors: list[Column]) -> Column:
    """Per dimension 0.5 * ((sum v)^2 - sum v^2) over the fields' vectors."""
    fields = F.array(*vectors)
    positions = F.sequence(F.lit(0), F.size(vectors[0]) - 1)

    def cell(i: Column) -> Column:
        values = F.transform(fields, lambda v: F.get(v, i).cast("double"))
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
        return (total * total - squares) * 0.5

    return F.transform(positions, cell)


def linear_term(vector: Column) -> Column:
    """The sum over a vector."""
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double"))


def counter_filter(ids: DataFrame, filter_freq: int = 3, key: str = "id") -> DataFrame:
    """The rows whose id occurs at least ``filter_freq`` times."""
    frequent = ids.groupBy(key).count().where(F.col("count") >= filter_freq).select(key)
    return ids.join(frequent, key, "left_semi")


def bloom_sizes(capacity: int, fpp: float) -> tuple[int, int]:
    """Counters and hash functions for so many ids and this false-positive rate."""
    capacity = max(1, capacity)
    m = max(8, math.ceil(-capacity * math.log(fpp) / math.log(2) ** 2))
    return m, max(1, round(m / capacity * math.log(2)))


def bloom_positions(col: Column, m: int, k: int) -> Column:
    return F.array(*(F.pmod(hash60(F.concat_ws(":", F.lit(i), col.cast("string"))), F.lit(m)) for i in range(k)))


class _Positions:
    """``bloom_positions`` of ids as text, a row each, those asked last remembered; a position that repeats in its row is ``m``."""

    def __init__(self, m: int, k: int):
        self.m, self.k, self.known, self.table = m, k, {}, np.zeros((0, k), np.int64)

    def of(self, ids: list[str | None]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        new = [x for x in dict.fromkeys(ids) if x not in self.known]
        rows = np.full((len(new), self.k), self.m, np.int64)
        for row, x in enumerate(new):
            self.known[x] = len(self.known)
            texts = (str(i) if x is None else f"{i}:{x}" for i in range(self.k))
            found = {int(hashlib.md5(t.encode()).hexdigest()[:15], 16) % self.m for t in texts}
            rows[row, : len(found)] = list(found)
        self.table = np.concatenate([self.table, rows]) if new else self.table
        return self.table[[self.known[x] for x in ids]]


def counting_cells(ids: DataFrame, m: int, k: int, key: str = "id") -> DataFrame:
    """The counters of a counting Bloom filter of ``m`` cells: chunk, cells (``CHUNK`` little-endian longs).

    Each task counts in arrays of its own, and only these are shuffled and added up: at most ``m`` counters a task, whatever
    the number of rows or ids, and ``m`` is at most ``MOST_CELLS``.  Tables of counters with the same ``m`` and ``k`` merge by
    ``merged_cells``.
    """
    if m > MOST_CELLS:
        raise ValueError(f"a task would hold {m} counters; at most {MOST_CELLS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, cells = _Positions(m, k), np.zeros((m // CHUNK + 1) * CHUNK, "<i8")
        for batch in batches:
            if batch.num_rows:
                found = batch.column(0).value_counts()
                at = positions.of(found.field("values").to_pylist())
                np.add.at(cells, at, np.asarray(found.field("counts"))[:, None])
        cells[m:] = 0
        cells = cells.reshape(-1, CHUNK)
        for chunk in np.flatnonzero(cells.any(axis=1)).tolist():
            values = cells[chunk]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([values.tobytes()], pa.binary())], names=["chunk", "cells"])

    return _added(ids.select(F.col(key).cast("string")).mapInArrow(run, "chunk long, cells binary"))


def _added(cells: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "cells"])
        for batch in batches:  # sorted; one chunk is held
            for chunk, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk != now and now is not None:
                    yield row()
                more = np.frombuffer(values, "<i8")
                now, total = chunk, more + total if chunk == now else more
        if now is not None:
            yield row()

    return cells.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long, cells binary")


def spread_cells(ids: DataFrame, m: int, k: int, key: str = "id") -> DataFrame:
    """The counters of ``counting_cells`` for any ``m``, as rows: pos, cell.  Ids are counted, and their counts summed by position."""
    counts = ids.groupBy(key).agg(F.count("*").alias("__n"))
    spread = counts.select("__n", F.explode(F.array_distinct(bloom_positions(F.col(key), m, k))).alias("pos"))
    return spread.groupBy("pos").agg(F.sum("__n").alias("cell"))


def batch_cells(ids: DataFrame, m: int, k: int, key: str = "id") -> DataFrame:
    """The counters of a batch: in arrays up to ``MOST_CELLS`` of them, else as rows."""
    return counting_cells(ids, m, k, key) if m <= MOST_CELLS else spread_cells(ids, m, k, key)


def merged_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """The counters of what both have counted, both in arrays or both as rows."""
    both = a.unionByName(b)
    return both.groupBy("pos").agg(F.sum("cell").alias("cell")) if "pos" in a.columns else _added(both)


def estimated(ids: DataFrame, cells: DataFrame, m: int, k: int, freq: int, key: str = "id") -> DataFrame:
    """The distinct ids whose smallest counter reaches ``freq``: id, estimate.  Only ids that pass are shuffled; those that meet counters as rows, all distinct ones."""
    if "pos" in cells.columns:
        spread = ids.select(key).distinct().select(key, F.explode(F.array_distinct(bloom_positions(F.col(key), m, k))).alias("pos"))
        return spread.join(cells, "pos").groupBy(key).agg(F.min("cell").alias("estimate")).where(F.col("estimate") >= freq)
    kind = ids.schema[key].dataType
    counters = np.zeros((m // CHUNK + 1, CHUNK), "<i8")
    for r in cells.collect():  # at most MOST_CELLS
        counters[r["chunk"]] = np.frombuffer(r["cells"], "<i8")
    counters = counters.reshape(-1)
    counters[m:] = np.iinfo(np.int64).max  # what repeats in a row doesn't count
    shared = ids.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions = _Positions(m, k)
        for batch in batches:
            found = pc.unique(batch.column(0)).to_pylist()
            least = shared.value[positions.of(found)].min(axis=1).tolist() if found else []
            kept = [(x, n) for x, n in zip(found, least, strict=True) if n >= freq]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["id", "estimate"])

    passed = ids.select(F.col(key).cast("string")).mapInArrow(run, "id string, estimate long").distinct()
    return passed.select(F.col("id").cast(kind).alias(key), "estimate")


def bloom_counter_filter(ids: DataFrame, freq: int, capacity: int | None = None, fpp: float = 0.01, key: str = "id") -> DataFrame:
    """Distinct ids whose count, estimated by a counting Bloom filter, reaches ``freq``: id, estimate.

    Own rule: k MD5 positions per id, an id's estimate is its smallest counter, never below the true
    count.  Without a ``capacity`` the filter is sized for the number of distinct ids.  Up to ``MOST_CELLS``
    counters tasks count in arrays; beyond, ids are counted, and their counters summed by position.
    """
    m, k = bloom_sizes(max(1, ids.select(key).distinct().count()) if capacity is None else capacity, fpp)
    return estimated(ids, batch_cells(ids, m, k, key), m, k, freq, key)


def evict_by_step(table: DataFrame, step: int, steps_to_live: int = 4000) -> DataFrame:
    """Drops rows that were not updated for more than ``steps_to_live`` steps."""
    return table.where(F.lit(step) - F.col("version") <= steps_to_live)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def evict_by_l2(table: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Drops rows whose vector is shorter than ``threshold``."""
    return table.where(l2_norm(F.col("value")) >= threshold)


def partitions_fixed(n: int) -> Column:
    return F.lit(n)


def partitions_min_max(rows: Column, row_bytes: Column, max_parts: int, min_slice_bytes: int) -> Column:
    """Parts of at least ``min_slice_bytes``, at most ``max_parts`` and one per row, at least one."""
    fitting = F.floor(rows * row_bytes / F.lit(min_slice_bytes))
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(max_parts).cast("long"), rows.cast("long"), fitting))
