"""SimHash near-dedup with pigeonhole blocks.

A text's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of its word
shingles.  Fingerprints, not documents, are compared, so exact copies cost one row.  The
64 bits are cut into ``b`` blocks: two fingerprints that differ in at most ``distance``
bits agree on at least ``b - distance`` blocks, so each fingerprint is put under every
choice of that many blocks, the join is on these keys and the Hamming distance is
verified in the join condition.
``b`` follows from the number of fingerprints (six blocks up to two million), so that a
key stays selective at any size; every ``b`` finds all pairs.

A bucket is a star first: each fingerprint is compared with the bucket's smallest, and what
is linked is contracted.  Then only pairs across the parts that are left are compared; the largest
part isn't paired with itself.  A bucket in which more than ``FULL`` members stand outside of its
largest part is split instead: its members agree on the bits of its key, so two of them differ in at
most ``distance`` of the others, which are cut into ``distance + 1`` further blocks; a close pair agrees on
one of them.  That is repeated while buckets are full and more than ``LAST_BITS`` bits are free, so no bucket
costs the square of its size and no pair is lost.
Components: links are contracted to stars inside tasks of bounded size; where there is more
than one task, alternating large-star and small-star steps, a checkpoint after each pair, join
them up.

Nulls: a null text is empty; a text without words has fingerprint 0, linked like any
other.  A null doc_id is no component's id unless nothing else is in it.  Rows that repeat
a doc_id are one row each in the result.  A bit that half of the hashes have is not set.  Empty
tables give empty results.  Very long texts are hashed piece by piece.  Other columns are not
looked at.  The pipeline's stage, at five words and a similarity of 0.8, is ``wide_simhash``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, text_of, written
from .components import components

SHINGLE, DISTANCE = 4, 4
#: Members outside of the largest part up to which a bucket's pairs are compared; where no more than ``LAST_BITS`` bits are
#: free there can't be more than so many parts (a code of 12 bits at distance 5 has 32 words). Levels at most.
FULL, LAST_BITS, MOST_LEVELS = 32, 12, 16
PIECE = 50_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest as xxh64

    words = text.encode().lower().split()  # bytes: only A-Z and only the six ASCII blanks
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        hashes = np.array([xxh64(joined[a:b], 42) for a, b in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=True)], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(x, shingle) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), fn, "doc_id long, fp long")


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks with which random fingerprints share a key with about one other at most."""
    b = distance + 2
    while b < 2 * distance + 2 and n >> (64 * (b - distance) // b):
        b += 1
    return b


def cut(mask: int, many: int) -> list[int]:
    """The bits of a mask in ``many`` blocks of about one size."""
    bits = [i for i in range(64) if mask >> i & 1]
    edges = [len(bits) * i // many for i in range(many + 1)]
    return [sum(1 << i for i in bits[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def choices(n: int, distance: int) -> list[int]:
    """For ``n`` fingerprints the bits that the two of a close pair may agree on."""
    blocks = cut((1 << 64) - 1, blocks_for(n, distance))
    return [sum(c) for c in combinations(blocks, len(blocks) - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def placed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fp, mask, key: each fingerprint under each mask; keys that meet by chance only bring candidates."""
    rows = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    return rows.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def split(rows: DataFrame, level: int, distance: int) -> DataFrame:
    """The rows (fp, mask, key) under further blocks of the bits that their masks don't cover.

    The 64 bits are dealt out to ``distance + 1`` blocks, at each level in another order; two members of a bucket agree on
    its mask, so if they are close there is a block whose other bits they agree on as well.
    """
    order = sorted(range(64), key=lambda i: (i * (5, 11, 23, 37, 43, 59)[level % 6] + level) % 64)
    edges = [64 * i // (distance + 1) for i in range(distance + 2)]
    blocks = [_signed(sum(1 << i for i in order[lo:hi])) for lo, hi in zip(edges, edges[1:], strict=False)]
    found = rows.select("fp", "key", "mask", F.posexplode(F.array(*map(F.lit, blocks))).alias("nth", "block"))
    found = found.select("fp", F.col("mask").bitwiseOR(F.col("block")).alias("mask"), "key", "nth")
    return found.select("fp", "mask", F.xxhash64("key", "nth", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def linked(fps: DataFrame, n: int, distance: int = DISTANCE, full: int = FULL) -> DataFrame:
    """(node, root) of the distinct fingerprints in ``fps`` that have links, as of ``components``."""
    rows, links, level = placed(fps, choices(n, distance)), None, 0
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    while True:
        buckets = rows.groupBy("key").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
        members = written(rows.join(buckets, "key"), "members")
        stars = written(members.select("u", F.col("fp").alias("v")).where((F.col("u") < F.col("v")) & close).distinct(), "links")
        links = stars if links is None else links.unionByName(stars)
        # In a bucket of two the only pair has been compared.
        parts = members.where("n > 2").join(components(links), F.col("fp") == F.col("node"), "left").select("key", "mask", "n", "fp", F.coalesce("root", "fp").alias("part"))
        parts = written(parts, "parts")
        sizes = parts.groupBy("key", "part").agg(F.count("*").alias("m"), F.first("n").alias("n"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("m", "part")).alias("most"), F.first("n").alias("n")).where("most.m < n")
        largest = largest.select("key", F.col("most.part").alias("largest"), (F.col("n") - F.col("most.m") > full).alias("full"))
        free = 64 - F.bit_count("mask")
        parts = written(parts.drop("n").join(largest, "key").withColumn("full", F.col("full") & (free > LAST_BITS) & F.lit(level < MOST_LEVELS)), "parts")
        u = parts.where("part != largest").select("key", F.col("fp").alias("u"), F.col("part").alias("u_part"), "full")
        v = parts.select("key", F.col("fp").alias("v"), F.col("part").alias("v_part"), "largest")
        once = (F.col("v_part") == F.col("largest")) | (F.col("u_part") < F.col("v_part"))
        across = u.where(~F.col("full")).join(v, "key").where((F.col("u_part") != F.col("v_part")) & once & close)
        across = across.groupBy("u", "v_part").agg(F.min("v").alias("v")).select("u", "v")  # one link to each other part is enough
        links = links.unionByName(written(across, "links"))
        if not parts.where("full").limit(1).count():
            return components(links)
        rows, level = split(parts.where("full").select("fp", "mask", "key"), level, distance), level + 1


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """A row per document: doc_id, fp, component_id."""
    found = written(fingerprints(docs, shingle), "fingerprints")
    reps = written(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "representatives")
    roots = linked(reps, reps.count(), distance)
    joined = written(reps.join(roots, reps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "roots")
    least = written(joined.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    # Both sides are shuffled for this join alone, so that adaptive execution can split a large component.
    classes = written(joined.join(least.hint("merge"), "root").select("fp", "component_id"), "classes")
    return found.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
