"""SimHash near copies at a similarity of 0.8: wide fingerprints of sets of five-word shingles.

Words are parted by the six ASCII blanks, A-Z count as a-z; a text of fewer words is one shingle.
Texts with one set are one row from the start.  Each shingle's hash is spread to ``BITS`` bits and
the fingerprint is their majority: two sets with a Jaccard similarity of 0.8 differ in 15 % of
the bits, more alike ones in fewer.  64 bits are too few for that: a pigeonhole over 16 differing
ones of 64 takes thousands of keys a text.  ``BITS`` are enough to be split into many blocks.

Blocks: ``blocks_of(n)`` cuts the bits into disjoint blocks of about log2(n) bits, so that a
random text shares a block with about one other, and takes as many of them as let a pair at 0.8
share none with a probability of ``MISS`` (1 %; at 0.85 it is below 0.1 %, at 0.9 below 0.001 %).
The number of blocks grows with the power 0.24 of the number of texts.  The join is on the
blocks, the Hamming distance is verified in its condition, and every pair that passes is
confirmed by the exact similarity of the two sets: no two texts below 0.8 are linked.

A large group must not make a square of pairs.  In fuller blocks than those that up to ``FEW`` sets
share, each set is first compared with one only: of the smallest sets of its blocks the one whose fingerprint is
nearest.  What is confirmed is contracted, then all pairs of the small blocks between different parts are compared.  Sets whose fingerprints are
close enough to such a smallest set (99.8 % of those at 0.8) are its family, and so are families that share sets.  All pairs between the parts of a family
are compared in cells of bounded size, fingerprints first, then the exact sets; a cell gives only what joins its parts up, so pairs never become
rows.  What is left are pairs of one full block and of two families, again the nearest one of each set first.
No partner is dropped, whatever their number; the comparisons of a family grow with its square, in many tasks, its rows with the square divided by
``CELL_SETS``.

Nulls: a null text is empty; texts without words are one group.  Of each group one row stays,
whatever its ids: see ``common.one_row_each``.  Ties in the majority are 0.  Very long texts
are spread in pieces.  Empty tables give empty results; other columns pass through unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_STEP_BYTES, best_rows, mapped, one_row_each, text_of, with_text_hash, written
from .components import between_parts, components
from .words import SPACED, mix, pair, words_of

SHINGLE = 5
#: The least similarity, as a fraction.
ALIKE, OF = 4, 5
WORDS = 32
BITS = 64 * WORDS
MISS, FEW = 0.01, 8
#: Share of bits in which sets at the least similarity differ.
DIFFERS = math.acos(2 * ALIKE / (ALIKE + OF)) / math.pi
#: Hashes spread at once.
SPREAD = 1 << 14
#: Of a family, sets and shingles in a chunk (on average), and sets of a chunk compared with another at once.
CELL_SETS, CELL_SHINGLES, STRIP = 1000, 1_000_000, 64
_OFFSETS = np.random.default_rng(20240501).integers(1, 2**63, WORDS, dtype=np.uint64)


def blocks_of(n: int) -> list[np.ndarray]:
    """The places of each block's bits in the fingerprint, for ``n`` texts."""
    width = max(8, math.ceil(math.log2(max(2, n))))
    many = math.ceil(-math.log(MISS) / (1 - DIFFERS) ** width)
    random = np.random.default_rng(20240502)
    cuts: list[np.ndarray] = []
    while len(cuts) < many:  # one splitting of the bits, and where that isn't enough, others
        order = random.permutation(BITS)
        cuts += [order[i : i + width] for i in range(0, BITS - width + 1, width)]
    return cuts[:many]


def furthest(bits: int) -> float:
    """Differing bits of ``bits`` that a pair at the least similarity exceeds in 0.2 % of cases or fewer."""
    return bits * DIFFERS + 3 * math.sqrt(bits * DIFFERS * (1 - DIFFERS))


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, one text after the other, and where each text's begin and end."""
    w = words_of(texts, SPACED)
    counts = w.counts()
    ends = np.cumsum(counts)
    n = np.where(counts > 0, np.maximum(1, counts - width + 1), 0)
    row = np.repeat(np.arange(w.rows), n)
    at = np.repeat(ends - counts, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hashes, stop = np.zeros(len(row), np.uint64), ends[row]
    for i in range(width):
        inside = at + i < stop
        hashes[inside] = pair(hashes[inside], w.key[at[inside] + i])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(w.rows + 1))


def _ones(hashes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For each row of hashes, how many of the valid ones have each of the ``BITS`` bits.

    The counts are added up bit plane by bit plane, 64 at once: halves of the rows, as binary numbers.
    """
    spread = mix(hashes[..., None] + _OFFSETS)
    spread[~valid] = 0
    planes = [spread]
    while (n := planes[0].shape[1]) > 1:
        if n % 2:
            planes = [np.concatenate([p, np.zeros_like(p[:, :1])], 1) for p in planes]
        added, carry = [], None
        for p in planes:
            a, b = p[:, 0::2], p[:, 1::2]
            half = a ^ b
            added.append(half if carry is None else half ^ carry)
            carry = a & b if carry is None else (a & b) | (half & carry)
        planes = [*added, carry]
    return sum(np.unpackbits(p[:, 0].astype(">u8").view(np.uint8), axis=1).astype(np.int32) << i for i, p in enumerate(planes))


def majorities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of each set's fingerprint (0 or 1, a row of ``BITS`` each)."""
    sizes = np.diff(at)
    out = np.zeros((len(sizes), BITS), np.uint8)
    # Sets of about one size (within an eighth) are one step.
    octave = np.maximum(np.log2(np.maximum(sizes, 1)).astype(np.int64) - 3, 0)
    padded = (sizes + (1 << octave) - 1 >> octave) << octave
    for size in np.unique(padded[sizes > 0]).tolist():
        alike = np.flatnonzero(padded == size)
        many = max(1, SPREAD // size)
        for i in range(0, len(alike), many):
            rows = alike[i : i + many]
            ones = np.zeros((len(rows), BITS), np.int32)
            for first in range(0, size, SPREAD):
                place = np.arange(first, min(size, first + SPREAD))[None, :]
                valid = place < sizes[rows, None]
                ones += _ones(hashes[np.where(valid, at[rows, None] + place, 0)], valid)
            out[rows] = 2 * ones > sizes[rows, None]
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).ravel().view(np.int64))


def signatures(docs: DataFrame, blocks: list[np.ndarray]) -> DataFrame:
    """A row per document: doc_id, text_hash, set_key, size, fp (the fingerprint's words), blocks (a key of each)."""
    width = len(blocks[0])
    places = np.concatenate(blocks)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, at = shingle_sets(batch.column("text"))
        size = np.diff(at)
        some = np.flatnonzero(size)
        set_key = np.zeros(batch.num_rows, np.uint64)
        if len(some):
            set_key[some] = mix(np.add.reduceat(mix(hashes), at[some]) + size[some].astype(np.uint64))
        bits = majorities(hashes, at)
        fp = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
        cut = np.packbits(bits[:, places].reshape(batch.num_rows, len(blocks), width), axis=2)
        keys = np.zeros((*cut.shape[:2], 8), np.uint8)
        keys[..., : cut.shape[2]] = cut
        keys = pair(np.broadcast_to(np.arange(len(blocks), dtype=np.uint64), keys.shape[:2]), keys.view(np.uint64)[..., 0])
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1]), _signed(x)) for x in (fp, keys)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), _signed(set_key), pa.array(size.astype(np.int64)), *lists], names=["doc_id", "text_hash", "set_key", "size", "fp", "blocks"])

    return mapped(_source(docs), fn, "doc_id long, text_hash long, set_key long, size long, fp array<long>, blocks array<long>", SMALL_STEP_BYTES)


def _source(docs: DataFrame) -> DataFrame:
    return with_text_hash(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", text_of().alias("text"))


def sets_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, shingles of the texts that ``rows`` (node, id, hash) name."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, at = shingle_sets(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _signed(hashes))], names=["node", "shingles"])

    source = _source(docs)
    wanted = source.join(rows.hint("merge"), source.doc_id.eqNullSafe(rows.id) & (source.text_hash == rows.hash)).select("node", "text")
    return mapped(wanted, fn, "node long, shingles array<long>", SMALL_STEP_BYTES).dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with a similarity of ``ALIKE / OF`` or more.  The hot side, u, is joined last: that join may be split."""
    u, v = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return pairs.join(v, "v").join(u, "u").where(shared * (ALIKE + OF) >= (F.size("a") + F.size("b")) * ALIKE).select("u", "v")


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "key"))


def _distance(words: range) -> Column:
    return sum((F.bit_count(F.get("u_fp", F.lit(i)).bitwiseXOR(F.get("v_fp", F.lit(i)))) for i in words), F.lit(0))


def _close() -> Column:
    """Sizes and whole fingerprints allow the least similarity; the majority of a few hashes varies more."""
    sizes = (F.col("u_size") * OF >= F.col("v_size") * ALIKE) & (F.col("v_size") * OF >= F.col("u_size") * ALIKE)
    return sizes & (_distance(range(4)) <= math.ceil(furthest(256))) & (_distance(range(WORDS)) <= F.lit(furthest(BITS)) + F.lit(BITS / 8) / F.least("u_size", "v_size"))


def linked(docs: DataFrame, signs: DataFrame, best: DataFrame) -> DataFrame:
    """(node, root) of the sets that are alike, as of ``components``."""
    sets = written(signs.groupBy(F.col("set_key").alias("node")).agg(*(F.first(c).alias(c) for c in ("size", "fp", "blocks"))), "sets")
    rows = sets.select("node", F.get("fp", F.lit(0)).alias("word"), F.explode("blocks").alias("key"))
    buckets = written(rows.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(rows.join(buckets, "key"), "members")

    few = members.where(F.col("n") <= FEW).select("key", "node", "word")
    near = F.bit_count(F.col("u_word").bitwiseXOR(F.col("v_word"))) <= math.ceil(furthest(64))
    some = _sided(few, "u").join(_sided(few, "v"), "key").where((F.col("u_node") < F.col("v_node")) & near)
    some = some.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).distinct()

    some = written(some, "some")
    prints = sets.select("node", "size", "fp")
    # A row per set: its fingerprint and its part are joined once, not in each of its blocks.
    full = members.where(F.col("n") > FEW).groupBy("node").agg(F.collect_list("key").alias("keys"), F.collect_set("least").alias("leasts"))
    full = written(full.join(prints, "node"), "full")
    u, v = ([F.col(c).alias(f"{side}_{c}" if c != "node" else side) for c in ("node", "size", "fp")] for side in "uv")
    nodes = some.select(F.col("u").alias("node")).union(some.select("v")).union(full.select("node")).distinct()
    texts = written(sets_of(docs, best.join(nodes, best.set_key == nodes.node, "left_semi").select(F.col("set_key").alias("node"), "id", "hash")), "shingles")

    stars = full.select(*v, F.explode("leasts").alias("u")).where("v > u").join(full.select(*u), "u")
    stars = written(stars.where(_close()).select("u", "v", _distance(range(WORDS)).alias("d")), "stars")
    links = written(confirmed(written(_nearest(stars), "pairs"), texts), "links")
    roots = written(components(links), "roots")
    links = written(links.unionByName(confirmed(written(_across(some, roots), "pairs"), texts)), "links")
    roots = written(components(links), "roots")

    # All pairs of a family are compared in cells; those of one block but of two families are joined.
    family = written(components(stars.select("u", "v").unionByName(links)), "families")
    whole = family.union(family.select("root", "root").distinct()).toDF("node", "family")
    whole = prints.join(whole, "node").join(roots, "node", "left").select("node", "size", "fp", "family", F.coalesce("root", "node").alias("part"))
    links = written(links.unionByName(within(written(whole, "whole"), texts)), "links")

    parts = full.join(family, "node", "left").select(F.explode("keys").alias("key"), "node", "size", "fp", F.coalesce("root", "node").alias("part"))
    rest, every = between_parts(parts, ["key"])
    once = (F.col("v_part") == F.col("v_largest")) | (F.col("u_node") < F.col("v_node"))
    across = _sided(rest, "u").join(_sided(every, "v"), "key").where((F.col("u_part") != F.col("v_part")) & once & _close())
    across = written(across.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"), _distance(range(WORDS)).alias("d")).distinct(), "across")
    tried = written(_nearest(across), "pairs")
    links = written(links.unionByName(confirmed(tried, texts)), "links")
    left = _across(across.select("u", "v").join(tried, ["u", "v"], "left_anti"), written(components(links), "roots"))
    return components(links.unionByName(written(confirmed(written(left, "pairs"), texts), "links")))


def within(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between the parts of each family, of ``members`` (node, size, fp, family, part).

    A family's members are dealt into chunks by their hash, and each cell, the rows of two chunks, is one step of a task: fingerprints
    first, then the exact sets.  A cell gives what joins its parts up, a row less than it has parts at most.
    """
    every = written(between_parts(members, ["family"])[1].join(texts, "node"), "family-sets")
    rest = every.where("part != largest")
    many = lambda rows, name: rows.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / CELL_SETS, F.sum("size") / CELL_SHINGLES)).cast("int").alias(name))
    chunks = written(many(rest, "rests").join(many(every, "alls"), "family"), "chunks")
    own, others = (lambda n: F.pmod(F.xxhash64("node"), n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    columns = ["family", "node", "part", "largest", "size", "fp", "shingles"]
    first = rest.join(chunks, "family").select(*columns, own(F.col("rests")).alias("i"), others("alls").alias("j"), F.lit(True).alias("first"))
    second = every.join(chunks, "family").select(*columns, others("rests").alias("i"), own(F.col("alls")).alias("j"), F.lit(False).alias("first"))
    return first.unionByName(second).groupBy("family", "i", "j").applyInArrow(cell_links, "u long, v long")


def cell_links(rows: pa.Table) -> pa.Table:
    """Links that join up the parts of a cell, nearest fingerprints first."""
    rows = rows.combine_chunks()
    first = np.asarray(rows["first"].to_numpy())
    node, part, size = (rows[c].to_numpy() for c in ("node", "part", "size"))
    fp = np.asarray(rows["fp"].combine_chunks().flatten()).view(np.uint64).reshape(-1, WORDS)
    lists = rows["shingles"].combine_chunks()
    shingles, ends = np.asarray(lists.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    u, v = np.flatnonzero(first), np.flatnonzero(~first)
    anchored = part[v] == rows["largest"].to_numpy()[v]
    close = []
    for at in range(0, len(u), STRIP):
        a = u[at : at + STRIP, None]
        apart = (part[a] != part[v]) & (anchored | (node[a] < node[v])) & (size[a] * OF >= size[v] * ALIKE) & (size[v] * OF >= size[a] * ALIKE)
        x, y = np.nonzero(apart)
        x, y = a[x, 0], v[y]
        for i in range(0, len(x), SPREAD):
            xs, ys = x[i : i + SPREAD], y[i : i + SPREAD]
            d = np.bitwise_count(fp[xs] ^ fp[ys]).sum(1, dtype=np.int64)
            near = d <= furthest(BITS) + BITS / 8 / np.maximum(1, np.minimum(size[xs], size[ys]))
            close.append(np.stack([d[near], xs[near], ys[near]]))
    root = {p: p for p in part.tolist()}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    found, close = [], np.concatenate(close, 1) if close else np.zeros((3, 0), np.int64)
    for _, x, y in close[:, np.lexsort(close[::-1])].T.tolist():
        if (a := find(int(part[x]))) != (b := find(int(part[y]))):
            p, q = shingles[ends[x] : ends[x + 1]], shingles[ends[y] : ends[y + 1]]
            shared = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
            if shared * (ALIKE + OF) >= (len(p) + len(q)) * ALIKE:
                root[a] = b
                found.append((node[x], node[y]))
    return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (u, v, d) for each v the one that differs least."""
    return pairs.groupBy("v").agg(F.min(F.struct("d", "u")).alias("best")).select(F.col("best.u").alias("u"), "v")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that ``roots`` doesn't link yet; the others have nothing to add."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    apart = F.coalesce("u_root", "u") != F.coalesce("v_root", "v")
    return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where(apart).select("u", "v")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with its own columns."""
    signs = written(signatures(docs, blocks_of(docs.count())), "signatures")
    best = written(best_rows(signs, "set_key"), "representatives")
    roots = linked(docs, signs, best)
    groups = best.join(roots, best.set_key == roots.node, "left").select(F.coalesce("root", "set_key").alias("root"), "none", "id", "hash", "rows")
    return one_row_each(docs, groups)
