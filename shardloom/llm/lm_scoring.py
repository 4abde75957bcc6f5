"""LM scoring: a bigram model with deleted interpolation, learned from the corpus.

P(w | v) = a * c(v,w)/c(v.) + b * c(w)/N + c / (V + 1): maximum-likelihood estimates mixed with
weights that depend on how often the context v was seen (a bucket per power of two).  The
weights are learned by expectation-maximisation on held-out counts: a fold of the training
documents is scored with the counts of the others, and what enters the iteration is a table
of (context bucket, binned log estimates) with counts, bounded by the number of bins.

Counting without a row per token.  Documents are dealt into groups of about ``GROUP_BYTES``
bytes.  Each group sends, for each range of the 64-bit hash space, its distinct n-gram
hashes, sorted, with their counts, as one packed row.  The task that has a range adds up the
counts of all groups and answers each group with the totals, in the order of the hashes sent,
so that an answer holds no hash.  Scoring a group derives the same sorted hashes again
and reads the totals off by place.  All counts are exact, over all training documents, and
travel as packed rows; no n-gram is dropped.  A packed row holds about (group bytes) * (range
bytes) / (input bytes) / 6 hashes.  So that it never holds fewer than about a hundred, both
sizes are at least the root of ``ROW_BYTES`` times the input: the number of packed rows grows
with the input, not with its square, and a task's memory with the root of the input (12 MB of
text up to 0.2 TB, 77 MB at 10 TB, 245 MB at 100 TB, of which a task needs some twenty times).

Tokens: words of the lower-cased (A-Z) text, then one end; the context of the first word is
the end.  Hashes have 64 bits.  The base score is a smoothed unigram model of its own.

Nulls: a null text is empty and has only the end; a null doc_id counts as the text "null".
Rows that repeat a doc_id are one row each.  Rows that repeat id and text share a group; if they are more than ``REPEATS``
and one in 10,000 of all rows, they are counted first, scored as one row that weighs as many, and get its score, so that no
group holds them all.  A text
longer than a group is a group's only large one.  Without training documents all counts are 0.
Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, freed_shuffles, steps, table, text_of, written
from .words import SPACED, U64, pair, words_of

MODULUS, HELD_OUT, TUNING = 7, 2, 5
GROUP_BYTES, RANGE_BYTES, ROW_BYTES = 12 << 20, 24 << 20, 600
REPEATS, MOST_REPEATED = 1_000, 10_000
END = U64(0x5851F42D4C957F2D)
BINS_PER_OCTAVE, ROUNDS = 8, 30
LEVELS = 34  # buckets of context frequency: none, then one per power of two


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, of each bigram that ends in it, and its text; a text's end is its last token."""
    w = words_of(texts, SPACED)
    counts = w.counts()
    ends = np.cumsum(counts + 1) - 1
    token = np.full(len(w.key) + w.rows, END, np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = w.key
    before = np.empty_like(token)
    before[1:] = token[:-1]
    if len(before):
        before[0] = END
    return token, pair(before, token), np.repeat(np.arange(w.rows), counts + 1)


def grouped(docs: DataFrame, group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int, int, DataFrame | None]:
    """(doc_id, text, part, grp, times, hot) with part 0 held out, 1 training, 2 training and tuning; the number of groups and of ranges.

    ``times`` is how many rows a row stands for, ``hot`` the hash of id and text where it is more than one;
    last the hashes of all rows that are not rows of their own.
    """
    size, n = docs.agg(F.sum(F.octet_length(text_of())), F.count("*")).first()
    size = size or 0
    least = int((size * ROW_BYTES) ** 0.5)
    groups, ranges = int(size // max(group_bytes, least)) + 1, int(size // max(range_bytes, least)) + 1
    rest = fold(MODULUS)
    part = F.when(rest == HELD_OUT, 0).when(rest == TUNING, 2).otherwise(1)
    tuning = int(groups // MODULUS) + 1  # tuning documents have groups of their own
    spread = F.xxhash64("doc_id", "text")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("part", part).withColumn("hot", spread)
    often = dealt.groupBy("hot").count().where(F.col("count") > max(REPEATS, n // MOST_REPEATED)).select("hot").collect()  # fewer than MOST_REPEATED
    grp = F.when(F.col("part") == 2, -1 - F.pmod(spread, F.lit(tuning))).otherwise(F.pmod(spread, F.lit(groups))).cast("int").alias("grp")
    columns = ("doc_id", "text", "part", grp, "times", "hot")
    if not often:
        return dealt.withColumns({"times": F.lit(1).cast("long"), "hot": F.lit(None).cast("long")}).select(*columns), groups, ranges, None
    keys = F.broadcast(docs.sparkSession.createDataFrame(often, "hot long"))
    repeated = dealt.join(keys, "hot", "left_semi")
    once = repeated.groupBy("doc_id", "text", "part", "hot").agg(F.count("*").alias("times"))
    single = dealt.join(keys, "hot", "left_anti").withColumns({"times": F.lit(1).cast("long"), "hot": F.lit(None).cast("long")})
    return single.select(*columns).unionByName(once.select(*columns)), groups, ranges, repeated.select("hot")


class Group:
    """The tokens of a group's documents and their distinct hashes."""

    def __init__(self, batches: list[pa.RecordBatch]):
        parts = [(tokens(x.column("text")), x) for b in batches for x in steps(b)]
        self.doc_id = pa.concat_arrays([x.column("doc_id") for _, x in parts])
        self.part, self.times = (np.concatenate([np.asarray(x.column(c)) for _, x in parts]) for c in ("part", "times"))
        self.hot = pa.concat_arrays([x.column("hot") for _, x in parts])
        base = np.cumsum([0] + [x.num_rows for _, x in parts])
        self.row = np.concatenate([t[2] + b for (t, _), b in zip(parts, base, strict=False)])
        token, bigram = (np.concatenate([t[i] for t, _ in parts]) for i in (0, 1))
        trained = self.part[self.row] > 0
        self.kinds = []
        for x in (token, bigram):
            hashes, place = np.unique(x, return_inverse=True)
            self.kinds.append((hashes, place, np.bincount(place[trained], self.times[self.row[trained]], len(hashes)).astype(np.int64)))
        self.first = np.concatenate([[True], self.row[1:] != self.row[:-1]]) if len(self.row) else np.zeros(0, bool)

    def requests(self, ranges: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(kind, range, hashes, counts) for each range."""
        for kind, (hashes, _, counts) in enumerate(self.kinds):
            cuts = np.searchsorted(hashes, bounds(ranges))
            for r, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(hashes)), strict=True)):
                if b > a:
                    yield kind, r, hashes[a:b], counts[a:b]


def bounds(ranges: int) -> np.ndarray:
    return np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)


def packed(x: np.ndarray) -> bytes:
    """Numbers in the fewest whole bytes that hold the largest, compressed."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) < 1 << 8 * int(k[2]))
    return kind[2].encode() + len(x).to_bytes(8, "little") + pa.compress(x.astype(kind).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    kind, n = f"<u{data[:1].decode()}", int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], n * int(kind[2]), "zstd", asbytes=True), kind).astype(np.int64)


def packed_hashes(x: np.ndarray) -> bytes:
    """Sorted hashes as their differences, one byte plane after the other: high planes compress to nothing."""
    gaps = np.diff(x, prepend=U64(0))
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(x).to_bytes(8, "little") + b"".join(len(p).to_bytes(8, "little") + p for p in (pa.compress(np.ascontiguousarray(p).tobytes(), "zstd", asbytes=True) if i > 3 else np.ascontiguousarray(p).tobytes() for i, p in enumerate(planes)))


def unpacked_hashes(data: bytes) -> np.ndarray:
    n, at, planes = int.from_bytes(data[:8], "little"), 8, []
    for i in range(8):
        size = int.from_bytes(data[at : at + 8], "little")
        raw = data[at + 8 : at + 8 + size]
        planes.append(np.frombuffer(pa.decompress(raw, n, "zstd", asbytes=True) if i > 3 else raw, np.uint8))
        at += 8 + size
    return np.cumsum(np.ascontiguousarray(np.stack(planes).T).view("<u8").ravel(), dtype=np.uint64)


def _table(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names.split())


REQUEST = "grp int, kind int, rng int, hashes binary, counts binary"
ANSWER = "grp int, kind int, rng int, total binary, kept binary, tokens long, distinct long, tuned long"


def counted(dealt: DataFrame, ranges: int) -> DataFrame:
    """For each group and range, the totals of its hashes in order: over all training documents, and without the tuning ones."""

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        g = int(key[0].as_py())
        found = [(g, kind, r, packed_hashes(hashes), packed(counts)) for kind, r, hashes, counts in Group(rows.combine_chunks().to_batches()).requests(ranges)]
        return _table(found, "grp kind rng hashes counts", [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def add_up(key: tuple, asked: pa.Table) -> pa.Table:
        rows = sorted(asked.to_pylist(), key=lambda x: x["grp"])
        hashes = [unpacked_hashes(x["hashes"]) for x in rows]
        counts = [unpacked(x["counts"]) for x in rows]
        every, place = np.unique(np.concatenate(hashes), return_inverse=True)
        tuned = np.repeat([x["grp"] < 0 for x in rows], [len(h) for h in hashes])
        flat = np.concatenate(counts)
        total = np.bincount(place, weights=flat, minlength=len(every)).astype(np.int64)
        kept = total - np.bincount(place[tuned], weights=flat[tuned], minlength=len(every)).astype(np.int64)
        at, out = 0, []
        for i, (x, h) in enumerate(zip(rows, hashes, strict=True)):
            own = place[at : at + len(h)]
            at += len(h)
            sums = (int(total.sum()), int((total > 0).sum()), int(kept.sum())) if i == 0 else (0, 0, 0)
            out.append((x["grp"], x["kind"], x["rng"], packed(total[own]), packed(kept[own]) if x["grp"] < 0 else None, *sums))
        return _table(out, "grp kind rng total kept tokens distinct tuned", [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])

    asked = dealt.groupBy("grp").applyInArrow(ask, REQUEST)
    return asked.groupBy("kind", "rng").applyInArrow(add_up, ANSWER)


def totals_of(answers: list[dict], kind: int, column: str) -> np.ndarray:
    found = [unpacked(x[column]) for x in sorted((x for x in answers if x["kind"] == kind), key=lambda x: x["rng"])]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def level(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency."""
    return np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), LEVELS - 1)


def estimates(group: Group, answers: list[dict], column: str, n_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: context bucket, bigram estimate, unigram estimate, count."""
    (_, uni_place, _), (_, bi_place, _) = group.kinds
    uni, bi = totals_of(answers, 0, column), totals_of(answers, 1, column)
    c, cc = uni[uni_place], bi[bi_place]
    context = np.empty_like(c)
    context[1:] = c[:-1]
    # A text's first word has the end as its context, which comes last in it: each text has one.
    last = np.append(group.first[1:], True)
    context[group.first] = c[last]
    return level(context), np.where(context > 0, cc / np.maximum(context, 1), 0.0), c / max(1, n_tokens), c


def fit_weights(bins: list[tuple[int, int, int, float]], floor: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per context bucket by EM over (bucket, bigram bin, unigram bin, count)."""
    weights = np.tile([0.4, 0.5, 0.1], (LEVELS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if bins:
        data = np.array(bins, float)
        bucket, n = data[:, 0].astype(int), data[:, 3]
        p = np.stack([unbinned(data[:, 1]), unbinned(data[:, 2]), np.full(len(data), floor)], 1)
        for _ in range(rounds):
            share = weights[bucket] * p
            share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
            sums = np.stack([np.bincount(bucket, share[:, i], LEVELS) for i in range(3)], 1)
            seen = sums.sum(1) > 0
            weights[seen] = sums[seen] / sums[seen].sum(1, keepdims=True)
    weights = np.maximum(weights, [0.0, 0.0, 1e-4])  # any token stays possible
    return weights / weights.sum(1, keepdims=True)


def binned(p: np.ndarray) -> np.ndarray:
    """0 for 0, else a bin of the logarithm."""
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * BINS_PER_OCTAVE) - 1, 0).astype(np.int64)


def unbinned(b: np.ndarray) -> np.ndarray:
    return np.where(b < 0, np.exp2((b + 1) / BINS_PER_OCTAVE), 0.0)


def score(docs: DataFrame, group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per document: doc_id, part, n_tokens, n_known, train_tokens, base_score, score (log10 probability)."""
    spark = docs.sparkSession
    dealt, _, ranges, repeated = grouped(docs, group_bytes, range_bytes)
    answers = written(counted(dealt, ranges), "counts")
    sums = {r["kind"]: r for r in answers.groupBy("kind").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v"), F.sum("tuned").alias("kept")).collect()}
    n, v, kept = (int(sums[0][x]) if 0 in sums else 0 for x in ("n", "v", "kept"))
    floor = 1 / (v + 1)
    columns = ["grp", "kind", "rng", "total", "kept"]

    def bins(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left.combine_chunks().to_batches())
        bucket, bi, uni, _ = estimates(group, right.to_pylist(), "kept", kept)
        cells, at = np.unique(np.stack([bucket, binned(bi), binned(uni)]), axis=1, return_inverse=True)
        many = np.bincount(at.reshape(-1), group.times[group.row].astype(np.float64), cells.shape[1])
        return pa.table({"bucket": cells[0], "bi": cells[1], "uni": cells[2], "n": many})

    tuning = dealt.where("part = 2").groupBy("grp").cogroup(answers.where("grp < 0").select(*columns).groupBy("grp"))
    cells = tuning.applyInArrow(bins, "bucket long, bi long, uni long, n double").groupBy("bucket", "bi", "uni").agg(F.sum("n").alias("n"))
    with freed_shuffles(spark):
        found = [tuple(r) for r in cells.collect()]  # bounded by the number of bins
    shared = spark.sparkContext.broadcast(fit_weights(sorted(found), floor))

    def scores(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({x: pa.array([], k) for x, k in zip(out.names, out.types, strict=True)})
        group = Group(left.combine_chunks().to_batches())
        bucket, bi, uni, c = estimates(group, right.to_pylist(), "total", n)
        w = shared.value[bucket]
        p = np.log10(w[:, 0] * bi + w[:, 1] * uni + w[:, 2] * floor)
        base = np.log10((c + 1) / (n + (v + 1)))
        rows = len(group.part)
        add = lambda x: np.bincount(group.row, x, rows)
        values = [group.doc_id, group.part, np.bincount(group.row, minlength=rows), add(c > 0).astype(np.int64), np.full(rows, n), add(base), add(p), group.hot]
        return pa.table([pa.array(x, k) for x, k in zip(values, out.types, strict=True)], names=out.names)

    out = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("hot", pa.int64())])
    pairs = dealt.groupBy("grp").cogroup(answers.select(*columns).groupBy("grp"))
    found = pairs.applyInArrow(scores, "doc_id long, part long, n_tokens long, n_known long, train_tokens long, base_score double, score double, hot long")
    if repeated is None:
        return found.drop("hot")
    found = written(found, "scores")
    every = repeated.join(F.broadcast(found.where("hot is not null")), "hot")  # fewer than MOST_REPEATED rows
    return found.where("hot is null").drop("hot").unionByName(every.drop("hot"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).select("doc_id", (F.col("part") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
