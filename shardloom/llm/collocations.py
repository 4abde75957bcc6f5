r"""Phrase collocations by SETM: relations of occurrences, merge-joined, counted and pruned level by level.

A text is lower-cased (A-Z) and split at ``[.,;:!?\x0A-\x0D]`` into pieces and these into words
``[^\x20\x09]+``.  Everything is counted per lang.  A relation of level k has a row per occurrence of
a phrase of k words, sorted by piece and position (one number, the slot: words that stand next to
each other in a piece have slots next to each other, two pieces never do).  Level by level:

1. persist: the relation is a written table, its rows packed in slot order, some hundred words a row;
2. merge-join: an occurrence meets the one at the next slot of its piece, which makes the
   occurrences of k + 1 words; both sides are sorted, and no piece spans two rows;
3. group-count: counts per task, then a shuffle of counts, the words as numbers of 32 bits while at most ``MOST_NUMBERED`` are frequent;
4. semi-join: before the next level only occurrences of frequent phrases stay.

The semi-join tests a bit filter of the frequent phrases (at most ``MOST_BITS`` bits, whatever the
size of the input), so occurrences are never shuffled.  It may let a rare phrase pass, never stop a
frequent one; the counts that follow are exact.  Phrases are told apart by the 64-bit hashes of their
words; whether two words share one is checked over all words, and if so another hash is taken.

A phrase of at least ``least`` occurrences is a candidate.  Each cut into two parts with l and r
occurrences scores floor(2000000 * a / (l + r)), in decimals of 38 digits; the lowest counts.  A candidate
inside a longer one with at least ``cover`` per cent of its occurrences goes.  Parts of a
candidate are at least as frequent as it is, so all of l and r are known.

Nulls: a null text is empty, a null lang is ``und``.  Ties: cuts of one score, the shortest first part;
phrases of one score and count, UTF-8 order.  Rows that repeat, null ids and extra columns:
each row counts, nothing but lang and text is looked at.  Long texts are cut between pieces; one piece
is one step's work, some forty times its bytes.  Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import steps, table, text_of, written
from .words import SEED, U64, _bytes_table, mix, pair, words_of

LONGEST, LEAST, TOP, COVER = 4, 30, 2000, 80
SCALE = 2_000_000
BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD_BYTES = _bytes_table(bytes(b for b in range(256) if b not in b" \t" + BREAKS), True)
WORD_BYTES[0] = 255  # a zero byte belongs to a word; see words.SPACED
LOWER = _bytes_table(bytes(range(256)), True)
IS_BREAK = np.isin(np.arange(256), list(BREAKS))
#: Bytes of a long text in one step, words of a packed row, packed rows in one step, rows of counts that a task gathers before it hands them on.
PORTION, ROW_WORDS, ROWS, GATHERED = 2 << 20, 128, 1024, 200_000
EMITTED = 50_000
#: Occurrences that one task counts at least: what it hands on is combined, so fewer tasks hand on fewer rows.
COUNTED = 4_000_000
#: A word's distance to the slot before it, and the bit that says that a phrase begins at it.
GAP, LIVE = np.uint32(2), np.uint32(1 << 31)
#: Bits of the filter: so many for each frequent phrase, up to 16 MB; with four probes less than one rare phrase in a thousand passes.
BITS_EACH, PROBES, MOST_BITS = 32, 4, 1 << 27
#: Frequent words up to which they are numbered: 16 MB to every task.
MOST_NUMBERED = 2_000_000

RELATION = "step binary, word binary"


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts at once, or a single long one in portions cut after a break."""
    if len(texts) != 1 or len(raw := texts[0].as_py().encode()) <= 2 * PORTION:
        yield texts
        return
    ends, at = np.flatnonzero(IS_BREAK[np.frombuffer(raw, np.uint8)]) + 1, 0
    while at < len(raw):
        k = int(np.searchsorted(ends, at + PORTION))
        stop = int(ends[k]) if k < len(ends) else len(raw)
        yield pa.array([raw[at:stop].decode()], pa.large_string())
        at = stop


@dataclass
class Occurrences:
    """Words in slot order: slot, word (hash with the lang), and where they stand in ``raw``."""

    slot: np.ndarray
    word: np.ndarray
    lang: np.ndarray  # number of the lang in ``langs``
    langs: list[str]
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray


def occurrences(langs: list[str], texts: pa.Array, seed: int) -> Occurrences:
    w = words_of(texts, WORD_BYTES, seed)
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    of = np.array([number[x] for x in langs], np.int64)[w.row] if len(w.key) else np.zeros(0, np.int64)
    salts = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in names], np.uint64)
    piece = np.cumsum(IS_BREAK[w.raw])[w.start] if len(w.key) else np.zeros(0, np.int64)
    first = np.ones(len(w.key), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (w.row[1:] != w.row[:-1])
    slot = np.arange(len(w.key)) + np.cumsum(first)  # one slot stays empty between pieces
    return Occurrences(slot, pair(salts[of], w.key) if len(w.key) else w.key, of, names, w.raw, w.start, w.end)


def _occurrences_of(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Occurrences]:
    for batch in batches:
        for part in steps(batch):
            langs = part.column("lang").to_pylist()
            for texts in portions(part.column("text")):
                yield occurrences(langs, texts, seed)


def _strings(o: Occurrences, at: np.ndarray) -> pa.Array:
    """The words at these places, lower-cased."""
    length = o.end[at] - o.start[at]
    ends = np.concatenate([[0], np.cumsum(length)])
    take = np.arange(ends[-1]) - np.repeat(ends[:-1] - o.start[at], length)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[o.raw[take]]))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, key, n of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for o in _occurrences_of(batches, seed):
            key, at, n = np.unique(o.word, return_index=True, return_counts=True)
            lang = pa.array(o.langs, pa.large_string()).take(pa.array(o.lang[at]))
            held.append(pa.table({"lang": lang, "word": _strings(o, at), "key": key.view(np.int64), "n": n}))
            if sum(len(t) for t in held) >= GATHERED:
                yield from _summed(held)
                held = []
        if held:
            yield from _summed(held)

    return docs.mapInArrow(run, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def _summed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    sums = pa.concat_tables(held).group_by(["lang", "word", "key"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
    yield from sums.select(["lang", "word", "key", "n"]).cast(schema).to_batches(max_chunksize=50_000)
    pa.default_memory_pool().release_unused()


def phrase_hash(word: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = word[at]
    for i in range(1, k):
        h = pair(h, word[at + i])
    return h


@dataclass
class Filter:
    """A bit filter: never says no to a member."""

    cells: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for place in probes(h, len(self.cells) * 64):
            found &= (self.cells[place >> U64(6)] >> (place & U64(63)) & U64(1)).astype(bool)
        return found


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    step = mix(h) | U64(1)
    return [(h + U64(i) * step) & U64(bits - 1) for i in range(PROBES)]


def bit_filter(frequent: DataFrame, k: int, most: int = MOST_BITS) -> Filter:
    """The filter of the phrases (w1 .. wk) of a written table; what comes to the driver is at most ``most`` bits."""
    bits = 1 << max(10, int(frequent.count() * BITS_EACH).bit_length())
    bits = min(bits, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            word = np.stack([np.asarray(batch.column(i)).view(np.uint64) for i in range(k)], 1).reshape(-1)
            place = np.concatenate(probes(phrase_hash(word, np.arange(batch.num_rows) * k, k), bits))
            cell, at = np.unique(place >> U64(6), return_inverse=True)
            value = np.zeros(len(cell), np.uint64)
            np.bitwise_or.at(value, at, U64(1) << (place & U64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(value.view(np.int64))], names=["cell", "value"])

    parts = frequent.select(*(f"w{i + 1}" for i in range(k))).mapInArrow(run, "cell long, value long")
    found = parts.groupBy("cell").agg(F.bit_or("value").alias("value")).toArrow()
    cells = np.zeros(bits // 64, np.uint64)
    cells[np.asarray(found["cell"])] = np.asarray(found["value"]).view(np.uint64)
    return Filter(cells)


def packed(slot: np.ndarray, word: np.ndarray, live: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the relation, cut between pieces; slots as distances, so that rows of any origin can be read in a row."""
    if not len(slot):
        return
    edges = np.flatnonzero(np.diff(slot) > 1) + 1
    at = np.searchsorted(edges, np.arange(ROW_WORDS, len(slot), ROW_WORDS))
    ends = np.concatenate([[0], np.unique(edges[at[at < len(edges)]]), [len(slot)]])
    step = np.minimum(np.diff(slot, prepend=0), LIVE - 1).astype(np.uint32)
    step[ends[:-1]] = GAP
    step |= live.astype(np.uint32) << np.uint32(31)
    columns = [pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in (step, word)]
    yield pa.RecordBatch.from_arrays(columns, names=["step", "word"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """slot, word, live of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            step, word = (np.frombuffer(b"".join(part.column(i).to_pylist()), kind) for i, kind in enumerate((np.uint32, np.uint64)))
            yield np.cumsum(step & ~LIVE, dtype=np.int64), word, (step & LIVE) != 0


def joined(slot: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Merge-join of a relation with itself on the next slot: the places at which a phrase one word longer begins."""
    return np.flatnonzero(live[:-1] & live[1:] & (slot[1:] == slot[:-1] + 1))


def first_relation(docs: DataFrame, shared: Broadcast, seed: int) -> DataFrame:
    """The occurrences of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for o in _occurrences_of(batches, seed):
            kept = shared.value.has(o.word)
            yield from packed(o.slot[kept], o.word[kept], np.ones(int(kept.sum()), bool))

    return docs.mapInArrow(run, RELATION)


def next_relation(relation: DataFrame, k: int, shared: Broadcast) -> DataFrame:
    """The occurrences of frequent phrases of ``k`` words, from those of one word less; words in none of them go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, word, live in unpacked(batches):
            at = joined(slot, live)
            at = at[shared.value.has(phrase_hash(word, at, k))]
            begins, kept = np.zeros(len(slot), bool), np.zeros(len(slot), bool)
            begins[at] = True
            for i in range(k):
                kept[at + i] = True
            yield from packed(slot[kept], word[kept], begins[kept])

    return relation.mapInArrow(run, RELATION)


def _unique(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words with their counts, equal rows added up."""
    h = phrase_hash(rows.reshape(-1), np.arange(len(rows)) * rows.shape[1], rows.shape[1])
    _, first, at = np.unique(h, return_index=True, return_inverse=True)
    if not (rows == rows[first][at]).all():  # two phrases of one hash
        found, at = np.unique(rows, axis=0, return_inverse=True)
    else:
        found = rows[first]
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at.reshape(-1), n)
    return found, sums


def numbered_words(frequent: DataFrame, most: int = MOST_NUMBERED) -> np.ndarray | None:
    """The frequent words in order, of which each one's place is its number; none if there are more than ``most``."""
    return np.sort(np.asarray(frequent.select("w1").toArrow()["w1"]).view(np.uint64)) if frequent.count() <= most else None


def numbers(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers, two in a column, of those rows that have numbered words only, and which rows these are."""
    place = np.minimum(np.searchsorted(words, rows), max(0, len(words) - 1))
    known = (words[place] == rows).all(1) if len(words) else np.zeros(len(rows), bool)
    place = place[known].astype(np.uint64)
    place = np.concatenate([place, np.zeros((len(place), place.shape[1] % 2), np.uint64)], 1)
    return place[:, 0::2] << U64(32) | place[:, 1::2], known


def spelled_out(coded: np.ndarray, k: int, words: np.ndarray) -> np.ndarray:
    """The rows of words with these numbers."""
    return words[np.stack([coded >> U64(32), coded & U64(0xFFFFFFFF)], 2).reshape(len(coded), -1)[:, :k]]


def phrase_counts(relation: DataFrame, k: int, least: int, shared: Broadcast) -> DataFrame:
    """w1 .. wk, n of the phrases of ``k`` words with at least ``least`` occurrences, from the relation of one word less.

    Where ``shared`` has the numbered words, these numbers are shuffled, two in a column, and not the words' hashes.
    """

    def arrays(rows: np.ndarray, n: np.ndarray, of: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in rows.view(np.int64).T), pa.array(n)], names=of)

    def emitted(rows: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if coded:
            rows, known = numbers(rows, shared.value)
            n = n[known]
        for at in range(0, len(n), EMITTED):
            yield arrays(rows[at : at + EMITTED], n[at : at + EMITTED], keys)

    def words_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.stack([np.asarray(x).view(np.uint64) for x in batch.columns[:-1]], 1)
                yield arrays(spelled_out(rows, k, shared.value), np.asarray(batch.column("n")), names)

    coded = shared.value is not None
    names = [*(f"w{i + 1}" for i in range(k)), "n"]
    keys = [*(f"p{i + 1}" for i in range((k + 1) // 2)), "n"] if coded else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts, fresh = [], [], 0
        for slot, word, live in unpacked(batches):
            at = joined(slot, live)
            rows.append(np.stack([word[at + i] for i in range(k)], 1))
            counts.append(np.ones(len(at), np.int64))
            fresh += len(at)
            if fresh >= GATHERED:
                found, n = _unique(np.concatenate(rows), np.concatenate(counts))
                rows, counts, fresh = [found], [n], 0
                if len(n) >= GATHERED:
                    yield from emitted(found, n)
                    rows, counts = [], []
        if rows:
            yield from emitted(*_unique(np.concatenate(rows), np.concatenate(counts)))

    schema = lambda of: ", ".join(f"{x} long" for x in of)
    found = relation.mapInArrow(run, schema(keys)).groupBy(*keys[:-1]).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return found.mapInArrow(words_again, schema(names)) if coded else found


def _words_with_keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """The table of all words, and the seed under which no two of them share a hash."""
    for seed in range(SEED, SEED + 20):
        words = written(word_counts(docs, seed), "words")
        if not words.groupBy("key").count().where("count > 1").limit(1).count():
            return words, seed
    raise RuntimeError("every seed gave two words one hash")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """All words (lang, word, key, n), and per number of words the phrases (w1 .. wk, n) with at least ``least`` occurrences, as written tables."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    words, seed = _words_with_keys(rows)
    levels = [written(words.where(F.col("n") >= least).select(F.col("key").alias("w1"), "n"), "phrases-1")]
    relation, words_shared = None, spark.sparkContext.broadcast(numbered_words(levels[0], MOST_NUMBERED))
    for k in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(bit_filter(levels[-1], k - 1))  # at most MOST_BITS
        relation = written(first_relation(rows, shared, seed) if relation is None else next_relation(relation, k - 1, shared), f"occurrences-{k - 1}")
        live = levels[-1].agg(F.sum("n")).first()[0] or 0
        levels.append(written(phrase_counts(relation.coalesce(max(1, live // COUNTED)), k, least, words_shared), f"phrases-{k}"))
        shared.destroy()
    words_shared.destroy()
    return words, levels


def scored(levels: list[DataFrame], cover: int = COVER) -> DataFrame:
    """The candidates that no longer one covers: key (the words' hashes), a, l, r, score."""
    keyed = [t.select(F.array(*(f"w{i + 1}" for i in range(k))).alias("key"), "n") for k, t in enumerate(levels, 1)]
    groups = keyed[0]
    for t in keyed[1:]:
        groups = groups.unionByName(t)
    long = groups.where(F.size("key") > 1).withColumnRenamed("n", "a")
    cuts = long.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("key", F.lit(1), F.col("k")).alias("left"), F.slice("key", F.col("k") + 1, F.size("key")).alias("right"))
    cuts = cuts.join(groups.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(groups.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr(f"cast(cast(a as decimal(20, 0)) * {SCALE} div cast(l + r as decimal(20, 0)) as long)")
    lowest = cuts.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = long.where(F.size("key") > 2).select(
        F.col("a").alias("n"), F.explode(F.flatten(F.expr("transform(sequence(2, size(key) - 1), m -> transform(sequence(1, size(key) - m + 1), i -> slice(key, i, m)))"))).alias("key")
    )
    most = inner.groupBy("key").agg(F.max("n").alias("longer"))
    covered = F.coalesce(F.col("longer").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * cover, F.lit(False))
    return lowest.join(most, "key", "left").where(~covered).select("key", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, cover: int = COVER) -> DataFrame:
    """The first ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    words, levels = frequent_phrases(docs, longest, least)
    names = words.where(F.col("n") >= least).select(F.col("key").alias("one"), "lang", "word")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = written(scored(levels, cover), "candidates")
    tagged = found.join(names.select(F.col("one").alias("first"), "lang"), F.col("key")[0] == F.col("first")).drop("first")
    # With their ties, before the words are looked up; Spark keeps the first rows of each task before the shuffle.
    best = tagged.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place")
    best = written(best, "best")
    spelled = best.select("key", F.posexplode("key").alias("at", "one")).join(names.select("one", "word"), "one")
    spelled = spelled.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
    texts = best.join(spelled.select("key", F.array_join(F.transform("parts", lambda x: x["word"]), " ").alias("phrase")), "key")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = texts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
o AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM p, range(1, 5) AS t(k)),
g AS (
  SELECT lang, k, phrase, count(*) AS n FROM o GROUP BY ALL),
c AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM g WHERE k > 1 AND n >= 30),
u AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.cut, array_to_string(w[1 : x.cut], ' ') AS part, array_to_string(w[x.cut + 1 : c.k], ' ') AS rest
  FROM c, range(1, 4) AS x(cut) WHERE x.cut < c.k),
s AS (
  SELECT u.lang, u.phrase, u.a, u.cut, f.n AS l, e.n AS r, (2000000::HUGEINT * u.a) // (f.n + e.n) AS score
  FROM u JOIN g f ON f.lang = u.lang AND f.phrase = u.part JOIN g e ON e.lang = u.lang AND e.phrase = u.rest),
b AS (
  SELECT lang, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM s GROUP BY ALL),
i AS (
  SELECT c.lang, array_to_string(c.w[y.i : y.i + m.m - 1], ' ') AS phrase, max(c.a) AS longer
  FROM c, range(2, 4) AS m(m), range(1, 4) AS y(i) WHERE m.m < c.k AND y.i + m.m - 1 <= c.k GROUP BY ALL),
v AS (
  SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM v)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM r JOIN (SELECT lang, sum(n) AS n FROM g WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
