"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``width`` consecutive words of a benchmark item (an item of fewer
words is one shorter pattern).  The alphabet of the search is words: a block is two words,
the shift table says how far the window may jump at a block, blocks that end a pattern
select a bucket of patterns by suffix hash, and the bytes of the words are compared to
confirm.  Texts are cut into lanes that all jump at once, so the search is vectorised.

The search tables are compiled once, on the driver, from at most ``block_bytes`` of benchmark
text, and broadcast as arrays.  A larger benchmark is searched block after block: a pass
over the texts for each, of which only digests of texts with hits and their hits are written
and joined to the documents at the end.  Nothing is left out and each block's memory is bounded: an
item of more than an eighth of a block is cut into pieces that share ``width`` - 1 words.

Nulls: a null text has no words; a null item_id counts as the text "null".  Items without
words give no window.  Rows that repeat a doc_id or item_id are searched like others; an item
whose windows occur in several places counts once.  Very long texts are steps of their own.
Empty tables give empty results or no hits.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, filtered, mapped, table, text_of, written
from .words import ALNUM, Words, pair, words_of

WIDTH, BLOCK_BYTES, LANE = 10, 8 << 20, 256
SHIFT_BITS = 18
_FOLD = bytes(b if b else 32 for b in ALNUM)


class Benchmark:
    """The words of a block of items: hashes, and their folded bytes with single blanks between."""

    def __init__(self, items: list[tuple[str, str]]):
        w = words_of(pa.array([text for _, text in items], pa.large_string()), ALNUM)
        self.names = [item for item, _ in items]
        self.key, self.row, self.counts = w.key, w.row, w.counts()
        length = w.end - w.start
        self.start = np.cumsum(length + 1) - (length + 1)
        self.end = self.start + length
        joined = np.full(int(self.end[-1]) if len(length) else 0, 32, np.uint8)
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        joined[np.repeat(self.start, length) + inside] = ALNUM[w.raw[np.repeat(w.start, length) + inside]]
        self.data = joined.tobytes()

    def window(self, first: int, length: int) -> bytes:
        return self.data[self.start[first] : self.end[first + length - 1]]


class Patterns:
    """The search tables of the windows of one length (in words) that begin at the words ``first`` of a benchmark."""

    def __init__(self, bench: Benchmark, first: np.ndarray, length: int):
        self.bench, self.length = bench, length
        self.block = min(2, length)
        words = [bench.key[first + i] for i in range(length)]
        whole = words[0]
        for x in words[1:]:
            whole = pair(whole, x)
        order = np.lexsort((bench.row[first], whole))
        first, whole, row = first[order], whole[order], bench.row[first][order]
        new = np.append(True, whole[1:] != whole[:-1])
        head = first[np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))]
        for i in np.flatnonzero(~new).tolist():  # equal hashes of unlike windows part them
            new[i] = bench.window(int(first[i]), length) != bench.window(int(head[i]), length)
        pattern = np.cumsum(new) - 1
        self.first = first[new]
        owned = np.append(True, (pattern[1:] != pattern[:-1]) | (row[1:] != row[:-1]))
        self.owner, self.owner_at = row[owned], np.searchsorted(pattern[owned], np.arange(len(self.first) + 1))
        words = [bench.key[self.first + i] for i in range(length)]
        self.shift = np.full(1 << SHIFT_BITS, length - self.block + 1, np.int32)
        for end in range(self.block, length + 1):  # the rightmost place counts
            np.minimum.at(self.shift, self.slot(self.block_key(words[end - self.block : end])), length - end)
        suffix = self.block_key(words[length - self.block :])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key & np.uint64((1 << SHIFT_BITS) - 1)).astype(np.int64)

    @staticmethod
    def block_key(words) -> np.ndarray:
        return pair(words[0], words[1]) if len(words) == 2 else words[0]

    def owners(self, patterns: np.ndarray) -> list[str]:
        """The items that have any of the windows."""
        low, many = self.owner_at[patterns], self.owner_at[patterns + 1] - self.owner_at[patterns]
        places = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return [self.bench.names[i] for i in np.unique(self.owner[places]).tolist()]

    def places(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last word of a window, pattern) of every occurrence."""
        none = np.zeros(0, np.int64)
        counts = w.counts()
        begin = np.cumsum(counts) - counts
        rooms = np.maximum(counts - self.length + 1, 0)  # window ends in each text
        lanes = -(-rooms // LANE)
        if not lanes.sum():
            return none, none
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(begin, lanes) + self.length - 1 + nth * LANE
        stop = np.minimum(at + LANE, np.repeat(begin + counts, lanes))
        found = []
        while len(at):
            key = self.block_key([w.key[at - i] for i in range(self.block - 1, -1, -1)])
            jump = self.shift[self.slot(key)]
            hit = jump == 0
            if hit.any():
                found.append((at[hit], key[hit]))
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return none, none
        ends, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        low, high = np.searchsorted(self.suffix, keys, "left"), np.searchsorted(self.suffix, keys, "right")
        many = high - low
        ends, slot = np.repeat(ends, many), np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pattern = self.order[slot]
        same = np.ones(len(ends), bool)
        for i in range(self.length):
            same &= w.key[ends - self.length + 1 + i] == self.bench.key[self.first[pattern] + i]
        ends, pattern = ends[same], pattern[same]
        data = w.raw.tobytes() if len(ends) else b""
        sure = [
            b" ".join(data[w.start[e - self.length + 1] : w.end[e]].translate(_FOLD).split()) == self.bench.window(int(self.first[p]), self.length)
            for e, p in zip(ends.tolist(), pattern.tolist(), strict=True)
        ]
        return ends[sure], pattern[sure]


def compile_patterns(items: list[tuple[str, str]], width: int = WIDTH) -> list[Patterns]:
    """Search tables of the windows of (item_id, text), one per pattern length."""
    bench = Benchmark(items)
    lengths = np.minimum(bench.counts, width)
    windows = np.where(lengths > 0, bench.counts - lengths + 1, 0)
    begin = np.repeat(np.cumsum(bench.counts) - bench.counts, windows)
    first = begin + np.arange(len(begin)) - np.repeat(np.cumsum(windows) - windows, windows)
    of = np.repeat(lengths, windows)
    return [Patterns(bench, first[of == n], n) for n in np.unique(of).tolist()]


def search(texts: pa.Array, tables: list[Patterns]) -> tuple[Words, list[list[tuple[int, int]]], list[set[str]]]:
    """The words, and per text its hit spans (first word, end word) and the items found."""
    w = words_of(texts, ALNUM)
    begin = np.cumsum(w.counts()) - w.counts()
    spans: list[list[tuple[int, int]]] = [[] for _ in range(w.rows)]
    items: list[set[str]] = [set() for _ in range(w.rows)]
    for t in tables:
        seen: dict[int, set[int]] = {}
        ends, pattern = t.places(w)
        for end, p in sorted(zip(ends.tolist(), pattern.tolist(), strict=True)):
            row = int(w.row[end])
            first, stop = end - t.length + 1 - int(begin[row]), end + 1 - int(begin[row])
            seen.setdefault(row, set()).add(p)
            if spans[row] and spans[row][-1][0] <= first <= spans[row][-1][1]:
                spans[row][-1] = (spans[row][-1][0], max(stop, spans[row][-1][1]))
            else:
                spans[row].append((first, stop))
        for row, patterns in seen.items():  # a pattern's owners once, however often it occurs
            items[row].update(t.owners(np.array(sorted(patterns))))
    return w, spans, items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces_of(texts: pa.Array, width: int, most: int) -> Iterator[tuple[int, str]]:
    """(row, text) of the texts, those beyond ``most`` bytes cut between words into pieces that share ``width`` - 1 words: no window is lost or new."""
    for row, text in enumerate(texts.to_pylist()):
        raw = text.encode()
        if len(raw) <= most:
            yield row, text
            continue
        w = words_of(pa.array([text], pa.large_string()), ALNUM)
        at = 0
        while at < len(w.start):
            stop = max(at + width, int(np.searchsorted(w.end, w.start[at] + most, side="right")))
            stop = min(stop, len(w.start))
            yield row, raw[w.start[at] : w.end[stop - 1]].decode()
            if stop == len(w.start):
                break
            at = stop - width + 1


def pattern_blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The search tables of about ``block_bytes`` of benchmark at a time, broadcast, and whether the block is the only one.

    Items that repeat id and text count once.  A block leaves the driver and the executors before the next one comes.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(pieces_of(batch.column("text"), width, max(1, block_bytes // 8)))
        return pa.RecordBatch.from_arrays([batch.column("item").take(pa.array([r for r, _ in found], pa.int64())), pa.array([x for _, x in found], pa.string())], names=["item", "text"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text_of().alias("text"))
    bench = mapped(items, fn, "item string, text string").distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        tables = compile_patterns(sorted((r["item"], r["text"]) for r in part.collect()), width)
        shared = benchmark.sparkSession.sparkContext.broadcast(tables)
        yield shared, blocks == 1
        if blocks > 1:
            shared.destroy()


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _searched(source: DataFrame, key: str, shared: Broadcast) -> DataFrame:
    """key, n_words, spans, items (sorted) of the rows (key, text)."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, spans, items = search(batch.column("text"), shared.value)
        rows = [[{"a": a, "b": b} for a, b in united(x)] for x in spans]
        columns = [batch.column(key), pa.array(w.counts(), pa.int64()), pa.array(rows, SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "spans", "items"])

    return mapped(source, fn, f"{key} {source.schema[key].dataType.simpleString()}, n_words long, spans array<struct<a:long,b:long>>, items array<string>")


def _digest() -> Column:
    return F.sha2(text_of(), 256)


def _hits(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """A row per distinct text with hits: digest, spans, items."""
    found = _searched(docs.select(_digest().alias("digest"), text_of().alias("text")), "digest", shared).where(F.size("items") > 0)
    return found.groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))


def _merged(hits: DataFrame) -> DataFrame:
    """One row per digest of the blocks' hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in united([(x["a"], x["b"]) for x in row])] for row in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(spans, SPANS), batch.column("items")], names=["digest", "spans", "items"])

    found = hits.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.mapInArrow(run, "digest string, spans array<struct<a:long,b:long>>, items array<string>")


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, spans (array of first and end word), items (sorted)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    hits = None
    for shared, only in pattern_blocks(benchmark, width, block_bytes):
        if only:
            return _searched(ids, "doc_id", shared)
        found = written(_hits(docs, shared), "passages")
        hits = found if hits is None else hits.unionByName(found)
    none = F.expr("cast(array() as array<struct<a:long,b:long>>)"), F.expr("cast(array() as array<string>)")
    n_words = F.regexp_count(ascii_lower(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    keyed = ids.select("doc_id", n_words.alias("n_words"), _digest().alias("digest"))
    joined = keyed.join(_merged(hits).hint("merge"), "digest", "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window occurs, with their own columns; with one block of benchmark no shuffle."""
    hits = None
    for shared, only in pattern_blocks(benchmark, width, block_bytes):
        if only:
            return filtered(docs, lambda texts, shared=shared: np.array([not s for s in search(texts, shared.value)[1]], bool))
        found = written(_hits(docs, shared).select("digest"), "passages")
        hits = found if hits is None else hits.union(found)
    hits = written(hits.distinct(), "passages")
    right = F.broadcast(hits) if hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hits.hint("merge")
    packed = docs.select(F.struct("*").alias("row"), _digest().alias("own_digest"))
    return packed.join(right, F.col("own_digest") == F.col("digest"), "left_anti").select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS pattern, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
v AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS pattern
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT doc_id, i, p.n, item FROM v JOIN p USING (pattern, n)),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
