r"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Faults of a row, in this order: blank (no ``[^\x20\x09-\x0D]``), duplicate (role and text stood before),
truncated (the last such character isn't ``[.!?]``).  Edits: Keep (0), Rerole to user or
assistant (3), Delete (4, required for blank and duplicate rows), Insert an empty user or assistant turn
(3); a truncated row that stays costs 3 more.  Of equally cheap edits the ASCII-least sequence of initials.

The roles written so far are in one of four states, so what the rest of a conversation costs is a
vector of four numbers.  Square-root checkpoints: the turns, without their texts, are sorted over the
cluster and cut into blocks of about the square root of all rows.  Vectors are stored only at the
ends of blocks: each block gives its costs between any two states, one pass over the blocks of
a conversation from its end makes the vectors.  Then each block is computed again, from its stored vector
(inside again by checkpoints), and walked forward, taking the least letter whose cost is
tight; where a conversation's state at the start of a block isn't known yet, from each of the four.
So a conversation of any length is many tasks' work.  Last the texts meet their turns in order
and the repaired text is hashed as it streams by; SHA-256 has no parallel form, so that pass is one task's
for one conversation, in bounded memory but for the audit itself.

Nulls: in ``conv_id:turn`` a null is a blank, a null role or text is one blank (a blank role has no
legal place and is reroled or deleted, as is an empty one); rows of a null conv_id are one conversation,
null turns come first.  Ties: rows of one turn stand by role, then by MD5 of the text; rows that
repeat all of them stand together, all but the first being duplicates, counted before anything is sorted.  Extra
columns are not looked at.  Empty tables give an empty result, very long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BLANKS = " \t\n\x0b\f\r"
KEY = ("conv_id", "turn", "role", "digest")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; the state after one more user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
DELETE, INSERT, REROLE, UNFINISHED = 4, 3, 3, 3
#: What the end costs in each state: nothing, or turns that must be inserted.
END = (0, 6, 3, 0)
FAR = 1 << 40
#: Rows of a block, at least.
LEAST_BLOCK = 1024
FORCED = 8

Vector = tuple[int, ...]


def code_of(role: str, fault: int) -> int:
    """What the repair needs to know of a row: it must go, or the initial of its role and whether it is truncated."""
    return FORCED if fault in (BLANK, DUPLICATE) else 2 * ("sua".find(role[0]) % 4 if role else 3) + (fault == TRUNCATED)


def kept(code: int, state: int) -> int | None:
    """The state after keeping the row, None where it may not stay."""
    initial = code >> 1
    if initial == 0:
        return SYSTEM if state == START else None
    after = NEXT[state]
    return after if (initial, after) in ((1, USER), (2, ASSISTANT)) else None


@lru_cache(100_000)
def _before(code: int, after: Vector) -> Vector:
    if code == FORCED:
        return tuple(x + DELETE for x in after)
    more, found = UNFINISHED * (code & 1), []
    for state in range(4):
        stays = kept(code, state)
        found.append(min(after[state] + DELETE, after[NEXT[state]] + REROLE + more, FAR if stays is None else after[stays] + more))
    user, assistant = min(found[USER], found[ASSISTANT] + INSERT), min(found[ASSISTANT], found[USER] + INSERT)
    return min(found[START], user + INSERT), min(found[SYSTEM], user + INSERT), user, assistant


def before(code: int, after: Vector) -> Vector:
    """The costs before a row from those after it; the differences take few values, so most are looked up."""
    low = min(after)
    return tuple(x + low for x in _before(code, tuple(min(x - low, FAR) for x in after)))


def letter(code: int, state: int, here: Vector, after: Vector) -> str:
    """The least initial of an edit that keeps the cost tight."""
    if after[state] + DELETE == here[state]:
        return "D"
    if here[NEXT[state]] + INSERT == here[state]:
        return "I"
    stays = kept(code, state)
    return "K" if stays is not None and after[stays] + UNFINISHED * (code & 1) == here[state] else "R"


def walked(codes: list[int], after: Vector, states: tuple[int, ...]) -> list[list[str]]:
    """For each first state the edits of each row: inserts before it, then its own letter."""
    gap = math.isqrt(len(codes)) + 1
    marks, vector = {len(codes): after}, after
    for i in range(len(codes) - 1, -1, -1):
        vector = before(codes[i], vector)
        if i % gap == 0:
            marks[i] = vector
    out, now = [[] for _ in states], list(states)
    for low in range(0, len(codes), gap):
        high = min(low + gap, len(codes))
        vectors = [marks[high]]
        for i in range(high - 1, low - 1, -1):  # this stretch once more
            vectors.append(before(codes[i], vectors[-1]))
        for i in range(low, high):
            here, following, code = vectors[high - i], vectors[high - i - 1], codes[i]
            for k, rows in enumerate(out):
                edits = ""
                while not edits or edits[-1] == "I":
                    edits += letter(code, now[k], here, following)
                    if edits[-1] in "IR":
                        now[k] = NEXT[now[k]]
                    elif edits[-1] == "K":
                        now[k] = kept(code, now[k])
                rows.append(edits)
    return out


def between(codes: list[int]) -> list[int]:
    """The costs of the rows from each state (slowest) to each state."""
    out = [[] for _ in range(4)]
    for end in range(4):
        vector = tuple(0 if s == end else FAR for s in range(4))
        for code in reversed(codes):
            vector = before(code, vector)
        for start in range(4):
            out[start].append(min(vector[start], FAR))
    return sum(out, [])


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: the row is dropped) by the CRC-32 of ``conv_id:turn``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")


def ordered_turns(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The rows (conv_id, turn, role, text, copies) without their texts, counted, with their faults, in order and in blocks, as a written table.

    conv_id, turn, role, digest, fault, n, place, block; rows alike in the first four are one with their number n.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    turns = rows.where("copies > 0").select("conv_id", "turn", "role", _digest(), fault.alias("fault"), "copies")
    turns = written(turns.groupBy(*KEY, "fault").agg(F.sum("copies").alias("n")), "turns")
    # Only texts that stand at several turns of a conversation are looked up; with few rows a key, a hot key's other side can be split.
    again = turns.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("first").isNotNull() & (F.col("fault") != BLANK) & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    marked = turns.join(again, same, "left").withColumn("fault", F.when(later, DUPLICATE).otherwise(F.col("fault"))).select(*KEY, "fault", "n")
    length = block_rows or max(LEAST_BLOCK, math.isqrt(turns.count()))
    placed = marked.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id())
    block = F.expr(f"shiftright(place, 33) * {1 << 33} + (place & {(1 << 33) - 1}) div {length}")
    return written(placed.withColumn("block", block), "blocks")


def _pieces(block: pa.Table) -> Iterator[tuple[object, pa.Table, list[int]]]:
    """The conversations of a block with their rows and codes, in order."""
    block = block.sort_by("place")
    convs, codes = block.column("conv_id").to_pylist(), [code_of(r, f) for r, f in zip(block.column("role").to_pylist(), block.column("fault").to_pylist(), strict=True)]
    cuts = [i for i in range(1, len(convs)) if convs[i] != convs[i - 1]]
    for low, high in zip([0, *cuts], [*cuts, len(convs)], strict=True):
        yield convs[low], block.slice(low, high - low), codes[low:high]


def checkpoints(turns: DataFrame) -> DataFrame:
    """block, conv_id, after: the vectors at the ends of blocks, of the first and last conversation in each; all others are whole."""

    def edges(block: pa.Table) -> pa.Table:
        found = list(_pieces(block))
        found = found[:1] + found[1:][-1:]
        return pa.table({"conv_id": pa.array([x[0] for x in found], pa.int64()), "block": pa.array([block.column("block")[0].as_py()] * len(found), pa.int64()), "costs": pa.array([between(x[2]) for x in found], pa.list_(pa.int64()))})

    def vectors(rows: pa.Table) -> pa.Table:
        rows, after, out = rows.sort_by([("block", "descending")]), END, []
        for costs in rows.column("costs").to_pylist():
            out.append(list(after))
            after = tuple(min(costs[4 * s + e] + after[e] for e in range(4)) for s in range(4))
        return pa.table({"block": rows.column("block"), "conv_id": rows.column("conv_id"), "after": pa.array(out, pa.list_(pa.int64()))})

    costs = turns.groupBy("block").applyInArrow(edges, "conv_id long, block long, costs array<long>")
    return costs.groupBy("conv_id").applyInArrow(vectors, "block long, conv_id long, after array<long>")


def edits(turns: DataFrame) -> DataFrame:
    """The turns with ``moves``: the edits of each, for the only or for each possible state at the start of its conversation's part of the block."""

    def walk(block: pa.Table, ends: pa.Table) -> pa.Table:
        after = dict(zip(ends.column("conv_id").to_pylist(), ends.column("after").to_pylist(), strict=True))
        moves = []
        for k, (conv, _, codes) in enumerate(_pieces(block) if block.num_rows else ()):
            found = walked(codes, tuple(after.get(conv, END)), (START, SYSTEM, USER, ASSISTANT) if k == 0 else (START,))
            moves += [list(x) for x in zip(*found, strict=True)]
        block = block.sort_by("place") if block.num_rows else block
        return block.select([*KEY, "fault", "n", "block"]).append_column("moves", pa.array(moves, pa.list_(pa.string())))

    kinds = "conv_id long, turn long, role string, digest binary, fault int, n long, block long, moves array<string>"
    return turns.groupBy("block").cogroup(written(checkpoints(turns), "checkpoints").groupBy("block")).applyInArrow(walk, kinds)


class Repair:
    """One conversation as its rows pass in order: its figures, edits and the hash of what they give."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost, self.illegal = conv, START, 0, 0
        self.counts, self.audit, self.hash, self.lines = [0] * 4, io.StringIO(), hashlib.sha256(), 0
        self.block = self.entry = self.initial = self.pending = self.low = self.high = None
        self.distinct = 0

    def turn(self, turn: int | None, role: str, fault: int, n: int, block: int, moves: list[str]) -> None:
        if turn is not None and turn != self.high:  # in order
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.illegal += n - 1 + (self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"))
        self.initial = role[:1]
        once = n if fault in (BLANK, DUPLICATE) else 1
        self.counts[fault] += once
        self.counts[DUPLICATE] += n - once
        if block != self.block:
            self.block, self.entry = block, self.state
        letters = moves[self.entry if len(moves) > 1 else 0]
        for x in letters[:-1]:
            self.insert(x)
        own = letters[-1]
        self.audit.write(own)
        self.pending = None
        if own == "D":
            self.cost += DELETE
        else:
            self.cost += UNFINISHED * (fault == TRUNCATED) + REROLE * (own == "R")
            self.state = kept(code_of(role, fault), self.state) if own == "K" else NEXT[self.state]
            self.pending = role if own == "K" else ("user" if self.state == USER else "assistant")
        self.audit.write("D" * (n - 1))
        self.cost += DELETE * (n - 1)

    def insert(self, initial: str) -> None:
        self.audit.write(initial)
        self.cost += INSERT
        self.state = NEXT[self.state]
        self.line("user" if self.state == USER else "assistant", "")

    def text(self, text: str) -> None:
        if self.pending is not None:
            self.line(self.pending, text)
            self.pending = None

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def result(self) -> tuple:
        while END[self.state]:
            self.insert("I")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv, gaps, *self.counts[BLANK:], self.illegal, self.cost, self.audit.getvalue(), self.hash.hexdigest()


RESULT = ("conv_id long", "gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string", "repaired_sha256 string")


def repaired(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text, copies); those with ``copies`` 0 aren't looked at but name their conversation.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    moves = edits(ordered_turns(rows, block_rows)).select(*KEY, F.lit(1).alias("what"), "fault", "n", "block", "moves", F.lit(None).cast("string").alias("text"))
    there = F.col("copies") > 0
    texts = rows.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"), F.when(there, _digest()).alias("digest"), F.when(there, 2).otherwise(0).alias("what"), F.when(there, F.col("text")).alias("text")
    )
    both = moves.unionByName(texts, allowMissingColumns=True)
    names = [x.split()[0] for x in RESULT]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, turn, role, what, fault, n, block, moves, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "what", "fault", "n", "block", "moves", "text")), strict=True):
                if now is None or conv != now.conv:
                    if now:
                        out.append(now.result())
                    now = Repair(conv)
                if what == 1:
                    now.turn(turn, role, fault, n, block, moves)
                elif what == 2:
                    now.text(text)
            yield batch_of(out)
            out = []
        if now:
            yield batch_of([now.result()])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return both.repartition("conv_id").sortWithinPartitions(*KEY, "what").mapInArrow(run, ", ".join(RESULT))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


SQL = r"""
WITH RECURSIVE
t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes FROM conversations),
c AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM k, t),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, range(2) AS x(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS MATERIALIZED (
  SELECT *, substr(role, 1, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before,
         count(*) OVER (PARTITION BY conv_id) AS n FROM o),
r AS MATERIALIZED (
  SELECT conv_id, i, n, role, text, ini, blank OR again AS forced, CASE WHEN open THEN 3 ELSE 0 END AS t FROM f),
b AS (
  SELECT DISTINCT conv_id, n + 1 AS i, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM r
  UNION ALL
  SELECT conv_id, i, least(r0, 3 + least(r2, 3 + r3)), least(r1, 3 + least(r2, 3 + r3)), least(r2, 3 + r3), least(r3, 3 + r2) FROM (
    SELECT r.conv_id, r.i,
           CASE WHEN forced THEN v0 + 4 ELSE least(v0 + 4, v2 + 3 + t, CASE ini WHEN 's' THEN v1 + t WHEN 'u' THEN v2 + t ELSE 1000000 END) END AS r0,
           CASE WHEN forced THEN v1 + 4 ELSE least(v1 + 4, v2 + 3 + t, CASE ini WHEN 'u' THEN v2 + t ELSE 1000000 END) END AS r1,
           CASE WHEN forced THEN v2 + 4 ELSE least(v2 + 4, v3 + 3 + t, CASE ini WHEN 'a' THEN v3 + t ELSE 1000000 END) END AS r2,
           CASE WHEN forced THEN v3 + 4 ELSE least(v3 + 4, v2 + 3 + t, CASE ini WHEN 'u' THEN v2 + t ELSE 1000000 END) END AS r3
    FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
s AS MATERIALIZED (
  SELECT b.conv_id, b.i, [v0, v1, v2, v3] AS here, lead([v0, v1, v2, v3]) OVER (PARTITION BY b.conv_id ORDER BY b.i) AS rest, r.* EXCLUDE (conv_id, i)
  FROM b LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i),
w AS (
  SELECT DISTINCT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, 0 AS cost, []::VARCHAR[] AS lines FROM r
  UNION ALL
  SELECT conv_id, CASE WHEN x = 'I' THEN i ELSE i + 1 END,
         CASE WHEN x IN ('I', 'R') THEN following WHEN x = 'K' THEN CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE q END,
         audit || x, cost + CASE x WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN t ELSE 3 + t END,
         CASE x WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                ELSE list_append(lines, CASE following WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE WHEN x = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, s.ini, s.role, s.text, s.t, ([2, 2, 3, 2])[w.q + 1] AS following,
           CASE WHEN s.rest IS NOT NULL AND s.rest[w.q + 1] + 4 = s.here[w.q + 1] THEN 'D'
                WHEN s.here[([2, 2, 3, 2])[w.q + 1] + 1] + 3 = s.here[w.q + 1] THEN 'I'
                WHEN s.rest IS NULL THEN NULL
                WHEN CASE s.ini WHEN 's' THEN w.q = 0 AND s.rest[2] + s.t = s.here[1]
                                WHEN 'u' THEN w.q <> 2 AND s.rest[3] + s.t = s.here[w.q + 1]
                                WHEN 'a' THEN w.q = 2 AND s.rest[4] + s.t = s.here[3] ELSE false END THEN 'K' ELSE 'R' END AS x
    FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i)
  WHERE x IS NOT NULL),
e AS (
  SELECT conv_id, max(i) AS last FROM s GROUP BY conv_id),
z AS (
  SELECT w.conv_id, w.audit, w.cost, sha256(array_to_string(w.lines, chr(10))) AS repaired_sha256
  FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = e.last AND w.q IN (0, 3)),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND open) AS truncated,
         count(*) FILTER (ini_before IS NOT NULL AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
