"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of a text selects a learned vector by hash, and so does
a word that repeats the one before it (one vector of its own for all such pairs); a document is
the average of its vectors, a softmax layer gives the label.  Vectors and layer are trained
together by stochastic gradient descent in numpy.

Training reads a bounded sample of labelled rows: at most ``SAMPLE_ROWS`` ids and
``SAMPLE_BYTES`` bytes of text, whole texts in the order of a hash of doc_id; a text that no
longer fits is passed over.  Of rows that repeat a doc_id one is learned from.  Scoring reads
every text whole.  The layer is linear in the average, so scoring looks up one number per
feature: the vector's product with the difference of the layer's two rows.

Nulls: a null text is empty and gets the score of the bias; rows with a null label or
doc_id are not learned from.  Labels that repeat a doc_id: the smallest label counts.
Without any label, or with one class only, the score is 0.5 or that class's share.
Empty tables give empty results.  Rows that repeat a doc_id are scored each; other columns
pass through ``accepted`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_STEP_BYTES, filtered, fold, mapped, table, text_of, written
from .words import SPACED, words_of

SAMPLE_ROWS, SAMPLE_BYTES = 4000, 24 << 20
BUCKET_BITS, DIM, GRAMS = 17, 12, (2, 3)
EPOCHS, RATE, SEED = 6, 0.4, 7
REPEAT = 1 << BUCKET_BITS
BUCKETS = REPEAT + 1
PIECE = 2 << 20


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature, and its text: words as they are, then n-grams inside each text."""
    w = words_of(texts, SPACED)
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    out, rows = [(w.key & mask).astype(np.int32)], [w.row.astype(np.int32)]
    if len(w.key) > 1:  # a word that repeats the one before is one feature, whatever the word
        again = (w.key[1:] == w.key[:-1]) & (w.row[1:] == w.row[:-1])
        out.append(np.full(int(again.sum()), REPEAT, np.int32))
        rows.append(w.row[1:][again].astype(np.int32))
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), np.asarray(pc.utf8_length(texts)))
    for n in GRAMS:
        if len(chars) >= n:
            gram = np.full(len(chars) - n + 1, n, np.uint32)
            for i in range(n):
                gram = (gram ^ chars[i : len(chars) - n + 1 + i]) * np.uint32(2654435761)
                gram ^= gram >> np.uint32(15)
            inside = of[: len(gram)] == of[n - 1 :]
            out.append((gram >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)[inside])
            rows.append(of[: len(inside)][inside])
    return np.concatenate(out), np.concatenate(rows)


def pieces(texts: pa.Array) -> Iterator[tuple[pa.Array, slice]]:
    """The texts at once, or a single long one in pieces cut before blanks, with their place; no feature spans a cut."""
    if len(texts) != 1 or len(text := texts[0].as_py()) <= PIECE:
        yield texts, slice(0, len(texts))
        return
    at = 0
    while at < len(text):
        cut = text.find(" ", at + PIECE)
        cut = len(text) if cut < 0 else cut
        yield pa.array([text[at:cut]], pa.large_string()), slice(0, 1)
        at = cut


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, float32
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        n, total = np.zeros(len(texts)), np.zeros(len(texts))
        for part, at in pieces(texts):
            bucket, row = features(part)
            n[at] += np.bincount(row, minlength=len(part))
            total[at] += np.bincount(row, weights=self.weight[bucket], minlength=len(part))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def train(texts: list[str], labels: list[int]) -> Model:
    """Softmax over averaged vectors, by stochastic gradient descent; classes count alike."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    random = np.random.default_rng(SEED)
    vectors = random.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = random.normal(0, 0.3, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    share = np.bincount(y, minlength=2) / len(y)
    worth = np.minimum(np.sqrt(0.5 / share), 3).astype(np.float32)  # rarer labels weigh more
    docs = []
    for text in texts:
        bucket, count = np.unique(features(pa.array([text], pa.large_string()))[0], return_counts=True)
        docs.append((bucket, (count / max(1, count.sum())).astype(np.float32)))
    last, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(docs)):
            bucket, part = docs[i]
            rate = RATE * (1 - done / last)
            done += 1
            average = part @ vectors[bucket] if len(bucket) else np.zeros(DIM, np.float32)
            logits = layer @ average + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= worth[y[i]]
            # A step along each vector is divided by the squared length of the average's parts, else long texts never learn.
            if len(bucket):
                vectors[bucket] -= (rate / max(1e-3, float(part @ part)) ** 0.5) * part[:, None] * (p @ layer)
            layer -= rate * np.outer(p, average)
            bias -= 0.1 * rate * p
    gap = layer[1] - layer[0]
    return Model((vectors @ gap).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of a bounded sample of the rows for which ``learn`` (over doc_id) holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    picked = known.groupBy("doc_id").agg(F.min(label).alias("__label")).orderBy(F.md5(F.concat_ws(":", F.lit(label), F.col("doc_id").cast("string")))).limit(rows)
    picked = docs.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in picked.collect()], "__id long, __label int")
    texts = docs.select(F.col("doc_id").alias("__id"), text_of().alias("text")).join(F.broadcast(picked), "__id")  # at most ``rows`` ids
    found = written(texts.select("__id", "__label", "text", F.xxhash64("text").alias("hash")), "labelled")
    sizes = found.groupBy("__id").agg(F.min(F.struct("hash", F.octet_length("text").alias("n"))).alias("one")).select("__id", "one.*").collect()
    total, keep = 0, []
    for r in sorted(sizes, key=lambda r: hashlib.md5(f"{label}:{r['__id']}".encode()).hexdigest()):
        if total + r["n"] <= most_bytes:
            total += r["n"]
            keep.append((r["__id"], r["hash"]))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(keep, "__id long, hash long"))
    got = sorted((r["__id"], r["text"], r["__label"]) for r in found.join(chosen, ["__id", "hash"]).dropDuplicates(["__id", "hash"]).collect())
    return [x[1] for x in got], [x[2] for x in got]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], names=["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), fn, "doc_id long, score double", SMALL_STEP_BYTES)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample(docs, labels, "quality", fold(3) != 1))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score of 0.5 or more, with their own columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: shared.value.scores(texts) >= 0.5)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
