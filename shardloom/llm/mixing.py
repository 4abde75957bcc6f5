"""Mixing sources to target weights, with DataFrame operations only.

Words are summed per source, each source gets a target and from it a repetition rate, and
each document is emitted floor(rate) times plus one copy with probability equal to the
fraction, drawn from a hash of seed, doc_id and text: reruns agree.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share
``share`` times all words; a target stops at ``most`` times its source's words and the
excess is shared anew by weight until none is above.  With sources sorted by words over
weight this has a closed form: sources are capped as long as the level of the rest is
above their own cap.

Nulls: a null text has no words, a null source is a source of its own, a null doc_id draws
as the text "null".  Rows that repeat a doc_id and its text draw alike, those that repeat one of them don't.  A source without words has rate
0.  The windows run over the table of sources in one task: some millions of sources at most.
A very long text is one row and may miss its source's target by its size.  Empty tables give empty results.  Other columns pass through ``mixed`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, id_text, table, text_of, unit_hash, written

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, "mix-1"


def n_words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rates(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From rows (source, size): source, source_size, target, rate; one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy()  # over sources, not over documents
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.select(
        "*",
        (F.sum("source_size").over(everyone) * F.lit(share)).alias("total"),
        F.sum("weight").over(everyone).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weights_before"),
    )
    capped = F.col("cap") * (F.col("weights") - F.col("weights_before")) <= F.col("weight") * (F.col("total") - F.col("caps_before"))
    level = level.withColumn("capped", capped)
    taken = [F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(everyone), F.lit(0.0)) for c in ("cap", "weight")]
    height = (F.col("total") - F.col("caps")) / (F.col("weights") - F.col("capped_weights"))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * height)
    level = level.withColumns({"caps": taken[0], "capped_weights": taken[1]}).withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return level.select("source", "source_size", "target", rate.alias("rate"))


def looked_up(docs: DataFrame, by_source: DataFrame) -> DataFrame:
    """Adds the columns of ``by_source``, whose size is checked before it is broadcast."""
    by_source = by_source.withColumnRenamed("source", "__source")
    small = by_source.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = F.broadcast(by_source) if small else by_source
    return docs.join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def draw(seed: str = SEED) -> Column:
    """A document's number in [0, 1)."""
    return unit_hash(F.lit(seed), id_text(), F.md5(text_of().cast("binary")))


def copies(rate: Column, drawn: Column) -> Column:
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("int")).cast("int")


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, copies."""
    sizes = written(docs.select("doc_id", "source", n_words().alias("size"), draw(seed).alias("draw")), "sizes")
    found = looked_up(sizes, written(rates(sizes), "rates"))
    return found.select("doc_id", "size", "source_size", "target", copies(F.col("rate"), F.col("draw")).alias("copies"))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    by_source = written(rates(docs.select("source", n_words().alias("size"))).select("source", "rate"), "rates")
    packed = docs.select(F.struct("*").alias("row"), F.col("source"), draw(seed).alias("draw"))  # one column, so that no name clashes
    found = looked_up(packed, by_source)
    return found.select("row", F.explode(F.array_repeat(F.lit(1), copies(F.col("rate"), F.col("draw"))))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size::DOUBLE * 2 AS cap,
         ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM s),
l AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER b, 0) AS caps_before, coalesce(sum(weight) OVER b, 0) AS weights_before
  FROM w
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT *, cap * (weights - weights_before) <= weight * (total - caps_before) AS capped FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap
              ELSE weight * ((total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))
                             / (weights - coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0))) END AS target
  FROM c),
r AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT
               + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE
                           < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
