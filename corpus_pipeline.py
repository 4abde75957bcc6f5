"""A corpus pipeline: quality, near duplicates, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads again as the next stage's docs.

Nulls: a null text is the empty text in every stage; rows with null or repeated ids are rows
of their own (what tells near copies apart is the row, not its id), a null source is a source of its
own, and null ids come first in the token files.  Texts without words are near copies of each other.
Ties between near copies: see ``wide_simhash``.  Texts are never cut; a very long one is a step of its own.
Without labels nothing is rejected (with labels of 0 alone, everything); without benchmark rows nothing is contaminated; empty documents give
an empty result.  All columns pass unchanged up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import common, decontamination, mixing, wide_simhash, quality, token_files


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    common.small_batches(spark)
    return quality.accepted(docs, quality.fitted(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    common.small_batches(spark)
    return wide_simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    common.small_batches(spark)
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row per document in them."""
    common.small_batches(spark)
    return token_files.token_output(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The classifier and the fingerprints have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
