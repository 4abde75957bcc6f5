"""Exact dedup against a persistent digest index, with DataFrame operations only.

Texts are equal when they are identical after all of ``[\\x20\\x09-\\x0D]`` is deleted;
their SHA-256 stands for them.  The index is a table bucketed and sorted by digest:
a batch is reduced to one row per digest (combined before its shuffle), deduplicated by a
sort-merge anti-join to the index, and what is new is appended.  An index that is opened
again, also in a session whose catalog doesn't know it, goes on with the rows it has; a
group's size is the number of its rows in the batch that brought its digest.

Of the rows of a text one stays: the one with the most code points in its original text, then the
smallest doc_id (null last), then the smallest XXH64 of the original; of rows that repeat all of
that any one.  If a later batch brings the row that stays once more, it is marked as kept again,
once, so that a batch can be marked anew; its other rows of the text go.

Nulls: a null text is the empty text; a null doc_id stands after all others.  Very long texts
are hashed whole, a row at a time.  Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, text_of, written

BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the normalised text, code points and XXH64 of the original text."""
    text = bare = text_of()
    for blank in BLANKS:
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(bare, 256)).alias("digest"), F.length(text).cast("long").alias("n_points"), F.xxhash64(text).alias("own"))


class DigestIndex:
    """One row per distinct text ever added: digest, the row that stays (keep_id, keep_own), group_size (rows of the batch that brought it)."""

    schema = "digest binary, keep_id long, keep_own long, group_size long"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        self.buckets = self._stored_buckets(buckets)
        if not spark.catalog.tableExists(self.name):
            # Not saveAsTable: creating a table from rows empties a folder that has files.
            place = self.path.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"CREATE TABLE {self.name} ({self.schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def _stored_buckets(self, wanted: int | None) -> int:
        """The number of buckets that the files were written with, kept beside them; a new index gets ``wanted`` or the number of shuffle partitions."""
        place = f"{self.path}/_buckets"
        try:
            return self.spark.read.schema("buckets int").parquet(place).first()["buckets"]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        if not wanted and self._has_rows():
            raise ValueError(f"{self.path} was written without its number of buckets; give it as buckets=")
        wanted = wanted or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.range(1, numPartitions=1).select(F.lit(wanted).cast("int").alias("buckets")).write.parquet(place)
        return wanted

    def _has_rows(self) -> bool:
        try:
            return bool(self.rows().limit(1).count())
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Appends the digests that are new; adding a batch again changes nothing.

        Returns a row per digest of the batch: digest, keep_id, keep_own, group_size as in the
        index, and ``repeats``, the most rows of the batch that repeat digest, doc_id and text.
        """
        same = batch.groupBy("digest", "doc_id", "n_points", "own").agg(F.count("*").alias("times"))
        best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "own"))
        groups = same.groupBy("digest").agg(best.alias("best"), F.sum("times").alias("group_size"), F.max("times").alias("repeats"))
        # Written first: the optimizer would move the anti-join below the aggregation, to all rows of a digest.
        groups = written(groups.select("digest", F.col("best.id").alias("keep_id"), F.col("best.own").alias("keep_own"), "group_size", "repeats"), "digest-groups")
        known = self.spark.table(self.name).select("digest").hint("merge")
        new = groups.join(known, "digest", "left_anti").drop("repeats")
        self._append(new.repartition(self.buckets, "digest"))
        # The index is read by its buckets, so only the batch's digests are shuffled, and none of them is hot.
        return groups.select("digest", "repeats").join(self.spark.table(self.name).hint("merge"), "digest")

    def compacted(self, path: str | None = None) -> DigestIndex:
        """The index with one file per bucket, at a new path; this one stays as it is.

        Each append adds a file to each of its buckets; here each bucket is written anew by one
        task.  If the job fails, the old index is still whole; take the new one once this returns.
        A path that holds rows already is refused.
        """
        new = DigestIndex(self.spark, path, self.buckets)
        if new._has_rows():
            raise ValueError(f"{path} holds an index already")
        new._append(self.rows().repartition(self.buckets, "digest"))
        return new

    def forget(self) -> None:
        """Takes the index out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        """Read as plain files."""
        return self.spark.read.schema(self.schema).parquet(self.path)


def mark_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Adds the texts of ``docs`` to the index and returns a row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    batch = written(digests(docs), "digests")
    own = index is None
    index = DigestIndex(docs.sparkSession) if own else index
    marks = written(index.add(batch), "digest-marks")
    if own:
        index.forget()
    # Both sides are of the batch's size and are shuffled, so that adaptive execution can split a hot digest.
    found = batch.join(marks.hint("merge"), "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("keep_own")))
    columns = ("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    if not marks.where("repeats > 1").limit(1).count():
        return found.select(*columns)
    # Rows that repeat the one that stays: counted, and one of them is kept.
    stay = found.where("kept").groupBy("doc_id", "keep_id", "group_size", "digest").agg(F.count("*").alias("times"))
    stay = stay.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("i")).withColumn("kept", F.col("i") == 1)
    return found.where("not kept").select(*columns).unionByName(stay.select(*columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
