"""Scans: file listings, manifests, samples, slices, metric streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples: a label, numeric and categorical columns, with the values of empty fields.
SAMPLE_NUMBERS = tuple(f"I{i}" for i in range(1, 14))
SAMPLE_STRINGS = tuple(f"C{i}" for i in range(1, 27))
SAMPLE_SCHEMA = T.StructType([T.StructField("clicked", T.IntegerType()), *(T.StructField(c, T.FloatType()) for c in SAMPLE_NUMBERS), *(T.StructField(c, T.StringType()) for c in SAMPLE_STRINGS)])
SAMPLE_DEFAULTS = {"clicked": 0, **dict.fromkeys(SAMPLE_NUMBERS, 0.0), **dict.fromkeys(SAMPLE_STRINGS, " ")}
REPORT_SCHEMA = "ts timestamp, task_name string, task_index int, options string"
MANIFEST_SCHEMA = "FileCount long, FileDir string, FileList array<string>"


def _plain(path: Column | str) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+://[^/]*", ""), "^[a-z0-9]+:/+", "/")


def _file_path() -> Column:
    """The path of a row's file, which Spark gives with blanks and signs encoded."""
    return F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))


def list_files(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """A row per file of each directory, not recursive: prefix, dir_ord, name, length.

    ``dirs`` are absolute paths, listed in one relation.  Hidden names (leading ``_`` or ``.``) are left out; contents are never read.
    """
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(dirs))).select("path", "length")
    files = files.select(_plain(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).alias("__dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")
    order = spark.createDataFrame(list(enumerate(dirs)), "dir_ord int, prefix string")  # as many rows as directories given
    found = files.join(F.broadcast(order), F.col("__dir") == F.regexp_replace(_plain("prefix"), "(.)/+$", "$1"))
    return found.select("prefix", "dir_ord", "name", "length")


def read_file_manifest(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON manifests as rows (manifest, FileCount, FileDir, FileList), and their files (prefix, dir_ord, name)."""
    found = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(paths).withColumn("manifest", _file_path())
    order = spark.createDataFrame(list(enumerate(paths)), "dir_ord int, given string")  # as many rows as paths given
    files = found.join(F.broadcast(order), _plain("manifest") == _plain("given")).select(F.coalesce("FileDir", F.lit("")).alias("prefix"), "dir_ord", F.explode("FileList").alias("name"))
    return found, files


def check_manifests(manifests: DataFrame, listing: DataFrame) -> DataFrame:
    """A status per manifest: manifest, status, missing_files.

    ok, no FileCount, no FileList, count differs, or files missing from ``listing`` (prefix, name).
    """
    files = manifests.select("manifest", F.coalesce("FileDir", F.lit("")).alias("prefix"), F.explode("FileList").alias("name"))
    lost = files.join(listing.select("prefix", "name"), ["prefix", "name"], "left_anti").groupBy("manifest").agg(F.count("*").alias("missing_files"))
    found = manifests.join(lost, "manifest", "left").withColumn("missing_files", F.coalesce("missing_files", F.lit(0)))
    status = F.when(F.col("FileCount").isNull(), "no FileCount").when(F.col("FileList").isNull(), "no FileList").when(F.size("FileList") != F.col("FileCount"), "count differs").when(F.col("missing_files") > 0, "files missing").otherwise("ok")
    return found.select("manifest", status.alias("status"), "missing_files")


def read_samples_csv(spark: SparkSession, paths: list[str] | str, schema: T.StructType = SAMPLE_SCHEMA, defaults: dict | None = None) -> DataFrame:
    """CSV without a header; empty fields get their column's default."""
    return spark.read.schema(schema).csv(paths).na.fill(SAMPLE_DEFAULTS if defaults is None else defaults)


def read_samples_parquet(spark: SparkSession, paths: list[str] | str, schema: T.StructType | None = None) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else paths
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Text lines, with the file they are from: line, path."""
    return spark.read.text(paths).select(F.col("value").alias("line"), _file_path().alias("path"))


def read_slices(spark: SparkSession, slice_files: DataFrame, paths: list[str], fmt: str = "text", schema: str | None = None) -> DataFrame:
    """Rows of the files of chosen slices, tagged with slice_id and (if given) epoch.

    ``slice_files``: slice_id, path, optional epoch.  ``paths`` (directories or files) are read
    once; the rows join the slices by file name.
    """
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema else reader).load(paths)
    tags = slice_files.select(_plain("path").alias("__path"), *(c for c in ("slice_id", "epoch") if c in slice_files.columns))
    return rows.withColumn("__path", _plain(_file_path())).join(tags, "__path").drop("__path")


def read_metric_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """An unbounded table of metric reports from JSON files that arrive in a folder."""
    return spark.readStream.schema(REPORT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_variable_manifest(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Variables of a checkpoint: name, shape, dtype."""
    return spark.read.schema("name string, shape array<long>, dtype string").format(fmt).load(path)
