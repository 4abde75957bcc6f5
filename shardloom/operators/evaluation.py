"""Aggregations for model evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, label: str, prob: str) -> DataFrame:
    """The share of rows whose rounded probability is the label."""
    return df.agg(F.avg(F.when(F.round(F.col(prob)) == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"))


def auc(df: DataFrame, label: str, prob: str, num_thresholds: int = 1000) -> DataFrame:
    """Area under the ROC curve from a fixed grid of thresholds, by trapezoids (own rule).

    Scores are counted per grid cell and label before the shuffle; the running sums are over
    the grid.  Null without both labels.
    """
    cell = F.least(F.greatest(F.floor(F.col(prob) * num_thresholds), F.lit(0)), F.lit(num_thresholds - 1))
    counts = df.groupBy(cell.alias("cell")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"))
    above = Window.orderBy(F.col("cell").desc())
    sums = counts.select("neg", F.sum("pos").over(above).alias("tp"), F.col("pos"), F.sum("pos").over(Window.partitionBy()).alias("all_pos"), F.sum("neg").over(Window.partitionBy()).alias("all_neg"))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0))
    return sums.agg(area.alias("auc"))


def mse(df: DataFrame, label: str, prob: str) -> DataFrame:
    """Mean squared error."""
    return df.agg(F.avg(F.pow(F.col(label).cast("double") - F.col(prob), F.lit(2))).alias("mse"))


def activation_summary(df: DataFrame, cols: list[str], bins: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Per column: rows and share of zeros in each fixed-width bin of a histogram (column, bin, n, zero_fraction)."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols))).alias("cell")).select("cell.*").where("x is not null")
    bin_ = F.least(F.greatest(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    counts = cells.groupBy("column", bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("x") == 0, 1).otherwise(0)).alias("zeros"))
    whole = Window.partitionBy("column")  # over bins
    return counts.select("column", "bin", "n", (F.sum("zeros").over(whole) / F.sum("n").over(whole)).alias("zero_fraction"))
