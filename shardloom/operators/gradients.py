"""Sparse gradients: summing by id and applying them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sum_vectors


def combine_gradients(grads: DataFrame, dim: int | None = None) -> DataFrame:
    """The sum of the gradients (key, grad array) of each id; combined per id before the shuffle.  ``dim``: their width, if known."""
    return sum_vectors(grads, "key", F.col("grad"), dim, name="grad")


def apply_adagrad(table: DataFrame, slot: DataFrame, grads: DataFrame, lr: float) -> DataFrame:
    """One step: acc += g^2, v -= lr * g / sqrt(acc) on the ids with a gradient; others stay.

    ``table`` (key, value), ``slot`` (key, acc), ``grads`` (key, grad; one row per id).  Returns key, value, acc.
    """
    rows = table.select("key", "value").join(slot.select("key", "acc"), "key").join(grads.select("key", "grad"), "key", "left")
    acc = F.when(F.col("grad").isNull(), F.col("acc").cast("array<double>")).otherwise(F.zip_with("acc", "grad", lambda a, g: a.cast("double") + g * g))
    step = F.zip_with("grad", "acc", lambda g, a: F.lit(lr) * g / F.sqrt(a))
    rows = rows.select("key", "value", acc.alias("acc"), "grad")
    value = F.when(F.col("grad").isNull(), F.col("value").cast("array<double>")).otherwise(F.zip_with(F.col("value"), step, lambda v, s: v.cast("double") - s))
    return rows.select("key", value.alias("value"), "acc")
