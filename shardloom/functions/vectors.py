"""Sums of vectors over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this width a sum is a column per dimension; beyond, generated code gets too long.
MOST_COLUMNS = 256


def sum_vectors(df: DataFrame, by: str, vector: Column, dim: int | None, weight: Column | None = None, extra: tuple[Column, ...] = (), name: str = "value") -> DataFrame:
    """Per ``by`` the (weighted) sum of the vectors, and the aggregates ``extra``.

    With a known, moderate ``dim`` each dimension is an aggregate of its own: rows are not
    unfolded, sums are combined before the shuffle and one row per group crosses it.
    Otherwise vectors are unfolded and summed per group and dimension.
    """
    w = F.lit(1.0) if weight is None else weight
    if dim is not None and dim <= MOST_COLUMNS:
        cells = [F.coalesce(F.sum(w * F.get(vector, F.lit(i)).cast("double")), F.lit(0.0)).alias(f"__v{i}") for i in range(dim)]
        sums = df.groupBy(by).agg(*cells, *extra)
        return sums.withColumn(name, F.array(*(F.col(f"__v{i}") for i in range(dim)))).drop(*(f"__v{i}" for i in range(dim)))
    cells = df.select(by, w.alias("__w"), F.posexplode(vector).alias("__dim", "__x")).groupBy(by, "__dim").agg(F.sum(F.col("__w") * F.col("__x").cast("double")).alias("__s"))
    parts = F.array_sort(F.collect_list(F.struct("__dim", "__s")))  # a cell per dimension
    sums = cells.groupBy(by).agg(F.transform(parts, lambda x: x["__s"]).alias(name))
    return sums.join(df.groupBy(by).agg(*extra), by) if extra else sums
