"""How large a model is and how many servers it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an element.
DTYPE_BYTES = {"bool": 1, "int8": 1, "uint8": 1, "int16": 2, "half": 2, "bfloat16": 2, "int32": 4, "float": 4, "float32": 4, "int64": 8, "double": 8, "float64": 8}
FILL = 0.6


def model_size(manifest: DataFrame) -> DataFrame:
    """Bytes of all variables (name, shape, dtype) and whether any is an embedding table (its keys are a variable)."""
    elements = F.aggregate("shape", F.lit(1).cast("long"), lambda a, d: a * d)
    width = F.lit(None).cast("long")
    for name, size in DTYPE_BYTES.items():
        width = F.when(F.col("dtype") == name, F.lit(size).cast("long")).otherwise(width)
    return manifest.agg(F.coalesce(F.sum(elements * F.coalesce(width, F.lit(4).cast("long"))), F.lit(0)).alias("n_bytes"), F.coalesce(F.bool_or(F.col("name").endswith("-keys")), F.lit(False)).alias("has_embedding"))


def required_servers(n_bytes: Column, limit: Column, configured: Column) -> Column:
    """Servers of ``limit`` bytes that hold the model at 60 % fill; without a limit the configured number."""
    return F.when(limit > 0, F.ceil(n_bytes / FILL / limit)).otherwise(configured).cast("long")
