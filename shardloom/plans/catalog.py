"""All queries of the library outside the subpackage for text corpora."""

from . import backup_queries, feature_queries, metric_queries, reshard_queries, slice_queries, source_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
