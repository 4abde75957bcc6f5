"""Readers and writers."""

from .readers import check_manifests, list_files, read_file_manifest, read_lines, read_metric_stream, read_samples_csv, read_samples_parquet, read_slices, read_variable_manifest
from .versions import Versions, upsert_newest
from .writers import read_newest_state, save_newest_state, write_snapshots, write_state

__all__ = [
    "check_manifests", "list_files", "read_file_manifest", "read_lines", "read_metric_stream", "read_samples_csv", "read_samples_parquet", "read_slices", "read_variable_manifest",
    "write_snapshots", "write_state", "save_newest_state", "read_newest_state", "Versions", "upsert_newest",
]
