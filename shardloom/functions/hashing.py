"""Portable hashes: the same numbers come out of any SQL engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(col: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a non-negative long; null stays null."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 15), 16, 10).cast("long")


def seeded_hash(seed: Column, key: Column) -> Column:
    """``hash60`` of ``seed:key``; a null key counts as the empty text."""
    return hash60(F.concat_ws(":", seed.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def epoch_seed(base_seed: int, epoch: Column) -> Column:
    """The seed of an epoch, a fixed function of the base seed."""
    return hash60(F.concat_ws(":", F.lit(f"epoch-{base_seed}"), epoch.cast("string")))


def top_bits(col: Column, bits: int = 10) -> Column:
    """The leading bits of a ``hash60``: a monotone bucket for ``global_index``."""
    return F.shiftright(col, 60 - bits)


def hash_bucket(col: Column, n: int = 10_000) -> Column:
    """Bucket ``[0, n)`` of a string; a null counts as the empty text (own rule: MD5 modulo n)."""
    return F.pmod(hash60(F.coalesce(col.cast("string"), F.lit(""))), F.lit(n))
