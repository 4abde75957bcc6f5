"""Checkpoint shards: names, copies, what to restore from, single-slot buffers, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import sum_before

CHUNK = 64 << 20


def ckpt_key(prefix: Column, shard: Column, num_shards: Column) -> Column:
    """``step:%05d-%05d``; the step is the text after the last hyphen of the prefix."""
    return F.concat(F.substring_index(prefix, "-", -1), F.format_string(":%05d-%05d", shard.cast("int"), num_shards.cast("int")))


def parse_ckpt_key(col: Column) -> Column:
    """(step, shard, num_shards) of a key; null for a malformed one."""
    pattern = r"^([0-9]+):([0-9]{5,})-([0-9]{5,})$"
    step, shard, n = (F.regexp_extract(col, pattern, i).try_cast("long") for i in (1, 2, 3))
    return F.when(col.rlike(pattern), F.struct(step.alias("step"), shard.cast("int").alias("shard"), n.cast("int").alias("num_shards")))


def parse_shard_key(col: Column) -> Column:
    """(shard, num_shards) of ``%05d-%05d``; null for a malformed one."""
    pattern = r"^([0-9]{5,})-([0-9]{5,})$"
    shard, n = (F.regexp_extract(col, pattern, i).try_cast("int") for i in (1, 2))
    return F.when(col.rlike(pattern), F.struct(shard.alias("shard"), n.alias("num_shards")))


def ckpt_filenames(prefix: Column, shard: Column, num_shards: Column) -> Column:
    """Index file, the shard's index and data file, and the prefix without its step."""
    tail = lambda kind: F.concat(prefix, F.format_string(f".{kind}-%05d-of-%05d", shard.cast("int"), num_shards.cast("int")))
    return F.struct(F.concat(prefix, F.lit(".index")).alias("index_file"), tail("index").alias("shard_index_file"), tail("data").alias("data_file"), F.regexp_replace(prefix, r"-[^-]*$", "").alias("base"))


def replica_placement(shards: DataFrame, replicas: int) -> DataFrame:
    """Holders of the copies of each shard (shard, num_shards): shard, copy, holder.  Nothing when there are as many copies as shards."""
    if replicas < 1:
        return shards.select("shard", F.lit(0).alias("copy"), F.lit(0).cast("long").alias("holder")).where("false")
    rows = shards.where(F.lit(replicas) < F.col("num_shards")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return rows.select("shard", "copy", F.pmod(F.col("shard") + F.col("copy") + 1, F.col("num_shards")).cast("long").alias("holder"))


def latest_cache(writes: DataFrame) -> DataFrame:
    """Per holder and shard the version written last, not the one with the greatest step: holder, shard, step, n_bytes."""
    last = writes.groupBy("holder", "shard").agg(F.max_by(F.struct("step", "n_bytes"), F.struct("arrival", "step")).alias("v"))
    return last.select("holder", "shard", "v.step", "v.n_bytes")


def cache_lookup(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (holder, shard, step) whether exactly it is in the cache."""
    hits = cache.select("holder", "shard", "step", F.lit(True).alias("found"))
    return wanted.join(hits, ["holder", "shard", "step"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def resolve_restore(wanted: DataFrame, cache: DataFrame, placement: DataFrame) -> DataFrame:
    """Where each wanted (shard, step) is restored from: its own holder, else a copy in order, else the file.

    The holder of shard s itself is s.  Returns shard, step, source, holder.
    """
    own = wanted.select("shard", "step", F.lit(-1).alias("rank"), F.col("shard").cast("long").alias("holder"))
    copies = wanted.join(placement, "shard").select("shard", "step", F.col("copy").alias("rank"), "holder")
    held = own.unionByName(copies).join(cache.select("holder", "shard", "step"), ["holder", "shard", "step"])
    best = held.groupBy("shard", "step").agg(F.min_by("holder", "rank").alias("holder"), F.min("rank").alias("rank"))
    found = wanted.join(best, ["shard", "step"], "left")
    source = F.when(F.col("rank").isNull(), F.lit("file")).when(F.col("rank") < 0, "local").otherwise(F.concat(F.lit("replica "), (F.col("rank") + 1).cast("string")))
    return found.select("shard", "step", source.alias("source"), "holder")


def backup_plan(writes: DataFrame, placement: DataFrame) -> DataFrame:
    """What is sent for the copies: source, holder, number of sends and bytes."""
    sent = writes.select("shard", "n_bytes").groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    moves = sent.join(placement, "shard")
    return moves.groupBy(F.col("shard").alias("source"), "holder").agg(F.sum("n").alias("n_sends"), F.sum("b").alias("n_bytes"))


def recoverable(cache: DataFrame, shards: DataFrame, failed: DataFrame) -> DataFrame:
    """For each shard whether a copy is left when the failed holders are gone: shard, copies_left, recoverable."""
    left = cache.join(failed.select("holder").distinct(), "holder", "left_anti").groupBy("shard").agg(F.count("*").alias("copies_left"))
    found = shards.select("shard").join(left, "shard", "left")
    return found.select("shard", F.coalesce("copies_left", F.lit(0)).alias("copies_left"), F.col("copies_left").isNotNull().alias("recoverable"))


def conflate(puts: DataFrame, takes: DataFrame) -> DataFrame:
    """Single-slot buffers: each take (buffer, ts, take_id) gets the newest put not taken yet (buffer, ts, put_id).

    Puts are counted for the next take at or after them; all but the newest were overwritten.
    Returns buffer, take_id, put_id (null: the slot was empty), overwritten.
    """
    rows = puts.select("buffer", "ts", F.lit(0).alias("is_take"), F.col("put_id").alias("id")).unionByName(takes.select("buffer", "ts", F.lit(1).alias("is_take"), F.col("take_id").alias("id")))
    numbered = sum_before(rows, "is_take", ("ts", "is_take", "id"), "nth", ("buffer",))  # puts and the take that ends them share a number
    put = F.col("is_take") == 0
    groups = numbered.groupBy("buffer", "nth").agg(
        F.max(F.when(~put, F.col("id"))).alias("take_id"), F.max_by("id", F.when(put, F.struct("ts", "id"))).alias("put_id"), F.count(F.when(put, 1)).alias("puts")
    )
    return groups.where("take_id is not null").select("buffer", "take_id", F.when(F.col("puts") > 0, F.col("put_id")).alias("put_id"), F.greatest(F.col("puts") - 1, F.lit(0)).alias("overwritten"))


def superseded_files(writes: DataFrame) -> DataFrame:
    """Versions replaced by a later write of their holder and shard: holder, shard, step, arrival."""
    last = writes.groupBy("holder", "shard").agg(F.max(F.struct("arrival", "step")).alias("last"))
    return writes.join(last, ["holder", "shard"]).where(F.struct("arrival", "step") < F.col("last")).select("holder", "shard", "step", "arrival")


def chunk_blobs(df: DataFrame, size: int = CHUNK, key: str = "id", blob: str = "blob") -> DataFrame:
    """Binary values in numbered chunks of ``size`` bytes; an empty value is one empty chunk."""
    n = F.greatest(F.ceil(F.octet_length(blob) / size), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(F.col(blob), (i * size + 1).cast("int"), F.lit(size)))
    return df.where(F.col(blob).isNotNull()).select(key, F.posexplode(cut).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


def assemble_blobs(chunks: DataFrame, key: str = "id") -> DataFrame:
    """The values back from their chunks, joined as bytes in the order of their numbers."""
    return chunks.groupBy(key).agg(F.expr("listagg(chunk, X'') WITHIN GROUP (ORDER BY chunk_no)").alias("blob"))
