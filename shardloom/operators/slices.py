"""Slicing input files and planning epochs over the slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import epoch_seed, seeded_hash, top_bits
from ..functions.indexing import as_of, global_index, row_before
from ..functions.tables import written

ID_BUCKET = 4096


def _id_bucket(name: str) -> Column:
    return F.floor(F.col(name) / ID_BUCKET)


def make_slices(files: DataFrame, slice_size: int) -> DataFrame:
    """Groups of ``slice_size`` consecutive files per directory: slice_id, prefix, names, size.

    ``files``: prefix, dir_ord (the directory's place), name.  Slices never span directories,
    ids run on over directories, the last slice of a directory may be short.
    """
    if slice_size < 1:
        raise ValueError("slice_size must be positive")
    placed = global_index(files, [F.col("name")], "__idx", ("prefix", "dir_ord"))
    per_dir = files.groupBy("prefix", "dir_ord").agg(F.count("*").alias("__files"))
    before = Window.orderBy("dir_ord", "prefix").rowsBetween(Window.unboundedPreceding, -1)  # over directories
    first = F.coalesce(F.sum(F.ceil(F.col("__files") / slice_size)).over(before), F.lit(0))
    starts = per_dir.select("prefix", "dir_ord", first.alias("__first"))
    tagged = placed.join(starts, ["prefix", "dir_ord"]).withColumn("slice_id", (F.col("__first") + F.floor(F.col("__idx") / slice_size)).cast("long"))
    return tagged.groupBy("slice_id", "prefix").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count("*").cast("int").alias("size"))


def slice_catalog(slices: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Slice ids in order with size and prefix; an id in ``wanted`` that isn't known has size -1."""
    known = slices.select("slice_id", "prefix", "size")
    if wanted is not None:
        known = wanted.select("slice_id").distinct().join(known, "slice_id", "left")
    return known.select("slice_id", "prefix", F.coalesce("size", F.lit(-1)).alias("size")).orderBy("slice_id")


def slice_files(slices: DataFrame) -> DataFrame:
    """A row per file: slice_id, position, path."""
    rows = slices.select("slice_id", "prefix", F.posexplode("names").alias("position", "name"))
    root = F.regexp_replace(F.coalesce("prefix", F.lit("")), "[/ ]+$", "")
    return rows.select("slice_id", "position", F.when(root == "", F.col("name")).otherwise(F.concat_ws("/", root, F.col("name"))).alias("path"))


def expand_epochs(slices: DataFrame, num_epochs: int) -> DataFrame:
    """The slice list once per epoch: pos, epoch, idx, slice_id, with pos = epoch * n + idx."""
    if num_epochs < 1:
        raise ValueError("num_epochs must be positive")
    placed = global_index(slices.select("slice_id"), [F.col("slice_id")], "idx", bucket=_id_bucket("slice_id"))
    total = placed.agg(F.count("*").alias("__n"))  # one row
    rows = placed.join(F.broadcast(total), F.lit(True)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(num_epochs - 1))))
    return rows.select((F.col("epoch") * F.col("__n") + F.col("idx")).alias("pos"), "epoch", "idx", "slice_id")


def shuffle_epochs(plan: DataFrame, base_seed: int, seeds: DataFrame | None = None) -> DataFrame:
    """A seeded permutation inside each epoch: pos, epoch, seed, idx, slice_id.

    An epoch's seed is a fixed function of ``base_seed``, unless ``seeds`` (epoch, seed) has it.
    """
    seeded = plan.withColumn("seed", epoch_seed(base_seed, F.col("epoch")))
    if seeds is not None:
        given = seeds.select("epoch", F.col("seed").alias("__given"))
        seeded = seeded.join(given, "epoch", "left").withColumn("seed", F.coalesce("__given", "seed")).drop("__given")
    hashed = seeded.withColumn("__hash", seeded_hash(F.col("seed"), F.col("slice_id"))).withColumn("__start", F.col("pos") - F.col("idx"))
    placed = global_index(hashed.drop("idx"), [F.col("__hash"), F.col("slice_id")], "idx", ("epoch",), top_bits(F.col("__hash")))
    return placed.select((F.col("__start") + F.col("idx")).alias("pos"), "epoch", "seed", "idx", "slice_id")


def resume_plan(plan: DataFrame, epoch_index: int, slice_index: int) -> DataFrame:
    """What is left after the whole epochs before ``epoch_index`` and the first ``slice_index`` slices of it."""
    return plan.where((F.col("epoch") > epoch_index) | ((F.col("epoch") == epoch_index) & (F.col("idx") >= slice_index)))


def data_state(handed_out: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: epoch_index, slice_index, shuffle_seed of the next slice; the number of epochs, 0 and 0 at the end."""
    following = handed_out.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("next_pos"))
    ends = plan.agg((F.max("epoch") + 1).alias("epochs"))
    found = following.join(plan, F.col("next_pos") == F.col("pos"), "left").join(F.broadcast(ends), F.lit(True), "left")  # one row
    return found.select(
        F.coalesce("epoch", "epochs", F.lit(0)).cast("long").alias("epoch_index"), F.coalesce("idx", F.lit(0)).cast("long").alias("slice_index"), F.coalesce("seed", F.lit(0)).cast("long").alias("shuffle_seed")
    )


def state_changes(states: DataFrame, content: list[str], time: str = "saved_at", key: str = "config_name") -> DataFrame:
    """The rows whose content differs from the row before of the same config."""
    digest = F.md5(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))
    rows = row_before(states, digest, (time,), "__before", (key,))
    return rows.where(~F.col("__before.value").eqNullSafe(digest)).drop("__before")


def restore_state(states: DataFrame, configs: DataFrame, time: str = "saved_at") -> DataFrame:
    """For each config the newest state saved under its name, else its fresh state (0, 0, seed)."""
    newest = states.groupBy("config_name").agg(F.max_by(F.struct("epoch_index", "slice_index", "shuffle_seed"), time).alias("__state"))
    found = configs.join(newest, "config_name", "left")
    pick = lambda name, fresh: F.coalesce(F.col(f"__state.{name}"), fresh).cast("long").alias(name)
    return found.select("config_name", pick("epoch_index", F.lit(0)), pick("slice_index", F.lit(0)), pick("shuffle_seed", F.col("seed")), F.col("__state").isNotNull().alias("restored"))


def assign_slices(plan: DataFrame, requests: DataFrame, order: tuple[str, ...] = ("ts", "task", "request_id")) -> DataFrame:
    """Who gets which slice: the k-th request in ``order`` gets the k-th slice of the plan."""
    asked = global_index(requests, [F.col(c) for c in order], "rank")
    queue = global_index(plan.select("pos", "slice_id"), [F.col("pos")], "rank", bucket=_id_bucket("pos"))
    return asked.join(queue, "rank").select("request_id", "task", "pos", "slice_id")


OPEN = ("ready", "start")


def dispatch_outcomes(requests: DataFrame, control: DataFrame, plan: DataFrame, patience: float | None = None) -> DataFrame:
    """Per request its status and slice.

    ``control`` (ts, control_id, action): ``ready`` or ``start`` opens the queue, ``stop`` closes it.
    Before any of them a request is UNAVAILABLE, while closed RETRY_LATER; the rest get slices
    in order until there is none: OUT_OF_RANGE.  With ``patience`` a request that finds the queue
    closed waits so many seconds; if it opens by then, those who wait are served first, in order.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gated = as_of(requests, control.withColumn("__act", F.col("action")), "__act", "gate", tie="control_id").withColumn("__from", F.when(F.col("gate").isin(*OPEN), micros))
    if patience is not None:
        opened = control.where(F.col("action").isin(*OPEN)).select((-micros).alias("__at"), micros.alias("__open"))
        gated = as_of(gated.withColumn("__at", -micros - 1), opened, "__open", "__next", "__at")  # the first opening after the request
        waits = (F.col("gate") == "stop") & (F.col("__next") - micros <= int(patience * 1_000_000))
        gated = gated.withColumn("__from", F.when(waits, F.col("__next")).otherwise(F.col("__from")))
    gated = written(gated.select("request_id", "task", "ts", "gate", "__from"), "gated")
    given = assign_slices(plan, gated.where("__from is not null"), ("__from", "ts", "task", "request_id")).select("request_id", F.col("slice_id"))
    status = F.when(F.col("gate").isNull(), "UNAVAILABLE").when(F.col("__from").isNull(), "RETRY_LATER").when(F.col("slice_id").isNull(), "OUT_OF_RANGE").otherwise("OK")
    return gated.join(given, "request_id", "left").select("request_id", "task", status.alias("status"), "slice_id")


def consumption_progress(plan: DataFrame, handed_out: DataFrame) -> DataFrame:
    """Per epoch: slices in all, handed out, left, and tasks that took any."""
    seen = plan.select("pos", "epoch").join(handed_out.select("pos", "task"), "pos", "left")
    done = F.count("task")
    return seen.groupBy("epoch").agg(F.count("*").alias("total"), done.alias("processed"), (F.count("*") - done).alias("remaining"), F.countDistinct("task").alias("tasks"))
