"""Re-sharding embedding tables (by id) and dense tables (by row ranges)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indexing import global_index
from ..sources.versions import Versions

KEYED = ("var", "key")


def shard_mod(col: Column, n: int) -> Column:
    """Shard of an id: ``id mod n``."""
    return F.pmod(col, F.lit(n)).cast("int")


def shard_div(col: Column, num_ids: int, n: int) -> Column:
    """Shard of an id in contiguous ranges; the first ``num_ids mod n`` shards are one longer."""
    base, extras = divmod(num_ids, n)
    if base == 0:
        return col.cast("int")
    return F.greatest(F.floor(col / (base + 1)), F.floor((col - extras) / base)).cast("int")


def part_start(part: Column, num_rows: Column, n: Column) -> Column:
    """First row of a part: the prefix sum of the part sizes."""
    return part * F.floor(num_rows / n) + F.least(part, num_rows % n)


def part_length(part: Column, num_rows: Column, n: Column) -> Column:
    return F.floor(num_rows / n) + F.when(part < num_rows % n, 1).otherwise(0)


def reshard_export(table: DataFrame, n_new: int) -> DataFrame:
    """The rows that must leave their shard, with their target as ``to_part``."""
    return table.withColumn("to_part", shard_mod(F.col("key"), n_new)).where(F.col("part") != F.col("to_part"))


def reshard_import(table: DataFrame, moved: DataFrame) -> DataFrame:
    """The table with the moved rows in their new shards; importing twice changes nothing.

    Of moved rows that repeat a key the one with the greatest version stays.
    """
    payload = [c for c in moved.columns if c not in (*KEYED, "to_part")]
    newest = moved.groupBy(*KEYED).agg(F.max_by(F.struct("to_part", *payload), F.struct("version", "to_part")).alias("__row"))
    rows = newest.select(*KEYED, "__row.*").withColumn("part", F.col("to_part")).drop("to_part").select(*table.columns)
    stay = table.join(rows.select(*KEYED), list(KEYED), "left_anti")
    return stay.unionByName(rows)


def reshard(table: DataFrame, n_new: int) -> DataFrame:
    """The whole table in ``n_new`` shards, each shard's rows together; payload unchanged."""
    return table.withColumn("part", shard_mod(F.col("key"), n_new)).repartition("part")


def reshard_with_slots(primary: DataFrame, slots: dict[str, DataFrame], n_new: int) -> list[tuple[str, DataFrame]]:
    """What moves, slot tables first and the primary last, all by the primary's keys."""
    plan = reshard_export(primary, n_new)
    keys = plan.select(*KEYED, "to_part")
    return [*((name, slot.join(keys, list(KEYED))) for name, slot in sorted(slots.items())), ("primary", plan)]


def store_tables(store: Versions, primary: DataFrame, slots: dict[str, DataFrame]) -> None:
    """Writes a table with ``var``, ``key``, ``part`` and its slot tables as one version, a directory per table and shard."""
    parts = {}
    for name, df in [*sorted(slots.items()), ("primary", primary)]:
        parts |= {f"{name}/{p}": d for p, d in store.write(df).items()}
    store.commit(parts)


def stored_table(store: Versions, name: str) -> DataFrame:
    """A table of the live version, with its shards as ``part``."""
    found = {p: d for p, d in store.live().items() if p.split("/")[0] == name}
    return store.read(found).withColumn("part", F.col("part").cast("int"))


def reshard_stored(store: Versions, n_new: int) -> list[int]:
    """Re-shards all stored tables by ``key mod n_new`` and returns the shards that were written.

    Which rows move is read from keys and shards of the primary alone.  Only shards that lose or get rows are
    written anew, slots first and the primary last; one manifest then makes all of them live at once.  So a job
    that dies in between changes nothing and is run again, and the other shards keep their files.
    """
    live = store.live()
    moving = stored_table(store, "primary").select("part", shard_mod(F.col("key"), n_new).alias("to")).where(F.col("part") != F.col("to"))
    changed = {x for r in moving.distinct().collect() for x in r}  # pairs of shards
    if not changed:
        return []
    fresh = {p: d for p, d in live.items() if int(p.split("/")[1]) not in changed}
    names = sorted({p.split("/")[0] for p in live}, key=lambda x: (x == "primary", x))
    for name in names:
        old = {p: d for p, d in live.items() if p.split("/")[0] == name and int(p.split("/")[1]) in changed}
        if old:
            rows = store.read(old).withColumn("part", shard_mod(F.col("key"), n_new))
            # A hot shard's rows are dealt out to several tasks by key.
            spread = rows.repartition("part", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("part", "key")
            fresh |= {f"{name}/{p}": d for p, d in store.write(spread).items()}
    store.commit(fresh)
    return sorted(changed)


def reshard_plan(table: DataFrame, n_new: int) -> DataFrame:
    """Rows and bytes from each shard to each other: part, to_part, n_rows, n_bytes."""
    row_bytes = F.size("value") * 4 + 24  # floats, key, version, frequency
    return reshard_export(table, n_new).groupBy("part", "to_part").agg(F.count("*").alias("n_rows"), F.sum(row_bytes).alias("n_bytes"))


def shard_sizes(table: DataFrame, n: int | None = None) -> DataFrame:
    """Rows per shard, of the present shards or of ``n``."""
    part = F.col("part") if n is None else shard_mod(F.col("key"), n)
    return table.groupBy(part.alias("part")).agg(F.count("*").alias("n_rows"))


def dense_split(table: DataFrame, num_rows: int, n_new: int) -> DataFrame:
    """Rows of a dense table in contiguous parts: adds part, local row, part offset and length."""
    part = shard_div(F.col("row_id"), num_rows, n_new).cast("long")
    placed = table.withColumn("part", part)
    total, n = F.lit(num_rows).cast("long"), F.lit(n_new).cast("long")
    return placed.withColumns({"part_offset": part_start(F.col("part"), total, n), "part_length": part_length(F.col("part"), total, n)}).withColumn("local_row", F.col("row_id") - F.col("part_offset"))


def dense_gather(parts: DataFrame) -> DataFrame:
    """The whole table back from (part, local_row): adds row_id from the sizes of the parts."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over parts
    offsets = sizes.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return parts.join(offsets, "part").withColumn("row_id", F.col("__offset") + F.col("local_row")).drop("__offset")


def dense_mod_layout(col: Column, num_rows: int, n: int) -> Column:
    """Row of an id when lookups go by ``id mod n`` over row-split parts; the parts must be of one length."""
    if num_rows % n:
        raise ValueError(f"{num_rows} rows don't split into {n} parts of one length")
    return (F.pmod(col, F.lit(n)) * F.lit(num_rows // n) + F.floor(col / n)).cast("long")


def dynamic_partition(df: DataFrame, n: int) -> DataFrame:
    """The ids of each row split by shard, with their positions: row_id, part, ids, positions."""
    cells = df.select("row_id", F.posexplode("ids").alias("position", "id")).withColumn("part", shard_mod(F.col("id"), n))
    pairs = F.array_sort(F.collect_list(F.struct("position", "id")))
    out = cells.groupBy("row_id", "part").agg(pairs.alias("pairs"))
    return out.select("row_id", "part", F.transform("pairs", lambda x: x["id"]).alias("ids"), F.transform("pairs", lambda x: x["position"]).alias("positions"))


def dynamic_stitch(parts: DataFrame) -> DataFrame:
    """The inverse of ``dynamic_partition``: row_id and ids in their first order."""
    cells = parts.select("row_id", F.explode(F.arrays_zip("positions", "ids")).alias("cell")).select("row_id", "cell.positions", "cell.ids")
    pairs = F.array_sort(F.collect_list(F.struct("positions", "ids")))
    return cells.groupBy("row_id").agg(pairs.alias("pairs")).select("row_id", F.transform("pairs", lambda x: x["ids"]).alias("ids"))


def part_sizes(vars_: DataFrame, n: int) -> DataFrame:
    """Start and length of each of ``n`` parts of the rows of each variable (var, num_rows)."""
    rows = vars_.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    total, parts = F.col("num_rows").cast("long"), F.lit(n).cast("long")
    return rows.select("var", "part", part_start(F.col("part"), total, parts).alias("start"), part_length(F.col("part"), total, parts).alias("length"))


def _slice_text(dims: Column, start: Column, length: Column) -> Column:
    rest = F.transform(F.slice(dims, 2, F.greatest(F.size(dims) - 1, F.lit(0))), lambda d: F.concat(F.lit("0,"), d.cast("string")))
    cuts = F.concat(F.array(F.concat_ws(",", start.cast("string"), length.cast("string"))), rest)
    return F.concat_ws(" ", F.array_join(dims.cast("array<string>"), " "), F.array_join(cuts, ":"))


def shape_and_slice(vars_: DataFrame, n: int) -> DataFrame:
    """Save manifest per variable (var, dims) and part: ``"30 16 0,15:0,16"``."""
    sizes = part_sizes(vars_.select("var", F.col("dims")[0].alias("num_rows")), n)
    return sizes.join(vars_, "var").select("var", "part", F.lit(n).alias("num_parts"), _slice_text(F.col("dims"), F.col("start"), F.col("length")).alias("shape_and_slice"))


def resplit_manifest(manifest: DataFrame, n_old: int, n_new: int) -> DataFrame:
    """Manifest rows (var, part, num_parts, shape_and_slice) cut anew along the first dimension.

    Variables with ``n_old`` parts get ``n_new``; unpartitioned ones and others stay.
    """
    words = F.split("shape_and_slice", " ")
    dims = F.transform(F.slice(words, 1, F.size(words) - 1), lambda x: x.cast("long"))
    parsed = manifest.withColumn("dims", dims)
    cut = (F.col("num_parts") == n_old) & (F.col("num_parts") > 1)
    fresh = shape_and_slice(parsed.where(cut & (F.col("part") == 0)).select("var", "dims"), n_new)
    stay = manifest.where(~cut).select("var", F.col("part").cast("long").alias("part"), "num_parts", "shape_and_slice")
    return stay.unionByName(fresh.select("var", "part", "num_parts", "shape_and_slice"))


def parse_var_name(col: Column) -> Column:
    """``prefix/part_K/slot`` as (prefix, part, slot); without a part the whole name is the prefix and the part is null."""
    pattern = r"^(.*?)/part_([0-9]+)(?:/(.*))?$"
    has = col.rlike(pattern)
    prefix = F.when(has, F.regexp_extract(col, pattern, 1)).otherwise(col)
    part = F.when(has, F.regexp_extract(col, pattern, 2).try_cast("int"))
    return F.struct(prefix.alias("prefix"), part.alias("part"), F.when(has, F.nullif(F.regexp_extract(col, pattern, 3), F.lit(""))).alias("slot"))


def rename_part(col: Column, part: Column) -> Column:
    """The name for another part; a name without a part gets ``/Copy_K``."""
    name = parse_var_name(col)
    tail = F.when(name["slot"].isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), name["slot"]))
    return F.when(name["part"].isNull(), F.concat(col, F.lit("/Copy_"), part.cast("string"))).otherwise(F.concat(name["prefix"], F.lit("/part_"), part.cast("string"), tail))


def place_parts(parts: DataFrame, n_dev: int) -> DataFrame:
    """Devices for new parts (device null) of each variable: on from the highest in use, modulo the number of devices."""
    top = parts.groupBy("var").agg(F.coalesce(F.max("device"), F.lit(-1)).alias("__top"))
    fresh = global_index(parts.where("device is null"), [F.col("part")], "__nth", ("var",), F.floor(F.col("part") / 1024))
    placed = fresh.join(top, "var").withColumn("device", F.pmod(F.col("__top") + 1 + F.col("__nth"), F.lit(n_dev)).cast("int"))
    return parts.where("device is not null").select("var", "part", "device").unionByName(placed.select("var", "part", "device"))


def parts_to_move(parts: DataFrame, n_dev: int) -> DataFrame:
    """Parts on devices that disappear; ``resplit`` tells whether the variable had one part per device and is cut anew."""
    counts = parts.groupBy("var").agg(F.count("*").alias("__parts"))
    return parts.where(F.col("device") >= n_dev).join(counts, "var").select("var", "part", "device", (F.col("__parts") > n_dev).alias("resplit"))
