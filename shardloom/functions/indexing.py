"""Positions, as-of values, rows before and running sums without a window over a whole table.

Up to ``BUCKET_ROWS`` rows a group is one window.  Beyond, the rows are cut at split points: Spark samples
the order key and shuffles the rows by range (``repartitionByRange``), so that limits follow the data, not its
span: one stray time stamp or a hot beginning of names makes no part larger.  The split points are over the
groups and all order columns, then a hash of the whole row, so a hot value of the first column is
split by the next ones; only rows that repeat each other entirely stay together.  The parts are written
once, and what a part takes over from those before it comes from a table with a row per part and
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructField, StructType

from .tables import written

#: Rows of a group up to which it is one window, and of a part beyond.
BUCKET_ROWS = 200_000
#: Parts at most; with more rows, each part has more.
MOST_PARTS = 20_000
#: Rows of what parts take over that are broadcast at most.
MOST_CARRIED = 100_000


def parted(df: DataFrame, by: tuple[str, ...], order: list[Column], n: int, most: int | None = None) -> DataFrame:
    """The ``n`` rows of ``df`` as a written table in range parts of ``by`` and ``order``, with ``__key`` (by, __part) and the row's place in its range, ``__row``.

    Parts of fewer rows than ``BUCKET_ROWS`` (``most``) are cut from such ranges, so tasks don't grow in number with them; rows that repeat each other may
    then be cut apart: pass distinct ones.
    """
    spark = df.sparkSession
    parts = min(MOST_PARTS, max(-(-n // max(most or 0, BUCKET_ROWS)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    whole = F.xxhash64(*(f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, MapType)))
    keys = [*map(F.col, by), *order, whole]
    placed = written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "parted")
    # As a struct the key is never null, so plain equality joins it.
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    if most:
        part = F.shiftleft(part, 33) + F.floor(row / most)
    return placed.withColumn("__key", F.struct(*by, part.alias("__part"))).withColumn("__row", row).drop("__id")


def _taken_over(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Joins what parts take over, a row per part and group; up to ``MOST_CARRIED`` go to every task, and the rows stay where they are."""
    carried = written(carried, "carried")
    return rows.join(F.broadcast(carried) if carried.count() <= MOST_CARRIED else carried, "__key")


def _parts_of(by: tuple[str, ...]) -> WindowSpec:
    """Over the table with a row per part and group."""
    return Window.partitionBy(*(F.col(f"__key.{c}") for c in by)).orderBy("__key.__part")


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def global_index(df: DataFrame, order: list[Column], name: str, by: tuple[str, ...] = (), bucket: Column | None = None) -> DataFrame:
    """Adds the 0-based position ``name`` of each row in ``order``, within each group of ``by``.

    A row's position is its place among its group's rows of the part, plus the rows of the parts before.
    ``bucket`` may name a coarse column that never falls along ``order`` and is known to part the rows
    evenly (leading bits of a hash, dense ids): then nothing is sampled or written.  ``df`` is read
    several times: pass a table or a checkpoint, not a long plan.
    """
    if bucket is None and (n := df.count()) > BUCKET_ROWS:
        rows = parted(df, by, order, n)
        counts = rows.groupBy("__key").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
        offset = F.coalesce(F.sum("__n").over(_before(_parts_of(by))), F.lit(0)) - F.col("__first")
        found = _taken_over(rows, counts.select("__key", offset.alias("__offset")))
        return found.withColumn(name, F.col("__row") + F.col("__offset")).drop("__key", "__row", "__offset")
    if bucket is None:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    marked = df.withColumn("__key", F.struct(*by, bucket.alias("__part")))
    counts = marked.groupBy("__key").agg(F.count("*").alias("__n"))
    offsets = counts.select("__key", F.coalesce(F.sum("__n").over(_before(_parts_of(by))), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__key").orderBy(*order)) - 1
    placed = marked.withColumn("__inside", inside).join(offsets, "__key")
    return placed.withColumn(name, F.col("__inside") + F.col("__offset")).drop("__key", "__inside", "__offset")


def as_of(left: DataFrame, right: DataFrame, value: str, name: str, time: str = "ts", by: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """Adds to each left row, as ``name``, the ``value`` of the last right row at or before its time.

    Right rows of one time are ordered by ``tie``.  Without an earlier right row the value is null.
    """
    kind = right.schema[value].dataType
    tied = F.col(tie) if tie else F.lit(0)
    # In a struct, so that a right row with a null value counts.
    rows = left.withColumns({"__left": F.lit(1), "__tie": F.lit(0).cast("long"), "__value": F.lit(None).cast(StructType([StructField("v", kind)]))})
    marks = right.select(*by, F.col(time), F.lit(0).alias("__left"), tied.cast("long").alias("__tie"), F.struct(F.col(value).alias("v")).alias("__value"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = [F.col(time), F.col("__left"), F.col("__tie")]
    own = lambda w: F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if (n := both.count()) <= BUCKET_ROWS:
        found = both.withColumn("__own", own(Window.partitionBy(*by).orderBy(*order))).where("__left = 1")
        return found.select(*(f"`{c}`" for c in left.columns), F.col("__own.v").alias(name))
    cut = parted(both, by, order, n)
    lasts = cut.groupBy("__key").agg(F.max_by("__value", F.when(F.col("__left") == 0, F.col("__row"))).alias("__last"))
    carried = lasts.select("__key", F.last("__last", ignorenulls=True).over(_before(_parts_of(by))).alias("__carried"))
    found = cut.withColumn("__own", own(Window.partitionBy("__key").orderBy("__row"))).where("__left = 1").join(carried, "__key")
    return found.select(*(f"`{c}`" for c in left.columns), F.coalesce("__own", "__carried")["v"].alias(name))


def largest_group(df: DataFrame, by: tuple[str, ...]) -> tuple[int, int]:
    """Rows of the largest group, and of all."""
    largest, n = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return largest or 0, n or 0


def row_before(df: DataFrame, value: Column, order: tuple[str, ...], name: str, by: tuple[str, ...]) -> DataFrame:
    """Adds, as ``name``, a struct with the ``value`` of the row before in ``order`` of the same ``by``; null for the first.

    Rows alike in ``order`` follow ``value``.  ``df`` is read several times: pass a table, not a long plan.
    """
    valued, sort = df.withColumn("__value", F.struct(value.alias("value"))), (*order, "__value")
    largest, n = largest_group(df, by)
    if largest <= BUCKET_ROWS:
        return valued.withColumn(name, F.lag("__value").over(Window.partitionBy(*by).orderBy(*sort))).drop("__value")
    cut = parted(valued, by, [F.col(c) for c in sort], n)
    lasts = cut.groupBy("__key").agg(F.max_by("__value", "__row").alias("__last"))
    carried = lasts.select("__key", F.lag("__last").over(_parts_of(by)).alias("__carried"))
    inside = cut.withColumn("__own", F.lag("__value").over(Window.partitionBy("__key").orderBy("__row")))
    return inside.join(carried, "__key").withColumn(name, F.coalesce("__own", "__carried")).drop("__value", "__key", "__row", "__own", "__carried")


def sum_before(df: DataFrame, amount: str, order: tuple[str, ...], name: str, by: tuple[str, ...]) -> DataFrame:
    """Adds, as ``name``, the sum of ``amount`` over the rows before in ``order`` of the same ``by``; 0 for the first."""
    total = lambda c, w: F.coalesce(F.sum(c).over(_before(w)), F.lit(0))
    largest, n = largest_group(df, by)
    if largest <= BUCKET_ROWS:
        return df.withColumn(name, total(amount, Window.partitionBy(*by).orderBy(*order)))
    cut = parted(df, by, [F.col(c) for c in order], n)
    sums = cut.groupBy("__key").agg(F.sum(amount).alias("__sum"))
    offsets = sums.select("__key", total("__sum", _parts_of(by)).alias("__offset"))
    inside = cut.withColumn("__inside", total(amount, Window.partitionBy("__key").orderBy("__row")))
    return inside.join(offsets, "__key").withColumn(name, F.col("__inside") + F.col("__offset")).drop("__key", "__row", "__inside", "__offset")
