"""Metric reports: unfolding, subscriptions, windows, usage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import global_index, row_before
from ..functions.scalars import glob_to_regex, task_id
from ..functions.tables import written

#: Subscriptions up to which their patterns are part of the plan.
MOST_PATTERNS = 1000
#: Types and subscribers of a pattern that meet in one cell, and tasks over which the cells are dealt at most.
CELL, MOST_TASKS = 1000, 10_000
REPORT_JSON = "MetricType array<string>, MetricValue array<double>"
PERIOD = "10 seconds"


def explode_metrics(reports: DataFrame) -> DataFrame:
    """A row per metric of a report (ts, task_name, task_index, options): ts, task, type, value.

    The two lists are cut to the shorter; a report without lists gives no row.
    """
    body = F.from_json("options", REPORT_JSON)
    parsed = reports.select("ts", task_id(F.col("task_name"), F.col("task_index")).alias("task"), body.alias("__b"))
    n = F.least(F.size("__b.MetricType"), F.size("__b.MetricValue"))
    kept = parsed.where(n > 0).withColumns({"__t": F.slice("__b.MetricType", F.lit(1), n), "__v": F.slice("__b.MetricValue", F.lit(1), n)})
    pairs = F.zip_with("__t", "__v", lambda t, v: F.struct(t.alias("type"), v.alias("value")))
    return kept.select("ts", "task", F.explode(pairs).alias("__m")).select("ts", "task", "__m.type", "__m.value")


def has_duplicate_tags(options: Column) -> Column:
    tags = F.filter(F.coalesce(F.from_json(options, REPORT_JSON)["MetricType"], F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return F.size(F.array_distinct(tags)) < F.size(tags)


def reject_duplicate_tags(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid reports, and those in which a non-empty tag repeats."""
    marked = reports.withColumn("__dup", has_duplicate_tags(F.col("options")))
    return marked.where("not __dup").drop("__dup"), marked.where("__dup").drop("__dup")


def subscribe(metrics: DataFrame, subs: DataFrame) -> DataFrame:
    """Metrics for each subscriber with a matching glob (subscriber, pattern), once per subscriber.

    Up to ``MOST_PATTERNS`` subscriptions are tested on each metric as it passes, without a join or
    a second reading.  More are matched to the distinct metric types (``matching_types``), and metrics join their types.
    """
    listed = subs.select("subscriber", "pattern").distinct().limit(MOST_PATTERNS + 1).collect()
    if len(listed) <= MOST_PATTERNS:
        return subscribe_small(metrics, [tuple(r) for r in listed])
    return metrics.join(matching_types(metrics.select("type").distinct(), subs), "type")


def _grams(text: Column, q: int) -> Column:
    """The distinct parts of ``q`` characters."""
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def literals(pattern: Column) -> Column:
    """What every match of a glob contains: the runs between ``*``, ``?`` and classes."""
    return F.filter(F.split(F.regexp_replace(pattern, r"\[!?\]?[^\]]*\]", "*"), r"[*?\[]"), lambda x: x != "")


def matching_types(types: DataFrame, subs: DataFrame) -> DataFrame:
    """(type, subscriber) of the distinct ``types`` and the globs (subscriber, pattern) that match them.

    An index of parts: every match of a pattern contains the pattern's literal runs, so it meets only the types that have
    the rarest part of these, six characters long where there are such runs, else three.  The few distinct patterns
    without a run of three are tested in blocks of ``MOST_PATTERNS`` as the types pass.
    """
    types = written(types, "types")
    patterns = subs.select("pattern").where("pattern is not null").distinct()
    parts = lambda q: F.array_distinct(F.flatten(F.transform(literals(F.col("pattern")), lambda x: _grams(x, q))))
    patterns = patterns.withColumn("long", parts(6)).withColumn("parts", F.when(F.size("long") > 0, F.col("long")).otherwise(parts(3))).drop("long")
    patterns = written(patterns.withColumn("regex", glob_to_regex(F.col("pattern"))), "patterns")
    there = written(types.select("type", F.explode(F.concat(_grams(F.col("type"), 6), _grams(F.col("type"), 3))).alias("part")), "parts")
    asked = patterns.select("pattern", F.explode("parts").alias("part"))
    often = there.groupBy("part").agg(F.count("*").alias("n"))
    # A part that no type has rules the pattern out, so it counts 0.
    rarest = asked.join(often, "part", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("least"))
    chosen = rarest.where("least.n > 0").join(patterns.select("pattern", "regex"), "pattern").select("pattern", "regex", F.col("least.part").alias("part"))
    found = there.join(chosen, "part").where(F.expr("type rlike regex")).select("type", "pattern")
    rest = patterns.where(F.size("parts") == 0).select("pattern", "regex")
    blocks = -(-rest.count() // MOST_PATTERNS)
    for k in range(blocks):
        block = rest.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()
        hits = F.array_compact(F.array(*(F.when(F.col("type").rlike(r["regex"]), F.lit(r["pattern"])) for r in block))) if block else F.array().cast("array<string>")
        found = found.unionByName(types.select("type", F.explode(hits).alias("pattern")))
    return _subscribers(written(found, "found"), written(subs.select("subscriber", "pattern").distinct(), "subs"))


def _subscribers(found: DataFrame, subs: DataFrame) -> DataFrame:
    """(type, subscriber) from the distinct (type, pattern) and (subscriber, pattern).

    A pattern's product is cut into cells of about ``CELL`` types and ``CELL`` subscribers, dealt out by the rows they make.  Only pairs of
    subscribers with several patterns can repeat and are made distinct.
    """
    sizes = found.groupBy("pattern").agg(F.count("*").alias("types")).join(subs.groupBy("pattern").agg(F.count("*").alias("names")), "pattern")
    sizes = written(sizes, "sizes")
    tasks = min(MOST_TASKS, 1 + (sizes.agg(F.sum(F.col("types") * F.col("names"))).first()[0] or 0) // CELL**2)
    cut = lambda n: F.ceil(F.col(n) / CELL)
    of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), cut(n) - 1))
    key = ["pattern", "i", "j"]
    several = subs.groupBy("subscriber").agg((F.count("*") > 1).alias("several"))
    names = subs.join(sizes, "pattern").join(several.withColumnRenamed("subscriber", "__name"), F.col("subscriber").eqNullSafe(F.col("__name")))
    names = names.select("subscriber", "several", "pattern", F.pmod(F.xxhash64("subscriber"), cut("names")).alias("j"), of("types").alias("i"))
    types = found.join(sizes, "pattern").select("type", "pattern", F.pmod(F.xxhash64("type"), cut("types")).alias("i"), of("names").alias("j")).repartition(tasks, *key)
    names = written(names, "names")
    pairs = lambda which: types.join(names.where(which).repartition(tasks, *key), key).select("type", "subscriber")
    return pairs("not several").unionByName(pairs("several").distinct())


def subscribe_small(metrics: DataFrame, subs: list[tuple[str, str]]) -> DataFrame:
    """The same for a listed handful of subscriptions, without a join (streams)."""
    names = sorted({s for s, _ in subs})
    if not names:
        return metrics.withColumn("subscriber", F.lit("")).where("false")
    patterns = metrics.sparkSession.createDataFrame([(p,) for p in sorted({p for _, p in subs})], "p string")
    regex = dict(tuple(r) for r in patterns.select("p", glob_to_regex(F.col("p"))).collect())  # once, not for each metric

    def matches(name: str) -> Column:
        test = F.lit(False)
        for s, pattern in subs:
            if s == name:
                test = test | F.col("type").rlike(regex[pattern])
        return F.when(test, F.lit(name))

    return metrics.withColumn("subscriber", F.explode(F.filter(F.array(*map(matches, names)), lambda x: x.isNotNull())))


def window_snapshot(metrics: DataFrame, period: str = PERIOD, watermark: str | None = None, keys: tuple[str, ...] = ("subscriber", "type")) -> DataFrame:
    """Per key and period the values in time order: keys, window_start, values.

    On a stream ``watermark`` bounds the state; later rows are dropped.
    """
    timed = metrics.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    values = F.array_sort(F.collect_list(F.struct("ts", "value")))
    found = timed.groupBy(*keys, F.window("ts", period).alias("w")).agg(values.alias("pairs"))
    return found.select(*keys, F.col("w.start").alias("window_start"), F.transform("pairs", lambda x: x["value"]).alias("values"))


def metric_sequence(metrics: DataFrame, order: list[str], by: tuple[str, ...] = ("subscriber", "type")) -> DataFrame:
    """The FIFO number (from 0) of each metric per subscriber and type."""
    return global_index(written(metrics, "metrics"), [F.col(c) for c in order], "seq", by)


def task_actions(reports: DataFrame, tasks: DataFrame) -> DataFrame:
    """The reports of the asked tasks: task, status (OK, NOT_FOUND), seq (place in time order, from 0), ts, options.

    A row per report, so that no task's history has to fit one row; a task without reports has one row.
    """
    rows = reports.select(task_id(F.col("task_name"), F.col("task_index")).alias("task"), "ts", "options")
    numbered = global_index(written(rows, "reports"), [F.col("ts"), F.col("options")], "seq", ("task",))
    found = tasks.select("task").distinct().join(numbered, "task", "left")
    return found.select("task", F.when(F.col("seq").isNotNull(), "OK").otherwise("NOT_FOUND").alias("status"), "seq", "ts", "options")


def parse_metric_tag(col: Column) -> Column:
    """A tag of six parts as (system, metric, job, replica, task, device); null for others."""
    parts = F.split(col, "/")
    names = ("system", "metric", "job", "replica", "task", "device")
    return F.when(F.size(parts) == 6, F.struct(*(parts[i].alias(n) for i, n in enumerate(names))))


def cpu_usage(samples: DataFrame, ticks: int = 100) -> DataFrame:
    """Percent of a CPU from cumulative ticks (task, ts, cpu_ticks); 0 for a task's first sample."""
    rows = row_before(samples, F.struct("ts", "cpu_ticks"), ("ts", "cpu_ticks"), "__before", ("task",))
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("__before.value.ts").cast("timestamp"))
    usage = F.when(seconds > 0, (F.col("cpu_ticks") - F.col("__before.value.cpu_ticks")) / (seconds * ticks) * 100.0)
    return rows.withColumn("cpu_percent", F.coalesce(usage, F.lit(0.0))).drop("__before")


def rss_mb(pages: Column, page_size: int = 4096) -> Column:
    return pages * page_size / F.lit(1024.0 * 1024.0)


def step_duration(marks: DataFrame) -> DataFrame:
    """Microseconds from begin to end of each task's steps (task, step, mark, micros); null where one is missing."""
    at = lambda m: F.max(F.when(F.col("mark") == m, F.col("micros")))
    return marks.groupBy("task", "step").agg((at("end") - at("begin")).alias("micros"))


def resource_total(listing: DataFrame, sizes: DataFrame) -> DataFrame:
    """Total MB of each ``name:size@name:size@`` listing (id, listing); size -1 means the live size of the table (name, n_bytes)."""
    items = listing.select("id", F.explode(F.filter(F.split("listing", "@"), lambda x: x != "")).alias("item"))
    cells = items.select("id", F.substring_index("item", ":", 1).alias("name"), F.substring_index("item", ":", -1).try_cast("long").alias("size"))
    live = cells.join(sizes.select("name", "n_bytes"), "name", "left")
    n = F.when(F.col("size") == -1, F.coalesce("n_bytes", F.lit(0))).otherwise(F.coalesce("size", F.lit(0)))
    return live.groupBy("id").agg((F.sum(n) / 1024 / 1024).alias("total_mb"))


def memory_growth(metrics: DataFrame) -> DataFrame:
    """Difference to the sample before of the same task (task, ts, value); null for the first."""
    rows = row_before(metrics, F.col("value"), ("ts", "value"), "__before", ("task",))
    return rows.withColumn("growth", F.col("value") - F.col("__before.value")).drop("__before")
