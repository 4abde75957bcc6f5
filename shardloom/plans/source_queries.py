"""Queries of sources and sinks (A1-A11), over files that Spark writes from the given tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators import slices as S
from ..sources import readers, writers
from ..streaming import flows
from . import fixtures as X
from . import metric_queries as M
from .registry import Tables, query


def _folders(t: Tables) -> list[str]:
    """Orders as text lines, a folder with one file for each of eight groups."""
    path = t.scratch("orders")
    line = F.concat_ws("|", "o_orderkey", "o_orderstatus", F.col("o_custkey").cast("string"))
    rows = t.orders.select(line.alias("value"), (F.col("o_custkey") % 8).alias("k"))
    rows.repartition(8, "k").write.partitionBy("k").text(path)
    return [f"{path}/k={k}" for k in range(8)]


@query("SELECT k::INT AS dir_ord, 1::BIGINT AS n_files, sum(strlen(o_orderkey || '|' || o_orderstatus || '|' || o_custkey) + 1)::BIGINT AS n_bytes FROM (SELECT *, o_custkey % 8 AS k FROM orders) GROUP BY 1")
def A1_list_files(t: Tables) -> DataFrame:
    return readers.list_files(t.spark, _folders(t)).groupBy("dir_ord").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


@query(f"""WITH {X.SLICES_SQL} SELECT prefix, (dense_rank() OVER (ORDER BY prefix) - 1)::INT AS dir_ord, name FROM files""")
def A2_read_file_manifest(t: Tables) -> DataFrame:
    path = t.scratch("manifests")
    names = X.files(t).groupBy("prefix").agg(F.count("*").alias("FileCount"), F.array_sort(F.collect_list("name")).alias("FileList"))
    names.select(F.col("prefix").alias("FileDir"), "FileCount", "FileList", F.substring("prefix", 1, 1).alias("p")).write.partitionBy("p").json(path)
    found = t.spark.read.schema(readers.MANIFEST_SCHEMA).json(path).inputFiles()  # a file per prefix
    return readers.read_file_manifest(t.spark, sorted(found))[1]


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END::DOUBLE AS l_quantity, CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_returnflag END AS l_returnflag FROM lineitem""")
def A4_read_samples_csv(t: Tables) -> DataFrame:
    path = t.scratch("samples")
    number = F.col("l_linenumber")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(number != 2, F.col("l_quantity")).alias("l_quantity"), F.when(number != 3, F.col("l_returnflag")).alias("l_returnflag"))
    rows.write.csv(path)
    return readers.read_samples_csv(t.spark, path, rows.schema, {"l_quantity": 0.0, "l_returnflag": " "})


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def A5_read_samples_parquet(t: Tables) -> DataFrame:
    return readers.read_samples_parquet(t.spark, f"{t.sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_tax")


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def A6_read_lines(t: Tables) -> DataFrame:
    parts = F.split("line", "[|]")
    return readers.read_lines(t.spark, _folders(t)).select(parts[0].cast("long").alias("o_orderkey"), parts[1].alias("o_orderstatus"), parts[2].cast("long").alias("o_custkey"))


@query("SELECT o_custkey % 8 AS slice_id, e::INT AS epoch, o_orderkey FROM orders, range(2) r(e) WHERE (o_custkey % 8 + e) % 3 > 0")
def A7_read_slices(t: Tables) -> DataFrame:
    folders = _folders(t)
    files = S.slice_files(S.make_slices(readers.list_files(t.spark, folders), 1))
    chosen = files.withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1)))).where("(slice_id + epoch) % 3 > 0")
    found = readers.read_slices(t.spark, chosen.select("slice_id", "epoch", "path"), folders)
    return found.select("slice_id", "epoch", F.split("value", "[|]")[0].cast("long").alias("o_orderkey"))


@query("SELECT 'config-' || s_nationkey AS config_name, s_suppkey AS slice_index, count(*) AS n FROM supplier, range(2) GROUP BY 1, 2")
def A8_write_state(t: Tables) -> DataFrame:
    path = t.scratch("states")
    states = t.supplier.select(F.concat(F.lit("config-"), F.col("s_nationkey").cast("string")).alias("config_name"), F.col("s_suppkey").alias("slice_index"))
    for _ in range(2):
        writers.write_state(states, path)
    return t.spark.read.parquet(path).groupBy("config_name", "slice_index").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT 'config-' || (user_id % 11) AS config_name, floor(value / 200)::BIGINT AS slice_index, event_id AS saved_at FROM events)
SELECT config_name, arg_max(slice_index, saved_at) AS slice_index, max(saved_at) AS saved_at FROM s GROUP BY 1""")
def A8_save_newest_state(t: Tables) -> DataFrame:
    path = t.scratch("newest")
    states = t.events.select(F.concat(F.lit("config-"), (F.col("user_id") % 11).cast("string")).alias("config_name"), F.floor(F.col("value") / 200).alias("slice_index"), F.col("event_id").alias("saved_at"))
    for i in range(3):
        writers.save_newest_state(states.where(f"saved_at % 3 = {i}"), path)
    return writers.read_newest_state(t.spark, path)


def _report_files(t: Tables) -> str:
    """Reports as JSON files in time order, the last of them a day late: it closes all windows."""
    path = t.scratch("reports")
    rows = X.reports(t).drop("event_id")
    late = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit("job_ps").alias("task_name"), F.lit(0).alias("task_index"), F.lit("{}").alias("options"))
    body = F.lit('{"MetricType": ["sys/mem/none"], "MetricValue": [0.0]}')
    rows.unionByName(late.withColumn("options", body)).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.json(path)
    return path


_SNAPSHOTS = f"""WITH {M.SUBSCRIBED_SQL}
SELECT subscriber, type, (sec // 10 * 10)::BIGINT AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM sub GROUP BY 1, 2, 3"""


@query(_SNAPSHOTS)
def A10_write_snapshots(t: Tables) -> DataFrame:
    """The stream A9 through D1-D5 into the sink A10, for all that has arrived."""
    out = t.scratch("snapshots")
    stream = flows.snapshot_stream(readers.read_metric_stream(t.spark, _report_files(t)), M.SUBS)
    writers.write_snapshots(stream, out, t.scratch("stream-state")).awaitTermination()
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    found = t.spark.read.parquet(out)
    return found.select("subscriber", "type", F.unix_timestamp("window_start").alias("window_start"), F.size("values").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("WITH " + X.REPORTS_SQL + " SELECT task, type, count(*) AS n, round(max(value), 4) AS most FROM metrics GROUP BY 1, 2")
def A9_read_metric_stream(t: Tables) -> DataFrame:
    out = t.scratch("metrics")
    valid, _ = metrics.reject_duplicate_tags(readers.read_metric_stream(t.spark, _report_files(t)))
    writers.write_snapshots(metrics.explode_metrics(valid), out, t.scratch("stream-state")).awaitTermination()
    found = t.spark.read.parquet(out).where("type <> 'sys/mem/none'")
    return found.groupBy("task", "type").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most"))


@query("SELECT 'v' || p_partkey AS name, p_size * 10 || 'x16' AS shape, CASE p_size % 2 WHEN 0 THEN 'float' ELSE 'int64' END AS dtype FROM part")
def A11_read_variable_manifest(t: Tables) -> DataFrame:
    path = t.scratch("variables")
    kind = F.when(F.col("p_size") % 2 == 0, "float").otherwise("int64")
    rows = t.part.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("name"), F.array((F.col("p_size") * 10).cast("long"), F.lit(16).cast("long")).alias("shape"), kind.alias("dtype"))
    rows.write.json(path)
    return readers.read_variable_manifest(t.spark, path).select("name", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "dtype")
