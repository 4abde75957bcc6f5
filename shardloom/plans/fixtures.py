"""Inputs of the operators, derived from the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slices as S
from .registry import Tables

SLICE, EPOCHS, SEED, DIM = 100, 3, 42, 64
HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def files(t: Tables) -> DataFrame:
    name = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    return t.orders.select(F.col("o_orderpriority").alias("prefix"), F.substring("o_orderpriority", 1, 1).cast("int").alias("dir_ord"), name.alias("name"))


def slices(t: Tables) -> DataFrame:
    return t.cut(S.make_slices(files(t), SLICE), "slices")


def plan(t: Tables) -> DataFrame:
    return S.expand_epochs(slices(t), EPOCHS)


def shuffled(t: Tables) -> DataFrame:
    return t.cut(S.shuffle_epochs(t.cut(plan(t), "plan"), SEED), "epochs")


def requests(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("click", "view")).select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("task"), "ts")


def control(t: Tables) -> DataFrame:
    action = F.when(F.col("event_type") == "error", "stop").otherwise("start")
    return t.events.where(F.col("event_type").isin("error", "signup")).select("ts", F.col("event_id").alias("control_id"), action.alias("action"))


SLICES_SQL = f"""
files AS (SELECT o_orderpriority AS prefix, substr(o_orderpriority, 1, 1)::INT AS dir_ord, lpad(o_orderkey::VARCHAR, 10, '0') AS name FROM orders),
fi AS (SELECT *, row_number() OVER (PARTITION BY prefix, dir_ord ORDER BY name) - 1 AS i, count(*) OVER (PARTITION BY prefix, dir_ord) AS n FROM files),
dirs AS (SELECT prefix, dir_ord, coalesce(sum(ceil(n / {SLICE}.0)) OVER (ORDER BY dir_ord, prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
         FROM (SELECT DISTINCT prefix, dir_ord, n FROM fi)),
slices AS (SELECT (first + i // {SLICE})::BIGINT AS slice_id, prefix, list(name ORDER BY name) AS names, count(*)::INT AS size
           FROM fi JOIN dirs USING (prefix, dir_ord) GROUP BY 1, 2)"""
PLAN_SQL = f"""{SLICES_SQL},
plan AS (SELECT e * n + i AS pos, e AS epoch, i AS idx, slice_id
         FROM (SELECT slice_id, row_number() OVER (ORDER BY slice_id) - 1 AS i, count(*) OVER () AS n FROM slices), range({EPOCHS}) AS r(e))"""
SHUFFLED_SQL = f"""{PLAN_SQL},
seeded AS (SELECT epoch, slice_id, pos - idx AS first, {HASH.format(f"'epoch-{SEED}:' || epoch")} AS seed FROM plan),
ordered AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY {HASH.format("seed || ':' || slice_id")}, slice_id) - 1 AS i FROM seeded),
shuffled AS (SELECT first + i AS pos, epoch, seed, i AS idx, slice_id FROM ordered)"""
REQUESTS_SQL = "requests AS (SELECT event_id AS request_id, user_id::VARCHAR AS task, ts FROM events WHERE event_type IN ('click', 'view'))"
CONTROL_SQL = "control AS (SELECT ts, event_id AS control_id, CASE event_type WHEN 'error' THEN 'stop' ELSE 'start' END AS action FROM events WHERE event_type IN ('error', 'signup'))"


def embedding(t: Tables, n: int = 3) -> DataFrame:
    freq = t.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("freq"))
    rows = t.embeddings.select(F.lit("emb").alias("var"), F.col("vec_id").alias("key"), F.col("embedding").alias("value"), (F.col("vec_id") * 37 % 6000).alias("version"))
    return rows.join(freq, "key", "left").select("var", "key", "value", "version", F.coalesce("freq", F.lit(0)).alias("freq"), F.pmod("key", F.lit(n)).cast("int").alias("part"))


EMB_SQL = """
freq AS (SELECT l_partkey AS key, count(*) AS freq FROM lineitem GROUP BY 1),
emb AS (SELECT 'emb' AS var, vec_id AS key, embedding AS value, vec_id * 37 % 6000 AS version, coalesce(freq, 0) AS freq, (vec_id % 3)::INT AS part
        FROM embeddings LEFT JOIN freq ON key = vec_id)"""


#: Sums in another order differ in their last bits; this keeps them away from where rounding turns.
NUDGE = 3.3e-8


def cells(df: DataFrame, *keys: str, value: str = "value", digits: int = 6) -> DataFrame:
    """Vectors as rows (keys, dim, v), rounded."""
    x = F.col("x").cast("double") + (NUDGE if digits < 6 else 0.0)
    return df.select(*keys, F.posexplode(value).alias("dim", "x")).select(*keys, "dim", (F.round(x, digits) + F.lit(0.0)).alias("v"))  # no negative zero


def dense(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("value"))


def bags(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("row_id"), (F.col("l_partkey") % 600).alias("id"), F.col("l_quantity").alias("weight"))


def scores(t: Tables) -> DataFrame:
    prob = (F.col("n_chars") % 997) / 1000.0
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("label"), prob.alias("prob"))


SCORES_SQL = "scores AS (SELECT doc_id, quality AS label, (n_chars % 997) / 1000.0::DOUBLE AS prob FROM labels JOIN documents USING (doc_id))"


def reports(t: Tables) -> DataFrame:
    """Two metrics per event, in lists of unequal length for some, with a repeated tag for others."""
    index = (F.col("user_id") % 5).cast("int")
    tag = lambda m: F.concat(F.lit(f"sys/{m}/job_ps/replica_0/task_"), index.cast("string"), F.lit("/device_CPU_0"))
    second = F.when(F.col("event_id") % 50 == 0, tag("mem")).when(F.col("event_id") % 50 == 1, F.lit("sys/loss")).otherwise(tag("cpu"))
    values = F.when(F.col("event_id") % 50 == 2, F.array(F.col("value") * 20)).otherwise(F.array(F.col("value") * 20, F.col("value")))
    body = F.to_json(F.struct(F.array(tag("mem"), second).alias("MetricType"), values.alias("MetricValue")))
    return t.events.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("job_ps").alias("task_name"), index.alias("task_index"), body.alias("options"), "event_id")


REPORTS_SQL = """
tags AS (SELECT event_id, floor(epoch(ts))::BIGINT AS sec, ts, (user_id % 5)::INT AS i, value,
  'sys/mem/job_ps/replica_0/task_' || (user_id % 5) || '/device_CPU_0' AS mem,
  CASE event_id % 50 WHEN 0 THEN 'sys/mem/job_ps/replica_0/task_' || (user_id % 5) || '/device_CPU_0' WHEN 1 THEN 'sys/loss'
       ELSE 'sys/cpu/job_ps/replica_0/task_' || (user_id % 5) || '/device_CPU_0' END AS other
  FROM events),
metrics AS (SELECT event_id, sec, ts, 'job_ps#' || i AS task, mem AS type, value * 20 AS value FROM tags WHERE event_id % 50 <> 0
  UNION ALL SELECT event_id, sec, ts, 'job_ps#' || i, other, value FROM tags WHERE event_id % 50 NOT IN (0, 2))"""


def memory_samples(t: Tables) -> DataFrame:
    """Memory in MB of five servers in each of seven jobs."""
    job = F.concat(F.lit("job-"), (F.col("user_id") % 7).cast("string"))
    task = F.concat(F.lit("ps#"), (F.col("user_id") % 5).cast("string"))
    return t.events.select(job.alias("job"), task.alias("task"), F.col("ts"), F.col("event_id"), (F.col("value") * 20).alias("value"))


LIMIT = 8_000 * 1024 * 1024
MEMORY_SQL = "memory AS (SELECT 'job-' || (user_id % 7) AS job, 'ps#' || (user_id % 5) AS task, ts, event_id, value * 20 AS value FROM events)"


def ckpt_writes(t: Tables) -> DataFrame:
    """Checkpoint shards: step and arrival rise with the order's day and key; each is kept by its own holder and a copy."""
    shard = F.col("o_custkey") % 8
    holder = F.when(F.col("o_orderkey") % 3 == 0, F.pmod(shard + 1, F.lit(8))).otherwise(shard)
    arrival = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1_000_000 + F.col("o_orderkey") % 1_000_000
    return t.orders.select(holder.alias("holder"), shard.alias("shard"), (F.col("o_orderkey") % 1000).alias("step"), F.round(F.col("o_totalprice")).cast("long").alias("n_bytes"), arrival.alias("arrival"))


WRITES_SQL = """
writes AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 8 + 1) % 8 ELSE o_custkey % 8 END AS holder, o_custkey % 8 AS shard, o_orderkey % 1000 AS step,
  round(o_totalprice)::BIGINT AS n_bytes, epoch(o_orderdate)::BIGINT * 1000000 + o_orderkey % 1000000 AS arrival FROM orders),
cache AS (SELECT holder, shard, arg_max(step, arrival * 1000 + step) AS step, arg_max(n_bytes, arrival * 1000 + step) AS n_bytes FROM writes GROUP BY 1, 2)"""


def shards(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_custkey") % 8).alias("shard"), F.lit(8).cast("long").alias("num_shards")).distinct()
