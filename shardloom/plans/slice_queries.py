"""Queries of sources, slicing and epoch planning (A)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..operators import slices as S
from ..sources import readers
from . import fixtures as X
from .registry import Tables, query

#: Seconds that a request waits for a closed queue.
PATIENCE = 1_800


@query(f"""
WITH {X.SLICES_SQL},
m AS (SELECT slice_id, prefix, names, CASE slice_id % 5 WHEN 1 THEN NULL WHEN 3 THEN size + 1 ELSE size END AS n, slice_id % 5 = 2 AS lost FROM slices)
SELECT slice_id::VARCHAR AS manifest, CASE WHEN n IS NULL THEN 'no FileCount' WHEN len(names) <> n THEN 'count differs' WHEN lost THEN 'files missing' ELSE 'ok' END AS status,
       CASE WHEN lost THEN len(names) ELSE 0 END::BIGINT AS missing_files FROM m""")
def A3_check_manifests(t: Tables) -> DataFrame:
    listing = X.files(t)
    kind = F.col("slice_id") % 5
    count = F.when(kind == 1, F.lit(None)).when(kind == 3, F.col("size") + 1).otherwise(F.col("size")).cast("long")
    folder = F.when(kind == 2, "elsewhere").otherwise(F.col("prefix"))
    manifests = X.slices(t).select(F.col("slice_id").cast("string").alias("manifest"), count.alias("FileCount"), folder.alias("FileDir"), F.col("names").alias("FileList"))
    return readers.check_manifests(manifests, listing)


@query(f"WITH {X.SLICES_SQL} SELECT slice_id, prefix, size, names[1] AS first_name, md5(array_to_string(names, ',')) AS names_md5 FROM slices")
def A12_make_slices(t: Tables) -> DataFrame:
    return X.slices(t).select("slice_id", "prefix", "size", F.col("names")[0].alias("first_name"), F.md5(F.array_join("names", ",")).alias("names_md5"))


@query(f"""
WITH {X.SLICES_SQL}, wanted AS (SELECT DISTINCT o_custkey AS slice_id FROM orders)
SELECT slice_id, prefix, coalesce(size, -1) AS size FROM wanted LEFT JOIN slices USING (slice_id)""")
def A13_slice_catalog(t: Tables) -> DataFrame:
    return S.slice_catalog(X.slices(t), t.orders.select(F.col("o_custkey").alias("slice_id")))


@query(f"WITH {X.SLICES_SQL} SELECT slice_id, unnest(range(len(names)))::INT AS position, prefix || '/' || unnest(names) AS path FROM slices")
def A14_slice_files(t: Tables) -> DataFrame:
    return S.slice_files(X.slices(t).withColumn("prefix", F.concat("prefix", F.lit("/ "))))


@query(f"WITH {X.PLAN_SQL} SELECT pos, epoch::INT AS epoch, idx, slice_id FROM plan")
def A15_expand_epochs(t: Tables) -> DataFrame:
    return X.plan(t)


@query(f"WITH {X.SHUFFLED_SQL} SELECT pos, epoch::INT AS epoch, seed, idx, slice_id FROM shuffled")
def A16_shuffle_epochs(t: Tables) -> DataFrame:
    return X.shuffled(t)


@query(f"WITH {X.SHUFFLED_SQL} SELECT pos, epoch::INT AS epoch, idx, slice_id FROM shuffled WHERE epoch > 1 OR (epoch = 1 AND idx >= 17)")
def A17_resume_plan(t: Tables) -> DataFrame:
    return S.resume_plan(X.shuffled(t), 1, 17).select("pos", "epoch", "idx", "slice_id")


@query(f"""
WITH {X.SHUFFLED_SQL}, nxt AS (SELECT max(pos) + 1 AS pos FROM plan WHERE epoch < 2 AND slice_id % 7 = 3)
SELECT coalesce(epoch, 3)::BIGINT AS epoch_index, coalesce(idx, 0)::BIGINT AS slice_index, coalesce(seed, 0) AS shuffle_seed FROM nxt LEFT JOIN shuffled USING (pos)""")
def A18_data_state(t: Tables) -> DataFrame:
    return S.data_state(X.plan(t).where("epoch < 2 and slice_id % 7 = 3"), X.shuffled(t))


def _states(t: Tables) -> DataFrame:
    """A saved state for each event of a user: some repeat the one before."""
    return t.events.select(
        F.concat(F.lit("config-"), (F.col("user_id") % 11).cast("string")).alias("config_name"), (F.col("event_id") % 3).alias("epoch_index"),
        F.floor(F.col("value") / 200).alias("slice_index"), F.lit(7).cast("long").alias("shuffle_seed"), (epoch_seconds(F.col("ts")) * 1_000_000 + F.col("event_id")).alias("saved_at"),
    )


_STATES_SQL = """states AS (SELECT 'config-' || (user_id % 11) AS config_name, event_id % 3 AS epoch_index, floor(value / 200)::BIGINT AS slice_index, 7::BIGINT AS shuffle_seed,
  epoch(date_trunc('second', ts))::BIGINT * 1000000 + event_id AS saved_at FROM events)"""


@query(f"""
WITH {_STATES_SQL}, d AS (SELECT *, lag((epoch_index, slice_index, shuffle_seed)) OVER (PARTITION BY config_name ORDER BY saved_at) AS p FROM states)
SELECT config_name, epoch_index, slice_index, shuffle_seed, saved_at FROM d WHERE p IS NULL OR p <> (epoch_index, slice_index, shuffle_seed)""")
def A19_state_changes(t: Tables) -> DataFrame:
    return S.state_changes(_states(t), ["epoch_index", "slice_index", "shuffle_seed"])


@query(f"""
WITH {_STATES_SQL}, configs AS (SELECT 'config-' || s_suppkey AS config_name, s_suppkey * 10 AS seed FROM supplier),
l AS (SELECT config_name, arg_max(epoch_index, saved_at) AS e, arg_max(slice_index, saved_at) AS s, arg_max(shuffle_seed, saved_at) AS k FROM states GROUP BY 1)
SELECT config_name, coalesce(e, 0)::BIGINT AS epoch_index, coalesce(s, 0)::BIGINT AS slice_index, coalesce(k, seed) AS shuffle_seed, e IS NOT NULL AS restored FROM configs LEFT JOIN l USING (config_name)""")
def A20_restore_state(t: Tables) -> DataFrame:
    configs = t.supplier.select(F.concat(F.lit("config-"), F.col("s_suppkey").cast("string")).alias("config_name"), (F.col("s_suppkey") * 10).alias("seed"))
    return S.restore_state(_states(t), configs)


@query(f"""
WITH {X.SHUFFLED_SQL}, {X.REQUESTS_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY ts, task, request_id) - 1 AS k FROM requests)
SELECT request_id, task, pos, slice_id FROM r JOIN shuffled ON k = pos""")
def A21_assign_slices(t: Tables) -> DataFrame:
    return S.assign_slices(X.shuffled(t), X.requests(t))


@query(f"""
WITH {X.SHUFFLED_SQL}, {X.REQUESTS_SQL}, {X.CONTROL_SQL},
u AS (SELECT ts, 0 AS is_request, control_id AS id, action, NULL AS task FROM control UNION ALL SELECT ts, 1, request_id, NULL, task FROM requests),
g AS (SELECT *, last_value(action IGNORE NULLS) OVER (ORDER BY ts, is_request, id) AS gate FROM u),
o AS (SELECT id AS request_id, task, row_number() OVER (ORDER BY ts, task, id) - 1 AS k FROM g WHERE is_request = 1 AND gate = 'start')
SELECT g.id AS request_id, g.task, CASE WHEN gate IS NULL THEN 'UNAVAILABLE' WHEN gate = 'stop' THEN 'RETRY_LATER' WHEN slice_id IS NULL THEN 'OUT_OF_RANGE' ELSE 'OK' END AS status, slice_id
FROM g LEFT JOIN o ON g.id = o.request_id LEFT JOIN shuffled ON k = pos WHERE is_request = 1""")
def A22_dispatch_outcomes(t: Tables) -> DataFrame:
    return S.dispatch_outcomes(X.requests(t), X.control(t), X.shuffled(t))


@query(f"""
WITH {X.SHUFFLED_SQL}, {X.REQUESTS_SQL}, {X.CONTROL_SQL},
u AS (SELECT ts, 0 AS is_request, control_id AS id, action, NULL AS task FROM control UNION ALL SELECT ts, 1, request_id, NULL, task FROM requests),
g AS (SELECT *, last_value(action IGNORE NULLS) OVER (ORDER BY ts, is_request, id) AS gate,
      min(CASE WHEN action = 'start' THEN ts END) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS opened FROM u),
w AS (SELECT id AS request_id, task, ts, gate, CASE WHEN gate = 'start' THEN ts WHEN gate = 'stop' AND opened - ts <= INTERVAL {PATIENCE} SECOND THEN opened END AS since FROM g WHERE is_request = 1),
o AS (SELECT request_id, row_number() OVER (ORDER BY since, ts, task, request_id) - 1 AS k FROM w WHERE since IS NOT NULL)
SELECT w.request_id, w.task, CASE WHEN gate IS NULL THEN 'UNAVAILABLE' WHEN since IS NULL THEN 'RETRY_LATER' WHEN slice_id IS NULL THEN 'OUT_OF_RANGE' ELSE 'OK' END AS status, slice_id
FROM w LEFT JOIN o USING (request_id) LEFT JOIN shuffled ON k = pos""")
def A22_dispatch_waiting(t: Tables) -> DataFrame:
    return S.dispatch_outcomes(X.requests(t), X.control(t), X.shuffled(t), PATIENCE)


@query(f"""
WITH {X.SHUFFLED_SQL}, {X.REQUESTS_SQL},
r AS (SELECT task, row_number() OVER (ORDER BY ts, task, request_id) - 1 AS k FROM requests)
SELECT epoch::INT AS epoch, count(*) AS total, count(task) AS processed, count(*) - count(task) AS remaining, count(DISTINCT task) AS tasks
FROM shuffled LEFT JOIN r ON k = pos GROUP BY epoch""")
def A23_consumption_progress(t: Tables) -> DataFrame:
    plan = X.shuffled(t)
    return S.consumption_progress(plan, S.assign_slices(plan, X.requests(t)))
