"""Queries of metric reports and scaling (D)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, task_id
from ..operators import metrics as M
from ..operators import scaling as C
from . import fixtures as X
from .registry import Tables, query

SUBS = [("trainer", "sys/mem/*"), ("trainer", "*task_[0-2]*"), ("viewer", "sys/?pu/*"), ("viewer", "sys/mem/*task_[!1-4]*")]
SUBS_SQL = "(type GLOB 'sys/mem/*' OR type GLOB '*task_[0-2]*')", "(type GLOB 'sys/?pu/*' OR type GLOB 'sys/mem/*task_[!1-4]*')"
SUBSCRIBED_SQL = f"""{X.REPORTS_SQL},
sub AS (SELECT 'trainer' AS subscriber, * FROM metrics WHERE {SUBS_SQL[0]} UNION ALL SELECT 'viewer', * FROM metrics WHERE {SUBS_SQL[1]})"""


def valid(t: Tables) -> DataFrame:
    return M.reject_duplicate_tags(X.reports(t))[0]


def metrics(t: Tables) -> DataFrame:
    return M.explode_metrics(valid(t))


def subscribed(t: Tables) -> DataFrame:
    return M.subscribe(metrics(t), t.spark.createDataFrame(SUBS, "subscriber string, pattern string"))


@query(f"WITH {X.REPORTS_SQL} SELECT sec, task, type, round(value, 6) AS value FROM metrics")
def D1_explode_metrics(t: Tables) -> DataFrame:
    return metrics(t).select(epoch_seconds(F.col("ts")).alias("sec"), "task", "type", F.round("value", 6).alias("value"))


@query("SELECT event_id, event_id % 50 = 0 AS rejected FROM events")
def D2_reject_duplicate_tags(t: Tables) -> DataFrame:
    good, bad = M.reject_duplicate_tags(X.reports(t))
    return good.select("event_id", F.lit(False).alias("rejected")).unionByName(bad.select("event_id", F.lit(True).alias("rejected")))


@query("SELECT s_suppkey, 'ps#' || s_nationkey AS task FROM supplier")
def D3_task_id(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", task_id(F.lit("ps"), F.col("s_nationkey")).alias("task"))


@query(f"WITH {SUBSCRIBED_SQL} SELECT subscriber, type, count(*) AS n, round(sum(value), 4) AS total FROM sub GROUP BY 1, 2")
def D4_subscribe(t: Tables) -> DataFrame:
    return subscribed(t).groupBy("subscriber", "type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH types AS (SELECT DISTINCT p_name || '/' || p_brand AS type FROM part),
subs AS (SELECT 'c' || s_suppkey AS subscriber, CASE s_suppkey % 5 WHEN 0 THEN left(s_name, 1) || '*' WHEN 1 THEN '*d ' || s_nationkey || '*' WHEN 2 THEN '*#' || (s_nationkey % 5 + 1) || '?' WHEN 3 THEN '[a-m]*#[1-3]*' ELSE '*' || right(s_suppkey::VARCHAR, 1) || '/*' END AS pattern FROM supplier)
SELECT DISTINCT type, subscriber FROM types, subs WHERE type GLOB pattern""")
def D4_matching_types(t: Tables) -> DataFrame:
    """Patterns of all suppliers against the types of all parts, by their rarest parts."""
    nation, key = F.col("s_nationkey"), F.col("s_suppkey")
    kind = key % 5
    pattern = F.when(kind == 0, F.concat(F.substring("s_name", 1, 1), F.lit("*"))).when(kind == 1, F.concat(F.lit("*d "), nation, F.lit("*"))).when(kind == 2, F.concat(F.lit("*#"), nation % 5 + 1, F.lit("?")))
    pattern = pattern.when(kind == 3, "[a-m]*#[1-3]*").otherwise(F.concat(F.lit("*"), F.substring(key.cast("string"), -1, 1), F.lit("/*")))
    subs = t.supplier.select(F.concat(F.lit("c"), key.cast("string")).alias("subscriber"), pattern.alias("pattern"))
    return M.matching_types(t.part.select(F.concat_ws("/", "p_name", "p_brand").alias("type")).distinct(), subs)


@query(f"""WITH {SUBSCRIBED_SQL}
SELECT subscriber, type, (sec // 10 * 10)::BIGINT AS window_start, count(*) AS n, string_agg(round(value * 100)::BIGINT, ',' ORDER BY ts, value) AS values FROM sub GROUP BY 1, 2, 3""")
def D5_window_snapshot(t: Tables) -> DataFrame:
    found = M.window_snapshot(subscribed(t))
    text = F.array_join(F.transform("values", lambda x: F.round(x * 100).cast("long").cast("string")), ",")
    return found.select("subscriber", "type", F.unix_timestamp("window_start").alias("window_start"), F.size("values").cast("long").alias("n"), text.alias("values"))


@query(f"WITH {SUBSCRIBED_SQL} SELECT subscriber, type, sec, round(value, 6) AS value, row_number() OVER (PARTITION BY subscriber, type ORDER BY ts, task, value) - 1 AS seq FROM sub")
def D6_metric_sequence(t: Tables) -> DataFrame:
    found = M.metric_sequence(subscribed(t), ["ts", "task", "value"])
    return found.select("subscriber", "type", epoch_seconds(F.col("ts")).alias("sec"), F.round("value", 6).alias("value"), "seq")


@query("""SELECT 'job_ps#' || i AS task, CASE WHEN seq IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, seq, micros
FROM (SELECT DISTINCT s_nationkey AS i FROM supplier)
LEFT JOIN (SELECT (user_id % 5)::INT AS i, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts) - 1 AS seq FROM events) USING (i)""")
def D7_task_actions(t: Tables) -> DataFrame:
    asked = t.supplier.select(task_id(F.lit("job_ps"), F.col("s_nationkey")).alias("task"))
    return M.task_actions(X.reports(t), asked).select("task", "status", "seq", F.unix_micros("ts").alias("micros"))


@query(f"""WITH {X.REPORTS_SQL}
SELECT type, count(*) AS n, CASE WHEN type LIKE '%/%/%/%/%/%' THEN split_part(type, '/', 2) END AS metric, CASE WHEN type LIKE '%/%/%/%/%/%' THEN split_part(type, '/', 5) END AS task FROM metrics GROUP BY 1""")
def D8_parse_metric_tag(t: Tables) -> DataFrame:
    found = metrics(t).groupBy("type").agg(F.count("*").alias("n")).withColumn("tag", M.parse_metric_tag(F.col("type")))
    return found.select("type", "n", "tag.metric", "tag.task")


def _cpu(t: Tables) -> DataFrame:
    return t.events.select(F.concat(F.lit("ps#"), (F.col("user_id") % 20).cast("string")).alias("task"), F.date_trunc("second", "ts").alias("ts"), (F.col("event_id") * 1000).alias("cpu_ticks"))


@query("""WITH s AS (SELECT 'ps#' || (user_id % 20) AS task, epoch(date_trunc('second', ts))::BIGINT AS sec, event_id * 1000 AS ticks FROM events),
d AS (SELECT *, sec - lag(sec) OVER w AS ds, ticks - lag(ticks) OVER w AS dt FROM s WINDOW w AS (PARTITION BY task ORDER BY sec, ticks))
SELECT task, sec, ticks AS cpu_ticks, round(CASE WHEN ds > 0 THEN dt / (ds * 100) * 100 ELSE 0 END, 6) AS cpu_percent FROM d""")
def D9_cpu_usage(t: Tables) -> DataFrame:
    return M.cpu_usage(_cpu(t)).select("task", epoch_seconds(F.col("ts")).alias("sec"), "cpu_ticks", F.round("cpu_percent", 6).alias("cpu_percent"))


@query("SELECT event_id, round(event_id * 4096 / 1048576.0::DOUBLE, 6) AS mb FROM events")
def D10_rss_mb(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(M.rss_mb(F.col("event_id")), 6).alias("mb"))


@query("""WITH m AS (SELECT 'ps#' || (user_id % 20) AS task, event_id // 3 AS step, event_type, epoch_us(ts) AS us FROM events)
SELECT task, step, (max(us) FILTER (event_type IN ('click', 'view')) - max(us) FILTER (event_type IN ('signup', 'error')))::BIGINT::VARCHAR AS micros FROM m WHERE event_type <> 'purchase' GROUP BY 1, 2""")
def D11_step_duration(t: Tables) -> DataFrame:
    mark = F.when(F.col("event_type").isin("click", "view"), "end").when(F.col("event_type").isin("signup", "error"), "begin")
    task = F.concat(F.lit("ps#"), (F.col("user_id") % 20).cast("string"))
    rows = t.events.select(task.alias("task"), F.floor(F.col("event_id") / 3).alias("step"), mark.alias("mark"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return M.step_duration(rows.where("mark is not null")).withColumn("micros", F.col("micros").cast("string"))


@query("""WITH i AS (SELECT s_suppkey AS id, s_nationkey AS n, floor(s_acctbal)::BIGINT AS b FROM supplier)
SELECT id, round((greatest(b, 0) * 1000 + CASE WHEN n % 2 = 0 THEN coalesce(c, 0) * 1000000 ELSE 5000 END) / 1048576.0::DOUBLE, 6) AS total_mb
FROM i LEFT JOIN (SELECT s_nationkey AS n, count(*) AS c FROM supplier WHERE s_nationkey < 20 GROUP BY 1) USING (n)""")
def D12_resource_total(t: Tables) -> DataFrame:
    number, nation = F.greatest(F.floor("s_acctbal"), F.lit(0)) * 1000, F.col("s_nationkey")
    live = F.concat(F.lit("t"), nation.cast("string"), F.lit(":"), F.when(nation % 2 == 0, "-1").otherwise("5000"), F.lit("@"))
    listing = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("fixed:"), number.cast("string"), F.lit("@"), live).alias("listing"))
    sizes = t.supplier.where("s_nationkey < 20").groupBy(F.concat(F.lit("t"), nation.cast("string")).alias("name")).agg((F.count("*") * 1_000_000).alias("n_bytes"))
    return M.resource_total(listing, sizes).select("id", F.round("total_mb", 6).alias("total_mb"))


@query("SELECT event_id, round(growth, 6) AS growth FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY task ORDER BY ts, value) AS growth FROM (SELECT event_id, user_id AS task, ts, value FROM events))")
def D13_memory_growth(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("user_id").alias("task"), "ts", "value")
    return M.memory_growth(rows).select("event_id", F.round("growth", 6).alias("growth"))


_CLASSES = f"""{X.MEMORY_SQL},
last AS (SELECT job, task, arg_max(value, (ts, value)) * 1048576 AS memory FROM memory GROUP BY 1, 2),
classes AS (SELECT job, task, memory, CASE WHEN memory / {X.LIMIT}.0 > 0.8 AND NOT acted THEN 'oom' WHEN memory / {X.LIMIT}.0 > 0.6 AND memory / {X.LIMIT}.0 <= 0.8 AND NOT acted THEN 'up'
  WHEN memory / {X.LIMIT}.0 < 0.4 THEN 'down' ELSE 'fit' END AS class FROM (SELECT *, job = 'job-3' AND task IN ('ps#0', 'ps#1') AS acted FROM last))"""


def classes(t: Tables) -> DataFrame:
    rows = X.memory_samples(t)
    already = rows.where("job = 'job-3' and task in ('ps#0', 'ps#1')").select("job", "task").distinct()
    return C.classify_servers(rows, X.LIMIT, already)


@query(f"WITH {_CLASSES} SELECT job, task, round(memory / 1048576, 4) AS mb, class FROM classes")
def D14_classify_servers(t: Tables) -> DataFrame:
    return classes(t).select("job", "task", F.round(F.col("memory") / 1048576, 4).alias("mb"), "class")


_DECIDE = """CASE WHEN oom > 0 THEN old_n + 2 WHEN up >= old_n / 2 THEN least(CASE WHEN old_n <= 4 THEN old_n * 2 ELSE ceil(old_n * 1.2::DOUBLE) END, 100)
  WHEN down > old_n / 2 THEN CASE WHEN old_n >= 4 THEN ceil(old_n / 2) ELSE 2 END ELSE old_n END::BIGINT AS new_n,
  CASE WHEN oom > 0 OR up >= old_n / 2 THEN 'SCALING_UP' WHEN down > old_n / 2 THEN 'SCALING_DOWN' ELSE 'NORMAL' END AS action"""
_DECISIONS = f"""w AS (SELECT job, task, ts // 86400000000 AS day, arg_max(value, (ts, value)) AS mb FROM (SELECT job, task, epoch_us(ts) AS ts, value FROM memory) GROUP BY 1, 2, 3),
k AS (SELECT job, day, count(*) FILTER (mb * 1048576 / {X.LIMIT}.0 > 0.8) AS oom, count(*) FILTER (mb * 1048576 / {X.LIMIT}.0 > 0.6 AND mb * 1048576 / {X.LIMIT}.0 <= 0.8) AS up,
  count(*) FILTER (mb * 1048576 / {X.LIMIT}.0 < 0.4) AS down FROM w GROUP BY 1, 2),
n AS (SELECT 'job-' || i AS job, i + 2 AS old_n FROM range(9) r(i))"""


def _old_n(t: Tables) -> DataFrame:
    return t.spark.range(9).select(F.concat(F.lit("job-"), F.col("id").cast("string")).alias("job"), (F.col("id") + 2).alias("old_n"))


def decisions(t: Tables) -> DataFrame:
    rows = X.memory_samples(t).withColumn("day", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86_400))
    return C.scaling_decision(C.classify_servers(rows, X.LIMIT, by=("job", "day")), _old_n(t), at=("day",))


@query(f"WITH {X.MEMORY_SQL}, {_DECISIONS} SELECT job, day::BIGINT AS day, old_n, {_DECIDE} FROM n LEFT JOIN k USING (job)")
def D15_scaling_decision(t: Tables) -> DataFrame:
    return decisions(t)


def control_events(t: Tables) -> DataFrame:
    """Decisions and what the cluster reports back, one per event."""
    kind = F.when(F.col("event_type") == "signup", "acquired").when(F.col("event_type") == "error", "closed").otherwise("decision")
    action = F.when(F.col("event_type") == "click", "SCALING_UP").when(F.col("event_type") == "view", "SCALING_DOWN").otherwise("NORMAL")
    servers = F.array(F.concat(F.lit("ps#"), (F.col("event_id") % 5).cast("string")))
    return t.events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        F.floor(F.col("value") / 10).alias("new_n"), action.alias("action"), servers.alias("servers"),
    )


_DAY = 86_400


@query(f"""
WITH RECURSIVE ev AS (SELECT 'job-' || user_id AS job, event_id, epoch(ts) AS t, CASE event_type WHEN 'signup' THEN 'acquired' WHEN 'error' THEN 'closed' ELSE 'decision' END AS kind,
  CASE event_type WHEN 'click' THEN 'up' WHEN 'view' THEN 'down' ELSE 'none' END AS action, floor(value / 10)::BIGINT AS new_n, 'ps#' || (event_id % 5) AS server,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
st AS (
  SELECT DISTINCT job, 0::BIGINT AS k, -1::BIGINT AS event_id, '' AS o, 'RUNNING' AS phase, NULL::DOUBLE AS last, false AS pending, NULL::BIGINT AS target, []::VARCHAR[] AS acted FROM ev
  UNION ALL
  SELECT job, k, event_id, o, CASE o WHEN 'ACQUIRED' THEN 'SCALING' WHEN 'CLOSED' THEN 'RUNNING' WHEN 'UP' THEN 'ACQUIRE_RESOURCE' WHEN 'DOWN' THEN 'SCALING' ELSE phase END,
    CASE WHEN o IN ('CLOSED', 'DOWN', 'PENDING') THEN t ELSE last END, CASE WHEN o IN ('UP', 'DOWN') THEN false ELSE pending OR o = 'PENDING' END,
    CASE WHEN o IN ('UP', 'DOWN', 'PENDING') THEN new_n ELSE target END, CASE WHEN o = 'UP' AND NOT list_contains(acted, server) THEN list_append(acted, server) ELSE acted END
  FROM (SELECT e.*, phase, last, pending, target, acted,
    CASE WHEN kind = 'acquired' THEN CASE phase WHEN 'ACQUIRE_RESOURCE' THEN 'ACQUIRED' ELSE 'IGNORED' END WHEN kind = 'closed' THEN CASE phase WHEN 'SCALING' THEN 'CLOSED' ELSE 'IGNORED' END
         WHEN phase <> 'RUNNING' THEN 'IGNORED' WHEN t - last < {_DAY} THEN 'WAITING' WHEN action = 'up' THEN 'UP' WHEN action = 'none' THEN 'NORMAL' WHEN pending THEN 'DOWN' ELSE 'PENDING' END AS o
    FROM st JOIN ev e ON e.job = st.job AND e.k = st.k + 1))
SELECT job, event_id, CASE WHEN o IN ('UP', 'DOWN') THEN 'FIRED' ELSE o END AS outcome, phase, target, len(acted) AS n_acted FROM st WHERE k > 0""")
def D16_scaling_controller(t: Tables) -> DataFrame:
    return C.scaling_controller(control_events(t), cooldown=_DAY)


@query("""WITH u AS (SELECT 'ps#' || (user_id % 40) AS task, event_type AS status, ts, event_id FROM events UNION ALL SELECT 'worker#' || (event_id % 30), 'Running', ts, event_id FROM events WHERE event_id % 4 = 0)
SELECT task, arg_max(status, (ts, event_id)) AS status FROM u GROUP BY 1""")
def D17_latest_status(t: Tables) -> DataFrame:
    return C.latest_status(status_updates(t))


def status_updates(t: Tables) -> DataFrame:
    ps = F.create_map(F.concat(F.lit("ps#"), (F.col("user_id") % 40).cast("string")), F.col("event_type"))
    worker = F.create_map(F.concat(F.lit("worker#"), (F.col("event_id") % 30).cast("string")), F.lit("Running"))
    return t.events.select("ts", F.col("event_id").alias("update_id"), F.to_json(F.when(F.col("event_id") % 4 == 0, F.map_concat(ps, worker)).otherwise(ps)).alias("statuses"))


@query("""WITH s AS (SELECT user_id AS task, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1)
SELECT count(*) FILTER (task % 2 = 0 AND status = 'click') AS ps, count(*) FILTER (task % 2 = 1 AND status = 'click') AS workers FROM s""")
def D18_running_counts(t: Tables) -> DataFrame:
    role = F.when(F.col("user_id") % 2 == 0, "ps#").otherwise("worker#")
    status = F.when(F.col("event_type") == "click", "Running").otherwise(F.col("event_type"))
    updates = t.events.select("ts", F.col("event_id").alias("update_id"), F.to_json(F.create_map(F.concat(role, F.col("user_id").cast("string")), status)).alias("statuses"))
    return C.running_counts(C.latest_status(updates))


@query("SELECT o_custkey AS job, bool_or(o_orderstatus = 'F') OR max(o_totalprice) > 400000 AS completed FROM orders GROUP BY 1")
def D19_job_completed(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "Succeeded").otherwise("Running")
    done = F.max(F.when(F.col("o_totalprice") > 400_000, F.col("o_orderdate")))
    jobs = t.orders.groupBy(F.col("o_custkey").alias("job")).agg(F.collect_set(F.struct(kind.alias("type"), F.lit("True").alias("status"))).alias("conditions"), done.alias("completion_time"))
    return C.job_completed(jobs)


@query("""WITH f AS (SELECT event_id // 200 AS round, user_id % 40 AS worker, min(ts) AS ts FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY ts, worker) AS k FROM f)
SELECT round, epoch_us(max(ts) FILTER (k = 38))::BIGINT::VARCHAR AS released_us, count(*) AS arrived FROM r GROUP BY 1""")
def D20_barrier(t: Tables) -> DataFrame:
    rows = t.events.select(F.floor(F.col("event_id") / 200).alias("round"), (F.col("user_id") % 40).alias("worker"), "ts")
    return C.barrier(rows, 38).select("round", F.unix_micros(F.col("released_at").cast("timestamp")).cast("string").alias("released_us"), "arrived")


@query("""WITH l AS (SELECT user_id AS job, arg_max((value / 50)::BIGINT, (ts, event_id)) AS o, arg_max(event_id % 10, (ts, event_id)) AS n FROM (SELECT user_id, ts, event_id, floor(value / 50) * 50 AS value FROM events) GROUP BY 1)
SELECT job, CASE WHEN n > o THEN 'SCALING_UP' WHEN n < o THEN 'SCALING_DOWN' ELSE 'NORMAL' END AS action, n AS target FROM l""")
def D21_scaling_state(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("job"), F.floor(F.col("value") / 50).alias("old_n"), (F.col("event_id") % 10).alias("new_n"), "ts", F.col("event_id").alias("update_id"))
    return C.scaling_state(rows)


_FIRES = """WITH RECURSIVE e AS ({rows}), f AS (
  SELECT task, min(x) AS x FROM e GROUP BY 1 UNION ALL SELECT f.task, min(e.x) FROM f JOIN e ON e.task = f.task AND e.x >= f.x + {n} GROUP BY 1)
SELECT task, x AS {name} FROM f"""


@query(_FIRES.format(rows="SELECT user_id AS task, event_id AS x FROM events", n=500, name="step"))
def D22_every_n_steps(t: Tables) -> DataFrame:
    return C.every_n_steps(t.events.select(F.col("user_id").alias("task"), F.col("event_id").alias("step")), 500)


@query(_FIRES.format(rows="SELECT CASE WHEN user_id % 3 > 0 THEN 'hot' ELSE 'task-' || user_id END AS task, event_id AS x FROM events", n=7, name="step"))
def D22_every_n_steps_hot(t: Tables) -> DataFrame:
    """Two thirds of all rows under one task, cut into parts."""
    task = F.when(F.col("user_id") % 3 > 0, "hot").otherwise(F.concat(F.lit("task-"), F.col("user_id").cast("string")))
    return C.every_n_steps(t.events.select(task.alias("task"), F.col("event_id").alias("step")), 7, most=500)


@query(_FIRES.format(rows="SELECT user_id AS task, epoch_us(ts) AS x FROM events", n=_DAY * 1_000_000, name="us"))
def D22_every_n_secs(t: Tables) -> DataFrame:
    return C.every_n_secs(t.events.select(F.col("user_id").alias("task"), "ts"), _DAY).select("task", F.unix_micros("ts").alias("us"))


@query("""WITH w AS (SELECT s_suppkey AS job, 'ps' AS role, s_nationkey % 4 AS n FROM supplier UNION ALL SELECT s_suppkey, 'worker', s_nationkey % 7 FROM supplier
  UNION ALL SELECT s_suppkey, 'master', 1 FROM supplier UNION ALL SELECT s_suppkey, 'evaluator', (s_suppkey % 2)::INT FROM supplier),
t AS (SELECT job, role || '#' || unnest(range(n)) AS task FROM w)
SELECT job, task FROM t WHERE NOT (task LIKE 'ps#%' AND job % 3 = 0) AND NOT (task = 'master#0' AND job % 5 = 0)""")
def D23_missing_tasks(t: Tables) -> DataFrame:
    nation, key = F.col("s_nationkey"), F.col("s_suppkey")
    specs = t.supplier.select(key.alias("job"), (nation % 4).alias("ps"), F.lit(1).alias("master"), (nation % 7).alias("worker"), F.lit(0).alias("chief"), (key % 2).alias("evaluator"))
    ps = t.supplier.where("s_suppkey % 3 = 0").select(key.alias("job"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("job", F.concat(F.lit("ps#"), F.col("i").cast("string")).alias("task"))
    master = t.supplier.where("s_suppkey % 5 = 0").select(key.alias("job"), F.lit("master#0").alias("task"))
    return C.missing_tasks(specs, ps.unionByName(master))


@query("""WITH m AS (SELECT max(event_id) // 2 AS h FROM events),
b AS (SELECT user_id AS task, max(event_id) // 400 AS uid FROM events, m WHERE event_id < h AND event_type = 'click' GROUP BY 1),
a AS (SELECT user_id AS task, max(event_id) // 4000 AS uid FROM events, m WHERE event_id >= h AND event_type = 'error' GROUP BY 1)
SELECT task, CASE WHEN b.uid IS NULL THEN 'added' WHEN a.uid IS NULL THEN 'deleted' WHEN a.uid <> b.uid THEN 'replaced' ELSE 'running' END AS change FROM b FULL JOIN a USING (task)""")
def D24_task_changes(t: Tables) -> DataFrame:
    middle = t.events.agg(F.floor(F.max("event_id") / 2).alias("h"))  # one row
    rows = t.events.join(F.broadcast(middle), F.lit(True))
    before = rows.where("event_id < h and event_type = 'click'").groupBy(F.col("user_id").alias("task")).agg(F.floor(F.max("event_id") / 400).alias("uid"))
    after = rows.where("event_id >= h and event_type = 'error'").groupBy(F.col("user_id").alias("task")).agg(F.floor(F.max("event_id") / 4000).alias("uid"))
    return C.task_changes(before, after)


@query("""WITH u AS (SELECT 'task-' || user_id AS task, epoch_us(ts) AS t, (event_id // 3000)::VARCHAR AS uid FROM events),
b AS (SELECT *, lag(t) OVER w AS bt, lag(uid) OVER w AS bu FROM u WINDOW w AS (PARTITION BY task ORDER BY t, uid)),
l AS (SELECT task, max(t) AS t, arg_max(uid, (t, uid)) AS uid, (SELECT max(t) FROM u) AS last FROM u GROUP BY 1),
x AS (SELECT task, t AS micros, CASE WHEN bt IS NULL THEN 'added' WHEN bu <> uid THEN 'replaced' WHEN t - bt > 86400000000 THEN 'returned' END AS change, uid FROM b
  UNION ALL SELECT task, bt + 86400000000, 'lost', bu FROM b WHERE t - bt > 86400000000 UNION ALL SELECT task, t + 86400000000, 'lost', uid FROM l WHERE last - t > 86400000000)
SELECT * FROM x WHERE change IS NOT NULL""")
def D24_task_presence(t: Tables) -> DataFrame:
    return C.task_presence(t.events.select(F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task"), "ts", F.floor(F.col("event_id") / 3000).alias("uid")), _DAY)


@query(f"""WITH {X.REPORTS_SQL},
s AS (SELECT sec // 86400 AS day, split_part(type, '/', 5) AS task, arg_max(value, (ts, value)) AS mb FROM metrics WHERE type LIKE 'sys/mem/job_ps/%/%/%' GROUP BY 1, 2),
k AS (SELECT day, count(*) FILTER (mb * 1048576 / {X.LIMIT}.0 > 0.8) AS oom, count(*) FILTER (mb * 1048576 / {X.LIMIT}.0 > 0.6 AND mb * 1048576 / {X.LIMIT}.0 <= 0.8) AS up,
  count(*) FILTER (mb * 1048576 / {X.LIMIT}.0 < 0.4) AS down FROM s GROUP BY 1), n AS (SELECT 5::BIGINT AS old_n)
SELECT 'job_ps' AS job, day::BIGINT AS day, old_n, {_DECIDE} FROM k, n""")
def flagship_metric_to_decision(t: Tables) -> DataFrame:
    """Reports, checked and unfolded, their memory tags parsed, per day the servers' classes and the decision."""
    found = metrics(t).select("ts", "value", M.parse_metric_tag(F.col("type")).alias("tag")).where("tag.metric = 'mem' and tag.job = 'job_ps'")
    rows = found.select(F.col("tag.job").alias("job"), F.col("tag.task").alias("task"), F.floor(F.unix_timestamp("ts") / 86_400).alias("day"), "ts", "value")
    servers = t.spark.range(1).select(F.lit("job_ps").alias("job"), F.lit(5).cast("long").alias("old_n"))
    return C.scaling_decision(C.classify_servers(rows, X.LIMIT, by=("job", "day")), servers, at=("day",))
