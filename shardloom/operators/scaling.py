"""From metrics to scaling decisions, and the states around them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import indexing, tables

#: Shares of the memory limit, and the most servers that a scale-up asks for.
OOM, HIGH, LOW, MOST_SERVERS = 0.8, 0.6, 0.4, 100
JOB = "job_ps"
ROLES = ("ps", "master", "worker", "chief", "evaluator")


def classify_servers(snapshot: DataFrame, limit: int, already: DataFrame | None = None, by: tuple[str, ...] = ("job",)) -> DataFrame:
    """A row per server (by, task) with its last memory value in bytes and its class.

    ``snapshot``: by, task, ts, value (MB).  Over 80 % of the limit is oom, over 60 % up,
    under 40 % down.  Servers in ``already`` (by, task) are neither oom nor up, but may be down.
    """
    last = snapshot.groupBy(*by, "task").agg((F.max_by("value", F.struct("ts", "value")) * 1024 * 1024).alias("memory"))
    if already is not None:
        last = last.join(already.select(*by, "task", F.lit(True).alias("acted")), [*by, "task"], "left").withColumn("acted", F.coalesce("acted", F.lit(False)))
    else:
        last = last.withColumn("acted", F.lit(False))
    share = F.col("memory") / F.lit(float(limit))
    kind = F.when((share > OOM) & ~F.col("acted"), "oom").when((share > HIGH) & (share <= OOM) & ~F.col("acted"), "up").when(share < LOW, "down").otherwise("fit")
    return last.select(*by, "task", "memory", kind.alias("class"))


def scaling_decision(classes: DataFrame, old_n: DataFrame, by: tuple[str, ...] = ("job",), at: tuple[str, ...] = ()) -> DataFrame:
    """New server count and action per job (and window ``at``): by, at, old_n, new_n, action.

    ``old_n``: by, old_n.  In this order: any oom adds two servers, without a cap; at least half
    up doubles the count up to four servers and adds a fifth beyond, capped at ``MOST_SERVERS``;
    more than half down halves the count (to two below four servers).  Otherwise, or without
    metrics, nothing changes.
    """
    count = lambda c: F.sum(F.when(F.col("class") == c, 1).otherwise(0))
    sums = classes.groupBy(*by, *at).agg(count("oom").alias("oom"), count("up").alias("up"), count("down").alias("down"))
    rows = old_n.join(sums, list(by), "left")
    n = F.col("old_n")
    up, down = F.col("up") >= n / 2, F.col("down") > n / 2
    grown = F.least(F.when(n <= 4, n * 2).otherwise(F.ceil(n * 1.2)), F.lit(MOST_SERVERS))
    shrunk = F.when(n >= 4, F.ceil(n / 2)).otherwise(2)
    new_n = F.when(F.col("oom") > 0, n + 2).when(up, grown).when(down, shrunk).otherwise(n).cast("long")
    action = F.when((F.col("oom") > 0) | up, "SCALING_UP").when(down, "SCALING_DOWN").otherwise("NORMAL")
    return rows.select(*by, *at, "old_n", new_n.alias("new_n"), action.alias("action"))


@dataclass
class Controller:
    """The state of one job: phase, seconds of the last scaling, whether a scale-down is pending, servers acted on."""

    phase: str = "RUNNING"
    last: float | None = None
    pending_down: bool = False
    target: int | None = None
    acted: frozenset[str] = frozenset()

    def step(self, kind: str, ts: float, new_n: int | None, action: str | None, servers: tuple[str, ...], cooldown: float, clear_flag: bool) -> str:
        """Takes one event and says what came of it: IGNORED, WAITING, NORMAL, PENDING, FIRED, ACQUIRED or CLOSED.

        A decision counts while RUNNING and outside the cool-down.  An up decision fires at
        once and waits for resources; a down decision fires if the one before was down too.
        ``clear_flag=False`` keeps the pending flag after it fired.
        """
        if kind == "acquired":
            if self.phase != "ACQUIRE_RESOURCE":
                return "IGNORED"
            self.phase = "SCALING"
            return "ACQUIRED"
        if kind == "closed":
            if self.phase != "SCALING":
                return "IGNORED"
            self.phase, self.last = "RUNNING", ts
            return "CLOSED"
        if self.phase != "RUNNING":
            return "IGNORED"
        if self.last is not None and ts - self.last < cooldown:
            return "WAITING"
        if action == "SCALING_UP":
            self.phase, self.target, self.pending_down = "ACQUIRE_RESOURCE", new_n, False
            self.acted |= frozenset(servers)
            return "FIRED"
        if action == "SCALING_DOWN":
            self.last, self.target = ts, new_n
            if self.pending_down:
                self.phase, self.pending_down = "SCALING", not clear_flag
                return "FIRED"
            self.pending_down = True
            return "PENDING"
        return "NORMAL"


CONTROL_SCHEMA = "job string, event_id long, outcome string, phase string, target long, n_acted long"


def control(state: Controller, rows: pd.DataFrame, cooldown: float, clear_flag: bool) -> pd.DataFrame:
    """Feeds events (job, event_id, ts, kind, new_n, action, servers) of one job, sorted here, to its state."""
    out = []
    rows = rows.sort_values(["ts", "event_id"], kind="stable")
    for r in rows.itertuples(index=False):
        new_n = None if pd.isna(r.new_n) else int(r.new_n)
        servers = tuple(r.servers) if r.servers is not None else ()
        outcome = state.step(r.kind, r.ts.timestamp(), new_n, r.action, servers, cooldown, clear_flag)
        out.append((r.job, r.event_id, outcome, state.phase, state.target, len(state.acted)))
    found = pd.DataFrame(out, columns=["job", "event_id", "outcome", "phase", "target", "n_acted"])
    return found.astype({"target": "Int64"})


def scaling_controller(events: DataFrame, cooldown: float = 300, clear_flag: bool = True) -> DataFrame:
    """What comes of each job's events (see ``control``): sequential inside a job, parallel over jobs.

    Events come sorted, batch by batch, and only the job's state is carried on: a job's history is never in memory at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            for job, rows in batch.groupby("job", sort=False, dropna=False):
                state = state if state is not None and _same(job, last) else Controller()
                last = job
                out.append(control(state, rows, cooldown, clear_flag))
            if out:
                yield pd.concat(out)

    return events.repartition("job").sortWithinPartitions("job", "ts", "event_id").mapInPandas(run, CONTROL_SCHEMA)


def _same(a: object, b: object) -> bool:
    """Equal, or both missing."""
    return a == b or bool(pd.isna(a) and pd.isna(b))


def latest_status(updates: DataFrame) -> DataFrame:
    """The last status of each task from JSON maps of task to status (ts, update_id, statuses): task, status."""
    cells = updates.select("ts", "update_id", F.explode(F.from_json("statuses", "map<string,string>")).alias("task", "status"))
    return cells.groupBy("task").agg(F.max_by("status", F.struct("ts", "update_id")).alias("status"))


def running_counts(status: DataFrame) -> DataFrame:
    """Running ``ps#`` and ``worker#`` tasks."""
    running = lambda role: F.count(F.when(F.col("task").startswith(f"{role}#") & (F.col("status") == "Running"), 1))
    return status.agg(running("ps").alias("ps"), running("worker").alias("workers"))


def job_completed(jobs: DataFrame) -> DataFrame:
    """Jobs (job, conditions array of (type, status), completion_time) with ``completed``: a Succeeded condition or a completion time."""
    done = F.exists(F.coalesce("conditions", F.expr("cast(array() as array<struct<type:string,status:string>>)")), lambda c: c["type"] == "Succeeded")
    return jobs.select("job", (F.coalesce(done, F.lit(False)) | F.col("completion_time").isNotNull()).alias("completed"))


def barrier(arrivals: DataFrame, expected: int) -> DataFrame:
    """When the ``expected``-th distinct worker arrived in each round (round, worker, ts); null while waiting."""
    first = arrivals.groupBy("round", "worker").agg(F.min("ts").alias("ts"))
    order = Window.partitionBy("round").orderBy("ts", "worker")  # over the workers of a round
    ranked = first.withColumn("__nth", F.row_number().over(order))
    return ranked.groupBy("round").agg(F.max(F.when(F.col("__nth") == expected, F.col("ts"))).alias("released_at"), F.count("*").alias("arrived"))


def scaling_state(updates: DataFrame) -> DataFrame:
    """Per job the pending action from its newest (old_n, new_n) record: job, action, target."""
    last = updates.groupBy("job").agg(F.max_by(F.struct("old_n", "new_n"), F.struct("ts", "update_id")).alias("s"))
    action = F.when(F.col("s.new_n") > F.col("s.old_n"), "SCALING_UP").when(F.col("s.new_n") < F.col("s.old_n"), "SCALING_DOWN").otherwise("NORMAL")
    return last.select("job", action.alias("action"), F.col("s.new_n").alias("target"))


def firings(values: list, n: float, last: float | None) -> tuple[list[bool], float | None]:
    """For the sorted ``values`` whether a check fires, and the last firing; a null fires nothing."""
    fired = []
    for x in values:
        fired.append(x is not None and (last is None or x >= last + n))
        last = x if fired[-1] else last
    return fired, last


def every_n_steps(rows: DataFrame, n: float, by: str = "task", value: str = "step", most: int | None = None) -> DataFrame:
    """The rows (by, value) at which a check fires: a task's first, then each first one at least ``n`` after the last firing.

    Null values fire nothing; with ``n`` of 0 or less all others do.  Tasks of up to ``most`` rows (``BUCKET_ROWS``
    of ``indexing``) are read sorted, batch by batch, only the last firing being carried on; if any has more, all are
    cut into parts (``_firings_of_parts``).
    """
    rows = rows.select(by, value).where(F.col(value).isNotNull())
    if n <= 0:
        return rows
    if isinstance(rows.schema[value].dataType, IntegralType):
        n = math.ceil(n)
    largest, total = indexing.largest_group(rows, (by,))
    if largest > (most or indexing.BUCKET_ROWS):
        return _firings_of_parts(rows, n, by, value, total, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:  # sorted
            tasks, kept = batch.column(0).to_pylist(), []
            cuts = [i for i in range(len(tasks)) if tasks[i] != (tasks[i - 1] if i else key)]
            for low, high in zip([0, *cuts], [*cuts, len(tasks)], strict=True):
                last = None if low in cuts else last
                fired, last = firings(batch.column(1).slice(low, high - low).to_pylist(), n, last)
                kept += fired
            key = tasks[-1] if tasks else key
            yield batch.filter(pa.array(kept, pa.bool_()))

    return rows.repartition(by).sortWithinPartitions(by, value).mapInArrow(run, rows.schema)


def _firings_of_parts(rows: DataFrame, n: float, by: str, value: str, total: int, most: int | None) -> DataFrame:
    """``every_n_steps`` with no pass over a whole task, by pointer doubling.

    Rows are cut at split points.  In a part each row has a next firing, and so a last one in the part.  A
    firing chain can enter a part only at rows less than ``n`` after its first, or at the next one: each of
    them points to where the chain goes on in a later part, found by one lookup over all of them.  Then the chains are
    followed from the tasks' first rows with pointers over 1, 2, 4, ... parts, in as many joins as that takes, and
    each part fires from its entry.
    """
    kind = rows.schema[value].dataType.simpleString()
    task = rows.schema[by].dataType.simpleString()
    cut = indexing.parted(rows.distinct(), (by,), [F.col(value)], total, most)  # of equal rows one can fire

    def onwards(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(values, values + n)

    def ways(part: pa.Table) -> pa.Table:
        v = np.unique(np.asarray(part.column(value)))
        last = np.arange(len(v))
        following = onwards(v)
        following = np.where(following < len(v), following, last)
        while (following != last).any():
            last, following = following, following[following]
        stop = int(np.searchsorted(v, v[0] + n)) + 1
        where = part.column("__key")[0].as_py()["__part"]
        m = min(stop, len(v))
        return pa.table({by: pa.array([part.column(by)[0].as_py()] * m, part.schema.field(by).type), "__part": np.full(m, where), "v": v[:m], "left": v[last[:m]]})

    def walk(part: pa.Table, entry: pa.Table) -> pa.Table:
        v, fired = np.unique(np.asarray(part.column(value))), []
        if entry.num_rows:
            following, i = onwards(v).tolist(), int(np.searchsorted(v, entry.column("v")[0].as_py()))
            while i < len(v):
                fired.append(i)
                i = following[i]
        name = part.column(by)[0].as_py() if part.num_rows else None
        return pa.table({by: pa.array([name] * len(fired), part.schema.field(by).type), value: pa.array(v[fired] if fired else [], part.schema.field(value).type)})

    ways_in = tables.written(cut.groupBy("__key").applyInArrow(ways, f"`{by}` {task}, __part long, v {kind}, left {kind}"), "ways")
    asked = ways_in.select(by, "v", (-(F.col("left") + n)).alias("__at"))
    ahead = indexing.as_of(asked, ways_in.select(by, (-F.col("v")).alias("__at"), F.col("v").alias("__to")), "__to", "to", "__at", (by,))
    jumps = tables.written(ahead.where("to is not null").select(F.col(by).alias("k"), "v", "to"), "jumps")
    reached = ways_in.groupBy(by).agg(F.min("v").alias("v"))
    while jumps.limit(1).count():
        same = F.col(by).eqNullSafe(F.col("k")) & (F.col("v") == F.col("at"))
        further = reached.join(jumps.select("k", F.col("v").alias("at"), "to"), same).select(by, F.col("to").alias("v"))
        reached = tables.written(reached.unionByName(further), "reached")
        twice = jumps.alias("a").join(jumps.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.to") == F.col("b.v")))
        jumps = tables.written(twice.select("a.k", "a.v", "b.to"), "jumps")
    at = ways_in.select(F.struct(by, "__part").alias("__key"), F.col(by).alias("k"), F.col("v").alias("at"))
    entries = reached.join(at, F.col(by).eqNullSafe(F.col("k")) & (F.col("v") == F.col("at"))).select("__key", "v")
    return cut.groupBy("__key").cogroup(entries.groupBy("__key")).applyInArrow(walk, rows.schema)


def every_n_secs(rows: DataFrame, seconds: float, by: str = "task", time: str = "ts", most: int | None = None) -> DataFrame:
    """The same by time, to the microsecond."""
    timed = rows.select(by, F.unix_micros(F.col(time).cast("timestamp")).alias("__at"))
    return every_n_steps(timed, seconds * 1_000_000, by, "__at", most).select(by, F.timestamp_micros("__at").alias(time))


def missing_tasks(specs: DataFrame, status: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """Expected tasks ``role#0..replicas-1`` of each job (job, a column per role) without a status row (job, task)."""
    wanted = specs.select("job", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).cast("int").alias("n")) for r in roles))).alias("x")).where("x.n > 0")
    tasks = wanted.select("job", "x.role", F.explode(F.sequence(F.lit(0), F.col("x.n") - 1)).alias("i"))
    named = tasks.select("job", F.concat_ws("#", "role", F.col("i").cast("string")).alias("task"))
    return named.join(status.select("job", "task"), ["job", "task"], "left_anti")


def task_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per task between two snapshots (task, uid): added, running, deleted or replaced."""
    both = before.select("task", F.col("uid").alias("old")).join(after.select("task", F.col("uid").alias("new")), "task", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "replaced").otherwise("running")
    return both.select("task", change.alias("change"))


PRESENCE = "task string, micros long, change string, uid string"


def task_presence(updates: DataFrame, patience: float, until: int | None = None) -> DataFrame:
    """What becomes of tasks over time, from their statuses (task, ts, uid): task, micros, change, uid.

    ``added`` at a task's first status, ``lost`` once it has been silent for ``patience`` seconds (at that time, with the
    last uid), then ``returned`` at its next status; ``replaced`` where the uid is another one.  Statuses of one time stand by
    uid, a null uid is the empty text.  Silence after a task's last status counts up to ``until`` (microseconds), by default the last time of all.
    """
    span = int(patience * 1_000_000)
    rows = updates.select(F.col("task").cast("string").alias("task"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.coalesce(F.col("uid").cast("string"), F.lit("")).alias("uid")).where("task is not null and micros is not null")
    rows = indexing.row_before(rows, F.struct("micros", "uid"), ("micros", "uid"), "__before", ("task",))
    before = F.col("__before.value")
    silent = F.col("micros") - before["micros"] > span
    row = lambda at, change, uid: F.struct(at.alias("micros"), F.lit(change).alias("change"), uid.alias("uid"))
    now = F.when(before.isNull(), row(F.col("micros"), "added", F.col("uid"))).when(before["uid"] != F.col("uid"), row(F.col("micros"), "replaced", F.col("uid"))).when(silent, row(F.col("micros"), "returned", F.col("uid")))
    inside = rows.select("task", F.explode(F.array_compact(F.array(F.when(silent, row(before["micros"] + span, "lost", before["uid"])), now))).alias("x")).select("task", "x.*")
    last = rows.groupBy("task").agg(F.max(F.struct("micros", "uid")).alias("last"))
    if until is None:
        until = last.agg(F.max("last.micros")).first()[0] or 0
    ends = last.where(F.lit(until) - F.col("last.micros") > span).select("task", (F.col("last.micros") + span).alias("micros"), F.lit("lost").alias("change"), F.col("last.uid").alias("uid"))
    return inside.unionByName(ends)
