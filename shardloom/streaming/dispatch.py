"""Handing out slices on a stream: a queue per job that keeps requests waiting while it is closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.slices import OPEN

ANSWERS = "job string, request_id long, task string, status string, rank long"


class DispatchProcessor(StatefulProcessor):
    """Per job: the last action, the number of slices asked for so far, and the requests that wait."""

    def __init__(self, patience: float | None):
        self.patience = None if patience is None else int(patience * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queue", "gate string, asked long")
        self.waiting = handle.getListState("waiting", "micros long, task string, request_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        gate, asked = self.state.get() if self.state.exists() else (None, 0)
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        before, out = list(waiting), []
        events = pd.concat(list(rows))
        order = sorted(zip(events["micros"], events["action"].notna(), events["task"].fillna(""), events["id"], events["action"], strict=True), key=lambda e: (e[0], not e[1], e[2], e[3]))
        for micros, is_control, task, ident, action in order:
            waiting = self._given_up(waiting, micros, out)
            if not is_control:
                if gate is None:
                    out.append((ident, task, "UNAVAILABLE", None))
                elif gate in OPEN:
                    out.append((ident, task, "OK", asked))
                    asked += 1
                elif self.patience is None:
                    out.append((ident, task, "RETRY_LATER", None))
                else:
                    waiting.append((micros, task, ident))
                continue
            gate = action
            if gate in OPEN:
                for _, waiter, request in sorted(waiting):
                    out.append((request, waiter, "OK", asked))
                    asked += 1
                waiting = []
        self.state.update((gate, asked))
        if waiting != before:
            self._keep(waiting)
        yield self._answers(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out, waiting = [], list(self.waiting.get()) if self.waiting.exists() else []
        left = self._given_up(waiting, expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        if len(left) < len(waiting):
            self._keep(left)
        yield self._answers(key, out)

    def _given_up(self, waiting: list[tuple], now: int, out: list[tuple]) -> list[tuple]:
        """Those who still wait; the others are told to come again."""
        if self.patience is None or not waiting:
            return waiting
        late = [w for w in waiting if now - w[0] > self.patience]
        out += [(request, task, "RETRY_LATER", None) for _, task, request in sorted(late)]
        return [w for w in waiting if now - w[0] <= self.patience] if late else waiting

    def _keep(self, waiting: list[tuple]) -> None:
        self.waiting.clear()
        if waiting:
            self.waiting.put(waiting)
            for micros in {w[0] for w in waiting}:
                self.handle.registerTimer((micros + self.patience) // 1000 + 1)

    @staticmethod
    def _answers(key: tuple, out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["request_id", "task", "status", "rank"])
        found.insert(0, "job", key[0])
        return found.astype({"request_id": "int64", "rank": "Int64"})

    def close(self) -> None:
        pass


def dispatch_stream(requests: DataFrame, control: DataFrame, plan: DataFrame, patience: float | None = None, watermark: str = "10 seconds") -> DataFrame:
    """``dispatch_outcomes`` on streams, with a queue per job: job, request_id, task, status, slice_id; append mode.

    ``requests`` (job, ts, request_id, task) and ``control`` (job, ts, control_id, action) are streams, ``plan`` (job,
    rank, slice_id) is a table with the slices of each job by rank, which only joins the answers.  The state holds
    a counter, so a stream that is started again from its checkpoint hands out nothing twice.
    Requests whose patience ends are answered by timers, when the watermark passes; rows later than
    it are dropped.  Gives the rows of the batch form when its input arrives in order.
    """
    asked = requests.select("job", F.col("ts").cast("timestamp").alias("ts"), F.col("request_id").alias("id"), "task", F.lit(None).cast("string").alias("action"))
    told = control.select("job", F.col("ts").cast("timestamp").alias("ts"), F.col("control_id").alias("id"), F.lit(None).cast("string").alias("task"), "action")
    events = asked.unionByName(told).withWatermark("ts", watermark).withColumn("micros", F.unix_micros("ts"))
    answers = events.groupBy("job").transformWithStateInPandas(DispatchProcessor(patience), ANSWERS, "Append", "EventTime")
    slices = plan.select("job", "rank", "slice_id")
    status = F.when((F.col("status") == "OK") & F.col("slice_id").isNull(), "OUT_OF_RANGE").otherwise(F.col("status"))
    return answers.join(slices, ["job", "rank"], "left").select("job", "request_id", "task", status.alias("status"), "slice_id")
