"""Custom state: the scaling controller and periodic checks on streams.

Both keep one small state per key in the state store and take each batch's rows of a key in
time order, so that a stream gives the rows of the batch form when its input arrives in order.
The session needs the RocksDB state store provider (``ROCKSDB``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scaling import CONTROL_SCHEMA, PRESENCE, Controller, control, firings

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ControllerProcessor(StatefulProcessor):
    """Keeps a ``Controller`` per job."""

    def __init__(self, cooldown: float, clear_flag: bool):
        self.cooldown, self.clear_flag = cooldown, clear_flag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("controller", "phase string, last double, pending boolean, target long, acted string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = Controller()
        if self.state.exists():
            phase, last, pending, target, acted = self.state.get()
            now = Controller(phase, last, pending, target, frozenset(x for x in acted.split("\n") if x))
        found = control(now, pd.concat(list(rows)), self.cooldown, self.clear_flag)
        self.state.update((now.phase, now.last, now.pending_down, now.target, "\n".join(sorted(now.acted))))
        yield found

    def close(self) -> None:
        pass


def scaling_controller_stream(events: DataFrame, cooldown: float = 300, clear_flag: bool = True) -> DataFrame:
    """``scaling_controller`` on a stream of events; append mode."""
    return events.groupBy("job").transformWithStateInPandas(ControllerProcessor(cooldown, clear_flag), CONTROL_SCHEMA, "Append", "None")


class PeriodicProcessor(StatefulProcessor):
    """Keeps the value of the last firing per key."""

    def __init__(self, by: str, value: str, n: float, kind: str):
        self.by, self.value, self.n, self.kind = by, value, n, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", f"last {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        group = pd.concat(list(rows)).sort_values(self.value)
        fired, last = firings(group[self.value].tolist(), self.n, self.state.get()[0] if self.state.exists() else None)
        self.state.update((last,))
        yield group[fired][[self.by, self.value]]

    def close(self) -> None:
        pass


def every_n_steps_stream(rows: DataFrame, n: float, by: str = "task", value: str = "step") -> DataFrame:
    """``every_n_steps`` on a stream, for ``n`` above 0; append mode.  Rows without a value or task fire nothing."""
    kept = rows.select(by, value).where(F.col(value).isNotNull() & F.col(by).isNotNull())  # a null would turn a batch of longs into doubles
    kind = kept.schema[value].dataType.simpleString()
    return kept.groupBy(by).transformWithStateInPandas(PeriodicProcessor(by, value, n, kind), kept.schema, "Append", "None")


class PresenceProcessor(StatefulProcessor):
    """Keeps a task's last status, whether its loss has been reported, and the timer that would report it."""

    def __init__(self, patience: float):
        self.span = int(patience * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("presence", "micros long, uid string, lost boolean, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, uid, lost, timer = self.state.get() if self.state.exists() else (None, None, False, None)
        group, out = pd.concat(list(rows)), []
        for micros, own in sorted(zip(group["micros"].tolist(), group["uid"].tolist(), strict=True)):
            if last is None:
                out.append((micros, "added", own))
            else:
                silent = lost or micros - last > self.span
                if silent and not lost:
                    out.append((last + self.span, "lost", uid))
                if own != uid or silent:
                    out.append((micros, "replaced" if own != uid else "returned", own))
            last, uid, lost = micros, own, False
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (last + self.span) // 1000 + 1
        self.handle.registerTimer(timer)
        self.state.update((last, uid, lost, timer))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, uid, lost, timer = self.state.get()
        out = []
        if not lost and timer == expiredTimerInfo.getExpiryTimeInMs():
            out.append((last + self.span, "lost", uid))
            self.state.update((last, uid, True, timer))
        yield self._rows(key, out)

    @staticmethod
    def _rows(key: tuple, out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["micros", "change", "uid"]).astype({"micros": "int64"})
        found.insert(0, "task", key[0])
        return found

    def close(self) -> None:
        pass


def task_presence_stream(updates: DataFrame, patience: float, watermark: str = "10 seconds") -> DataFrame:
    """``task_presence`` on a stream (task, ts, uid); append mode.

    A silent task is reported once, by a timer, when the watermark passes the end of its patience, and again when it comes back.
    """
    rows = updates.select(F.col("task").cast("string").alias("task"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("uid").cast("string"), F.lit("")).alias("uid"))
    timed = rows.where("task is not null and ts is not null").withWatermark("ts", watermark).withColumn("micros", F.unix_micros("ts"))
    return timed.groupBy("task").transformWithStateInPandas(PresenceProcessor(patience), PRESENCE, "Append", "EventTime")
