"""Jobs as a state machine on a stream: every event is checked against its job's state as it arrives.

A job is pending or in progress until it is completed, failed or cancelled, and then stays so. An
event that asks for anything else is refused, with the reason, and changes nothing: a cancel of a
job that has ended or is not known, a step back, an event after the end. Progress never falls. A
job that hears nothing for ``stuck_after`` seconds of event time is reported once, and again if it
falls silent after a later event.

One small state per job lies in the state store; a batch's events of one job are put in order of
time first, so what is reported does not depend on how they are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from songloom.constants import CANCELLED_MESSAGE, COMPLETED_MESSAGE, FAILED_MESSAGE, FINAL_STATES

# What a job may become.
ALLOWED = {
    None: {"pending", "in_progress", "completed", "failed"},
    "pending": {"in_progress", "completed", "failed", "cancelled"},
    "in_progress": {"in_progress", "completed", "failed", "cancelled"},
    **{state: set() for state in FINAL_STATES},
}
FINAL_MESSAGES = {"completed": COMPLETED_MESSAGE, "failed": FAILED_MESSAGE, "cancelled": CANCELLED_MESSAGE}

STATE = "status string, progress int, message string, error string, created_at timestamp, updated_at timestamp"
REPORT = ("job_id {id}, event_id bigint, ts timestamp, kind string, reason string, status string, progress int, message string, "
          "error string, created_at timestamp, updated_at timestamp")
COLUMNS = ["job_id", "event_id", "ts", "kind", "reason", "status", "progress", "message", "error", "created_at", "updated_at"]


def refusal(state: str | None, asked: str) -> str | None:
    """Why an event is refused in a state, or None if it is not."""
    if asked in ALLOWED.get(state, ()):
        return None
    if state is None:
        return "no such job" if asked == "cancelled" else "unknown status"
    if state in FINAL_STATES:
        return f"already {state}"
    return "step back" if asked == "pending" else "unknown status"


def advance(state: tuple | None, event: tuple) -> tuple[tuple | None, str | None]:
    """The state after an event (ts, status, progress, message), and the reason if it is refused."""
    ts, status, progress, message = event
    reason = refusal(state[0] if state else None, status)
    if reason:
        return state, reason
    done, created = state[1] if state else 0, state[4] if state else ts
    if status in FINAL_STATES:
        progress, error = (100 if status == "completed" else 0), (message if status == "failed" else None)
        return (status, progress, FINAL_MESSAGES[status], error, created, ts), None
    return (status, max(done, 0 if progress is None else int(progress)), message, None, created, ts), None


_NO_STATE = (None,) * 6


def _plain(values: pd.Series) -> list:
    """Values as Python has them, None for those that are missing."""
    plain = values.astype(object).tolist()
    return [None if pd.isna(v) else v for v in plain] if values.hasnans else plain


class JobMachine(StatefulProcessor):
    def __init__(self, stuck_after: int | None):
        self.stuck_after = stuck_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events = events.take(np.lexsort((events["event_id"].to_numpy(), events["ts"].to_numpy())))
        state = tuple(self.state.get()) if self.state.exists() else None
        before, states, reasons = state, [], []
        # Column by column: a frame's row costs far more than the step it asks for.
        told = (_plain(events[c]) for c in ("ts", "status", "progress", "message"))
        for event in zip(*told, strict=True):
            state, reason = advance(state, event)
            states.append(state or _NO_STATE)
            reasons.append(reason)
        if state is not None and state is not before:
            self.state.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in state))
            if self.stuck_after is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if state[0] not in FINAL_STATES:
                    self.handle.registerTimer(int(pd.Timestamp(state[5]).timestamp() * 1000) + self.stuck_after * 1000)
        n = len(events)
        yield self._frame([[key[0]] * n, events["event_id"].to_numpy(), events["ts"].to_numpy(),
                           ["refused" if r else "accepted" for r in reasons], reasons, *map(list, zip(*states, strict=True))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            report = [key[0], None, at, "stuck", f"nothing for {self.stuck_after} s", *self.state.get()]
            yield self._frame([[value] for value in report])

    @staticmethod
    def _frame(columns: list) -> pd.DataFrame:
        frame = dict(zip(COLUMNS, columns, strict=True))
        for column in ("ts", "created_at", "updated_at"):
            frame[column] = pd.to_datetime(frame[column])
        for column in ("event_id", "progress"):
            frame[column] = pd.array(frame[column], dtype="Int64" if column == "event_id" else "Int32")
        return pd.DataFrame(frame, columns=COLUMNS)

    def close(self) -> None:
        pass


def job_reports(events: DataFrame, stuck_after: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """A streamed report per event of ``job_id, ts, event_id, status, progress, message``, and per stuck job.

    Each holds the state that the job is in then. Events that come later than ``delay`` behind the
    newest are taken like any other; the delay only says when silence is certain.
    """
    kind = events.schema["job_id"].dataType.simpleString()
    if stuck_after is not None:
        events = events.withWatermark("ts", delay)
    return events.groupBy("job_id").transformWithStateInPandas(
        JobMachine(stuck_after), REPORT.format(id=kind), "Update", "EventTime" if stuck_after is not None else "None")


def stream_job_reports(events: DataFrame, output: str, checkpoint: str, stuck_after: int | None = None,
                       **trigger: bool | str) -> StreamingQuery:
    """Store the reports of each batch; a batch that runs again overwrites its own folder."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (job_reports(events, stuck_after).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start())


def latest_states(reports: DataFrame) -> DataFrame:
    """The state each job is in after all reports, and how many of its events were refused.

    Jobs that were only ever refused have no status.
    """
    seen = F.struct("updated_at", F.col("ts").alias("at"), "event_id", "status", "progress", "message", "error", "created_at")
    state = reports.groupBy("job_id").agg(
        F.max(F.when(F.col("kind") == "accepted", seen)).alias("s"),
        F.count_if(F.col("kind") == "refused").alias("refused"), F.count_if(F.col("reason") == "no such job").alias("unknown"))
    return state.select("job_id", "s.status", "s.progress", "s.message", "s.error", "s.created_at", "s.updated_at", "refused", "unknown")
