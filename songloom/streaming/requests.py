"""Requests that arrive as a stream, answered batch by batch, in one step or stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from songloom.constants import CANCELLED_MESSAGE, COMPLETED_MESSAGE
from songloom.session import settle

Answer = Callable[[DataFrame], DataFrame]


def recommend_stream(requests: DataFrame, answer: Answer, output: str, checkpoint: str,
                     **trigger: bool | str) -> StreamingQuery:
    """Answer each micro-batch of requests and store the ranked rows as Parquet.

    Every batch owns the folder ``batch_id=N`` and overwrites it, so a batch that runs
    again after a lost driver leaves each answer stored once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        requests.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start()
    )


@dataclass(frozen=True)
class Stage:
    """A step of the work on a batch of requests.

    ``work`` gets the requests that are still wanted and what the stage before has left (None at
    first), and leaves a value for the next one; the last leaves the rows of the answers.
    """

    message: str
    progress: int
    work: Callable[[DataFrame, object], object]


def staged_stream(requests: DataFrame, stages: list[Stage], cancelled: Callable[[int], DataFrame], output: str, progress: str,
                  checkpoint: str, **trigger: bool | str) -> StreamingQuery:
    """Answer requests stage by stage, telling how far each is, and drop those cancelled meanwhile.

    Ahead of every stage, and once after the last, ``cancelled`` is asked, with the number of the
    stage, for the requests (``request_id``) that are no longer wanted; these are dropped by an anti
    join and told of as cancelled. ``progress`` gets a row per request and stage: ``request_id,
    stage, status, progress, message, at``. Each batch and stage owns a folder and overwrites it, so
    a batch that runs again tells everything once.
    """
    done = Stage(COMPLETED_MESSAGE, 100, lambda wanted, left: left)

    def store(batch: DataFrame, batch_id: int) -> None:
        wanted, left = settle(batch, "requests"), None
        for no, stage in enumerate([*stages, done]):
            dropped = settle(cancelled(no).select("request_id").distinct(), "cancelled")
            gone = wanted.join(dropped, "request_id", "left_semi")
            wanted = settle(wanted.join(dropped, "request_id", "left_anti"), "requests")
            told = [rows.select("request_id", F.lit(no).alias("stage"), F.lit(status).alias("status"), F.lit(percent).alias("progress"),
                                F.lit(message).alias("message"), F.current_timestamp().alias("at"))
                    for rows, status, percent, message in (
                        (gone, "cancelled", 0, CANCELLED_MESSAGE),
                        (wanted, "completed" if stage is done else "in_progress", stage.progress, stage.message))]
            told[0].unionAll(told[1]).write.mode("overwrite").parquet(f"{progress}/batch_id={batch_id}/step={no}")
            left = stage.work(wanted, left)
        left.join(wanted.select("request_id"), "request_id", "left_semi").write.mode("overwrite").parquet(
            f"{output}/batch_id={batch_id}")

    return (
        requests.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_progress(told: DataFrame) -> DataFrame:
    """How far each request is, by the rows that :func:`staged_stream` stored, and how many it has."""
    last = F.max_by(F.struct("status", "progress", "message"), "stage")
    return told.groupBy("request_id").agg(last.alias("s"), F.count(F.lit(1)).alias("told")).select("request_id", "s.*", "told")
