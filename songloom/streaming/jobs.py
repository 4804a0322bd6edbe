"""State of a job from its progress events, in batch and on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from songloom.constants import CANCELLED_MESSAGE, COMPLETED_MESSAGE, FAILED_MESSAGE, FINAL_STATES


def job_status(events: DataFrame) -> DataFrame:
    """Latest state per job from ``job_id, ts, event_id, status, progress, message``.

    The first final event (completed, failed, cancelled) decides; without one the last
    event does. The aggregate keeps two events per job, so it is combined before the
    shuffle in batch and holds constant state per job on a stream.
    """
    event = F.struct("ts", "event_id", "status", "progress", "message")
    final = F.col("status").isin(FINAL_STATES)
    state = events.groupBy("job_id").agg(
        F.min(F.when(final, event)).alias("final"),
        F.max(event).alias("last"),
        F.min("ts").alias("created_at"),
    )
    at = F.coalesce(F.col("final"), F.col("last"))
    status = at["status"]
    return state.select(
        "job_id",
        status.alias("status"),
        F.when(status == "completed", 100).when(status.isin("failed", "cancelled"), 0)
        .otherwise(at["progress"]).cast("int").alias("progress"),
        F.when(status == "completed", F.lit(COMPLETED_MESSAGE)).when(status == "failed", F.lit(FAILED_MESSAGE))
        .when(status == "cancelled", F.lit(CANCELLED_MESSAGE)).otherwise(at["message"]).alias("message"),
        F.when(status == "failed", at["message"]).alias("error"),
        "created_at",
        at["ts"].alias("updated_at"),
    )


def stream_job_status(events: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None],
                      **trigger: bool | str) -> StreamingQuery:
    """Keep job states up to date from a stream; ``publish`` gets the changed jobs of each batch.

    Jobs never expire, as a job can be asked for at any time; a batch that runs again
    publishes the same states again.
    """
    return (
        job_status(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(publish).trigger(**(trigger or {"availableNow": True})).start()
    )
