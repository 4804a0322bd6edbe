import pytest
from pyspark.sql import functions as F

from songloom.streaming import machine, requests
from songloom.streaming.jobs import job_status, stream_job_status
from songloom.streaming.requests import recommend_stream

EVENT = "event_id bigint, ts timestamp, job_id bigint, status string, progress int, message string"


@pytest.fixture
def events(spark):
    rows = [
        (1, "2024-01-01 00:00:01", 1, "pending", 0, "queued"), (2, "2024-01-01 00:00:02", 1, "in_progress", 40, "half"),
        (3, "2024-01-01 00:00:03", 1, "completed", 90, "x"), (4, "2024-01-01 00:00:04", 1, "cancelled", 0, "late cancel"),
        (5, "2024-01-01 00:00:01", 2, "pending", 0, "queued"), (6, "2024-01-01 00:00:05", 2, "in_progress", 30, "Found 3 songs"),
        (7, "2024-01-01 00:00:02", 3, "cancelled", 10, "c"), (8, "2024-01-01 00:00:03", 3, "in_progress", 70, "too late"),
        (9, "2024-01-01 00:00:03", 4, "in_progress", 70, "w"), (10, "2024-01-01 00:00:03", 4, "failed", 70, "boom"),
    ]
    return spark.createDataFrame(rows, EVENT.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))


WANTED = {
    1: ("completed", 100, "Playlist created successfully!", None),
    2: ("in_progress", 30, "Found 3 songs", None),
    3: ("cancelled", 0, "Job cancelled by user", None),
    4: ("failed", 0, "Failed to create playlist", "boom"),
}


def states(rows):
    return {r["job_id"]: (r["status"], r["progress"], r["message"], r["error"]) for r in rows}


def test_job_status(events):
    assert states(job_status(events).collect()) == WANTED


def test_job_status_stream_equals_batch(spark, events, tmp_path):
    # Out of order on purpose: the first final event by time decides, whenever it arrives.
    for i, part in enumerate((events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    seen = {}

    def publish(batch, batch_id):
        for row in batch.collect():
            seen[row["job_id"]] = row

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream_job_status(stream, str(tmp_path / "checkpoint"), publish).awaitTermination()
    assert states(seen.values()) == WANTED


def test_recommend_stream_stores_each_answer_once(spark, tmp_path):
    asked = spark.range(6).withColumnRenamed("id", "request_id")
    asked.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart finds nothing new
        recommend_stream(stream, lambda batch: batch.withColumn("rank", F.lit(1)), str(tmp_path / "out"),
                         str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["request_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))


def test_the_rules_of_the_machine():
    state, said = None, []
    for event in [(1, "cancelled", 0, "c"), (2, "pending", 0, "q"), (3, "in_progress", 40, "a"), (4, "pending", 50, "q"), (5, "in_progress", 20, "b"),
                  (6, "in_progress", None, "n"), (7, "odd", 1, "x"), (8, "failed", 70, "boom"), (9, "cancelled", 0, "c"), (10, "failed", 0, "again")]:
        state, reason = machine.advance(state, event)
        said.append((state and state[:4], reason))
    end = ("failed", 0, "Failed to create playlist", "boom")
    assert said == [(None, "no such job"), (("pending", 0, "q", None), None), (("in_progress", 40, "a", None), None),
                    (("in_progress", 40, "a", None), "step back"), (("in_progress", 40, "b", None), None),
                    (("in_progress", 40, "n", None), None), (("in_progress", 40, "n", None), "unknown status"), (end, None),
                    (end, "already failed"), (end, "already failed")]


def _reports(spark, parts, tmp_path, **options):
    for i, part in enumerate(parts):  # one file after the other
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart finds nothing new
        machine.stream_job_reports(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_job_machine_stream(spark, events, tmp_path):
    rows = _reports(spark, [events.filter("second(ts) <= 2"), events.filter("second(ts) > 2")], tmp_path)
    reports = sorted((r["event_id"], r["kind"], r["reason"], r["status"], r["progress"]) for r in rows.collect())
    assert reports == [
        (1, "accepted", None, "pending", 0), (2, "accepted", None, "in_progress", 40), (3, "accepted", None, "completed", 100),
        (4, "refused", "already completed", "completed", 100), (5, "accepted", None, "pending", 0), (6, "accepted", None, "in_progress", 30),
        (7, "refused", "no such job", None, None), (8, "accepted", None, "in_progress", 70), (9, "accepted", None, "in_progress", 70),
        (10, "accepted", None, "failed", 0)]
    latest = {r["job_id"]: (r["status"], r["refused"], r["unknown"]) for r in machine.latest_states(rows).collect()}
    assert latest == {1: ("completed", 1, 0), 2: ("in_progress", 0, 0), 3: ("in_progress", 1, 1), 4: ("failed", 0, 0)}


def test_silent_jobs_are_reported(spark, tmp_path):
    def at(*rows):
        return spark.createDataFrame([(i, f"2024-01-01 00:{t}", job, status, 5, "m") for i, t, job, status in rows],
                                     EVENT.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))

    parts = [at((1, "00:00", 1, "pending"), (2, "00:00", 2, "pending"), (3, "00:00", 3, "completed")),
             at((4, "00:50", 2, "in_progress")), at((5, "01:30", 4, "pending")), at((6, "01:31", 4, "in_progress"))]
    rows = _reports(spark, parts, tmp_path, stuck_after=60)
    stuck = [(r["job_id"], str(r["ts"]), r["status"]) for r in rows.filter("kind = 'stuck'").collect()]
    assert stuck == [(1, "2024-01-01 00:01:00", "pending")]  # job 2 spoke again, job 3 has ended


def test_stages_tell_and_drop_what_is_cancelled(spark, tmp_path):
    """Cancelled ahead of a stage: told so, and neither worked on nor answered from there on."""
    asked = spark.range(8).withColumnRenamed("id", "request_id")
    asked.coalesce(1).write.parquet(str(tmp_path / "in"))
    worked = []

    def step(wanted, left):
        worked.append(sorted(r["request_id"] for r in wanted.collect()))
        return wanted.withColumn("rank", F.lit(len(worked)))

    stages = [requests.Stage("first", 30, step), requests.Stage("second", 60, step)]
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart finds nothing new
        requests.staged_stream(
            stream, stages, lambda no: asked.filter(F.col("request_id") < 2 * no), str(tmp_path / "out"), str(tmp_path / "told"),
            str(tmp_path / "checkpoint")).awaitTermination()
    assert worked == [list(range(8)), list(range(2, 8))]
    assert sorted(r["request_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [4, 5, 6, 7]
    far = {r["request_id"]: (r["status"], r["progress"], r["told"]) for r in requests.latest_progress(
        spark.read.parquet(str(tmp_path / "told"))).collect()}
    assert far == {**{i: ("cancelled", 0, 2) for i in (0, 1)}, **{i: ("cancelled", 0, 3) for i in (2, 3)},
                   **{i: ("completed", 100, 3) for i in (4, 5, 6, 7)}}
