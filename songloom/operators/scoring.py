"""Relevance from an outside scorer: failures stay with their call, and no pair is paid for twice.

A scorer is asked in batches. If a batch fails, its calls are made one by one, each at most
``ATTEMPTS`` times; one that fails all the same is a row with ``failed`` and its error, and no other
row is touched. Answers are kept in a memo table by a hash of the request's text, which holds the
prompt, the song and its lyrics: pairs that were answered before, in this run or an earlier one, are
not asked again, and a song that many requests share in the same words is asked once. Failures
are not kept, so the next run asks again.

The memo is a folder of Parquet files; every run adds a folder of its own when it is complete, so
a run that breaks off or is repeated leaves nothing half written and nothing twice that matters:
of equal requests the first run's answer counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.functions.payload import parse_score
from songloom.functions.text import render_prompt
from songloom.operators.encode import Scorer
from songloom.operators.groups import first_per_key
from songloom.session import settle

ATTEMPTS = 3
# Requests up to this number are dealt out once more, so that few of them are asked side by side as well.
SHORT_LIST = 10_000
# Characters of an error that are kept with its row.
ERROR_CHARS = 200

MEMO = "request_hash string, response string, run string"


def read_memo(spark: SparkSession, path: str) -> DataFrame:
    """(request_hash, response) of all calls answered so far; none where there is no memo yet."""
    try:
        stored = spark.read.schema(MEMO).parquet(path)
    except AnalysisException:
        stored = spark.createDataFrame([], MEMO)
    return first_per_key(stored, ["request_hash"], ["run", "response"]).select("request_hash", "response")


def _one(scorer: Scorer, request: str, attempts: int) -> tuple[str | None, bool, str | None]:
    """Response, whether the call failed, and its last error."""
    for left in range(attempts - 1, -1, -1):
        try:
            (response,) = scorer([request])
            return response, False, None
        except Exception as error:  # noqa: BLE001 - whatever a scorer raises stays with its row
            if not left:
                return None, True, f"{type(error).__name__}: {error}"[:ERROR_CHARS]
    return None, True, "not asked"


def _ask(batches: Iterator[pd.DataFrame], scorer: Scorer, attempts: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        asked = batch["request"].tolist()
        try:
            responses = list(scorer(asked))
            if len(responses) != len(asked):
                raise ValueError(f"{len(responses)} responses to {len(asked)} requests")
            rows = [(r, False, None) for r in responses]
        except Exception:  # noqa: BLE001 - found out one by one which calls fail
            rows = [_one(scorer, request, attempts) for request in asked]
        yield pd.DataFrame({"request_hash": batch["request_hash"].tolist(), "response": [r[0] for r in rows],
                            "failed": [r[1] for r in rows], "error": [r[2] for r in rows]})


def score_with_memo(pairs: DataFrame, scorer: Scorer, memo: str, attempts: int = ATTEMPTS, concurrency: int | None = None
                    ) -> DataFrame:
    """(prompt, title, artist, lyrics) rows with ``relevance``, ``failed`` and ``error``.

    Relevance is NULL where there are no lyrics, which are not asked about, and where the call
    failed. ``memo`` is the folder of earlier answers; ``concurrency`` bounds how many tasks ask
    at a time.
    """
    spark = pairs.sparkSession
    request = F.when(F.col("lyrics").isNotNull(), render_prompt(F.col("prompt"), F.col("title"), F.col("artist"), F.col("lyrics")))
    # Whether there are lyrics is noted here: behind the join below nothing needs the text itself.
    told = pairs.withColumn("_request", request).withColumn("_hash", F.sha2("_request", 256)).withColumn(
        "_sung", F.col("lyrics").isNotNull())
    asked = told.filter(F.col("_request").isNotNull()).select(F.col("_hash").alias("request_hash"), F.col("_request").alias("request"))
    hashes = settle(asked.select("request_hash").distinct(), "request-hashes")
    # Stored: it must not see what this run adds below.
    known = settle(read_memo(spark, memo).join(hashes, "request_hash", "left_semi"), "known-answers")
    # The texts go to their hash once, and are asked about where they arrive.
    fresh = asked.groupBy("request_hash").agg(F.first("request").alias("request")).join(
        known.select("request_hash"), "request_hash", "left_anti")
    short = hashes.join(known.select("request_hash"), "request_hash", "left_anti").limit(SHORT_LIST + 1).count() <= SHORT_LIST
    dealt = fresh.repartition(concurrency or spark.sparkContext.defaultParallelism, "request_hash") if concurrency or short else fresh
    answered = settle(dealt.mapInPandas(
        lambda batches: _ask(batches, scorer, attempts),
        "request_hash string, response string, failed boolean, error string"), "answers")
    run = uuid.uuid4().hex
    new = answered.filter("NOT failed").select("request_hash", "response", F.lit(run).alias("run"))
    new.write.mode("append").parquet(memo)
    answers = known.select("request_hash", "response", F.lit(False).alias("_failed"), F.lit(None).cast("string").alias("_error")).unionAll(
        answered.select("request_hash", "response", "failed", "error"))
    joined = told.join(answers.withColumnRenamed("request_hash", "_hash"), "_hash", "left")
    failed = F.coalesce(F.col("_failed"), F.lit(False))
    relevance = F.when(F.col("_sung") & ~failed, parse_score(F.col("response")))
    return joined.select(*[F.col(f"`{c}`") for c in pairs.columns if c not in ("relevance", "failed", "error")],
                         relevance.alias("relevance"), failed.alias("failed"), F.col("_error").alias("error"))
