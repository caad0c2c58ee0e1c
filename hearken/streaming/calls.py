"""The call pipeline as a stream: chunks arrive in files, calls are rolled up when all their chunks are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHUNKS = "call_id long, chunk_index long, total_chunks int, start double, end double, transcript string"


def chunk_stream(spark: SparkSession, path: str, files_per_batch: int = 1, kind: str = "parquet") -> DataFrame:
    """A bounded number of files per batch is the back-pressure."""
    return spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def progress_counts(prepared: DataFrame) -> DataFrame:
    """Per call, so far: chunks transcribed, normalised, classified and expected."""
    return prepared.groupBy("call_id").agg(
        F.count("*").alias("transcribed_chunks"), F.count("normalized").alias("normalized_chunks"), F.count("result").alias("classified_chunks"), F.max("total_chunks").alias("total_chunks")
    )


def run(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Prepare each chunk as it comes and append it to ``out``; the per-chunk work keeps no state.

    An error in either half ends the query.  The checkpoint makes each file count once.
    """
    return prepare(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(prepared: DataFrame) -> DataFrame:
    """The chunks of calls that are complete."""
    whole = prepared.groupBy("call_id").agg(F.count("*").alias("n"), F.max("total_chunks").alias("all")).where("n >= all").select("call_id")
    return prepared.join(whole, "call_id", "left_semi")


def rate_limited_stream(requests: DataFrame, most: int = 10, window: float = 60.0) -> DataFrame:
    """Decisions on a stream of (owner_key, seconds, request_id), with the allowed times of each owner as state.

    Within a batch an owner's requests are ordered by time; state of owners that stay away is dropped after the window.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def decide(key, frames, state: GroupState):
        log = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["seconds", "request_id"])
        allowed = []
        for now in rows["seconds"]:
            log = [t for t in log if now - t < window]
            allowed.append(len(log) < most)
            if allowed[-1]:
                log.append(float(now))
        state.update((log,))
        state.setTimeoutDuration(int(window * 1000) or 1)
        yield rows.assign(allowed=allowed)[["owner_key", "seconds", "request_id", "allowed"]]

    schema = "owner_key string, seconds double, request_id long, allowed boolean"
    return requests.groupBy("owner_key").applyInPandasWithState(decide, schema, "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
