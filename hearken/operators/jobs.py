"""State machines of jobs and requests, folded over ordered events.

Each decision depends on the ones before it, so a key's events are walked in order.  They are sorted by the shuffle and
streamed through one small state per key: a key of any size never sits in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hearken.functions.display import STAGES

# Moves between states, and the error codes with HTTP status, stage and whether a retry can help.
MOVES = {"queued": ("running", "failed", "cancelled"), "running": ("completed", "failed", "cancelled"), "completed": (), "failed": (), "cancelled": ()}
ERRORS = (
    ("REQUEST.INVALID", 400, "request_validation", False),
    ("AUDIO.UNSUPPORTED_FORMAT", 400, "upload_validation", False),
    ("AUDIO.EMPTY", 400, "upload_validation", False),
    ("AUDIO.INVALID_FORMAT", 400, "upload_validation", False),
    ("SERVICE.RATE_LIMITED", 429, "request_validation", True),
    ("MODEL.NOT_READY", 503, "model_loading", True),
    ("ANALYSIS.FAILED", 500, "analysis", True),
    ("JOB.NOT_FOUND", 404, "job_lookup", False),
    ("JOB.DUPLICATE", 409, "job_lookup", False),
    ("JOB.NOT_COMPLETED", 409, "job_lookup", False),
    ("JOB.CANNOT_CANCEL", 409, "job_cancel", False),
    ("INTERNAL.ERROR", 500, "server", True),
)


def error_codes(spark) -> DataFrame:
    return spark.createDataFrame(list(ERRORS), "error_code string, status_code int, stage string, retryable boolean")


def fold_in_order(df: DataFrame, key: str, order: list[str], used: list[str], initial: Callable[[], object], step: Callable[[object, dict], tuple], columns: str) -> DataFrame:
    """``df`` with new ``columns``: what ``step(state, row)`` returns for each row of a key, in order.

    Only the key and the ``used`` columns become Python objects; those that ``df`` lacks are null.
    """
    fields = T._parse_datatype_string(columns).fields
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = [T.StructType([f]) for f in fields]
    read = [key, *(c for c in used if c in df.columns)]
    absent = dict.fromkeys(c for c in used if c not in df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [to_arrow_schema(k).field(0).type for k in kinds]
        last, state = object(), None
        for batch in batches:
            made = []
            for row in batch.select(read).to_pylist():
                if row[key] != last:
                    last, state = row[key], initial()
                made.append(step(state, row | absent))
            added = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *(f.name for f in fields)])

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def rate_limited(requests: DataFrame, most: int = 10, window: float = 60.0, key: str = "owner_key", seconds: str = "seconds", tie: str = "request_id") -> DataFrame:
    """Requests with ``allowed``: at most ``most`` allowed ones of a key in any ``window`` seconds; refused ones do not count.

    Equal times go by ``tie``.  The state of a key is its last ``most`` allowed times, and none after a pause of a window; so a key
    is cut at its pauses and its parts are walked apart, by many tasks.  Pauses are found among the windows that hold requests, of
    which there is a row each; rows without a time are a part of their own.
    """
    from collections import deque

    if window <= 0:
        raise ValueError("a window must be positive")
    # Requests that are parted by two empty windows are more than a window apart, however quotients are rounded.
    at = F.floor(F.col(seconds) / window)
    seen = requests.select(F.col(key).alias("__key"), at.alias("__at")).distinct()
    order = Window.partitionBy("__key").orderBy("__at")
    begins = F.coalesce((F.col("__at") - F.lag("__at").over(order) > 2).cast("long"), F.lit(1))
    parts = seen.withColumn("__begins", begins).withColumn("__part", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__begins")
    placed = requests.join(parts, requests[key].eqNullSafe(F.col("__key")) & at.eqNullSafe(F.col("__at")), "left").withColumn("__of", F.struct("__key", "__part"))
    cut = placed.select(*[requests[c] for c in requests.columns], "__of")

    def step(log, row: dict) -> tuple:
        now = row[seconds]
        if now is None:
            return (None,)
        while log and now - log[0] >= window:
            log.popleft()
        if len(log) >= most:
            return (False,)
        log.append(now)
        return (True,)

    return fold_in_order(cut, "__of", [seconds, tie], [seconds], deque, step, "allowed boolean").drop("__of")


def job_states(events: DataFrame) -> DataFrame:
    """Job events (job_id, seq, op, status, stage, progress, result, error, metadata) with the verdict on each and the job's state
    after it.

    op is create, update or cancel.  An update to the same status is no move; progress defaults to the stage's, stays for failed and
    cancelled jobs, and may not fall otherwise.  The result is kept of an update to completed and the error of one to failed, any
    other move clears them; metadata (a map) stays until an update brings some.  Refused events leave the state as it is.
    The columns result, error and metadata may be missing.
    """
    names = ("status", "stage", "progress", "result", "error", "metadata")

    def step(job: dict, row: dict) -> tuple:
        change = moved(job, row)
        job.update(change or {})
        return (change is not None, *(job[n] for n in names))

    def moved(job: dict, row: dict) -> dict | None:
        """What an event changes; None if it is refused."""
        known = job["status"] is not None
        if row["op"] == "create":
            return None if known else {"status": "queued", "stage": "queued", "progress": 0, "metadata": []}
        if row["op"] == "cancel":
            return {"status": "cancelled", "stage": "cancelled", "result": None, "error": None} if "cancelled" in MOVES.get(job["status"], ()) else None
        status, stage, given = row["status"], row["stage"], row["progress"]
        ended = status in ("failed", "cancelled")
        legal = known and status in MOVES and stage in (*STAGES, "failed", "cancelled") and (given is None or 0 <= given <= 100)
        if not legal or (status != job["status"] and status not in MOVES[job["status"]]):
            return None
        progress = given if given is not None else job["progress"] if ended else STAGES.get(stage, job["progress"])
        if progress < job["progress"] and not ended:
            return None
        kept = {"result": row["result"] if status == "completed" else None, "error": row["error"] if status == "failed" else None}
        return {"status": status, "stage": stage, "progress": progress, **kept} | ({"metadata": row["metadata"]} if row["metadata"] is not None else {})

    columns = "accepted boolean, now_status string, now_stage string, now_progress int, now_result string, now_error string, now_metadata map<string,string>"
    return fold_in_order(events, "job_id", ["seq"], ["op", *names], lambda: dict.fromkeys(names), step, columns)


def latest_jobs(states: DataFrame) -> DataFrame:
    """(job_id, status, stage, progress, result, error_code, metadata): the state of each job after its last event; unknown jobs are left out."""
    state = F.struct("seq", *[F.col(f"now_{a}").alias(b) for a, b in (("status", "status"), ("stage", "stage"), ("progress", "progress"), ("result", "result"), ("error", "error_code"))])
    last = states.groupBy("job_id").agg(F.max(state).alias("s"), F.max_by("now_metadata", "seq").alias("metadata"))
    return last.select("job_id", "s.status", "s.stage", "s.progress", "s.result", "s.error_code", "metadata").where("status is not null")


def admissions(requests: DataFrame, most: int = 10, window: float = 60.0) -> DataFrame:
    """Requests (owner_key, seconds, request_id, job_id, op, error, ready) with ``outcome``.

    op ``analyze`` asks for the job ``job_id``, ``finish`` gives up the lock that this job holds; another job's lock stays.  The
    checks come in a fixed order: the upload's own ``error``, the rate limit (which a request uses up even if it is refused
    later), readiness, an active job.
    """
    from collections import deque

    def initial() -> dict:
        return {"log": deque(), "active": None}

    def step(state: dict, row: dict) -> tuple:
        if row["op"] == "finish":
            held = state["active"] is not None and state["active"] == row["job_id"]
            if held:
                state["active"] = None
            return ("released" if held else "not_held",)
        if row["error"]:
            return (row["error"],)
        log = state["log"]
        while log and row["seconds"] - log[0] >= window:
            log.popleft()
        if len(log) >= most:
            return ("SERVICE.RATE_LIMITED",)
        log.append(row["seconds"])
        if not row["ready"]:
            return ("MODEL.NOT_READY",)
        if state["active"] is not None:
            return ("JOB.DUPLICATE",)
        state["active"] = row["job_id"]
        return ("queued",)

    return fold_in_order(requests, "owner_key", ["seconds", "request_id"], ["seconds", "request_id", "job_id", "op", "error", "ready"], initial, step, "outcome string")


def shown_progress(reports: DataFrame, progress: str = "progress", stage: str = "stage") -> DataFrame:
    """Reports (job_id, seq, ...) with running maxima: progress never falls and the stage never goes back."""
    past = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = F.array(*map(F.lit, STAGES))
    at = F.coalesce(F.nullif(F.array_position(names, F.col(stage)), F.lit(0)), F.lit(1)).cast("int")
    return reports.withColumn("shown_progress", F.max(progress).over(past)).withColumn("shown_stage", F.element_at(names, F.max(at).over(past)))


def result_view(jobs: DataFrame) -> DataFrame:
    """What a result request returns: the result, or the error code that explains its absence."""
    code = F.when(F.col("status") == "failed", F.coalesce("error_code", F.lit("ANALYSIS.FAILED"))).when(F.col("status") != "completed", "JOB.NOT_COMPLETED")
    return jobs.select("job_id", code.alias("error_code"), F.when(code.isNull(), F.col("result")).alias("result"))


def status_view(jobs: DataFrame) -> DataFrame:
    """What a status request returns; details only where there are any."""
    return jobs.select("job_id", "status", "stage", "progress", F.when(F.size("metadata") > 0, F.col("metadata")).alias("progress_details"))
