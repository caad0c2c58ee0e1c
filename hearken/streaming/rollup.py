"""Calls rolled up inside the stream: a call's row leaves in the batch that brings its last chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from hearken.operators.calls import CHUNK, call_rows, one_chunk

#: Seconds for which a call waits for its next chunk.
PATIENCE = 3600.0
#: Chunks of a call and batch that are held before they go to the state.
FRESH = 256
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a row of a call that never got all its chunks says.
FAILED = "ANALYSIS.FAILED"
#: Observed by ``observed``, in the order of the stages.
COUNTS = ("transcribed_chunks", "normalized_chunks", "classified_chunks")


class OpenCalls(StatefulProcessor):
    """Keeps the chunks of open calls by their index, and gives them away once as many came as the call has.

    A chunk that comes again replaces itself.  What a call holds is dropped when it leaves; only a mark stays until no chunk
    has come for the time of patience, so that chunks repeated meanwhile are not taken for a new call.  A call that waits in
    vain for so long leaves with what it has.
    """

    def __init__(self, patience: float):
        self.patience = int(patience * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk_index long", "chunk string")
        self.call = handle.getValueState("call", "came long, total long, gone boolean, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came, total, gone, timer = self.call.get() if self.call.exists() else (0, None, False, None)
        fresh: dict[int, str] = {}  # not in the state yet: a call that comes whole in one batch never is
        for row in rows:
            if gone:
                continue
            fresh[row.chunk_index] = row.chunk
            if row.total_chunks is not None:
                total = max(total or 0, row.total_chunks)
            if len(fresh) >= FRESH:
                came += self.kept(fresh, came)
        now = timerValues.getCurrentProcessingTimeInMs()
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.patience)
        if not gone:
            if came or total is None or len(fresh) < total:
                came += self.kept(fresh, came)
            else:
                came = len(fresh)
            if total is not None and came >= total:
                yield self.leaving(key, total - came, fresh)
                gone = True
        self.call.update((came, total, gone, now + self.patience))

    def kept(self, fresh: dict[int, str], before: int) -> int:
        """Puts chunks into the state; how many of them were not there."""
        new = 0
        for at, chunk in fresh.items():
            new += not (before and self.chunks.containsKey((at,)))
            self.chunks.updateValue((at,), (chunk,))
        fresh.clear()
        return new

    def leaving(self, key, missing: int | None, fresh: dict[int, str]) -> Row:
        packed = list(fresh.values())
        if not packed:
            packed = [v[0] for v in self.chunks.values()]
            self.chunks.clear()
        return Row(call_id=key[0], missing_chunks=missing, packed=packed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.call.exists():
            came, total, gone, timer = self.call.get()
            if timer is None or timer > expiredTimerInfo.getExpiryTimeInMs():
                return
            if not gone:
                yield self.leaving(key, None if total is None else total - came, {})
            self.call.clear()

    def close(self) -> None:
        pass


def rolled_up_stream(prepared: DataFrame, patience: float = PATIENCE) -> DataFrame:
    """Rows of calls as a stream, from a stream of prepared chunks that carry ``total_chunks``.

    Columns are those of the batch roll-up, then missing_chunks and error_code.  Complete calls miss none and have no error.
    Others leave after ``patience`` seconds without a chunk: with an error, and with neither label nor score.  missing_chunks is
    null where no chunk told how many there are.
    """
    index = F.col("chunk_index").cast("long").alias("chunk_index")
    packed = prepared.select("call_id", index, F.col("total_chunks").cast("long").alias("total_chunks"), F.to_json(one_chunk()).alias("chunk"))
    kind = prepared.schema["call_id"].dataType.simpleString()
    gone = packed.groupBy("call_id").transformWithState(OpenCalls(patience), f"call_id {kind}, missing_chunks long, packed array<string>", "Append", "ProcessingTime")
    chunks = F.sort_array(F.transform("packed", lambda c: F.from_json(c, CHUNK)))
    rows = call_rows(gone.select("call_id", "missing_chunks", chunks.alias("chunks")), "missing_chunks")
    whole = F.coalesce(F.col("missing_chunks") <= 0, F.lit(False))
    return rows.withColumns({
        **{c: F.when(whole, F.col(c)) for c in ("label", "suspicion_score")},
        "classification_status": F.when(whole, F.col("classification_status")).otherwise("failed"),
        "error_code": F.when(~whole, FAILED),
    })


def observed(prepared: DataFrame, name: str = "chunks") -> DataFrame:
    """The same stream, of which each batch's counts of chunks by stage are observed as it is worked off; no second pass."""
    return prepared.observe(name, *[F.count(F.lit(1) if c == COUNTS[0] else F.col(of)).alias(c) for c, of in zip(COUNTS, ("", "normalized", "result"))])


class Progress(StreamingQueryListener):
    """Adds up what ``observed`` streams tell, and reports it after each batch; a failure is reported once.

    report: gets the counts so far, which never fall, with the number of batches.  failed: gets the error's text.
    """

    def __init__(self, report: Callable[[dict[str, int]], None] | None = None, failed: Callable[[str], None] | None = None, name: str = "chunks"):
        self.report, self.failed, self.name = report, failed, name
        self.counts = dict.fromkeys((*COUNTS, "batches"), 0)
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        for c in COUNTS:
            self.counts[c] += row[c]
        self.counts["batches"] += 1
        if self.report is not None:
            self.report(dict(self.counts))

    def onQueryTerminated(self, event) -> None:
        if event.exception and str(event.runId) not in self.ended:
            self.ended.add(str(event.runId))
            if self.failed is not None:
                self.failed(event.exception)


def run_calls(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, patience: float = PATIENCE, seconds: float | None = None) -> StreamingQuery:
    """Prepare chunks as they come and append the rows of calls to ``out`` as they are complete.

    Works off what is there, or every so many ``seconds`` from then on.  In the first form calls that wait in vain leave with the
    next batch that has chunks: batches without any, which look after them otherwise, would have no end.  State is kept by
    RocksDB, off the heap, and with the log in ``checkpoint``; a query started again there goes on where the last one ended,
    and each call is written once.  Batches are as large as the source admits, and the next is read when one is written: that
    is the back-pressure, and an error in any part ends the query.
    """
    conf = stream.sparkSession.conf
    wanted = {PROVIDER: ROCKSDB, EMPTY_BATCHES: str(seconds is not None).lower()}
    before = {key: conf.get(key) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        writer = rolled_up_stream(observed(prepare(stream)), patience).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
    finally:
        for key, value in before.items():
            conf.set(key, value)
