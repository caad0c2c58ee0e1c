"""Calls rolled up in the stream: with the last chunk, across restarts, repeats, and calls that never end."""

import time

import pytest
from pyspark.sql import functions as F

from hearken.functions.correct import Rule
from hearken.operators import calls
from hearken.plans.engine import Engine
from hearken.streaming import calls as streaming
from hearken.streaming import rollup

RULES = (Rule("r1", "aa", "b", "s"),)
READ = calls.per_tile(lambda t: F.array(F.lit(0.0), F.length(t) / 10.0))
BAD = "아아 아아 아아 아아 아아"


def prepare(df):
    return calls.prepared(df, RULES, READ)


def chunk(call, k, n, text):
    return (call, k, n, 30.0 * k, 30.0 * k + 30, text)


@pytest.fixture
def place(spark, tmp_path):
    """Writes files of chunks one by one, and runs the stream over what is there."""

    class Place:
        log, out = f"{tmp_path}/log", f"{tmp_path}/out"

        def add(self, rows):
            spark.createDataFrame(rows, streaming.CHUNKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

        def start(self, of=prepare, **options):
            spark.conf.set("spark.sql.shuffle.partitions", "1")  # each batch starts a worker for each
            try:
                return rollup.run_calls(streaming.chunk_stream(spark, f"{tmp_path}/in"), of, self.out, self.log, **options)
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", "4")

        def rows(self):
            return {r.call_id: r for r in spark.read.parquet(self.out).collect()}

        def state(self, name):
            before = spark.conf.get(rollup.PROVIDER)
            spark.conf.set(rollup.PROVIDER, rollup.ROCKSDB)
            try:
                return spark.read.format("statestore").option("stateVarName", name).load(self.log).count()
            finally:
                spark.conf.set(rollup.PROVIDER, before)

    return Place()


def test_rows_leave_with_the_last_chunk_and_survive_a_restart(spark, place):
    place.add([chunk(1, 1, 2, "second aa"), chunk(2, 0, 1, "alone aa aa")])
    place.add([chunk(3, 0, 3, BAD), chunk(3, 2, 3, "third"), chunk(4, 0, 1, BAD)])
    place.start().awaitTermination()
    assert sorted(place.rows()) == [2, 4] and place.state("chunks") == 3
    place.add([chunk(1, 0, 2, "first of one"), chunk(3, 1, 3, None)])
    place.start().awaitTermination()
    got = place.rows()
    assert sorted(got) == [1, 2, 3, 4] and spark.read.parquet(place.out).count() == 4
    every = [chunk(1, 1, 2, "second aa"), chunk(2, 0, 1, "alone aa aa"), chunk(3, 0, 3, BAD), chunk(3, 2, 3, "third"), chunk(4, 0, 1, BAD), chunk(1, 0, 2, "first of one"), chunk(3, 1, 3, None)]
    batch = {r.call_id: r for r in calls.analyze(spark.createDataFrame(every, streaming.CHUNKS), RULES, READ).collect()}
    for call, row in batch.items():
        told = got[call].asDict()
        assert told.pop("missing_chunks") == 0 and told.pop("error_code") is None
        assert told == row.asDict(), call
    assert place.state("chunks") == 0  # texts are dropped as a call leaves


def test_calls_larger_than_what_is_held(place, monkeypatch):
    monkeypatch.setattr(rollup, "FRESH", 2)
    place.add([chunk(1, k, 5, f"t{k}") for k in (3, 0, 3, 4)] + [chunk(2, k, 2, f"u{k}") for k in range(2)] + [chunk(3, k, 3, f"v{k}") for k in range(3)])
    place.start().awaitTermination()
    assert sorted(place.rows()) == [2, 3] and place.state("chunks") == 3
    place.add([chunk(1, k, 5, f"t{k}") for k in (1, 0, 2)])
    place.start().awaitTermination()
    assert {c: r.raw_transcript for c, r in place.rows().items()} == {1: "t0 t1 t2 t3 t4", 2: "u0 u1", 3: "v0 v1 v2"} and place.state("chunks") == 0


def test_repeated_chunks_count_once(place):
    place.add([chunk(1, 0, 2, "a first"), chunk(1, 0, 2, "a first")])
    place.add([chunk(1, 0, 2, "a first")])
    place.start().awaitTermination()
    assert place.state("chunks") == 1
    place.add([chunk(1, 1, 2, "then")])
    place.add([chunk(1, 1, 2, "then"), chunk(1, 0, 2, "a first")])  # after the call has left
    place.start().awaitTermination()
    assert place.rows()[1].raw_transcript == "a first then" and place.state("chunks") == 0 and place.state("call") == 1


def test_calls_that_never_end_leave_with_an_error(spark, place):
    place.add([chunk(1, 0, 2, "only half"), chunk(2, 0, None, "of how many"), chunk(3, 0, 1, "whole")])
    query = place.start(patience=1.0, seconds=0.3)
    until = time.time() + 60
    while time.time() < until and (query.lastProgress is None or len(place.rows() if place_has_rows(spark, place) else {}) < 3):
        time.sleep(0.5)
    time.sleep(2)
    query.stop()
    got = place.rows()
    assert (got[1].error_code, got[1].classification_status, got[1].label, got[1].suspicion_score, got[1].missing_chunks) == ("ANALYSIS.FAILED", "failed", None, None, 1)
    assert got[2].error_code == "ANALYSIS.FAILED" and got[2].missing_chunks is None and got[1].raw_transcript == "only half"
    assert got[3].error_code is None and got[3].label is not None
    assert place.state("call") == 0  # marks go too


def place_has_rows(spark, place):
    try:
        return spark.read.parquet(place.out).count() > 0
    except Exception:
        return False


def settled(spark, true):
    until = time.time() + 30
    while time.time() < until and not true():
        time.sleep(0.2)
    assert true()


def test_progress_is_observed_and_failure_reported_once(spark, place):
    told, failures = [], []
    progress = rollup.Progress(told.append, failures.append)
    spark.streams.addListener(progress)
    try:
        place.add([chunk(1, 0, 2, "aa"), chunk(1, 1, 2, BAD)])
        place.add([chunk(2, 0, 1, "more words")])
        place.start().awaitTermination()
        settled(spark, lambda: len(told) == 2)
        batch = prepare(spark.read.parquet(place.out.replace("/out", "/in")))
        sums = streaming.progress_counts(batch).agg(*[F.sum(c).alias(c) for c in rollup.COUNTS]).first()
        assert {c: told[-1][c] for c in rollup.COUNTS} == sums.asDict() and told[-1]["batches"] == 2
        assert all(a[c] <= b[c] for a, b in zip(told, told[1:]) for c in rollup.COUNTS) and not failures
        place.add([chunk(9, 0, 1, " ")])
        query = place.start(of=lambda df: calls.prepared(df, RULES, READ, strict=True))
        with pytest.raises(Exception, match="must not be blank"):
            query.awaitTermination()
        settled(spark, lambda: len(failures) == 1)
        assert "must not be blank" in failures[0]
    finally:
        spark.streams.removeListener(progress)


def test_batches_are_as_large_as_the_source_admits(spark, place, tmp_path):
    """One file a batch, and the next only when that one is written."""
    for call, n in ((1, 3), (2, 1), (3, 2)):
        place.add([chunk(call, k, n, f"words {k}") for k in range(n)])
    engine = Engine(scorer=READ, rules=RULES)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        query = engine.analyze_stream(streaming.chunk_stream(spark, f"{tmp_path}/in"), place.out, place.log)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    query.awaitTermination()
    assert sorted(p.numInputRows for p in query.recentProgress) == [1, 2, 3]
    assert {c: r.error_code for c, r in place.rows().items()} == {1: None, 2: None, 3: None}
    with pytest.raises(ValueError):
        Engine().analyze_stream(streaming.chunk_stream(spark, f"{tmp_path}/in"), place.out, place.log)
