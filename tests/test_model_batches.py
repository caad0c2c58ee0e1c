"""Batches that a model gets, from many rows, and the profile of its step."""

import random

import pytest
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from hearken.functions.scoring import Filled, ModelScorer
from hearken.sources.transcribe import transcripts


def test_answers_return_to_their_rows_in_order():
    rng = random.Random(0)
    for batch in (1, 3, 8):
        sizes, seen = [], []

        def model(texts):
            seen.append(len(texts))
            return [[float(t), -float(t)] for t in texts]

        filled, given = Filled(model, batch), 0
        for _ in range(50):
            n = rng.choice([0, 0, 1, 2, 5, 17])
            filled.add([str(k) for k in range(given, given + n)])
            given += n
            sizes.append(n)
        filled.flush()
        got = [filled.take(n) for n in sizes]
        assert [x[0] for part in got for x in part] == list(range(given)) and not filled.answers
        assert set(seen[:-1]) == {batch} and sum(seen) == given


def test_batches_are_full_across_rows_and_record_batches(spark):
    """Forty rows of one to three tiles, read four at a time: all batches of a task but the last hold eight texts."""

    def load():
        def model(texts):
            return [[float(len(texts)), float(t.split()[1])] for t in texts]

        return model

    rows = [(k, None if k % 9 == 4 else [f"w {k * 10 + i}" for i in range(k % 4)]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, tiles array<string>").coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "4")
    try:
        got = {r.k: r.logits for r in ModelScorer(load).add(df, F.col("tiles"), "logits").collect()}
    finally:
        spark.conf.set(size, before)
    assert {k: None if x is None else [int(v[1]) for v in x] for k, x in got.items()} == {k: None if t is None else [int(w.split()[1]) for w in t] for k, t in rows}
    total = sum(len(t or ()) for _, t in rows)
    filled = [v[0] for k in sorted(got) for v in got[k] or ()]
    assert len(filled) == total and filled[: total - total % 8] == [8.0] * (total - total % 8) and set(filled[total - total % 8 :]) <= {float(total % 8)}


def test_profile_is_in_the_plan(spark):
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", 0.25)).build
    df = spark.createDataFrame([(0, ["a b"])], "k int, tiles array<string>")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    scored = ModelScorer(lambda: None, profile=profile).add(df, F.col("tiles"), "logits")
    assert "gpu" in plan(scored) and "gpu" not in plan(ModelScorer(lambda: None).add(df, F.col("tiles"), "logits"))
    files = spark.createDataFrame([("a", bytearray(b"x"))], "filename string, content binary")
    assert "gpu" in plan(transcripts(files, lambda: None, profile=profile))


def test_blank_texts_are_errors(spark):
    df = spark.createDataFrame([(0, [" "])], "k int, tiles array<string>")
    with pytest.raises(Exception, match="must not be blank"):
        ModelScorer(lambda: list).add(df, F.col("tiles"), "logits").collect()
