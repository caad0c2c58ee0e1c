"""Texts of many calls in few files: round trips, commits, and failed tasks that leave nothing."""

import os

import pytest
from pyspark.sql import functions as F

from hearken.sources.bundles import bundle_index, read_bundles, write_bundles

SCHEMA = "call_id string, raw_transcript string, reference_segments array<struct<start:double,end:double,transcript:string,suspicion_score:double>>"


def calls(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def files(path, folder):
    return sorted(os.listdir(f"{path}/{folder}")) if os.path.isdir(f"{path}/{folder}") else []


def test_round_trip_in_as_many_files_as_tasks(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = [(f"c{k}", f" 통화 {k}\nnext \"line\" ", [(0.0, 1.5, f"말 {k}", 0.5)] * (k % 3)) for k in range(200)] + [("none", None, None), ("empty", "", []), (None, "no id", [])]
    write_bundles(calls(spark, rows), path)
    assert len(files(path, "bodies")) == len(files(path, "indexes")) == 3 and len(files(path, "_commits")) == 1
    got = {r.call_id: r for r in read_bundles(bundle_index(spark, path), path).collect()}
    assert len(got) == 203 and got["c7"].transcript == "통화 7\nnext \"line\""
    assert got["c8"].segments.split("\n") == ['{"start":0.0,"end":1.5,"transcript":"말 8","suspicion_score":0.5}'] * 2 and got["c9"].segments == ""
    assert (got["none"].transcript, got["none"].segments) == (None, None) and (got["empty"].transcript, got["empty"].segments) == ("", "")
    some = bundle_index(spark, path).where("call_id in ('c3', 'c5')")
    assert sorted(r.transcript[:4] for r in read_bundles(some, path).collect()) == ["통화 3", "통화 5"]


def test_appending_and_overwriting(spark, tmp_path):
    path = str(tmp_path / "b")
    ids = lambda: sorted(r.call_id for r in bundle_index(spark, path).collect())
    write_bundles(calls(spark, [("a", "x", [])]), path)
    write_bundles(calls(spark, [("b", "y", [])]), path)
    assert ids() == ["a", "b"]
    write_bundles(calls(spark, [("c", "z", [])]), path, mode="overwrite")
    assert ids() == ["c"] and [r.transcript for r in read_bundles(bundle_index(spark, path), path).collect()] == ["z"]
    write_bundles(calls(spark, []), path)
    assert ids() == ["c"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "b")
    write_bundles(calls(spark, [("a", "x", [])], 1), path)
    kept = files(path, "bodies"), files(path, "indexes"), files(path, "_commits")
    rows = calls(spark, [(f"c{k}", f"text {k}", []) for k in range(40)], 4)
    broken = rows.withColumn("raw_transcript", F.when(F.col("call_id") == "c17", F.raise_error(F.lit("lost"))).otherwise(F.col("raw_transcript")))
    with pytest.raises(Exception, match="lost"):
        write_bundles(broken, path)
    assert (files(path, "bodies"), files(path, "indexes"), files(path, "_commits")) == kept
    assert [r.call_id for r in bundle_index(spark, path).collect()] == ["a"]
