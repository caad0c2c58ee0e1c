"""Texts of many calls in few files: a sink with a two-phase commit, and its reader.

Each task writes the texts and segments of its calls one after the other into a file of its own, and beside it an index of where
each call's lie.  The driver gets a line per task and makes the whole write visible with one small file that names the tasks'
files; until then, and if a task fails for good, nothing is there, and what failed tasks left is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from hearken.sources.recordings import store_of

SCHEMA = "call_id string, transcript string, segments string"
INDEX = "call_id string, at long, text_bytes long, segments_bytes long"
COMMITS, BODIES, INDEXES = "_commits", "bodies", "indexes"


@dataclass
class Written(WriterCommitMessage):
    """A task's file and how many calls it holds."""

    name: str
    calls: int


class BundleWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def place(self, *parts: str) -> tuple[fs.FileSystem, str]:
        store, root = store_of(self.path)
        return store, "/".join([root.rstrip("/"), *parts])

    def write(self, rows: Iterator) -> Written:
        """One attempt of a task; each has a name of its own, so that a repeated one meets nothing of the first."""
        name = f"{self.job}-{uuid.uuid4().hex}"
        store, root = self.place()
        for folder in (BODIES, INDEXES):
            store.create_dir(f"{root}/{folder}", recursive=True)
        calls = at = 0
        with store.open_output_stream(f"{root}/{BODIES}/{name}.txt") as body, store.open_output_stream(f"{root}/{INDEXES}/{name}.json") as index:
            for row in rows:
                text, segments = (row.transcript or "").encode(), (row.segments or "").encode()
                body.write(text + b"\n" + segments + b"\n")
                index.write((json.dumps({"call_id": row.call_id, "at": at, "text_bytes": -1 if row.transcript is None else len(text), "segments_bytes": -1 if row.segments is None else len(segments)}, ensure_ascii=False) + "\n").encode())
                at += len(text) + len(segments) + 2
                calls += 1
        return Written(name, calls)

    def commit(self, messages: list[Written | None]) -> None:
        kept = [m for m in messages if m is not None]
        store, root = self.place()
        store.create_dir(f"{root}/{COMMITS}", recursive=True)
        before = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/{COMMITS}")) if f.path.endswith(".json")] if self.overwrite else []
        with store.open_output_stream(f"{root}/{COMMITS}/{self.job}.tmp") as out:
            out.write("".join(json.dumps({"name": m.name, "calls": m.calls}) + "\n" for m in kept).encode())
        store.move(f"{root}/{COMMITS}/{self.job}.tmp", f"{root}/{COMMITS}/{self.job}.json")
        for path in before:
            store.delete_file(path)
        self.clear({m.name for m in kept})

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(set())

    def clear(self, kept: set[str]) -> None:
        """Delete what this job's other attempts left."""
        store, root = self.place()
        for folder in (BODIES, INDEXES):
            for f in store.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)):
                name = f.base_name.rpartition(".")[0]
                if name.startswith(self.job) and name not in kept:
                    store.delete_file(f.path)


class Bundles(DataSource):
    """``df.write.format("bundles").mode("append").save(path)`` for rows of SCHEMA; ``overwrite`` hides all earlier ones.

    The path must be in a store that the executors reach: a shared folder, or an address that Arrow opens.
    """

    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options, overwrite)


def write_bundles(calls: DataFrame, path: str, mode: str = "append") -> None:
    """The stripped transcripts of calls and their segments as JSON lines, whole or not at all.

    There are as many files as tasks, however many calls; null transcripts stay null, and no segments are an empty text.
    """
    calls.sparkSession.dataSource.register(Bundles)
    lines = F.array_join(F.transform("reference_segments", lambda s: F.to_json(s)), "\n")
    rows = calls.select(F.col("call_id").cast("string").alias("call_id"), F.trim("raw_transcript").alias("transcript"), lines.alias("segments"))
    rows.write.format("bundles").mode(mode).save(path)


def bundle_index(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, at, text_bytes, segments_bytes, name) of all committed calls."""
    path = path.rstrip("/")
    names = spark.read.schema("name string, calls long").json(f"{path}/{COMMITS}/*.json")
    rows = spark.read.schema(INDEX).json(f"{path}/{INDEXES}").withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.join(names.select("name"), "name", "left_semi")


def read_bundles(index: DataFrame, path: str) -> DataFrame:
    """SCHEMA of the calls in an index, or part of one; only their bytes are read, and a file is opened once per batch."""
    path = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        for batch in batches:
            done = []
            for name, rows in by_name(batch.to_pylist()).items():
                with store.open_input_file(f"{root}/{BODIES}/{name}.txt") as body:
                    for r in rows:
                        body.seek(r["at"])
                        text = body.read(max(r["text_bytes"], 0))
                        body.seek(r["at"] + len(text) + 1)
                        segments = body.read(max(r["segments_bytes"], 0))
                        done.append((r["call_id"], None if r["text_bytes"] < 0 else text.decode(), None if r["segments_bytes"] < 0 else segments.decode()))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["call_id", "transcript", "segments"])

    return index.select("call_id", "at", "text_bytes", "segments_bytes", "name").mapInArrow(run, SCHEMA)


def by_name(rows: list[dict]) -> dict[str, list[dict]]:
    found: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["at"])):
        found.setdefault(r["name"], []).append(r)
    return found
