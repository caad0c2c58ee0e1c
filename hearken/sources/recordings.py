"""Long recordings: a data source whose partitions are byte ranges of WAV files, cut at tiles.

The driver lists files with their sizes and opens none.  A task reads a file's header and then the tiles that begin in its range,
one at a time, so a recording of any length is read by many tasks and held by none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hearken.functions.resample import resampled_part, size_after
from hearken.sources.audio import RATE, encoded_wav, mono_samples

SCHEMA = "filename string, chunk_index int, total_chunks int, start double, end double, wav binary, error string"
#: Bytes of a recording per task, unless the option ``bytes`` says otherwise.
BYTES = 64 << 20
# Formats of PCM in a WAV header; the second names the first in an extension.
PCM, EXTENSIBLE = 1, 0xFFFE


class NotPcm(ValueError):
    """A file that is no WAV of whole-number PCM."""


@dataclass(frozen=True)
class Range(InputPartition):
    """A recording's bytes from first to last - 1; tiles that begin there belong to it."""

    path: str
    size: int
    first: int
    last: int


@dataclass(frozen=True)
class Layout:
    """Where a WAV's samples are."""

    offset: int
    frames: int
    rate: int
    channels: int
    width: int

    @classmethod
    def of(cls, file, size: int) -> Layout:
        """From a file's chunks.  A length that runs beyond the file, as recorders leave it when cut off, ends with the file."""
        head = file.read(12)
        if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
            raise NotPcm("file does not start with RIFF id")
        at, form = 12, None
        while at + 8 <= size:
            file.seek(at)
            name, length = struct.unpack("<4sI", file.read(8))
            at += 8
            if name == b"fmt ":
                form = struct.unpack("<HHIIHH", file.read(16))
                if form[0] == EXTENSIBLE and length >= 26:
                    file.seek(at + 24)
                    form = (*struct.unpack("<H", file.read(2)), *form[1:])
            elif name == b"data":
                if form is None or form[0] != PCM or form[5] % 8 or not 8 <= form[5] <= 32 or not form[1] or not form[2]:
                    raise NotPcm(f"unknown format: {form and form[0]}")
                width = form[5] // 8
                return cls(at, min(length if length else size, size - at) // (width * form[1]), form[2], form[1], width)
            at += length + length % 2
        raise NotPcm("fmt chunk and/or data chunk missing")


def tiles(file, part: Range, seconds: float) -> Iterator[tuple]:
    """Rows of the tiles that begin in a range."""
    lay = Layout.of(file, part.size)
    step = lay.width * lay.channels

    def between(a: int, b: int) -> np.ndarray:
        file.seek(lay.offset + a * step)
        return mono_samples(file.read((b - a) * step), lay.width, lay.channels)

    total, size = size_after(lay.frames, lay.rate, RATE), max(1, int(RATE * seconds))
    count = -(-total // size)
    begins = lambda k: lay.offset + k * size * lay.rate // RATE * step
    # The first tile belongs to the header's range; the first one not before another range is near its place.
    k = 0 if part.first == 0 else max(1, (part.first - lay.offset) // step * RATE // (lay.rate * size) - 1)
    while 0 < k < count and begins(k) < part.first:
        k += 1
    while k < count and (begins(k) < part.last or k == 0):
        first, last = k * size, min((k + 1) * size, total)
        made = resampled_part(between, lay.frames, lay.rate, RATE, first, last).astype(np.float32)
        yield part.path, k + 1, count, first / RATE, last / RATE, encoded_wav(made), None
        k += 1


class RecordingReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.seconds, self.bytes = options["path"], float(options.get("seconds", "30")), int(options.get("bytes", str(BYTES)))
        if self.seconds <= 0 or self.bytes <= 0:
            raise ValueError("seconds and bytes must be positive")

    def partitions(self) -> list[Range]:
        store, path = store_of(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        named = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))
        return [Range(p, n, a, min(a + self.bytes, n)) for p, n in named for a in range(0, max(n, 1), self.bytes)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.string()]
        names = ["filename", "chunk_index", "total_chunks", "start", "end", "wav", "error"]
        batch = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)
        with store.open_input_file(part.path) as file:
            try:
                for row in tiles(file, part, self.seconds):
                    yield batch(row)
            except NotPcm as problem:
                if part.first == 0:  # told once
                    yield batch((part.path, None, None, None, None, None, f"{type(problem).__name__}: {problem}"))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Recordings(DataSource):
    """``spark.read.format("recordings").option("seconds", 30).load(path)``: tiles of the WAV files below a path.

    The path must be in a store that the executors reach: a shared folder, or an address that Arrow opens.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


def recording_tiles(spark: SparkSession, path: str, seconds: float = 30.0, part_bytes: int = BYTES) -> DataFrame:
    """Rows as those of ``audio_chunks``, for recordings of any length; a file that is no PCM WAV gives one row with an error."""
    spark.dataSource.register(Recordings)
    return spark.read.format("recordings").option("seconds", str(seconds)).option("bytes", str(part_bytes)).load(path)
