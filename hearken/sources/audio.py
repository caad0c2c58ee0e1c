"""Uploaded audio: validation by name, type and leading bytes; decoding and encoding of PCM WAV."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions.resample import resampled

RATE = 16_000
# Content types accepted for each suffix.
TYPES = {".wav": ("audio/wav", "audio/x-wav", "audio/wave"), ".mp3": ("audio/mpeg", "audio/mp3"), ".m4a": ("audio/mp4", "audio/x-m4a", "video/mp4")}


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with their bytes: filename, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("filename"), "content")


def upload_error(filename: Column, content_type: Column, content: Column) -> Column:
    """The error code of an upload, null if it is accepted.  Name first, then emptiness, then bytes and type."""
    name = F.substring_index(F.coalesce(filename, F.lit("")), "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))
    start = F.hex(F.substring(content, F.lit(1), F.lit(32)))
    at = lambda first, n: F.substring(start, 2 * first + 1, 2 * n)
    wav = (F.length(content) >= 12) & (at(0, 4) == "52494646") & (at(8, 4) == "57415645")
    mp3 = (at(0, 3) == "494433") | at(0, 2).isin("FFFB", "FFF3", "FFF2")
    # A hit must start at a whole byte.
    m4a = start.rlike("^(..)*66747970")
    fits = F.lit(False)
    for kind, marked in ((".wav", wav), (".mp3", mp3), (".m4a", m4a)):
        fits = F.when(suffix == kind, marked & F.coalesce(content_type.isin(*TYPES[kind]), F.lit(False))).otherwise(fits)
    return (
        F.when(~suffix.isin(*TYPES), "AUDIO.UNSUPPORTED_FORMAT").when(F.coalesce(F.length(content), F.lit(0)) == 0, "AUDIO.EMPTY")
        .when(~fits, "AUDIO.INVALID_FORMAT")
    )


def mono_samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Whole PCM frames of so many bytes a sample as floats, channels averaged."""
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        samples = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return samples.reshape(-1, channels).mean(axis=1, dtype=np.float32)


def decoded_wav(blob: bytes) -> np.ndarray:
    """Mono float samples at 16 kHz.  Channels are averaged, other rates are resampled."""
    with wave.open(io.BytesIO(blob)) as sound:
        width, channels, rate = sound.getsampwidth(), sound.getnchannels(), sound.getframerate()
        raw = sound.readframes(sound.getnframes())
    return resampled(mono_samples(raw, width, channels), rate, RATE)


def resampled_column(samples: Column, rate: int, to: int = RATE) -> Column:
    """An array of samples at another rate."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            made = [resampled(x.values.to_numpy(zero_copy_only=False), rate, to) if x.is_valid else None for x in column]
            yield pa.array(made, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(samples.cast("array<double>"))


def encoded_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """PCM of 16 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(2)
        sound.setframerate(rate)
        sound.writeframes((np.clip(np.round(np.asarray(samples, dtype=np.float64) * 32768), -32768, 32767)).astype("<i2").tobytes())
    return out.getvalue()


def audio_chunks(files: DataFrame, seconds: float = 30.0, decoders: Mapping[str, Callable[[bytes], np.ndarray]] | None = None) -> DataFrame:
    """(filename, chunk_index, total_chunks, start, end, wav, error) of files (filename, content), a row per tile.

    ``decoders`` turn the bytes of files by their lower-case suffix into mono samples at RATE, which is how compressed formats
    are plugged in; what has no decoder is read as PCM WAV.  A file that cannot be decoded gives one row with an error and
    no audio; an empty one gives none.
    """
    known = dict(decoders or {})
    size = max(1, int(RATE * seconds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["filename", "chunk_index", "total_chunks", "start", "end", "wav", "error"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.string()]
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                decode = known.get(f".{(name or '').rpartition('.')[2].lower()}", decoded_wav)
                try:
                    samples = decode(blob.as_py() or b"")
                except (wave.Error, EOFError, ValueError) as problem:
                    rows = [(name, None, None, None, None, None, f"{type(problem).__name__}: {problem}")]
                else:
                    firsts = range(0, len(samples), size)
                    rows = [(name, k + 1, len(firsts), at / RATE, min(at + size, len(samples)) / RATE, encoded_wav(samples[at : at + size]), None) for k, at in enumerate(firsts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return files.select("filename", "content").mapInArrow(run, "filename string, chunk_index int, total_chunks int, start double, end double, wav binary, error string")
