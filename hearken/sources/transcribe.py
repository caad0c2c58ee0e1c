"""Speech-to-text plug-ins: Python models that read audio bytes, loaded once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The one language that the engine's texts are in.
LANGUAGE = "ko"
HEARD = "call_id string, chunk_index long, total_chunks int, start double, end double, transcript string, whole boolean"


def heard_by(model: Any, audio: bytes) -> Iterator[tuple[int, int, float | None, float | None, str]]:
    """(index, total, start, end, text) by the fullest form that a model has: a stream of chunks, a list of them, or one text.

    ``transcribe_chunks_stream`` yields (index, total, (start, end, text)), ``transcribe_chunks`` returns (start, end, text) triples,
    ``transcribe``, or the model itself if it can be called, returns a text.  The last form has no times.
    """
    if hasattr(model, "transcribe_chunks_stream"):
        for index, total, (start, end, text) in model.transcribe_chunks_stream(audio):
            yield index, total, start, end, text
    elif hasattr(model, "transcribe_chunks"):
        found = list(model.transcribe_chunks(audio))
        for index, (start, end, text) in enumerate(found, 1):
            yield index, len(found), start, end, text
    else:
        yield 1, 1, None, None, getattr(model, "transcribe", model)(audio)


def transcripts(files: DataFrame, load: Callable[[], Any], strict: bool = True, profile: ResourceProfile | None = None) -> DataFrame:
    """HEARD of files (filename, content): a row per chunk, or one with ``whole`` set for a model that only gives one text.

    ``load`` builds the model, once per task.  A model for another language is an error, and so is audio without any chunk; blank
    texts are errors too unless ``strict`` is False.  With a ``profile`` the step runs on executors of that resource profile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        if (language := getattr(model, "language", LANGUAGE)) != LANGUAGE:
            raise ValueError(f"the model transcribes {language}, not {LANGUAGE}")
        whole = not (hasattr(model, "transcribe_chunks_stream") or hasattr(model, "transcribe_chunks"))
        for batch in batches:
            for name, audio in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, index, total, start, end, text, whole) for index, total, start, end, text in heard_by(model, audio or b"")]
                if not rows:
                    raise ValueError(f"no speech was found in {name}")
                if strict and any(not (row[5] or "").strip() for row in rows):
                    raise ValueError(f"an empty transcript of {name}")
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["call_id", "chunk_index", "total_chunks", "start", "end", "transcript", "whole"])

    return files.select(F.col("filename").cast("string"), "content").mapInArrow(run, HEARD, profile=profile)
