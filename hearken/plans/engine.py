"""The engine: plug-ins in, calls out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearken.functions.correct import Rule, checked
from hearken.functions.quality import Gate
from hearken.functions.scoring import ModelScorer
from hearken.operators import calls
from hearken.operators.tiling import token_tiles
from hearken.session import work_folder
from hearken.sources.audio import audio_chunks
from hearken.sources.recordings import recording_tiles
from hearken.sources.transcribe import transcripts
from hearken.streaming.rollup import PATIENCE, run_calls

#: From (filename, chunk_index, total_chunks, start, end, wav) to the same with a transcript.
Transcriber = Callable[[DataFrame], DataFrame]


@dataclass
class Engine:
    """Holds what a deployment plugs in.  ``scorer`` maps arrays of texts to arrays of logit pairs, or wraps a Python model;
    ``tiler`` cuts texts into what the scorer takes, ``transcriber`` adds texts to rows of audio tiles, or ``speech`` loads a Python model that reads whole files.

    None is shipped: all are trained models.  Without a scorer the engine is not ready to analyse.
    """

    scorer: calls.TileScorer | ModelScorer | None = None
    transcriber: Transcriber | None = None
    rules: tuple[Rule, ...] = ()
    kinds: tuple[str, ...] = ("typo",)
    gate: Gate = field(default_factory=Gate)
    chunk_seconds: float = 30.0
    strict: bool = False
    speech: Callable[[], Any] | None = None
    decoders: dict[str, Callable[[bytes], Any]] = field(default_factory=dict)
    tiler: Callable[[Column], Column] = token_tiles

    def __post_init__(self) -> None:
        self.rules = checked(self.rules)

    def status(self) -> dict[str, object]:
        part = lambda x: "ready" if x is not None else "not_ready"
        stt = part(self.transcriber if self.transcriber is not None else self.speech)
        return {"stt": stt, "classifier": part(self.scorer), "analyzable": stt == part(self.scorer) == "ready"}

    def analyze(self, chunks: DataFrame) -> DataFrame:
        if self.scorer is None:
            raise ValueError("no scorer is plugged in")
        return calls.analyze(chunks, self.rules, self.scorer, self.gate, self.kinds, self.strict, self.tiler)

    def analyze_whole(self, transcripts: DataFrame) -> DataFrame:
        if self.scorer is None:
            raise ValueError("no scorer is plugged in")
        return calls.analyze_whole(transcripts, self.rules, self.scorer, self.gate, self.kinds, self.tiler)

    def analyze_with_progress(self, chunks: DataFrame, report_stage: Callable[[str], None], report_progress: Callable[[dict], None] | None = None) -> DataFrame:
        """``analyze`` that reports: each stage as it begins, and the counts of chunks once they are prepared.

        The prepared chunks are written to the shared folder, so what is reported has happened.
        """
        if self.scorer is None:
            raise ValueError("no scorer is plugged in")
        for stage in ("normalizing", "classifying"):
            report_stage(stage)
        spark = chunks.sparkSession
        path = f"{work_folder(spark, 'prepared')}/chunks"
        calls.prepared(chunks, self.rules, self.scorer, self.gate, self.kinds, self.strict, self.tiler).write.parquet(path)
        rows = spark.read.parquet(path)
        if report_progress is not None:
            done = rows.agg(F.count("*").alias("transcribed_chunks"), F.count("normalized").alias("normalized_chunks"), F.count("result").alias("classified_chunks"), F.count("*").alias("total_chunks"))
            report_progress(done.first().asDict())
        report_stage("finalizing")
        return calls.rolled_up_calls(rows)

    def analyze_stream(self, chunks: DataFrame, out: str, checkpoint: str, patience: float = PATIENCE, seconds: float | None = None) -> StreamingQuery:
        """A stream of chunks with ``total_chunks`` to rows of calls in ``out``, each as its last chunk comes (``run_calls``)."""
        if self.scorer is None:
            raise ValueError("no scorer is plugged in")
        prepare = lambda df: calls.prepared(df, self.rules, self.scorer, self.gate, self.kinds, self.strict, self.tiler)
        return run_calls(chunks, prepare, out, checkpoint, patience, seconds)

    def analyze_recordings(self, spark: SparkSession, path: str) -> DataFrame:
        """WAV recordings of any length below a path to calls named by file; many tasks read one."""
        if self.transcriber is None:
            raise ValueError("no transcriber of tiles is plugged in")
        heard = self.transcriber(recording_tiles(spark, path, self.chunk_seconds).where("error is null"))
        return self.analyze(heard.withColumnRenamed("filename", "call_id"))

    def analyze_audio(self, files: DataFrame) -> DataFrame:
        """Files (filename, content) to calls named by file.  Files of which a model gives one text only are analysed whole."""
        if self.transcriber is not None:
            heard = self.transcriber(audio_chunks(files, self.chunk_seconds, self.decoders).where("error is null"))
            return self.analyze(heard.withColumnRenamed("filename", "call_id"))
        if self.speech is None:
            raise ValueError("no transcriber is plugged in")
        heard = transcripts(files, self.speech)
        return self.analyze(heard.where("not whole").drop("whole")).unionByName(self.analyze_whole(heard.where("whole").select("call_id", "transcript")))


def with_rules(engine: Engine, rules: Iterable[Rule]) -> Engine:
    return replace(engine, rules=tuple(rules))
