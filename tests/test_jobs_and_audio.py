import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearken.operators import calls, jobs
from hearken.plans.engine import Engine
from hearken.plans.settings import Settings, loaded
from hearken.sources import audio, transcribe
from hearken.streaming import calls as streaming


def test_rate_limit(spark):
    rows = [("o1", float(t), k) for k, t in enumerate((0, 1, 2, 59, 60, 61))] + [("o2", 0.0, 9), (None, 5.0, 10)]
    asked = spark.createDataFrame(rows, "owner_key string, seconds double, request_id long")
    got = {r.request_id: r.allowed for r in jobs.rate_limited(asked, 2, 60.0).collect()}
    assert [got[k] for k in range(6)] == [True, True, False, False, True, True] and got[9] and got[10]


def test_jobs(spark):
    events = [
        ("a", 1, "create", None, None, None), ("a", 2, "update", "completed", "completed", None), ("a", 3, "update", "running", "preprocessing", None), ("a", 4, "update", "running", "queued", None),
        ("a", 5, "update", "running", "classifying", 70), ("a", 6, "update", "running", "classifying", 101), ("a", 7, "update", "failed", "failed", None), ("a", 8, "cancel", None, None, None), ("a", 9, "update", "failed", "failed", None),
        ("b", 1, "create", None, None, None), ("b", 2, "cancel", None, None, None), ("b", 3, "update", "running", "queued", None), ("c", 1, "update", "running", "queued", None),
    ]
    rows = jobs.job_states(spark.createDataFrame(events, "job_id string, seq long, op string, status string, stage string, progress int")).orderBy("job_id", "seq").collect()
    assert [r.accepted for r in rows] == [True, False, True, False, True, False, True, False, True, True, True, False, False]
    assert (rows[8].now_status, rows[8].now_progress) == ("failed", 70) and rows[10].now_status == "cancelled" and rows[12].now_status is None


def test_job_fold_keeps_result_error_and_metadata(spark):
    events = [
        ("a", 1, "create", None, None, None, None, None, None), ("a", 2, "update", "running", "classifying", 70, "early", "x", {"total": "3"}), ("a", 3, "update", "completed", "completed", None, "done", "x", None),
        ("a", 4, "update", "completed", "completed", None, None, None, {"total": "4"}), ("b", 1, "create", None, None, None, None, None, None), ("b", 2, "update", "failed", "failed", None, "r", "ANALYSIS.FAILED", None),
        ("c", 1, "create", None, None, None, None, None, None), ("c", 2, "update", "running", "queued", None, None, None, {"k": "v"}), ("c", 3, "cancel", None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(events, "job_id string, seq long, op string, status string, stage string, progress int, result string, error string, metadata map<string,string>")
    states = jobs.job_states(frame)
    rows = states.orderBy("job_id", "seq").collect()
    assert all(r.accepted for r in rows)
    assert [(r.now_result, r.now_error, r.now_metadata) for r in rows] == [
        (None, None, {}), (None, None, {"total": "3"}), ("done", None, {"total": "3"}), (None, None, {"total": "4"}), (None, None, {}), (None, "ANALYSIS.FAILED", {}), (None, None, {}), (None, None, {"k": "v"}), (None, None, {"k": "v"}),
    ]
    latest = {r.job_id: r for r in jobs.latest_jobs(states).collect()}
    assert (latest["b"].status, latest["b"].error_code, latest["b"].progress) == ("failed", "ANALYSIS.FAILED", 0) and latest["c"].status == "cancelled"


def test_admissions(spark):
    rows = [
        (1, "j1", "analyze", None, True), (2, "j2", "analyze", None, True), (3, "j2", "finish", None, True), (4, "j1", "finish", None, True), (5, "j1", "finish", None, True),
        (6, "j3", "analyze", None, False), (7, "j4", "analyze", "AUDIO.EMPTY", True), (8, "j5", "analyze", None, True), (9, "j6", "analyze", None, True),
    ]
    asked = spark.createDataFrame([("o", float(k), k, j, op, e, r) for k, j, op, e, r in rows], "owner_key string, seconds double, request_id long, job_id string, op string, error string, ready boolean")
    got = {r.request_id: r.outcome for r in jobs.admissions(asked, 4, 60.0).collect()}
    assert got == {1: "queued", 2: "JOB.DUPLICATE", 3: "not_held", 4: "released", 5: "not_held", 6: "MODEL.NOT_READY", 7: "AUDIO.EMPTY", 8: "queued", 9: "SERVICE.RATE_LIMITED"}


def test_views_and_codes(spark):
    assert jobs.error_codes(spark).count() == 12
    rows = spark.createDataFrame([("a", "failed", "failed", 30, None, None, {}), ("b", "running", "queued", 0, None, None, {"t": "1"}), ("c", "completed", "completed", 100, None, "r", {})], "job_id string, status string, stage string, progress int, error_code string, result string, metadata map<string,string>")
    assert {r.job_id: (r.error_code, r.result) for r in jobs.result_view(rows).collect()} == {"a": ("ANALYSIS.FAILED", None), "b": ("JOB.NOT_COMPLETED", None), "c": (None, "r")}
    assert {r.job_id: r.progress_details for r in jobs.status_view(rows).collect()} == {"a": None, "b": {"t": "1"}, "c": None}


def test_shown_progress(spark):
    rows = spark.createDataFrame([("a", 1, "classifying", 70), ("a", 2, "transcribing", 33), ("a", 3, "unknown", 80)], "job_id string, seq int, stage string, progress int")
    assert [(r.shown_progress, r.shown_stage) for r in jobs.shown_progress(rows).orderBy("seq").collect()] == [(70, "classifying"), (70, "classifying"), (80, "classifying")]


def test_uploads(spark):
    wav = b"RIFF\0\0\0\0WAVE" + bytes(8)
    rows = [
        ("call.txt", "text/plain", b"x", "AUDIO.UNSUPPORTED_FORMAT"), (None, None, b"x", "AUDIO.UNSUPPORTED_FORMAT"), ("call.wav", "audio/wav", b"", "AUDIO.EMPTY"), ("call.wav", "audio/wav", b"not a wav", "AUDIO.INVALID_FORMAT"),
        ("d/call.WAV", "audio/wav", wav, None), ("call.wav", None, wav, "AUDIO.INVALID_FORMAT"), ("a.mp3", "audio/mp3", b"\xff\xf3x", None), ("a.m4a", "video/mp4", b"0000ftyp", None), ("a.m4a", "video/mp4", b"\x06\x67\x47\x97\x07", "AUDIO.INVALID_FORMAT"),
        (".wav", "audio/wav", wav, "AUDIO.UNSUPPORTED_FORMAT"),
    ]
    made = spark.createDataFrame([(k, n, t, bytearray(b)) for k, (n, t, b, _) in enumerate(rows)], "k int, n string, t string, b binary")
    got = made.select("k", audio.upload_error(F.col("n"), F.col("t"), F.col("b")).alias("e")).orderBy("k").collect()
    assert [r.e for r in got] == [r[3] for r in rows]


def test_wav_round_trip_and_chunks(spark, tmp_path):
    tone = np.sin(np.arange(16000) / 20).astype(np.float32) * 0.5
    assert np.abs(audio.decoded_wav(audio.encoded_wav(tone)) - tone).max() < 1e-4
    assert len(audio.decoded_wav(audio.encoded_wav(tone, 8000))) == 32000
    (tmp_path / "a.wav").write_bytes(audio.encoded_wav(tone))
    (tmp_path / "b.wav").write_bytes(b"junk")
    rows = audio.audio_chunks(audio.uploads(spark, str(tmp_path)), 0.4).orderBy("filename", "chunk_index").collect()
    assert [(r.chunk_index, r.total_chunks, r.start, r.end) for r in rows[:3]] == [(1, 3, 0.0, 0.4), (2, 3, 0.4, 0.8), (3, 3, 0.8, 1.0)]
    assert rows[3].error and rows[3].wav is None
    (tmp_path / "c.MP3").write_bytes(b"123")
    pressed = audio.audio_chunks(audio.uploads(spark, str(tmp_path)), 0.4, {".mp3": lambda blob: np.zeros(len(blob) * 1000, dtype=np.float32)}).where("filename like '%MP3'").collect()
    assert [(r.chunk_index, r.start, r.end) for r in pressed] == [(1, 0.0, 0.1875)]
    (tmp_path / "c.MP3").unlink()
    heard = lambda df: df.withColumn("transcript", F.concat(F.lit("part "), F.col("chunk_index").cast("string")))
    done = Engine(scorer=calls.per_tile(lambda t: F.array(F.lit(0.0), F.lit(1.0))), transcriber=heard, chunk_seconds=0.4).analyze_audio(audio.uploads(spark, str(tmp_path))).collect()
    assert len(done) == 1 and done[0].raw_transcript == "part 1 part 2 part 3"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, k, 3, 30.0 * k, 30.0 * k + 30, f"말 {c} {k} 송금") for c in range(4) for k in range(3)] + [(9, 0, 2, 0.0, 30.0, "끝나지 않은 통화")]
    made = spark.createDataFrame(rows, streaming.CHUNKS)
    for k in range(3):
        made.where(F.col("chunk_index") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    scorer = calls.per_tile(lambda t: F.array(F.lit(0.0), F.length(t).cast("double") - 8))
    prepare = lambda df: calls.prepared(df, (), scorer)
    streaming.run(streaming.chunk_stream(spark, str(tmp_path / "in")), prepare, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    prepared = spark.read.parquet(str(tmp_path / "out"))
    assert {r.call_id: r.classified_chunks for r in streaming.progress_counts(prepared).collect()}[9] == 1
    got = calls.rolled_up_calls(streaming.finished(prepared)).orderBy("call_id").collect()
    assert got == calls.analyze(made.where("call_id < 9"), (), scorer).orderBy("call_id").collect()


def test_rate_limited_stream(spark, tmp_path):
    for k, t in enumerate((0.0, 1.0, 2.0, 61.0)):
        spark.createDataFrame([("o", t, k)], "owner_key string, seconds double, request_id long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    asked = spark.readStream.schema("owner_key string, seconds double, request_id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = streaming.rate_limited_stream(asked, 2, 60.0).writeStream.format("memory").queryName("decided").outputMode("append").start()
    try:  # the state's timeouts keep the query busy, so it is stopped once all decisions are there
        until = time.time() + 60
        while time.time() < until and spark.table("decided").count() < 4:
            time.sleep(0.5)
    finally:
        query.stop()
    assert {r.request_id: r.allowed for r in spark.table("decided").collect()} == {0: True, 1: True, 2: False, 3: True}


class Chunked:
    def transcribe_chunks(self, audio):
        return [(0.0, 30.0, "first part"), (30.0, 60.0, f"{len(audio)} bytes")]


def test_transcribers_are_asked_in_their_fullest_form():
    class Streamed(Chunked):
        def transcribe_chunks_stream(self, audio):
            yield 1, 1, (0.0, 1.0, "streamed")

    class Single:
        def transcribe(self, audio):
            return "one text"

    forms = [list(transcribe.heard_by(m, b"xy")) for m in (Streamed(), Chunked(), Single(), lambda audio: "called")]
    assert forms == [[(1, 1, 0.0, 1.0, "streamed")], [(1, 2, 0.0, 30.0, "first part"), (2, 2, 30.0, 60.0, "2 bytes")], [(1, 1, None, None, "one text")], [(1, 1, None, None, "called")]]


def test_speech_models(spark):
    def chunked():
        class Model:
            def transcribe_chunks(self, audio):
                return [(0.0, 30.0, "first part"), (30.0, 60.0, f"{len(audio)} bytes")]

        return Model()

    files = spark.createDataFrame([("a.wav", bytearray(b"xyz"))], "filename string, content binary")
    scorer = calls.per_tile(lambda t: F.array(F.lit(0.0), F.lit(1.0)))
    done = Engine(scorer=scorer, speech=chunked).analyze_audio(files).collect()
    assert [(r.call_id, r.raw_transcript, len(r.reference_segments)) for r in done] == [("a.wav", "first part 3 bytes", 2)]
    whole = Engine(scorer=scorer, speech=lambda: lambda audio: "one text").analyze_audio(files).collect()
    assert [(r.call_id, r.raw_transcript, len(r.reference_segments)) for r in whole] == [("a.wav", "one text", 0)]
    assert Engine(scorer=scorer, speech=chunked).status() == {"stt": "ready", "classifier": "ready", "analyzable": True}

    def foreign():
        model = lambda audio: "text"
        model.language = "en"
        return model

    for load, said in ((lambda: lambda audio: " ", "empty transcript"), (foreign, "transcribes en")):
        with pytest.raises(Exception, match=said):
            transcribe.transcripts(files, load).collect()


def test_progress_is_reported(spark):
    chunks = spark.createDataFrame([("a", 0, 0.0, 30.0, "some words"), ("a", 1, 30.0, 60.0, "...")], "call_id string, chunk_index long, start double, end double, transcript string")
    engine, stages, counts = Engine(scorer=calls.per_tile(lambda t: F.array(F.lit(0.0), F.lit(1.0)))), [], []
    got = engine.analyze_with_progress(chunks, stages.append, counts.append).collect()
    assert got == engine.analyze(chunks).collect() and stages == ["normalizing", "classifying", "finalizing"]
    assert counts == [{"transcribed_chunks": 2, "normalized_chunks": 2, "classified_chunks": 1, "total_chunks": 2}]


def test_settings_and_loaders():
    env = {"RATE_LIMIT_MAX_REQUESTS": "3", "STT_AUDIO_CHUNK_SECONDS": "15", "STT_RUNTIME": ""}
    made = Settings.from_env(env, timeout_seconds=5.0)
    assert (made.max_requests, made.chunk_seconds, made.timeout_seconds, made.runtime) == (3, 15.0, 5.0, "faster-whisper")
    with pytest.raises(ValueError):
        Settings.from_env({"ANALYSIS_TIMEOUT_SECONDS": "0"})

    def broken(settings):
        raise OSError("no weights")

    assert loaded({"stt": broken, "classifier": lambda s: s.runtime}, made) == ({"classifier": "faster-whisper"}, {"stt": "error", "classifier": "ready"})
