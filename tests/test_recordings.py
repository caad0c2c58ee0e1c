"""Tiles read by byte ranges against those of whole files."""

import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearken.operators import calls
from hearken.plans.engine import Engine
from hearken.sources import recordings
from hearken.sources.audio import audio_chunks, decoded_wav
from hearken.sources.recordings import Range, recording_tiles, tiles


def wav(rate, channels, width, seconds, seed=0, extra=b"", length=None):
    """A header with other chunks between, and noise."""
    n = int(rate * seconds)
    data = np.random.default_rng(seed).integers(0, 256, n * channels * width, dtype=np.uint8).tobytes()
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    body = form + (struct.pack("<4sI", b"LIST", len(extra)) + extra + b"\0" * (len(extra) % 2) if extra else b"") + struct.pack("<4sI", b"data", len(data) if length is None else length) + data
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def test_tiles_equal_those_of_whole_files(spark, tmp_path):
    files = {"a.wav": wav(16000, 1, 2, 3.3), "b/c.WAV": wav(44100, 2, 2, 2.7, 1, b"odd"), "b/d.wav": wav(8000, 1, 1, 5.0, 2), "e.wav": wav(22050, 1, 3, 1.0, 3), "none.wav": wav(16000, 1, 2, 0), "f.wav": wav(48000, 2, 4, 1.1, 4), "bad.wav": b"no sound at all", "g.txt": b"x"}
    for name, blob in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(blob)
    whole = spark.createDataFrame([(f"{tmp_path}/{n}", b) for n, b in files.items() if n not in ("g.txt", "bad.wav")], "filename string, content binary")
    want = {(r.filename, r.chunk_index): r for r in audio_chunks(whole, 0.5).collect()}
    rows = recording_tiles(spark, str(tmp_path), 0.5, 30_000).collect()
    got = {(r.filename, r.chunk_index): r for r in rows if r.error is None}
    assert len(got) == len(rows) - 1 and got.keys() == want.keys()
    for key, r in got.items():
        w = want[key]
        assert (r.total_chunks, r.start, r.end) == (w.total_chunks, w.start, w.end)
        assert np.abs(decoded_wav(r.wav) - decoded_wav(w.wav)).max() <= 1.01 / 32768, key
    (bad,) = [r for r in rows if r.error]
    assert bad.filename.endswith("bad.wav") and "RIFF" in bad.error and bad.wav is None
    one = recording_tiles(spark, f"{tmp_path}/a.wav", 0.5, 30_000)
    assert one.rdd.getNumPartitions() == 4 and one.count() == 7  # one recording, many tasks


@pytest.mark.parametrize("rate,width,channels", [(16000, 2, 1), (44100, 2, 2), (8000, 1, 1)])
@pytest.mark.parametrize("part", [1, 777, 5000, 10**9])
def test_ranges_share_out_every_tile_once(tmp_path, rate, width, channels, part):
    blob = wav(rate, channels, width, 0.4, 5, b"abc")
    (tmp_path / "x.wav").write_bytes(blob)
    seen = []
    with open(tmp_path / "x.wav", "rb") as file:
        for a in range(0, len(blob), max(part, len(blob) // 60)):
            file.seek(0)
            seen += [r[1] for r in tiles(file, Range("x", len(blob), a, min(a + max(part, len(blob) // 60), len(blob))), 0.05)]
    assert seen == list(range(1, 9))


def test_a_length_beyond_the_file_ends_with_it(tmp_path):
    for length in (0, 0xFFFFFFFF):
        (tmp_path / "x.wav").write_bytes(wav(16000, 1, 2, 1.0, length=length))
        with open(tmp_path / "x.wav", "rb") as file:
            assert [r[1:5] for r in tiles(file, Range("x", (tmp_path / "x.wav").stat().st_size, 0, 10**9), 0.6)] == [(1, 2, 0.0, 0.6), (2, 2, 0.6, 1.0)]


def test_two_gigabytes_in_bounded_memory(tmp_path):
    """A sparse file; a range in its middle holds a few tiles at most."""
    size = 2 << 30
    with open(tmp_path / "long.wav", "wb") as file:
        file.write(wav(44100, 2, 2, 0, length=size - 44))
        file.truncate(size)
    reader = recordings.RecordingReader({"path": str(tmp_path), "seconds": "30"})
    parts = reader.partitions()
    assert len(parts) == 32
    tracemalloc.start()
    rows = [b.column("chunk_index")[0].as_py() for b in reader.read(parts[16])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) in (12, 13) and rows == list(range(rows[0], rows[0] + len(rows))) and peak < 120 << 20, peak


def test_options_are_checked():
    with pytest.raises(ValueError):
        recordings.RecordingReader({"path": "x", "seconds": "0"})


def test_recordings_become_calls(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(wav(22050, 1, 2, 1.1))
    heard = lambda df: df.withColumn("transcript", F.concat(F.lit("part "), F.col("chunk_index").cast("string")))
    engine = Engine(scorer=calls.per_tile(lambda t: F.array(F.lit(0.0), F.lit(1.0))), transcriber=heard, chunk_seconds=0.4)
    (call,) = engine.analyze_recordings(spark, str(tmp_path)).collect()
    assert call.call_id.endswith("x.wav") and call.raw_transcript == "part 1 part 2 part 3"
    with pytest.raises(ValueError):
        Engine().analyze_recordings(spark, str(tmp_path))
