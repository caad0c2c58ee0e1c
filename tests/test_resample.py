"""The filter bank against the plain sum, and tones inside and outside the band."""

import io
import math
import wave

import numpy as np
import pytest

from hearken.functions import resample
from hearken.functions.resample import resampled
from hearken.sources.audio import RATE, decoded_wav


def plain(x, rate, to):
    """The law, an output at a time: sinc, low-passed at 0.99 of the smaller rate, faded by a squared cosine over six crossings."""
    band = min(rate, to) * 0.99
    out = []
    for n in range(math.ceil(len(x) * to / rate)):
        total = 0.0
        for i, v in enumerate(x):
            d = (i / rate - n / to) * band
            if abs(d) < 6:
                total += v * (1 if d == 0 else math.sin(math.pi * d) / (math.pi * d)) * math.cos(math.pi * d / 12) ** 2
        out.append(total * band / rate)
    return np.array(out)


@pytest.mark.parametrize("rate,to", [(8000, 16000), (44100, 16000), (48000, 16000), (22050, 16000), (11025, 16000), (16000, 8000), (7, 5)])
@pytest.mark.parametrize("n", [1, 2, 157])
def test_equals_the_plain_sum(rate, to, n):
    x = np.random.default_rng(n).normal(size=n)
    got = resampled(x, rate, to)
    assert len(got) == math.ceil(n * to / rate) and np.abs(got - plain(x, rate, to)).max() < 1e-9


def tone(hertz, rate, seconds=0.5):
    return np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("rate", [8000, 22050, 44100, 48000])
def test_tones_in_the_band_pass(rate):
    for hertz in (100, 440, 1000, 3000):
        middle = slice(800, 7000)
        assert np.abs(resampled(tone(hertz, rate), rate, RATE)[middle] - tone(hertz, RATE)[middle]).max() < 0.02, hertz


@pytest.mark.parametrize("rate", [22050, 44100, 48000])
def test_tones_above_the_band_stop(rate):
    for hertz in (10_500, 10_900):
        level = np.sqrt((resampled(tone(hertz, rate), rate, RATE)[800:7000] ** 2).mean()) * np.sqrt(2)
        assert 20 * np.log10(level) < -40, (hertz, level)


def test_parts_join_without_a_seam(monkeypatch):
    x = np.random.default_rng(0).normal(size=5000)
    whole = resampled(x, 44100, 16000)
    monkeypatch.setattr(resample, "FRAMES", 3)
    assert np.array_equal(resampled(x, 44100, 16000), whole) or np.abs(resampled(x, 44100, 16000) - whole).max() < 1e-12


def test_edges():
    assert len(resampled(np.zeros(0), 8000, 16000)) == 0
    x = np.arange(5.0)
    assert resampled(x, 16000, 16000) is x and resampled(x.astype(np.float32), 8000, 16000).dtype == np.float32
    with pytest.raises(ValueError):
        resampled(x, 0, 16000)


def test_wav_of_another_rate():
    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(44100)
        w.writeframes(np.repeat((tone(440, 44100) * 16000).astype("<i2"), 2).tobytes())
    got = decoded_wav(sound.getvalue())
    assert len(got) == 8000 and got.dtype == np.float32 and np.abs(got[800:7000] - tone(440, RATE)[800:7000] * 16000 / 32768).max() < 0.01
