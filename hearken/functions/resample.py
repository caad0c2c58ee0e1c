"""Band-limited resampling: a bank of windowed sinc filters, one per phase.

An output sample at time s is the sum of the input samples around it, each weighted by a sinc of its distance, low-passed
somewhat below the smaller of both Nyquist rates and faded out by a squared cosine.  Two rates repeat their relative positions
with a period, so there are as many filters as outputs in one; frames of input are multiplied with the whole bank at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

# Zero crossings on each side of the filter, and the part of the band that passes.
CROSSINGS, ROLLOFF = 6, 0.99
#: Frames of input that are multiplied with the bank at a time.
FRAMES = 1 << 14


def weights(distance: np.ndarray, band: float) -> np.ndarray:
    """Weights of samples by their distance in seconds, for a filter that passes ``band`` / 2 hertz."""
    crossing = np.clip(distance * band, -CROSSINGS, CROSSINGS)
    return np.sinc(crossing) * np.cos(crossing * np.pi / (2 * CROSSINGS)) ** 2


def bank(rate: int, to: int) -> tuple[np.ndarray, int]:
    """Filters by phase (taps by phases) for two rates without a common factor, and the inputs before a frame that they reach."""
    band = min(rate, to) * ROLLOFF
    reach = math.ceil(CROSSINGS * rate / band)
    at = np.arange(-reach, reach + rate)[:, None] / rate
    return weights(at - np.arange(to)[None, :] / to, band) * band / rate, reach


def resampled_part(between: Callable[[int, int], np.ndarray], n: int, rate: int, to: int, first: int, last: int) -> np.ndarray:
    """Outputs first to last - 1 of n samples at another rate; ``between(a, b)`` reads those from a to b - 1, and no more than the
    outputs need are read at a time."""
    if rate <= 0 or to <= 0:
        raise ValueError("rates must be positive")
    common = math.gcd(rate, to)
    rate, to = rate // common, to // common
    if rate == to:
        return between(first, last)
    filters, reach = bank(rate, to)
    taps, done = len(filters), []
    frame, end = first // to, -(-last // to)
    while frame < end:
        stop = min(frame + FRAMES, end)
        low, high = frame * rate - reach, (stop - 1) * rate - reach + taps
        given = between(max(0, low), min(n, high)) if low < n and high > 0 else np.zeros(0)
        part = np.zeros(high - low, dtype=np.float64)
        part[max(0, -low) : max(0, -low) + len(given)] = given
        done.append(np.lib.stride_tricks.sliding_window_view(part, taps)[::rate] @ filters)
        frame = stop
    out = np.concatenate(done).ravel() if done else np.zeros(0)
    return out[first - first // to * to :][: last - first]


def size_after(n: int, rate: int, to: int) -> int:
    """How many samples n samples are at another rate: as many as it has in their time, rounded up."""
    return -(-n * to // rate)


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate; silence is taken to lie around the given ones."""
    samples = np.asarray(samples)
    if rate == to and rate > 0 or not len(samples):
        return samples
    out = resampled_part(lambda a, b: samples[a:b], len(samples), rate, to, 0, size_after(len(samples), rate, to) if rate > 0 and to > 0 else 0)
    return out.astype(samples.dtype) if samples.dtype.kind == "f" else out
