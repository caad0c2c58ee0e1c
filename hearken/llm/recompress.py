"""Recompression of word sequences: rounds that name runs and pairs, the same in every text.

A name is a 64-bit hash of what it stands for, so equal runs and pairs get equal names everywhere and a round needs no
exchange between tasks.  In a round, runs of one symbol become one symbol; then every symbol is a left or a right one by a bit
of its hash, and each left symbol joins a right one that follows it.  Inside equal sequences the symbols are equal but near
the ends.  Each symbol therefore carries its footing: the words that alone determine it.
"""

from __future__ import annotations

import numpy as np

from hearken.llm.common import mix

#: Further rounds leave few symbols that rest inside a window of 13 words, and those break up stretches of windows with one key: on
#: 0.51 GB going on until none rests made 714 MB of entries instead of 429.  The result is the same.
ROUNDS = 2
FAR = 1 << 40


class Level:
    """Symbols in text order: name, footing [left, right) in words, and the piece of text they belong to."""

    def __init__(self, name: np.ndarray, left: np.ndarray, right: np.ndarray, piece: np.ndarray):
        self.name, self.left, self.right, self.piece = name, left, right, piece

    def beside(self, what: np.ndarray, by: int, outside: int) -> np.ndarray:
        """``what`` of the neighbour before (-1) or after (1) in the same piece, else ``outside``."""
        out = np.full(len(what), outside, dtype=what.dtype)
        if len(what) > 1:
            same = self.piece[1:] == self.piece[:-1]
            if by < 0:
                out[1:][same] = what[:-1][same]
            else:
                out[:-1][same] = what[1:][same]
        return out

    def runs(self) -> "Level":
        """A symbol that stands alone depends on its neighbours too: they show that the run is no longer."""
        if not len(self.name):
            return self
        first = np.concatenate(([True], (self.name[1:] != self.name[:-1]) | (self.piece[1:] != self.piece[:-1])))
        at = np.flatnonzero(first)
        last = np.concatenate((at[1:], [len(first)])) - 1
        length = (last - at + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            name = np.where(length > 1, mix(self.name[at] * np.uint64(0xD6E8FEB86659FD93) + length), self.name[at])
        left = np.minimum(self.left[at], self.beside(self.left, -1, -FAR)[at])
        right = np.maximum(self.right[last], self.beside(self.right, 1, FAR)[last])
        return Level(name, left, right, self.piece[at])

    def pairs(self, seed: int) -> "Level":
        is_left = (mix(self.name ^ np.uint64(seed)) & np.uint64(1)) == 0
        opens = is_left & ~self.beside(is_left, 1, True)
        closes = ~is_left & self.beside(is_left, -1, False)
        with np.errstate(over="ignore"):
            joined = mix(self.name * np.uint64(0xA0761D6478BD642F) + np.roll(self.name, -1) * np.uint64(0xE7037ED1A0B428DB))
        name = np.where(opens, joined, self.name)
        # A left symbol depends on what follows it, a right one on what precedes it, paired or not.
        left = np.where(is_left, self.left, np.minimum(self.left, self.beside(self.left, -1, -FAR)))
        right = np.where(is_left, np.maximum(self.right, self.beside(self.right, 1, FAR)), self.right)
        left = np.where(opens, np.minimum(left, self.beside(self.left, 1, FAR)), left)
        keep = ~closes
        return Level(name[keep], left[keep], right[keep], self.piece[keep])


def levels(words: np.ndarray, piece: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    at = np.arange(len(words))
    now, out = Level(words, at, at + 1, piece), []
    for k in range(rounds):
        now = now.runs().pairs(0x51ED270B + 977 * k)
        out.append(now)
    return out


def rolling(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers, for hashes of any stretch of words."""
    n = len(words)
    with np.errstate(over="ignore"):
        powers = np.ones(n + 1, dtype=np.uint64)
        powers[1:] = np.cumprod(np.full(n, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(words) * powers[:-1], out=prefix[1:])
    return prefix, powers


def stretch_hashes(prefix: np.ndarray, inverse: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of words[left:right], independent of where they stand."""
    with np.errstate(over="ignore"):
        return mix((prefix[right] - prefix[left]) * inverse[left] + (right - left).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def inverse_powers(n: int) -> np.ndarray:
    step = pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
    out = np.ones(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(n, step, dtype=np.uint64))
    return out


def windows(words: np.ndarray, piece: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words inside a piece, and the key of the symbol each one rests on.

    Windows of equal words have equal keys: the key names the highest symbol whose footing lies inside the window (of several,
    that with the longest footing, then by hash), hashed with its footing.  A window that holds no such symbol is its own key.
    """
    n = len(words)
    starts = np.flatnonzero(piece[: max(0, n - width + 1)] == piece[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    prefix, _ = rolling(words)
    inverse = inverse_powers(n)
    own = stretch_hashes(prefix, inverse, starts, starts + width)
    best = np.zeros(n, dtype=np.uint64)
    for depth, level in enumerate(levels(words, piece), 1):
        size = level.right - level.left
        fits = np.flatnonzero((size <= width) & (level.left >= 0) & (level.right <= n))
        left, size = level.left[fits], size[fits]
        hashed = stretch_hashes(prefix, inverse, left, left + size) ^ mix(level.name[fits])
        rank = np.uint64(depth) << np.uint64(60) | size.astype(np.uint64) << np.uint64(55) | hashed >> np.uint64(9)
        for shift in range(width):
            use = (size + shift <= width) & (left >= shift)
            if not use.any():
                break
            np.maximum.at(best, left[use] - shift, rank[use])
    key = best[starts]
    return starts, np.where(key > 0, mix(key), mix(own ^ np.uint64(0x5851F42D4C957F2D)))
