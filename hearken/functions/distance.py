"""Edit distances of long sequences, bit-parallel and banded.

A column of the table of distances is kept as two rows of bits, that say where it rises and falls; a step is a handful of
operations on whole numbers, however many bits they have.  Only a band around the diagonal is kept, doubled until the
distance fits into it, so alike sequences cost little more than their length; unlike ones go on to whole columns.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Half the width of the first band.
BAND = 32


def places(pattern: Sequence) -> dict:
    """Per symbol the bits of its places, gathered bytewise so that building takes one pass."""
    found: dict = {}
    for i, c in enumerate(pattern):
        found.setdefault(c, []).append(i)
    size = (len(pattern) + 7) // 8
    bits = {}
    for c, at in found.items():
        held = bytearray(size)
        for i in at:
            held[i >> 3] |= 1 << (i & 7)
        bits[c] = int.from_bytes(held, "little")
    return bits


def in_columns(bits: dict, m: int, text: Sequence) -> int:
    """The distance of a pattern of m symbols from a text, by whole columns."""
    mask, last = (1 << m) - 1, 1 << (m - 1)
    up, down, total = mask, 0, m
    for c in text:
        x = bits.get(c, 0) | down
        zero = (((x & up) + up) ^ up) | x
        rise, fall = (down | ~(up | zero)) & mask, up & zero
        total += 1 if rise & last else -1 if fall & last else 0
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~(rise | zero)) & mask, rise & zero & mask
    return total


def in_band(bits: dict, m: int, text: Sequence, k: int) -> int | None:
    """The distance if it is k at most, k < m; else none.

    The window holds the 2k + 1 rows around the diagonal and moves down a row each step; its last row is followed until the
    pattern ends, and the pattern's last row from then on.
    """
    n = len(text)
    width = 2 * k + 1
    mask, last = (1 << width) - 1, 1 << (width - 1)
    up, down, total = ((1 << (k + 1)) - 1) << k, 0, k
    most = k + n - (m - k)  # what the steps along the last row can still take off
    for j, c in enumerate(text):
        p = bits.get(c, 0)
        x = (p >> (j - k) if j >= k else p << (k - j)) & mask
        zero = ((((x & up) + up) ^ up) | x | down) & mask
        rise, fall = (down | ~(zero | up)) & mask, zero & up
        if j < m - k:
            total += not zero & last
            if total > most:
                return None
        else:
            row = 1 << (m - 1 - j + k)
            total += 1 if rise & row else -1 if fall & row else 0
        zero >>= 1
        up, down = (fall | ~(zero | rise)) & mask, zero & rise
    return total if total <= k else None


def edit_distance(left: Sequence, right: Sequence, band: int = BAND) -> int:
    """Insertions, deletions and substitutions between two strings, or lists of anything that can be told apart."""
    first, n = 0, min(len(left), len(right))
    while first < n and left[first] == right[first]:
        first += 1
    end = 0
    while end < n - first and left[-1 - end] == right[-1 - end]:
        end += 1
    pattern, text = sorted((left[first : len(left) - end], right[first : len(right) - end]), key=len)
    m, n = len(pattern), len(text)
    if m == 0:
        return n
    bits = places(pattern)
    k = max(band, n - m)
    while 2 * k + 1 < m:
        found = in_band(bits, m, text, k)
        if found is not None:
            return found
        k *= 2
    return in_columns(bits, m, text)
