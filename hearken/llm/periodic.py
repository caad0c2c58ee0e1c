"""Periodic runs: maximal stretches of words that repeat with a period.

Every maximal repetition holds a Lyndon word of its period, under the order of words or under its reverse.  So a stack of suffix
starts is scanned from right to left under either order: what lies between a position and the next smaller suffix is the longest
Lyndon word there.  Suffixes are compared, and candidates extended both ways, by the longest common extension: a binary search
over rolling hashes, whose answer is then checked on the words themselves.  There is no suffix array.

Each text is a row and is judged by itself, so nothing is shuffled.  Words are numbered within a text, in pieces.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import as_bytes, between_words, in_slices, let, mix, powers, words

#: A run repeats its period so often at least, and has so many words at least.
REPEATS, LEAST = 4, 6
#: Words that are compared one by one before hashes are; stretches of more words are kept as packed numbers, not as lists.
DIRECT, PACKED = 8, 1 << 20
_BASE = 0xD1342543DE82EF95
SCHEMA = "doc_id long, n_words long, n_dropped long, runs array<struct<start:long,length:long,period:long>>, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Extensions:
    """Longest common extensions within a sequence of numbers, to the right and to the left."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.sums = self.powers = None
        #: By distance p, the last stretch [lo, hi) in which words p apart were seen to be equal; the words at hi differ.
        self.equal: dict[int, tuple[int, int]] = {}

    def same(self, i: int, j: int, k: int) -> bool:
        """Whether the hashes of k words from i < j on agree."""
        if self.sums is None:
            with np.errstate(over="ignore"):
                self.powers = powers(_BASE, self.n + 1)
                self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.ids.astype(np.uint64) + np.uint64(1)) * self.powers[: self.n])))
        with np.errstate(over="ignore"):
            return bool((self.sums[i + k] - self.sums[i]) * self.powers[j - i] == self.sums[j + k] - self.sums[j])

    def longest(self, most: int, at) -> int:
        """The largest k up to ``most`` for which the k words that ``at(k)`` places are equal, for any shorter k too.

        Steps are doubled, then halved.  Unequal hashes prove a difference; equal ones are checked on the words.
        """
        low, step = 0, DIRECT
        while low + step <= most and self.same(*at(low + step), low + step):
            low, step = low + step, 2 * step
        high = min(most, low + step)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(*at(mid), mid) else (low, mid - 1)
        return low

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j > i on."""
        p, ids = j - i, self.ids
        known = self.equal.get(p)
        if known and known[0] <= i < known[1]:
            return known[1] - i
        most = (known[0] if known and known[0] > i else self.n - p) - i
        k = self.longest(most, lambda k: (i, j))
        differ = np.flatnonzero(ids[i : i + k] != ids[j : j + k])
        k = int(differ[0]) if len(differ) else k
        if known and known[0] > i and k == most:
            k = known[1] - i
        self.equal[p] = (i, i + k)
        return k

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j > i."""
        ids = self.ids
        k = self.longest(i, lambda k: (i - k, j - k))
        differ = np.flatnonzero(ids[i - k : i] != ids[j - k : j])
        return k - 1 - int(differ[-1]) if len(differ) else k


def lyndon_runs(ids: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least max(least, repeats * period) numbers.

    A run that repeats four times starts a Lyndon word of its period within its first period, after which two more follow; so
    only candidates whose period repeats so far to the right are extended to the left.
    """
    n = len(ids)
    found: set[tuple[int, int, int]] = set()
    common = Extensions(ids)
    further = max(0, repeats - 2)
    for order in (ids, -ids):
        seq = order.tolist() if n <= PACKED else array("q", order.astype(np.int64).tobytes())
        seq.append(-(1 << 40))  # what has ended is smaller under both orders
        last: dict[int, tuple[int, int]] = {}
        stack = [n]
        for i in range(n - 1, -1, -1):
            x, j = seq[i], stack[-1]
            while True:
                y = seq[j]
                if x < y:
                    stack.pop()
                    j = stack[-1]
                    continue
                k = 0
                if x == y:
                    k = 1
                    while k < DIRECT and seq[i + k] == seq[j + k] and j + k < n:
                        k += 1
                    if k == DIRECT:
                        k = common.right(i, j)
                    if seq[i + k] < seq[j + k]:
                        stack.pop()
                        j = stack[-1]
                        continue
                break
            stack.append(i)
            p = j - i
            if k and k >= further * p:
                done = last.get(p)
                if done and done[0] <= i and i + p + k <= done[1]:
                    continue
                start, end = i - common.left(i, j), j + k
                last[p] = (start, end)
                if end - start >= max(least, repeats * p):
                    found.add((start, end, p))
    return found


def stretches(ids: np.ndarray, repeats: int, least: int) -> Iterator[tuple[int, int]]:
    """Stretches that may hold runs: every word of a run stands in the text as often as the run repeats, so rarer words part them."""
    often = np.bincount(ids)[ids] >= repeats
    edges = np.flatnonzero(np.diff(np.concatenate(([False], often, [False])).astype(np.int8)))
    for lo, hi in zip(edges[0::2].tolist(), edges[1::2].tolist()):
        if hi - lo >= least:
            yield lo, hi


def numbered_words(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word of a text, and the words by number; no more than a piece of the text is split at a time."""
    codes: dict[bytes, int] = {}
    number = codes.setdefault
    parts = [np.fromiter((number(w, len(codes)) for w in part.split()), dtype=np.int32) for part in between_words(text)]
    return np.concatenate(parts), list(codes)


@dataclass(frozen=True)
class Found:
    """What one text holds: its number of words, runs (start, length, period) in order, and the words that are kept."""

    n_words: int
    runs: list[tuple[int, int, int]]
    n_dropped: int
    collapsed_sha256: str

    @property
    def best(self) -> tuple[int, int, int] | None:
        """The run that repeats most often, exactly; then the first, then that of the smallest period."""
        best = None
        for run in self.runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        return best

    def row(self) -> tuple:
        start, length, period = self.best or (None, None, None)
        listed = hashlib.sha256("".join([f"{s},{k},{p}\n" for s, k, p in self.runs]).encode()).hexdigest()
        runs = [{"start": s, "length": k, "period": p} for s, k, p in self.runs]
        return self.n_words, self.n_dropped, runs, len(runs), start, length, period, None if start is None else 1000 * length // period, listed, self.collapsed_sha256


def examined(text: bytes | None, repeats: int = REPEATS, least: int = LEAST, pieces: int = 1 << 16) -> Found:
    """The runs of a text, and its words without those that any run holds after its first period."""
    ids, vocabulary = numbered_words(text or b"")
    runs = []
    for lo, hi in stretches(ids, repeats, least):
        runs += [(lo + s, e - s, p) for s, e, p in lyndon_runs(ids[lo:hi], repeats, least)]
    runs.sort(key=lambda r: (r[0], r[2]))
    if runs:
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        at = np.array(runs, dtype=np.int64)
        np.add.at(edge, at[:, 0] + at[:, 2], 1)
        np.add.at(edge, at[:, 0] + at[:, 1], -1)
        kept = ids[np.cumsum(edge[:-1]) == 0]
    else:
        kept = ids
    digest = hashlib.sha256()
    for k in range(0, len(kept), pieces):
        digest.update(b" " * (k > 0) + b" ".join([vocabulary[x] for x in kept[k : k + pieces].tolist()]))
    return Found(len(ids), runs, len(ids) - len(kept), digest.hexdigest())


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_words, n_dropped, all ``runs`` by start and period, the digests of both, and the run that
    repeats most.

    A run repeats its period at least ``repeats`` (three or more) times and has at least ``least`` words.  Null and empty texts
    have no words and no runs.  Repeated rows and null ids are each judged; of runs that repeat equally often the first counts,
    then that of the smallest period.  Texts may be of any length: words are split in pieces and stay as four bytes each.  Other
    columns are not read.  An empty table gives an empty result.
    """
    if repeats < 3:
        raise ValueError("a run must repeat three times at least")
    schema = pa.schema([(name, kind) for name, kind in zip(("n_words", "n_dropped", "runs", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"), [pa.int64()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))] + [pa.int64()] * 5 + [pa.string()] * 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = [examined(b, repeats, least).row() for b in as_bytes(batch.column(1))]
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *schema.names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which every tenth text by crc32 of its id repeats some of its words to its end.

    With h = crc32 of the id, g = h div 10 and n words, each word i >= a = g mod n becomes word a + (i - a) mod p, where
    p = 1 + (n - a) div (3 + g mod 8).  Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def edited(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), tail), " "))

    text = F.col(text_col).cast("string")
    made = F.when(h % 10 == 0, F.coalesce(let(words(text), edited), text)).otherwise(text)
    return docs.select(F.col(id_col).alias("doc_id"), made.alias("text"))
