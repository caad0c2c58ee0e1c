"""Helpers shared by the operators: words, tables, shared storage and batches of bytes."""

from __future__ import annotations

import gc
import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.session import shared_folder, spread

#: Words are maximal runs of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles at a time; each takes about fifty bytes of memory.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; a small one is dealt out over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE_RUN), ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression, so that ``body`` can name it often without evaluating it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives the loss of executors.

    The files go with ``dropped``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hearken-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return back


def dropped(*frames: DataFrame) -> None:
    """Delete the files of stored frames that no result still to be computed reads."""
    for df in frames:
        df._stored_at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._stored_at, True)


def released(spark: SparkSession) -> None:
    """Let the driver notice which shuffles nothing refers to any more, so that the executors delete their files now."""
    gc.collect()
    spark._jvm.System.gc()


def sent_to_workers(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value with the classes it is made of, so that workers need no copy of this package; call it once per task."""
    blob = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(blob.value)


def pieces(blobs: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive texts that hold about ``limit`` bytes each; a longer text stands alone."""
    start = total = 0
    for i, blob in enumerate(blobs):
        if total and total + len(blob) > limit:
            yield slice(start, i)
            start, total = i, 0
        total += len(blob)
    if start < len(blobs):
        yield slice(start, len(blobs))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time, so that no more texts than these are copied at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets from counts: 0 first, the total last."""
    return np.concatenate(([0], np.cumsum(counts)))


def sum_rows(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i, 0 for empty runs; works on one or two axes."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Per byte a random value and whether it is white space; then powers of an odd number and their inverses, grown as needed.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_BASE = 0xD1342543DE82EF95
#: Words of more bytes are hashed one by one: sums of powers repeat over very long ones.
_LONG = 256
_SPACE_BYTES = [c.encode() for c in SPACES]
_SPACE_RUN = re.compile(rb"[\x20\x09-\x0D]+")


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)


class WordHashes:
    """64-bit hashes of all words of some texts at once, equal for equal words.

    A word's hash is the sum of its bytes' values times powers by position, taken as a difference of running sums over the
    whole buffer, and scrambled with its length.  ``skip`` lists bytes that do not count.
    """

    def __init__(self, lower: bool = False, skip: bytes = b""):
        self.values = (_BYTE[_LOWER] if lower else _BYTE).copy()
        self.counts = ~_SPACE & ~np.isin(np.arange(256), list(skip))
        self.values[~self.counts] = 0
        self.lower, self.skip = lower, skip
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in order, 0 for those of skipped bytes alone, and each text's number of words.

        A text above ``CHUNK_BYTES`` is hashed piece by piece, cut between words, so that memory beside the result stays bounded.
        """
        if sum(map(len, texts)) <= 2 * CHUNK_BYTES:
            return self.at_once(texts)
        hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
        short = [k for k, t in enumerate(texts) if len(t) <= CHUNK_BYTES]
        done = {}
        for part in pieces([texts[k] for k in short]):
            own = short[part]
            found, counts[own] = self.at_once([texts[k] for k in own])
            done.update(zip(own, np.split(found, np.cumsum(counts[own])[:-1])))
        for k, text in enumerate(texts):
            if k not in done:
                found = [self.at_once([p])[0] if len(p) <= CHUNK_BYTES else np.array([self.one(p)], dtype=np.uint64) for p in between_words(text)]
                done[k] = np.concatenate(found)
                counts[k] = len(done[k])
            hashes.append(done.pop(k))
        return np.concatenate(hashes), counts

    def one(self, word: bytes) -> int:
        """The hash of one long word."""
        import xxhash

        word = word.translate(None, self.skip)
        return xxhash.xxh64_intdigest(word.lower() if self.lower else word) if word else 0

    def at_once(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buffer = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        n = len(buffer)
        if n == 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
        if len(self.up) <= n:
            size = max(n, CHUNK_BYTES) + 1
            self.up, self.down = powers(_BASE, size), powers(pow(_BASE, -1, 1 << 64), size)
        inside = ~_SPACE[buffer]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        start, end = edges[0::2], edges[1::2]  # the buffer ends in white space
        # The place of a byte is its number among the counted ones, or in the buffer if all count.
        place = np.cumsum(self.counts[buffer]) if self.skip else np.arange(n)
        with np.errstate(over="ignore"):
            sums = np.cumsum(self.values[buffer] * (self.up[place] if self.skip else self.up[:n]))
            before, first = np.where(start > 0, sums[start - 1], np.uint64(0)), np.where(start > 0, place[start - 1], 0) if self.skip else start
            size = place[end - 1] - first if self.skip else end - start
            hashes = mix((sums[end - 1] - before) * self.down[first] + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        for k in np.flatnonzero(end - start > _LONG).tolist():
            hashes[k] = self.one(buffer[start[k] : end[k]].tobytes())
        hashes[size == 0] = 0
        bounds = np.cumsum([len(t) + 1 for t in texts])
        return hashes, np.diff(np.searchsorted(start, bounds), prepend=0)


def between_words(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Pieces of at most ``limit`` bytes, cut at white space; a word that is longer is a piece by itself."""
    at = 0
    while len(text) - at > limit:
        end = max(text.rfind(c, at, at + limit) for c in _SPACE_BYTES) + 1
        if end <= 0:
            found = _SPACE_RUN.search(text, at)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named by their places, so that no helper column can clash with one of them."""
    return docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])


def named(docs: DataFrame, like: DataFrame, added: dict[str, str] | None = None) -> DataFrame:
    """The columns of ``like`` under their names again; ``added`` columns after them, in place of any that have their names."""
    old = [F.col(f"_{k}").alias(c) for k, c in enumerate(like.columns) if c not in (added or {}).values()]
    return docs.select(*old, *[F.col(a).alias(b) for a, b in (added or {}).items()])


def at_place(docs: DataFrame, name: str) -> str:
    """The name that a column has after ``numbered``."""
    return f"_{docs.columns.index(name)}"


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the contracts; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n, F.lit(0))
