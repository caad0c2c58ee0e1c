"""Scores of a binary classifier, and a stand-in for one.

A scorer is a function from a text column to a column of two logits.  ``lexicon_scorer`` is a deterministic surrogate for
tests and benchmarks, not a trained model; a real one goes into a ``ModelScorer``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.functions.expr import let

NORMAL, SUSPECT = "normal", "voice_phishing"
Scorer = Callable[[Column], Column]


def softmax(logits: Column) -> Column:
    """Shifted by the largest logit, so that no exponential overflows."""

    def shares(x: Column) -> Column:
        powers = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return let(powers, lambda p: F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))

    return let(logits, shares)


def classified(logits: Column) -> Column:
    """struct(label, label_id, suspicion_score); the first of equal shares wins; other than two logits is an error."""

    def told(p: Column) -> Column:
        at = F.array_position(p, F.array_max(p)).cast("int") - 1
        return F.struct(F.when(at == 1, SUSPECT).otherwise(NORMAL).alias("label"), at.alias("label_id"), p[1].alias("suspicion_score"))

    two = F.when(F.size(logits) == 2, logits).otherwise(F.raise_error(F.lit("a scorer must return two logits")))
    return F.when(logits.isNotNull(), let(softmax(two), told))


def lexicon_scorer(terms: Iterable[str], weight: float = 24.0, offset: float = 2.0) -> Scorer:
    """Logits (0, weight x hits / words - offset), with hits the words that are in the lexicon."""
    known = F.array(*map(F.lit, sorted(terms)))

    def scorer(text: Column) -> Column:
        found = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
        return let(found, lambda w: F.array(F.lit(0.0), weight * F.size(F.filter(w, lambda t: F.array_contains(known, t))) / F.greatest(F.size(w), F.lit(1)) - offset))

    return scorer


def logit_rows(raw: Sequence, n: int) -> np.ndarray:
    """What a model returned for n texts as n rows of two; a batch axis around a single row is taken off."""
    rows = np.asarray(raw, dtype=np.float64)
    rows = rows.reshape(n, -1) if rows.ndim != 2 else rows
    if rows.shape != (n, 2):
        raise ValueError(f"a model must return {n} rows of two logits, not {rows.shape}")
    return rows


class Filled:
    """Texts of many rows as full batches for a model, whose answers go back to the rows in order.

    Less than a batch waits for the next rows; only the last batch of a task may be short.
    """

    def __init__(self, model: Callable[[list[str]], Sequence], batch: int):
        self.model, self.batch = model, batch
        self.texts: list[str] = []
        self.answers: deque = deque()

    def add(self, texts: list[str]) -> None:
        self.texts += texts
        full = len(self.texts) - len(self.texts) % self.batch
        self.ask(full)

    def ask(self, n: int) -> None:
        for k in range(0, n, self.batch):
            part = self.texts[k : min(k + self.batch, n)]
            self.answers.extend(logit_rows(self.model(part), len(part)).tolist())
        del self.texts[:n]

    def flush(self) -> None:
        self.ask(len(self.texts))

    def take(self, n: int) -> list:
        return [self.answers.popleft() for _ in range(n)]


@dataclass(frozen=True)
class ModelScorer:
    """Scores tiles with a Python model.  ``load`` runs once per task; the model gets ``batch`` texts at a time, from as many rows
    as it takes, and fewer only at a task's end.

    It works on whole rows, as a step of its own in the plan; with a ``profile`` that step runs on executors of that resource
    profile, such as those with an accelerator, and the others do not ask for one.  Rows with null tiles are not scored.  A
    blank text is an error.
    """

    load: Callable[[], Callable[[list[str]], Sequence]]
    batch: int = 8
    profile: ResourceProfile | None = None

    def add(self, df: DataFrame, tiles: Column, out: str) -> DataFrame:
        """``df`` with the logits of an array of texts."""
        given = df.withColumn(out, tiles)
        at, load, batch = len(given.columns) - 1, self.load, self.batch
        pairs = pa.list_(pa.list_(pa.float64()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filled, waiting = Filled(load(), batch), deque()

            def scored() -> Iterator[pa.RecordBatch]:
                """Rows all of whose texts have been scored."""
                while waiting and waiting[0][2] <= len(filled.answers):
                    rows, sizes, _ = waiting.popleft()
                    made = pa.array([None if n is None else filled.take(n) for n in sizes], pairs)
                    yield pa.RecordBatch.from_arrays([*rows.columns[:at], made], rows.schema.names)

            for rows in batches:
                texts = rows.column(at).to_pylist()
                flat = [t for row in texts if row is not None for t in row]
                if any(not t or not t.strip() for t in flat):
                    raise ValueError("a text to score must not be blank")
                waiting.append((rows, [None if row is None else len(row) for row in texts], len(flat)))
                filled.add(flat)
                yield from scored()
            filled.flush()
            yield from scored()

        logits = T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))
        return given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], logits]), profile=self.profile)
