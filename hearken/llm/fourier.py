"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

A text becomes a short vector of statistics: its words, letters, marks and lines, and how they repeat.  Cosines of random
projections approximate a Gaussian kernel over these.  Each task sums the normal equations of its labelled rows, by fold; the sums
are whole numbers, so they are the same however rows are dealt out.  The driver solves one small system for each strength of the
ridge, takes the one with the least error on the folds left out, and calibrates: raw scores of rows whose fold was left out are
counted by bins, and pooled until the share of good documents never falls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import CHUNK_BYTES, as_bytes, dropped, in_slices, sent_to_workers, stored
from hearken.llm.periodic import numbered_words

STATISTICS = (
    "words", "bytes", "word_length", "variety", "commonest", "upper", "digits", "symbols", "calls", "stops", "other_marks", "beyond_ascii",
    "short_words", "long_words", "lines", "repeated_lines", "doubled_words", "repeated_pairs",
)
#: Statistics are whole numbers of ten-thousandths; features are whole numbers of this part of a cosine.
UNIT, PART = 10_000, 1024
#: Raw scores from ``LOW`` to ``HIGH`` are counted in so many bins.
BINS, LOW, HIGH = 4096, -0.5, 1.5
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\"'()-/@[\\]^_`{}~+=", bytes(range(128, 256)), b"\n")
_CLASS = np.full(256, len(_CLASSES), dtype=np.uint8)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k


@dataclass(frozen=True)
class Kernel:
    """features: random projections.  width: of the Gaussian, as a multiple of the root of the number of statistics.  folds and
    ridges: what the strength of the ridge is chosen by and from."""

    features: int = 256
    width: float = 0.7
    folds: int = 3
    ridges: tuple[float, ...] = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
    seed: int = 11

    def projections(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(n, self.features)) / (self.width * n**0.5), rng.uniform(0, 2 * np.pi, self.features)


def line_repeats(text: bytes) -> tuple[int, int]:
    """Lines that are not blank, and those equal to an earlier one; read in pieces."""
    n, seen, rest = 0, set(), b""
    for at in range(0, len(text), CHUNK_BYTES):
        *lines, rest = (rest + text[at : at + CHUNK_BYTES]).split(b"\n")
        lines = [x for x in lines if x.strip()]
        n += len(lines)
        seen.update(map(hash, lines) if len(text) > CHUNK_BYTES else lines)
    if rest.strip():
        n += 1
        seen.add(hash(rest) if len(text) > CHUNK_BYTES else rest)
    return n, n - len(seen)


def statistics(text: bytes | None) -> list[int]:
    """The statistics of a text in units; all zero where it has no words."""
    text = text or b""
    ids, vocabulary = numbered_words(text)
    n = len(ids)
    if not n:
        return [0] * len(STATISTICS)
    lower, upper, digits, symbols, calls, stops, other, beyond, breaks = sum(
        (np.bincount(_CLASS[np.frombuffer(text, np.uint8, min(CHUNK_BYTES, len(text) - at), at)], minlength=len(_CLASSES) + 1)[: len(_CLASSES)] for at in range(0, len(text), CHUNK_BYTES)), np.zeros(len(_CLASSES), np.int64)
    ).tolist()
    seen, sizes = np.bincount(ids), np.array([len(w) for w in vocabulary])
    lines, again = line_repeats(text)
    pairs = ids[:-1].astype(np.int64) * len(vocabulary) + ids[1:]
    total = int((seen * sizes).sum())
    values = (
        np.log2(1 + n) / 16, np.log2(1 + len(text)) / 20, np.log2(1 + total / n) / 8, np.log(1 + len(vocabulary)) / np.log(1 + n), seen.max() / n,
        upper / max(1, lower + upper), digits / total, symbols / n, calls / n, stops / n, other / n, beyond / total,
        seen[sizes <= 3].sum() / n, seen[sizes > 12].sum() / n, breaks / n, again / max(1, lines), np.count_nonzero(ids[1:] == ids[:-1]) / n, 1 - len(np.unique(pairs)) / max(1, n - 1) if n > 1 else 0.0,
    )
    return [round(min(float(v), 3.0) * UNIT) for v in values]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(b) for b in as_bytes(batch.column(1))], pa.list_(pa.int32()))], ["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<int>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


@dataclass
class Classifier:
    """Centre and scale of the statistics, projections, weights (the last is the constant's), and the calibration's steps."""

    centre: np.ndarray
    scale: np.ndarray
    kernel: Kernel
    weights: np.ndarray
    raw: np.ndarray
    share: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Whole numbers, the last a constant."""
        w, b = self.kernel.projections(len(STATISTICS))
        x = np.clip((stats - self.centre) * self.scale, -6, 6)
        # Sums in a fixed order: a product of matrices may round otherwise for another number of rows.
        at = b + sum(x[:, k, None] * w[k] for k in range(x.shape[1]))
        return np.concatenate((np.rint(PART * np.cos(at)), np.full((len(stats), 1), PART)), axis=1)

    def raw_scores(self, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.round(features @ weights / PART, 6)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.round(np.interp(self.raw_scores(self.features(stats), self.weights), self.raw, self.share), 6)


def pooled(raw: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean raw score and share of good ones of blocks of neighbouring bins, pooled until shares rise; one good and one bad row are
    spread over all blocks, so that no share is quite 0 or 1."""
    blocks: list[list[float]] = []
    for x, g, k in zip(raw.tolist(), good.tolist(), n.tolist()):
        blocks.append([x * k, g, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x1, g1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x1, blocks[-1][1] + g1, blocks[-1][2] + k1]
    x, g, k = np.array(blocks).T
    share = (g + 0.5) / (k + 1)
    return x / k, np.maximum.accumulate(share)


def solved(total: np.ndarray, ridge: float) -> np.ndarray:
    """Weights from summed equations: features by features, then by labels in the last column."""
    a, b = total[:, :-1] / PART**2, total[:, -1] / PART
    n = a[-1, -1]
    penalty = np.full(len(a), ridge * n)
    penalty[-1] = 0  # the constant is free
    return np.linalg.solve(a + np.diag(penalty) + 1e-9 * n * np.eye(len(a)), b)


def train(stats: DataFrame, labels: DataFrame, learn: Column, kernel: Kernel = Kernel(), id_col: str = "doc_id", label_col: str = "quality") -> Classifier:
    """Fit on all labelled rows of ``measured`` documents where ``learn`` (over the labels' ids) holds.

    Labels other than 0 and 1 and null ids teach nothing; of several labels of one id the larger counts, and of several texts one.
    The driver receives sums, whose size depends on the number of features alone, and counts by bins.  With labels of one class
    every text gets the same score, 0.5 without any.
    """
    marked = labels.where(learn).select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and label_id is not null")
    taught = stats.join(marked, F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.max("label").alias("label"), F.min("stats").alias("stats"))
    rows = stored(taught.select("label", "stats", F.pmod(F.xxhash64("doc_id"), F.lit(kernel.folds)).cast("int").alias("fold")))
    d = len(STATISTICS)
    value = lambda k: F.get("stats", F.lit(k)).cast("long")
    known = rows.agg(F.count("*").alias("n"), F.sum("label").alias("good"), *[F.sum(value(k)).alias(f"s{k}") for k in range(d)], *[F.sum(value(k) * value(k)).alias(f"q{k}") for k in range(d)]).first()
    n, good = known.n, known.good or 0
    if good in (0, n):
        dropped(rows)
        share = 0.5 if not n else (good + 0.5) / (n + 1)
        return Classifier(np.zeros(d), np.zeros(d), kernel, np.zeros(kernel.features + 1), np.zeros(1), np.full(1, share))
    centre = np.array([known[f"s{k}"] / n for k in range(d)])
    spread = np.array([known[f"q{k}"] / n for k in range(d)]) - centre**2
    scale = np.where(spread > 1, 1 / np.sqrt(np.maximum(spread, 1)), 0.0)
    model = Classifier(centre, scale, kernel, np.zeros(kernel.features + 1), np.zeros(1), np.zeros(1))
    sent = sent_to_workers(rows.sparkSession, model)
    size = kernel.features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = sent(), {}
        for batch in batches:
            z, fold, label = own.features(matrix(batch.column(1))), batch.column(2).to_numpy(), batch.column(0).to_numpy()
            for f in np.unique(fold).tolist():
                part = np.concatenate((z[fold == f], label[fold == f, None]), axis=1)
                made = part[:, :-1].T @ part  # whole numbers below 2 ** 53, so exact
                sums[f] = sums.get(f, 0) + np.rint(made).astype(np.int64)
        for f, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, f), pa.int32()), pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], ["fold", "line", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total = group.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, size + 1).sum(axis=0)
        return pa.table({"fold": group.column("fold")[:1], "line": group.column("line")[:1], "sums": pa.array([total], pa.list_(pa.int64()))})

    shape = "fold int, line int, sums array<long>"
    by_fold = np.zeros((kernel.folds, size, size + 1))
    for r in rows.mapInArrow(equations, shape).groupBy("fold", "line").applyInArrow(added, shape).collect():  # folds x features lines
        by_fold[r.fold, r.line] = r.sums
    total = by_fold.sum(axis=0)
    squares = lambda w, s: w @ (s[:, :-1] / PART**2) @ w - 2 * w @ s[:, -1] / PART
    left_out = {ridge: [solved(total - own, ridge) for own in by_fold] for ridge in kernel.ridges}
    best = min(kernel.ridges, key=lambda ridge: sum(squares(w, own) for w, own in zip(left_out[ridge], by_fold)))
    model.weights = solved(total, best)
    tested = sent_to_workers(rows.sparkSession, (model, np.array(left_out[best])))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = tested()
        for batch in batches:
            z, fold = own.features(matrix(batch.column(1))), batch.column(2).to_numpy()
            raw = np.round((z * weights[fold]).sum(axis=1) / PART, 6)
            at = np.clip(np.floor((raw - LOW) / (HIGH - LOW) * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0)], ["bin", "label"])

    counted = sorted(rows.mapInArrow(binned, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect())  # BINS rows at most
    at, count, right = (np.array(x, dtype=np.float64) for x in zip(*counted))
    model.raw, model.share = pooled(LOW + (at + 0.5) * (HIGH - LOW) / BINS, right, count)
    dropped(rows)
    return model


def score(stats: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) for every row of ``measured`` documents: the chance that the text is good.

    Null and empty texts have the statistics of a text without words and are scored like any.  Repeated rows and null ids are each
    scored.  Texts of any length are read in pieces.  An empty table gives an empty result.
    """
    sent = sent_to_workers(stats.sparkSession, model)  # features x statistics numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(matrix(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, learn: Column, kernel: Kernel = Kernel(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Measure, train and score in one go; the texts are read once and only their statistics are stored."""
    stats = stored(measured(docs, id_col, text_col))
    return score(stats, train(stats, labels, learn, kernel, id_col, label_col))
