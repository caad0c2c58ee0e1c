"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms: lower-cased words without outer punctuation, and the stems of longer words.  Linear weights
tell terms apart; factors add what pairs of terms say together, such as an insult beside the mention of a group.  Terms are
64-bit hashes; those that tell the classes apart in a bounded sample of labelled documents, alone or two together, are the
model's features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import as_bytes, between_words, dropped, mix, pieces, sent_to_workers, starts_of, stored, sum_rows

#: Labelled documents per class, features, factors, the z value a feature must reach, and letters of a stem.
PER_CLASS, FEATURES, FACTORS, Z, STEM = 6000, 8192, 8, 4.5, 5
#: A feature stands in so many unlike toxic documents at least; a stem's documents are toxic in this share of cases at least.
UNLIKE, PURE = 6, 0.9
#: Terms whose pairs are tried, the z value by which a pair must depart from what its terms say, and pairs that become features.
PAIR_TERMS, PAIR_Z, PAIRS = 1024, 8.0, 64


def term_hashes(word: bytes) -> tuple[int, int]:
    """Signed hashes of a word's term (even) and stem (odd), 0 where it has none."""
    import xxhash

    text = word.decode("utf-8", "replace").lower()
    inner = "".join(c for c in text if c.isalnum())
    if not inner:
        return 0, 0
    term = (xxhash.xxh64_intdigest(inner) - (1 << 63)) & ~1
    return term, ((xxhash.xxh64_intdigest("stem " + inner[:STEM]) - (1 << 63)) | 1 if len(inner) > STEM else 0)


def distinct_words(blob: bytes) -> set[bytes]:
    found: set[bytes] = set()
    for part in between_words(blob):
        found.update(part.split())
    return found


def terms_of(blob: bytes) -> np.ndarray:
    """Sorted distinct term hashes of a text."""
    found = {h for w in distinct_words(blob) for h in term_hashes(w)}
    found.discard(0)
    return np.array(sorted(found), dtype=np.int64)


@dataclass
class Machine:
    """Features (sorted hashes), bias, linear weights and factors."""

    features: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, active: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums for texts whose active features are active[bounds[i]:bounds[i + 1]]."""
        v = self.factors[active]
        together = sum_rows(v, bounds)
        return self.bias + sum_rows(self.linear[active], bounds) + 0.5 * ((together**2) - sum_rows(v**2, bounds)).sum(axis=1)

    def looked_up(self, hashes: list[int]) -> list[int]:
        """Index of each hash among the features, -1 for others."""
        h = np.array(hashes, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.features, h), max(0, len(self.features) - 1))
        return np.where(self.features[at] == h, at, -1).tolist() if len(self.features) else [-1] * len(h)


class Scorer:
    """Scores texts; remembers the features of words while the memory of them stays small."""

    def __init__(self, model: Machine, most: int = 300_000):
        self.model, self.most, self.known = model, most, {}

    def active(self, blob: bytes) -> set[int]:
        found = distinct_words(blob)
        if len(self.known) > self.most:
            self.known.clear()
        new = [w for w in found if w not in self.known]
        if new:
            both = [h for w in new for h in term_hashes(w)]
            index = self.model.looked_up(both)
            self.known.update((w, tuple({i for i in index[2 * k : 2 * k + 2] if i >= 0})) for k, w in enumerate(new))
        return {i for w in found for i in self.known[w]}

    def scores(self, blobs: list[bytes]) -> np.ndarray:
        out = np.zeros(len(blobs))
        for part in pieces(blobs):
            sets = [sorted(self.active(b)) for b in blobs[part]]
            bounds = starts_of(np.array([len(s) for s in sets]))
            active = np.fromiter((i for s in sets for i in s), dtype=np.int64, count=int(bounds[-1]))
            out[part] = self.model.raw(active, bounds)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def likeness_of(terms: np.ndarray) -> int:
    """Likely copies of a text share the smallest of their scrambled terms."""
    return int(mix(terms.view(np.uint64)).min().view(np.int64)) if len(terms) else 0


def telling_pairs(where: np.ndarray, owner: np.ndarray, toxic: np.ndarray, names: int) -> np.ndarray:
    """Terms of the pairs that together say what their terms alone do not; each document is unlike the others.

    A pair is expected to add up what its terms add to the share of toxic documents.
    """
    n, p = len(toxic), toxic.mean()
    held = np.bincount(where, weights=toxic[owner], minlength=names)
    tried = np.sort(np.argsort(-held, kind="stable")[:PAIR_TERMS])
    new = np.full(names, -1)
    new[tried] = np.arange(len(tried))
    keep = new[where] >= 0
    x = np.zeros((n, len(tried)), dtype=np.float32)
    x[owner[keep], new[where[keep]]] = 1
    both, bad = x.T @ x, x[toxic].T @ x[toxic]
    seen = np.maximum(1, np.diag(both))
    added = np.diag(bad) / seen - p
    expected = both * np.clip(p + added[:, None] + added[None, :], 0, 1)
    z = np.triu(np.abs(bad - expected) / np.sqrt(np.maximum(1e-9, both * p * (1 - p))), 1)
    z[both < 4 * UNLIKE] = 0
    best = np.argsort(-z, axis=None, kind="stable")[:PAIRS]
    best = best[z.ravel()[best] >= PAIR_Z]
    return np.unique(tried[np.concatenate(np.divmod(best, len(tried)))]) if len(best) else tried[:0]


def fit(terms: list[np.ndarray], labels: np.ndarray, likeness: np.ndarray | None = None, rounds: int = 500, rate: float = 0.05, decay: float = 2e-6) -> Machine:
    """Weighted logistic loss with Adam steps over all documents, from the features that tell the classes apart best, alone or
    in pairs.

    The bias is held near its start: most clean texts show no feature, and a bias that fits them ever better would let no single
    term outweigh it.  In every other step each feature of a toxic text is left out by chance, so that a term which is telling
    by itself learns to do without the company it keeps.
    """
    labels = np.asarray(labels, dtype=np.float64)
    empty = Machine(np.zeros(0, np.int64), -5.0, np.zeros(0), np.zeros((0, FACTORS)))
    if not len(labels) or labels.min() == labels.max():
        return empty if not len(labels) or labels[0] == 0 else Machine(empty.features, 5.0, empty.linear, empty.factors)
    flat, owner = np.concatenate(terms), np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    names, where = np.unique(flat, return_inverse=True)
    positive, n = labels.sum(), len(labels)
    seen, bad = np.bincount(where, minlength=len(names)), np.bincount(where, weights=labels[owner], minlength=len(names))
    expected = seen * positive / n
    z = np.abs(bad - expected) / np.sqrt(np.maximum(1e-9, expected * (1 - positive / n)))
    z[(names % 2 != 0) & (bad < PURE * seen)] = 0  # a stem must speak for nearly all words that share it
    # Copies of one text are one piece of evidence.
    likeness = np.unique([likeness_of(t) for t in terms] if likeness is None else likeness, return_inverse=True)[1]
    toxic, kinds = labels > 0, int(likeness.max()) + 1
    unlike = np.bincount(np.unique(where[toxic[owner]] * kinds + likeness[owner[toxic[owner]]]) // kinds, minlength=len(names))
    z[unlike < UNLIKE] = 0
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    _, once = np.unique(likeness * 2 + toxic, return_index=True)
    place = np.full(n, -1)
    place[once] = np.arange(len(once))
    of_once = place[owner] >= 0
    paired = telling_pairs(where[of_once], place[owner[of_once]], toxic[once], len(names)) if len(names) else chosen[:0]
    chosen = np.union1d(chosen[z[chosen] >= Z], paired)
    new = np.full(len(names), -1)
    new[chosen] = np.arange(len(chosen))
    keep = new[where] >= 0
    all_active, all_owner = new[where][keep], owner[keep]
    rng = np.random.default_rng(5)
    model = Machine(names[chosen], -2.0, np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS)))
    weight = np.where(labels > 0, 0.5 / positive, 0.5 / (n - positive)) * n
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), model.linear, model.factors)]
    bias = np.array([model.bias])
    for t in range(1, rounds + 1):
        model.bias = float(bias[0])
        shown = rng.random(len(all_active)) < np.where((t % 2 == 0) & (labels[all_owner] > 0), 0.4, 1.0)
        active, owner = all_active[shown], all_owner[shown]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        error = weight * (1 / (1 + np.exp(-np.clip(model.raw(active, bounds), -30, 30))) - labels) / n
        v = model.factors[active]
        together = sum_rows(v, bounds)
        grad_linear = np.bincount(active, weights=error[owner], minlength=len(chosen)) + decay * model.linear
        pull = error[owner][:, None] * (together[owner] - v)
        grad_factors = np.stack([np.bincount(active, weights=pull[:, k], minlength=len(chosen)) for k in range(FACTORS)], axis=1) + decay * model.factors
        for p, g, (m1, m2) in zip((bias, model.linear, model.factors), (np.array([error.sum() + 0.05 * (bias[0] + 2)]), grad_linear, grad_factors), moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    model.bias = float(bias[0])
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Machine:
    """Fit on at most ``per_class`` labelled documents of each class where ``learn`` (over the labels' ids) holds.

    Labels other than 0 and 1 and null ids teach nothing; of several labels of one id the larger counts, and of several texts
    the one that sorts first.  Terms of fewer than ``UNLIKE`` documents are left out before the fit, which runs in one task
    over the bounded sample; the driver receives the machine alone.
    """
    marked = labels.where(learn).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and label_id is not null").groupBy("label_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    chosen = marked.where("label = 1").orderBy(*order).limit(per_class).unionByName(marked.where("label = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    taken = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("label_id", "label").agg(F.min("text").alias("text"))  # 2 x per_class ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(b or b"") for b in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([likeness_of(t) for t in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "label", "likeness", "terms"])

    def fitted(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id").combine_chunks()
        column = group.column("terms").combine_chunks()
        terms = [np.sort(column[i].values.to_numpy()) if column[i].is_valid else np.zeros(0, np.int64) for i in range(len(column))]
        model = fit(terms, group.column("label").to_numpy(), group.column("likeness").to_numpy())
        return pa.table({"bias": [model.bias], "features": pa.array([model.features.tobytes()], pa.binary()), "linear": pa.array([model.linear.tobytes()], pa.binary()), "factors": pa.array([model.factors.tobytes()], pa.binary())})

    of_text = stored(taken.mapInArrow(run, "doc_id long, label int, likeness long, terms array<long>"))
    term = of_text.select("doc_id", F.explode("terms").alias("term"))
    common = term.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= UNLIKE).select("term")
    held = term.join(common, "term").groupBy("doc_id").agg(F.collect_list("term").alias("held"))
    rows = of_text.select(F.col("doc_id").alias("of_id"), "label", "likeness").join(held, F.col("doc_id") == F.col("of_id"), "left").select(F.col("of_id").alias("doc_id"), "label", "likeness", F.col("held").alias("terms"))
    made = rows.groupBy().applyInArrow(fitted, "bias double, features binary, linear binary, factors binary").collect()
    dropped(of_text)
    if not made:
        return fit([], np.zeros(0))
    (r,) = made
    return Machine(np.frombuffer(r.features, dtype=np.int64), r.bias, np.frombuffer(r.linear), np.frombuffer(r.factors).reshape(-1, FACTORS))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: the chance that the text is toxic.

    Null and empty texts, and texts without a known term, get the score of the bias alone.  Repeated rows are each scored.
    Other columns are not read.  Without labels of both classes all texts get one score.  An empty table gives an empty result.
    """
    sent = sent_to_workers(docs.sparkSession, model)  # FEATURES x FACTORS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores([b or b"" for b in as_bytes(batch.column(1))]))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
