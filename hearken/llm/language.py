"""Language identification: a family first, then one-versus-one linear support vector machines inside it.

All decisions share one pass over hashed byte n-grams of the whole lower-cased text, so a text of any length needs only its
sums.  A family is told from the rest by a machine of its own, so the model grows with the number of languages and not with
its square.  The machines are fitted in tasks of the cluster, each from a bounded number of labelled documents per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hearken.llm.common import as_bytes, between_words, in_slices, named, numbered, pieces, sent_to_workers, starts_of

#: Which languages are close: one list per family.  A language named nowhere is a family of its own.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"), "romance": ("fr", "es", "it", "pt", "ro", "ca")}
#: Size of the hashed feature space, n-gram lengths, labelled documents read per language, and documents of the other families
#: that a family's machine learns from.
BUCKETS, ORDERS, PER_LANGUAGE, OTHERS = 8192, (2, 3, 4), 400, 1600
#: Chosen documents up to which their ids are broadcast.
BROADCAST_ROWS = 1_000_000
GAP = b"\0\0\0\0"


def hashed_grams(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (orders x positions) of every n-gram that starts in a text, and the bounds of the texts."""
    whole = np.frombuffer(GAP.join([*blobs, GAP]), dtype=np.uint8).astype(np.uint32)
    bounds = starts_of(np.array([len(b) + len(GAP) for b in blobs]))
    n = int(bounds[-1])
    code, rows = whole[:n].copy(), []
    for k in range(1, max(ORDERS)):
        code |= whole[k : n + k] << np.uint32(8 * k)
        if k + 1 in ORDERS:
            own = code.copy()
            for back in range(1, k + 1):
                own[bounds[1:] - back] = 0  # these reach into the next text
            rows.append(((own * np.uint32(0x9E3779B1) + np.uint32(k * 0x1EBCA6B)) >> np.uint32(32 - 13)).astype(np.int32))
    return np.stack(rows), bounds


@dataclass
class Model:
    """Languages by family, and linear machines by their two sides; positive means the first."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def margins(self, blobs: list[bytes]) -> dict[tuple[str, str], np.ndarray]:
        """Each machine's margin of each text, from frequencies of n-grams."""
        parts = [(i, p) for i, blob in enumerate(blobs) for p in between_words(blob)]
        sums, size = np.zeros((len(self.machines), len(blobs))), np.zeros(len(blobs))
        for group in pieces([p for _, p in parts]):
            own = np.array([i for i, _ in parts[group]])
            grams, bounds = hashed_grams([p for _, p in parts[group]])
            np.add.at(size, own, np.diff(bounds) * len(ORDERS))
            for m, (weights, _) in enumerate(self.machines.values()):
                np.add.at(sums[m], own, sum(np.add.reduceat(weights[g], bounds[:-1], dtype=np.float64) for g in grams))
        return {key: sums[m] / np.maximum(1, size) + bias for m, (key, (_, bias)) in enumerate(self.machines.items())}

    def predict(self, blobs: list[bytes]) -> tuple[list[str | None], np.ndarray]:
        """The language and its chance: that of its family times the mean chance against its relatives."""
        if not self.families:
            return [None] * len(blobs), np.zeros(len(blobs))
        chance = {key: 1 / (1 + np.exp(-3 * np.clip(m, -20, 20))) for key, m in self.margins(blobs).items()}
        kinds = sorted(self.families)
        if len(kinds) > 2:
            family = np.stack([chance[f"family:{k}", ""] for k in kinds], axis=1)
            family /= family.sum(axis=1, keepdims=True)
        elif len(kinds) == 2:
            first = chance[f"family:{kinds[0]}", f"family:{kinds[1]}"]
            family = np.stack([first, 1 - first], axis=1)
        else:
            family = np.ones((len(blobs), 1))
        best = family.argmax(axis=1)
        labels, scores = [None] * len(blobs), np.zeros(len(blobs))
        for f, kind in enumerate(kinds):
            names = sorted(self.families[kind])
            own = np.zeros((len(blobs), len(names)))
            for (i, a), (j, b) in combinations(enumerate(names), 2):
                own[:, i] += chance[a, b]
                own[:, j] += 1 - chance[a, b]
            own = own / (len(names) - 1) if len(names) > 1 else own + 1
            for i in np.flatnonzero(best == f):
                k = int(own[i].argmax())
                labels[i], scores[i] = names[k], family[i, f] * own[i, k]
        return labels, np.clip(scores, 0, 1)


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, cost: float = 30.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient steps; classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (2 * cost * float((weight * (1 + np.einsum("ij,ij->i", x, x))).sum()) + 1)
    w = v = np.zeros(x.shape[1] + 1, dtype=np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        pull = (weight * y * slack).astype(np.float32)
        gradient = v - 2 * cost * np.append(pull @ x, pull.sum())
        new = (v - step * gradient).astype(np.float32)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A machine over n-gram frequencies, which are scaled in place so that rare n-grams count as well."""
    squares = sum((x[at : at + 128] ** 2).sum(axis=0, dtype=np.float64) for at in range(0, len(x), 128))
    spread = np.sqrt(np.maximum(0, squares / max(1, len(x)) - x.mean(axis=0, dtype=np.float64) ** 2))
    scale = (np.where(spread > 0, np.sqrt(spread.max(initial=0) / np.maximum(spread, 1e-12)), 0) * 30).astype(np.float32)
    x *= scale
    weights, bias = machine(x, y.astype(np.float32))
    return weights * scale, bias


def lowered(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in as_bytes(pc.utf8_lower(column))]


def frequencies(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, in order, and their shares of all n-grams."""
    count, total = np.zeros(BUCKETS, dtype=np.int64), 0
    for part in between_words(blob):
        grams, _ = hashed_grams([part])
        count, total = count + np.bincount(grams.ravel(), minlength=BUCKETS), total + grams.size
    at = np.flatnonzero(count)
    return at.astype(np.int32), (count[at] / max(1, total)).astype(np.float32)


def lessons(families: dict[str, list[str]], per_language: int) -> list[tuple[str, str, str, int, int]]:
    """(left, right, language, side, documents) of all machines: which languages teach each side, and by how many documents."""
    kinds, langs = sorted(families), sum(map(len, families.values()))
    out = []
    for kind in kinds if len(kinds) > 2 else kinds[: len(kinds) - 1]:
        right = "" if len(kinds) > 2 else f"family:{kinds[1]}"
        others = min(per_language, -(-max(OTHERS, per_language) // max(1, langs - len(families[kind]))))
        out += [(f"family:{kind}", right, lang, 1 if k == kind else -1, per_language if k == kind or len(kinds) == 2 else others) for k in kinds for lang in families[k]]
    for names in families.values():
        out += [(a, b, lang, side, per_language) for a, b in combinations(sorted(names), 2) for lang, side in ((a, 1), (b, -1))]
    return out


def train(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Fit on at most ``per_language`` documents of each language where ``learn`` holds, those with the smallest id hashes.

    Rows without language or text teach nothing.  Of rows with one id and language the text that sorts first counts.  Every
    language that occurs is learned, however rare.
    """
    rows = docs.where(learn).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    home = {lang: kind for kind, names in families.items() for lang in names}
    known: dict[str, list[str]] = {}
    for lang in sorted(counts):
        known.setdefault(home.get(lang, f"only {lang}"), []).append(lang)
    spark = docs.sparkSession
    # A few times as many ids as are wanted pass by their hash; only those are told apart and ranked.
    share = spark.createDataFrame([(lang, min(1.0, (4 * per_language + 64) / n)) for lang, n in counts.items()], "of_lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    ids = rows.select("lang", "doc_id").join(F.broadcast(share), F.col("lang") == F.col("of_lang")).where(drawn).groupBy("lang", "doc_id").agg(F.lit(1).alias("one"))  # a row per language
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language).select(F.col("lang").alias("of_lang"), F.col("doc_id").alias("of_id"), "place")
    few = per_language * len(counts) <= BROADCAST_ROWS
    taken = rows.join(F.broadcast(chosen) if few else chosen, (F.col("lang") == F.col("of_lang")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).groupBy("lang", "place").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [frequencies(blob) for blob in lowered(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([f for _, f in found], pa.list_(pa.float32()))], ["lang", "place", "at", "freq"])

    def learned(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("lang", "ascending"), ("place", "ascending")])
        x, row = np.zeros((group.num_rows, BUCKETS), dtype=np.float32), 0
        for batch in group.select(["at", "freq"]).to_batches():
            for at, freq in zip(batch.column(0), batch.column(1)):
                x[row, at.values.to_numpy()] = freq.values.to_numpy()
                row += 1
        weights, bias = fit(x, group.column("side").to_numpy())
        return pa.table({"left": group.column("left")[:1], "right": group.column("right")[:1], "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary()), "bias": [bias]})

    plan = spark.createDataFrame(lessons(known, per_language), "left string, right string, of_lang string, side int, most int")
    features = taken.mapInArrow(count, "lang string, place int, at array<int>, freq array<float>")
    taught = features.join(plan, (F.col("lang") == F.col("of_lang")) & (F.col("place") <= F.col("most"))).select("left", "right", "side", "lang", "place", "at", "freq")
    made = taught.groupBy("left", "right").applyInArrow(learned, "left string, right string, weights binary, bias double").collect()  # a row of BUCKETS numbers per machine
    return Model(known, {(r.left, r.right): (np.frombuffer(r.weights, dtype="<f4"), r.bias) for r in sorted(made)})


def labelled(docs: DataFrame, model: Model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """``docs`` with __lang and __score, in place of columns of these names; no shuffle.

    ``und`` with score 0 where the text is null, has no letter, or no language was learned.  Ties go to the name that sorts
    first.  Repeated rows are each predicted.  An empty table gives an empty result.  With ``least``, only the rows of a known
    language with that score at least, and no column more.
    """
    sent = sent_to_workers(docs.sparkSession, model)  # BUCKETS numbers per family and per pair of relatives
    flat, at, n = numbered(docs), docs.columns.index(text_col), len(docs.columns)
    names = [*flat.columns, "lang", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in in_slices(batches):
            labels, scores = model.predict(lowered(batch.column(at)))
            letter = batch.column(n).to_pylist()
            labels = [lang if ok and lang else "und" for lang, ok in zip(labels, letter)]
            scores = [float(s) if lang != "und" else 0.0 for s, lang in zip(scores, labels)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names)

    given = flat.select("*", F.coalesce(F.col(f"_{at}").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    done = given.mapInArrow(run, T.StructType([*flat.schema.fields, T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    if least is None:
        return named(done, docs, {"lang": "__lang", "score": "__score"})
    return named(done.where((F.col("lang") != "und") & (F.col("score") >= least)), docs)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; see ``labelled``.  Other columns are not read."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return labelled(narrow, model).select("doc_id", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
