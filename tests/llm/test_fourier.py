"""The quality classifier: statistics, kernel, sums, calibration, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearken.llm import fourier, queries


def texts(n, seed=0):
    """(doc_id, text, quality): plain prose against marks, shouting and repetition."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.25
        if bad:
            w = rng.choice([[x + rng.choice(["###", "$$$"]) for x in w], [x.upper() + "!!" for x in w], [w[0]] * len(w)])
        rows.append((k, " ".join(w), int(not bad)))
    return rows


def frames(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, stats string"), spark.createDataFrame([(i, q, 1) for i, _, q in rows], "doc_id long, quality int, score int")


@pytest.fixture(scope="module")
def trained(spark):
    rows = texts(600)
    docs, labels = frames(spark, rows)
    return rows, docs, labels, fourier.train(fourier.measured(docs), labels, F.col("doc_id") % 5 != 0)


def test_held_out_accuracy(trained):
    rows, docs, _, model = trained
    score = {r.doc_id: r.score for r in fourier.score(fourier.measured(docs), model).collect()}
    held = [(score[i], q) for i, _, q in rows if i % 5 == 0]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= 0.3) == q for s, q in held]) >= 0.97


def test_shares_rise_with_raw_scores(trained):
    model = trained[3]
    assert (np.diff(model.raw) > 0).all() and (np.diff(model.share) >= 0).all()


def test_sums_do_not_depend_on_the_deal(spark, trained):
    rows, docs, labels, model = trained
    other = fourier.train(fourier.measured(docs.repartition(7)), labels.repartition(5), F.col("doc_id") % 5 != 0)
    assert (other.weights == model.weights).all() and (other.share == model.share).all()


def test_normal_equations_give_ridge_weights(spark, trained):
    """The weights are those of a direct solution over all rows."""
    rows, docs, labels, model = trained
    taught = [(fourier.statistics(t.encode()), q) for i, t, q in rows if i % 5]
    z, y = model.features(np.array([s for s, _ in taught])) / fourier.PART, np.array([q for _, q in taught], dtype=float)
    found = []
    for ridge in model.kernel.ridges:
        penalty = np.full(z.shape[1], ridge * len(y))
        penalty[-1] = 0
        w = np.linalg.solve(z.T @ z + np.diag(penalty) + 1e-9 * len(y) * np.eye(len(penalty)), z.T @ y)
        found.append(np.abs(w - model.weights).max())
    assert min(found) < 1e-6


def test_features_approximate_the_kernel():
    kernel = fourier.Kernel(features=8192)
    d = len(fourier.STATISTICS)
    model = fourier.Classifier(np.zeros(d), np.ones(d), kernel, np.zeros(8193), np.zeros(1), np.zeros(1))
    x = np.random.default_rng(2).normal(size=(6, d))
    z = model.features(x)[:, :-1] / fourier.PART
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(2 * z @ z.T / 8192 - np.exp(-far / (2 * kernel.width**2 * d))).max() < 0.06


def test_blocks_are_pooled_until_shares_rise():
    raw, share = fourier.pooled(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 0.0, 3.0, 4.0]), np.array([2.0, 2.0, 4.0, 4.0]))
    assert raw.tolist() == [0.5, 2.0, 3.0] and share.tolist() == [1.5 / 5, 3.5 / 5, 4.5 / 5]


@pytest.mark.parametrize("of", [[], [1, 1], [0, 0, 0]])
def test_labels_of_one_class(spark, of):
    rows = [(k, "some words", q) for k, q in enumerate(of)] + [(9, None, None)]
    docs, labels = frames(spark, rows)
    scores = {r.score for r in fourier.classified(docs, labels, F.lit(True)).collect()}
    assert len(scores) == 1 and scores.pop() == pytest.approx(0.5 if not of else (sum(of) + 0.5) / (len(of) + 1))


def test_odd_rows_and_an_empty_table(spark, trained):
    model = trained[3]
    rows = [(None, "a b", "k"), (1, None, "k"), (1, None, "k"), (2, "", "k"), (3, " \n\t", "k"), (4, " 　", "k"), (5, "w " * 700_000, "k"), (6, "\n" * 10, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    done = fourier.score(fourier.measured(df), model).collect()
    assert len(done) == len(rows) and len({r.score for r in done if r.doc_id in (1, 2, 3, 6)}) == 1
    assert fourier.score(fourier.measured(df.limit(0)), model).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "".join(f"line {k % 50} of #{k}!\n" + "\n" * (k % 3) for k in range(400)).encode()
    whole = fourier.statistics(text)
    monkeypatch.setattr(fourier, "CHUNK_BYTES", 37)
    assert fourier.statistics(text) == whole
    assert fourier.line_repeats(b"a\nb\n\na\n a\nb") == (5, 2)


def test_repeated_ids_and_labels_teach_once(spark):
    rows = texts(200, seed=3)
    docs, labels = frames(spark, rows)
    once = fourier.train(fourier.measured(docs), labels, F.lit(True))
    extra = labels.union(spark.createDataFrame([(None, 0, 1), (3, None, 1), (4, 7, 1)], labels.schema)).union(labels)
    assert (fourier.train(fourier.measured(docs.union(docs)), extra, F.lit(True)).weights == once.weights).all()


def test_registered_query_learns_from_its_folds_alone(spark, tmp_path):
    rows = texts(300, seed=5)
    docs, labels = frames(spark, rows)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    docs.write.parquet(f"{tmp_path}/b/documents.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    turned.write.parquet(f"{tmp_path}/b/labels.parquet")
    a, b = (sorted(map(tuple, queries.op11_quality_classifier(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b and len(a) == 300 and {r[1] for r in a} == {True, False} and all(r[3] == (r[2] >= 0.3) for r in a)
