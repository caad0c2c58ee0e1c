import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hearken.llm import lmscore
from hearken.llm.common import WordHashes, id_bucket, table

SMALL = "/root/testdata/sf0.001"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain(rows, learn):
    split = {k: (t or "").encode().translate(LOW).split() + [None] for k, (_, t) in enumerate(rows)}
    counts = Counter(w for k, (i, _) in enumerate(rows) if learn(i) for w in split[k])
    total, distinct = sum(counts.values()), len(counts)
    return sorted(((i, len(split[k]), sum(counts[w] > 0 for w in split[k]), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in split[k]), 6)) for k, (i, _) in enumerate(rows)), key=repr)


def digest(frame):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in frame.collect()), key=repr)


def learn(i):
    return zlib.crc32(str(i).encode()) % 7 != 2


def test_base_over_the_whole_table(spark, monkeypatch):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    monkeypatch.setattr(lmscore, "HEAD", 500)  # most distinct tokens are asked for
    assert digest(lmscore.score(docs, id_bucket("doc_id", 7) != 2)) == plain([tuple(r) for r in docs.collect()], learn)


def test_edges(spark):
    rows = [(1, "The the THE cat"), (2, None), (3, ""), (4, "É é"), (1, "again the cat"), (1, "again the cat"), (9, "unseen tokens only")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, token int")
    assert digest(lmscore.score(frame, F.col("doc_id") < 9)) == plain(rows, lambda i: i < 9)
    assert lmscore.score(frame.where("false"), F.lit(True)).count() == 0
    nothing = lmscore.score(frame, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score <= 0 for r in nothing)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = lmscore.score(docs, id_bucket("doc_id", 7) != 2).where(id_bucket("doc_id", 7) == 2).agg(F.sum("base_score").alias("b"), F.sum("score").alias("s"), F.max("score").alias("m")).first()
    assert got.s > got.b and got.m <= 0


def test_filter_gives_back_quantised_counts():
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(0, 2**31, 20_000).astype(np.uint32) * np.uint32(2))
    q = lmscore.quantised(rng.integers(1, 1000, len(grams)))
    bits = np.frombuffer(lmscore.filled(grams, q), np.uint8)
    level = lmscore.levels(bits, grams, int(q.max()))
    assert (level >= q).all() and (level == q).mean() > 1 - 2 * lmscore.ERROR
    assert (lmscore.levels(bits, grams + np.uint32(1), int(q.max())) > 0).mean() < 1.5 * lmscore.ERROR


def test_error_is_the_same_at_every_size():
    """A hundred times the grams get a hundred times the bits."""
    rng = np.random.default_rng(1)
    for n in (2_000, 200_000):
        grams = np.unique(rng.integers(0, 2**31, n).astype(np.uint32) * np.uint32(2))
        bits = np.frombuffer(lmscore.filled(grams, np.ones(len(grams), np.int64)), np.uint8)
        assert 0.5 * lmscore.ERROR < (lmscore.levels(bits, grams + np.uint32(1), 1) > 0).mean() < 1.5 * lmscore.ERROR
        assert 8 < 8 * len(bits) / len(grams) < 9


def test_probing_a_full_filter_ends():
    assert lmscore.levels(np.full(512, 255, dtype=np.uint8), np.arange(100, dtype=np.uint32), 4).tolist() == [4] * 100


def test_segments_part_the_hash_space():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    for text_bytes in (0, 1 << 30, 1 << 50):
        segments = lmscore.Segments(text_bytes)
        held, cuts = segments.cuts(grams)
        assert (np.repeat(held, np.diff(cuts)) == (grams >> np.uint64(64 - segments.log2)).astype(np.int64)).all()
        inner = segments.inner(grams)
        assert all((np.diff(inner[a:b].astype(np.int64)) >= 0).all() for a, b in zip(cuts[:-1], cuts[1:]))
    assert (lmscore.from_steps(lmscore.steps(grams), np.uint64) == grams).all()


def test_several_pieces_and_segments_give_the_same(spark, monkeypatch):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    fold = id_bucket("doc_id", 7) != 2
    want = {r.doc_id: (r.n_known, round(r.score, 0)) for r in lmscore.score(docs, fold).collect()}
    monkeypatch.setattr(lmscore, "PIECE_BYTES", 10_000)
    monkeypatch.setattr(lmscore, "SEGMENT_BYTES", 1_000)
    monkeypatch.setattr(lmscore, "GATHER", 3_000)
    got = {r.doc_id: (r.n_known, r.score) for r in lmscore.score(docs, fold).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) <= 2 + 0.02 * abs(want[i][1]) for i in want)


def test_score_against_plain_smoothing(spark):
    """With a filter so empty that it errs nowhere, scores follow from counts by the smoothing's formula."""
    texts = ["a b a b c", "a b", "c c c", "a d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lmscore.score(rows, F.col("doc_id") < 3).collect()}
    split = [["<s>", *t.split(), "</s>"] for t in texts]
    single = Counter(w for s in split[:3] for w in s)
    pair = Counter(p for s in split[:3] for p in zip(s, s[1:]))
    total, distinct = sum(v for w, v in single.items() if w != "<s>"), len(single) - 1
    q = lambda n: 1 + math.floor(2 * math.log2(n) + 1e-9) if n else 0
    low, high = lambda n: 2 ** ((q(n) - 1) / 2) if n else 0.0, lambda n: 2 ** (q(n) / 2)
    for k, s in enumerate(split):
        want = sum(math.log10(0.6 * min(1, low(pair[p]) / high(single[p[0]])) + 0.4 * (low(single[p[1]]) + 1) / (total + distinct + 1)) for p in zip(s, s[1:]))
        assert abs(got[k] - want) < 1e-6, k


def test_word_hashes_tell_words_apart():
    texts = [b"", b" \t\n", b"ab ba aab aba baa", "É é".encode(), b"x" * 5000 + b" y", b"\x0bq\x0c"]
    hashes, counts = WordHashes()(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(set(hashes.tolist())) == len(set(words)) == len(words)
    lower, _ = WordHashes(lower=True)([b"AbC abc", "É é".encode()])
    assert lower[0] == lower[1] and lower[2] != lower[3]
    marked, _ = WordHashes(skip=b".,")([b"word wo.rd, .word ., , word" + b" " + b"x" * 300 + b" " + b"x." * 300])
    assert len(set(marked[[0, 1, 2, 5]].tolist())) == 1 and marked[3] == marked[4] == 0 and marked[6] == marked[7] != 0
