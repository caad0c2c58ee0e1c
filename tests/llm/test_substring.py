import hashlib

import numpy as np

from hearken.llm import recompress, substring
from hearken.llm.common import WordHashes, table


def plain(rows, width=13):
    first, out = {}, []
    key = lambda i: (i is None, i or 0)
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, key(i)), key(i))
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, 0, "y") for i, t in rows], "doc_id long, text string, row int, found string")
    return sorted(map(tuple, substring.dedup(frame).collect()), key=repr)


def test_whole_table_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert sorted(map(tuple, substring.dedup(docs).collect()), key=repr) == plain([tuple(r) for r in docs.collect()])


def test_edges(spark):
    p = " ".join(f"w{k}" for k in range(20))
    spam = "a " * 200
    rows = [(5, p), (3, "x " + p + " y"), (9, p), (9, p), (1, None), (2, ""), (None, p), (None, p + " z"), (20, spam), (21, spam + "b"), (22, "a b " * 60), (23, "b a " * 60), (30, " ".join(p.split())), (31, " ".join(f"w{k}" for k in range(12)))]
    assert run(spark, rows) == plain(rows)
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_vocabularies(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), " ".join(f"t{x}" for x in rng.integers(0, 2 + i % 3, rng.integers(0, 60)))) for i in range(120)]
    assert run(spark, rows) == plain(rows)


def test_pieces_of_long_texts_leave_no_trace(spark, monkeypatch):
    text = [" ".join(f"t{x}" for x in np.random.default_rng(2).integers(0, 9, 500)).encode()]
    whole = substring.windows_of(text, WordHashes(), 13)
    monkeypatch.setattr(substring, "PIECE", 40)
    for a, b in zip(whole, substring.windows_of(text, WordHashes(), 13)):
        assert a.tolist() == b.tolist()


def test_equal_windows_rest_on_equal_symbols():
    rng = np.random.default_rng(0)
    names = rng.integers(0, 2**63, 60, dtype=np.uint64)
    docs = [names[rng.integers(0, (2, 12, 60)[k % 3], rng.integers(0, 60))] for k in range(300)]
    docs += [np.concatenate((docs[a][:30], docs[b][5:], docs[c][:20])) for a, b, c in rng.integers(0, 300, (300, 3))]
    words, piece = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    seen = {}
    for at, key in zip(*recompress.windows(words, piece, 13)):
        assert seen.setdefault(tuple(words[at : at + 13]), key) == key
    assert len(set(seen.values())) > 0.2 * len(seen)  # neighbours share symbols


def test_forced_collisions_of_hashes_remove_nothing(spark, monkeypatch):
    """Words have 40 hashes only, so that unlike windows share symbols; what goes is judged by the words themselves."""

    class Weak(WordHashes):
        def __call__(self, texts):
            found, counts = WordHashes.__call__(self, texts)
            return found % np.uint64(40), counts

    monkeypatch.setattr(substring, "WordHashes", Weak)
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"t{x}" for x in rng.integers(0, 3000, 200))) for k in range(60)]
    rows += [(100 + k, " ".join([*rows[k][1].split()[20:50], *rows[k + 1][1].split()[:14]])) for k in range(20)]
    assert run(spark, rows) == plain(rows)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 1)
    monkeypatch.setattr(substring, "GATHER", 500)
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"t{x}" for x in rng.integers(0, 4, 60))) for k in range(40)]
    assert run(spark, rows) == plain(rows)


def test_kept_text(spark):
    p = " ".join(f"w{k}" for k in range(14))
    rows = spark.createDataFrame([(1, p), (2, "a\n" + p + "  b")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in substring.dedup(rows, texts=True).collect()} == {1: p, 2: "a b"}
