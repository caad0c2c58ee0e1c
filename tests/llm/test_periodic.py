"""Periodic runs against brute force, with forced collisions, long texts and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearken.llm import periodic, queries


def all_runs(a, repeats=4, least=6):
    """Every stretch whose words q apart are equal and that no neighbour extends, for every q; smallest periods only."""
    found = set()
    for q in range(1, len(a) + 1):
        i = 0
        while i + q < len(a):
            if a[i] != a[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(a) and a[i] == a[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, repeats * q) and not any(all(a[x] == a[x + r] for x in range(s, e - r)) for r in range(1, q)):
                found.add((s, e, q))
    return found


def made(seed):
    rng = random.Random(seed)
    a = [rng.randrange(rng.choice([1, 2, 2, 3])) for _ in range(rng.randint(0, 90))]
    if a and rng.random() < 0.7:
        p, s = rng.randint(1, 14), rng.randrange(len(a))
        for x in range(s, len(a)):
            a[x] = a[s + (x - s) % p]
        if rng.random() < 0.5:
            a[rng.randrange(len(a))] = 5
    return np.array(a, dtype=np.int32)


@pytest.mark.parametrize("repeats,least", [(4, 6), (3, 4), (5, 1)])
def test_runs_equal_brute_force(repeats, least):
    for seed in range(700):
        a = made(seed)
        assert periodic.lyndon_runs(a, repeats, least) == all_runs(a.tolist(), repeats, least), a.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_any_sequence(a):
    assert periodic.lyndon_runs(np.array(a, dtype=np.int32)) == all_runs(a)


def test_hashes_that_always_agree_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic.Extensions, "same", lambda self, i, j, k: True)
    for seed in range(300):
        a = made(seed)
        assert periodic.lyndon_runs(a) == all_runs(a.tolist())


def test_packed_stretches_give_the_same(monkeypatch):
    monkeypatch.setattr(periodic, "PACKED", 10)
    for seed in range(200):
        a = made(seed)
        assert periodic.lyndon_runs(a) == all_runs(a.tolist())


def test_rare_words_part_a_text():
    for seed in range(300):
        a = made(seed)
        found = {(lo + s, lo + e, p) for lo, hi in periodic.stretches(a, 4, 6) for s, e, p in periodic.lyndon_runs(a[lo:hi])}
        assert found == all_runs(a.tolist())


def test_long_periodic_texts_take_little_more_than_their_length():
    assert periodic.lyndon_runs(np.zeros(100_000, dtype=np.int32)) == {(0, 100_000, 1)}
    block = np.random.default_rng(0).integers(0, 50, 1000).astype(np.int32)
    assert periodic.lyndon_runs(np.tile(block, 60)) >= {(0, 60_000, 1000)}


def test_texts_are_numbered_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 7} é{k % 3}\t" for k in range(2000)).encode()
    whole = periodic.examined(text)
    monkeypatch.setattr(periodic, "between_words", lambda t: iter(re.findall(rb".{1,50}(?:[ \t]|$)", t, re.S)))
    assert periodic.examined(text, pieces=13) == whole
    assert whole.runs == [(0, 4000, 42)] and whole.n_dropped == 4000 - 42


def test_first_of_equally_many_repeats():
    found = periodic.examined(b"x " * 8 + b"y " + b"a b " * 8)
    assert found.runs == [(0, 8, 1), (9, 16, 2)] and found.best == (0, 8, 1)
    assert periodic.examined(b"a b " * 4 + b"q " + b"x " * 9).best == (9, 9, 1)


def expected(doc_id, text):
    """A row of the query by brute force."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = sorted((s, e - s, q) for s, e, q in all_runs(w))
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)), n, len(gone))


def test_query_rows_by_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a " * 6, "a " * 5, "a b a b " * 4, "x y z " * 5 + "end", "\x0b\x0ca\rb\n" * 9]
    texts += [" ".join(rng.choice(["the", "of", "é", "　", "z"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    ids = [0, 7, -3, None, None, 9, 9, 1, 2, *range(100, 160)]
    rows = list(zip(ids, texts, ["x"] * len(ids)))
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids if i is not None)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=str)


def test_empty_table_and_bounds(spark):
    assert periodic.runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic.runs(spark.createDataFrame([], "doc_id long, text string"), repeats=2)


def test_all_runs_of_a_row_come_back(spark):
    (row,) = periodic.runs(spark.createDataFrame([(5, "x " * 8 + "y " + "a b " * 4)], "n long, said string"), "n", "said").collect()
    assert [tuple(r) for r in row.runs] == [(0, 8, 1), (9, 8, 2)] and row.doc_id == 5 and row.n_dropped == 13
