import numpy as np
import xxhash
from pyspark.sql import functions as F

from hearken.llm import common, simhash, vptree
from hearken.llm.common import table

SMALL = "/root/testdata/sf0.001"


def plain_print(text, width=3):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = (text or "").encode().translate(low).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(rows, reach=2):
    prints = [(i, plain_print(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= reach:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, f"{p:016x}", least[find(k)]) for k, (i, p) in enumerate(prints))


def test_whole_table_against_brute_force(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == plain_components([tuple(r) for r in docs.collect()])


def test_edges(spark):
    texts = [(5, "The cat sat"), (2, "the CAT  sat"), (9, None), (7, " \t"), (7, " \t"), (11, "one"), (12, "É é"), (13, "é é")]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, fp string, component_id int")
    got = sorted(map(tuple, simhash.near_duplicates(rows).collect()))
    assert got == plain_components(texts)
    assert simhash.near_duplicates(rows.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "zz")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(nulls).collect()} == {(None, 3), (3, 3), (None, None)}


def test_one_of_each(spark):
    rows = spark.createDataFrame([(4, "a b c d", 1, 7), (2, "a b c d", 2, 7), (2, "a b c d", 3, 7), (8, "other words here", 4, 7), (None, "x", 5, 7)], "doc_id long, text string, node int, __odd int")
    kept = simhash.one_of_each(rows).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 2, 8]
    assert simhash.one_of_each(rows.where("false")).count() == 0


def near(rng, n):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    flipped = base.copy()
    for _ in range(2):
        flipped ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(np.concatenate((base, flipped)))


def pairs_within(points, reach):
    return {(int(points[i]), int(q)) for i in range(len(points)) for q in points[i + 1 :][np.bitwise_count(points[i + 1 :] ^ points[i]) <= reach]}


def test_tree_and_leaves_lose_no_pair():
    points = near(np.random.default_rng(3), 2500)
    tree, got, homes, leaves = vptree.Tree.layout(points, 1.0, 300), set(), [], 0
    for _, h, g in tree.routed(points, 2):
        homes.append(h)
        leaves += 1
        both = np.concatenate((points[h], points[g]))
        for i, j in vptree.near_pairs(points[h], points[g], 2):
            got |= {(min(a, b), max(a, b)) for a, b in zip(both[i].tolist(), both[j].tolist())}
    assert leaves > 8 and sorted(np.concatenate(homes)) == list(range(len(points)))
    assert got == pairs_within(points, 2)


def test_large_leaf_continues_the_tree(monkeypatch):
    monkeypatch.setattr(vptree, "INNER", 64)
    points = near(np.random.default_rng(4), 800)
    got = {(min(a, b), max(a, b)) for i, j in vptree.near_pairs(points, points[:0], 2) for a, b in zip(points[i].tolist(), points[j].tolist())}
    assert got == pairs_within(points, 2)


def test_grafted_tree_sends_points_on():
    points = near(np.random.default_rng(5), 3000)
    tree = vptree.Tree.layout(points, 1.0, 2000)
    home = tree.home(points)
    subs = {leaf: vptree.Tree.layout(points[home == leaf], 1.0, 200) for leaf in np.unique(home).tolist()[:2]}
    after = tree.grafted(subs)
    assert after.leaves == tree.leaves + sum(s.leaves - 1 for s in subs.values())
    now = after.home(points)
    for leaf in np.unique(home).tolist():
        inside = np.unique(now[home == leaf])
        assert len(inside) == (subs[leaf].leaves if leaf in subs else 1)
    assert len(np.unique(now)) == after.leaves


def test_forest_keeps_the_components_of_every_bound():
    rng = np.random.default_rng(6)
    a, b, w = rng.integers(0, 200, 3000), rng.integers(0, 200, 3000), rng.integers(0, 30, 3000)
    keep = vptree.forest(200, a, b, w)

    def parts(x, y):
        root = list(range(200))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for i, j in zip(x.tolist(), y.tolist()):
            root[max(find(i), find(j))] = min(find(i), find(j))
        return [find(k) for k in range(200)]

    for bound in range(30):
        assert parts(a[w <= bound], b[w <= bound]) == parts(a[keep][w[keep] <= bound], b[keep][w[keep] <= bound])
    assert len(keep) <= 199 and len(vptree.forest(5, a[:0], b[:0], w[:0])) == 0


def test_links_through_spark_with_many_leaves(spark, monkeypatch):
    """The tree grows in rounds, as each draw is too small for all leaves; components against brute force over all pairs."""
    points = near(np.random.default_rng(9), 3000)
    frame = spark.createDataFrame([(0, int(p), 0, k, 0) for k, p in enumerate(points.view(np.int64))], "tab long, fp long, then long, name long, size long")
    trees = vptree.grown(frame, 1, 2, leaf=100, sample=512)
    sizes = np.unique(trees[0].home(points), return_counts=True)[1]
    assert trees[0].leaves >= 30 and sizes.max() <= 200
    edges = vptree.links(frame, 1, 2, leaf=100, sample=512).collect()
    number = {int(p): k for k, p in enumerate(points)}
    want = {(number[x], number[y]) for x, y in pairs_within(points, 2)}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in edges} <= want
    assert plain_roots(len(points), want) == plain_roots(len(points), [(r.a, r.b) for r in edges])


def plain_roots(n, pairs):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for x, y in pairs:
        root[max(find(x), find(y))] = min(find(x), find(y))
    return [find(k) for k in range(n)]


def test_leaves_stay_as_small_with_ten_times_the_points(spark):
    largest = []
    for n in (20_000, 200_000):
        frame = spark.range(n).select(F.lit(0).cast("long").alias("tab"), F.xxhash64("id").alias("fp"))
        tree = vptree.grown(frame, 1, 2, leaf=1000, sample=1000)[0]
        found = frame.toArrow().column("fp").to_numpy().view(np.uint64)
        largest.append(np.unique(tree.home(found), return_counts=True)[1].max())
    assert max(largest) <= 2000


def test_text_in_pieces_has_the_same_fingerprint(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(f"W{i}" for i in rng.integers(0, 900, 4000))
    want = plain_print(text)
    monkeypatch.setattr(common.between_words, "__defaults__", (97,))
    assert simhash.fingerprint_of(text.encode(), 3) % 2**64 == want
    long_word = b"x" * 5000
    assert b"".join(common.between_words(b"a b " + long_word + b" c" * 90)) == b"a b " + long_word + b" c" * 90


def test_word_hashes_of_long_texts_in_pieces(monkeypatch):
    texts = [b"one Two three", b"", b"  lead and trail ", b"w" * 700 + b" x", b"a,b c! -- d " * 400]
    for how in ({}, {"lower": True}, {"skip": b",!-"}):
        want = common.WordHashes(**how)(texts)
        with monkeypatch.context() as m:
            m.setattr(common, "CHUNK_BYTES", 50)
            m.setattr(common.between_words, "__defaults__", (50,))
            m.setattr(common.pieces, "__defaults__", (50,))
            got = common.WordHashes(**how)(texts)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_word_prints_against_plain_votes():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 300, 7, 1200)]
    words[3] = np.repeat(words[3][:3], 5)
    got = simhash.word_prints(words)
    for row, found in zip(got, words):
        for k in range(simhash.TABLES):
            hashes = [int(common.mix(np.uint64(w) ^ simhash._SEEDS[k])) for w in set(found.tolist())]
            assert int(row[k]) % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 60).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(200, 100), (300, 100)], "a long, b long"))
    got = {r.node: r.component for r in simhash.components(chain).collect()}
    assert got == {**{k: 1 for k in range(2, 61)}, 200: 100, 300: 100}
