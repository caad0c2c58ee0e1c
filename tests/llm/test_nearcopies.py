from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hearken.llm import simhash
from hearken.llm.common import table


LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    words = text.translate(LOW).split()
    return {hash(tuple(words[k : k + 5])) for k in range(max(1, len(words) - 4))} if words else set()


def true_links(texts):
    """Pairs of unlike sets with a similarity of 0.8 or more, by counting what each set shares with all before it."""
    sets, at, out = {}, {}, {}
    for i, t in texts:
        sets.setdefault(frozenset(shingles(t)), i)
    size = {i: len(s) for s, i in sets.items()}
    for s, i in sets.items():
        for j, n in Counter(j for g in s for j in at.get(g, ())).items():
            if n >= 0.8 * (size[i] + size[j] - n):
                out[j, i] = n / (size[i] + size[j] - n)
        for g in s:
            at.setdefault(g, []).append(i)
    return out


def test_recall_on_copies_with_changed_words(spark):
    """Copies with 1 to 6 changed words, on both sides of the bound, against brute force."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(200):
        text = [f"w{i}" for i in rng.integers(0, 500, 150)]
        edited = list(text)
        for i in rng.choice(150, 1 + k % 6, replace=False):
            edited[i] = "edited"
        texts += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(edited))]
    want = true_links(texts)
    texts += [(900, None), (901, " "), (902, "two words"), (903, "TWO  words"), (904, "two others")]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(want) > 80 and (got[900], got[901], got[902], got[903], got[904]) == (900, 900, 902, 902, 904)
    found = [got[a] == got[b] for a, b in want]
    assert sum(found) >= 0.9 * len(found)
    assert all(got[2 * k + 1] == 2 * k + 1 for k in range(200) if (2 * k, 2 * k + 1) not in want)


def test_recall_on_a_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = true_links(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    for low, high in ((0.8, 0.85), (0.85, 1.01)):  # the table holds few of each
        of = [got[a] == got[b] for (a, b), j in want.items() if low <= j < high]
        assert len(of) > 5 and sum(of) >= 0.9 * len(of), (low, sum(of), len(of))
    # Nothing but links and equal sets joins documents.
    root = {i: i for i, _ in texts}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first = {}
    equal = [(i, first.setdefault(frozenset(shingles(t)), i)) for i, t in texts]
    for a, b in [*equal, *want]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(find(got[i]) == find(i) for i, _ in texts)


def test_a_large_group_of_near_copies_is_one(spark):
    """Every copy differs from the original in a word of its own, so that all are unlike sets in one dense cluster."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*words[:k], f"other{k}", *words[k + 1 :]])) for k in range(400)] + [(1000, " ".join(words)), (2000, "nothing like the others at all")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame).collect()}
    assert got.pop(2000) == 2000 and set(got.values()) == {0}
    assert sorted(r.doc_id for r in simhash.one_of_each(frame.withColumn("rep", F.lit(1))).collect()) == [0, 2000]


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (5, text), (3, text + " tail"), (3, text + " tail"), (None, "alone"), (8, None), (9, "")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 3), (5, 3), (3, 3), (3, 3), (None, None), (8, 8), (9, 8)], key=str)


def partition(pairs, ids):
    root = {i: i for i in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_no_link_is_lost(spark):
    """Short and long texts with scattered changes, which move fingerprints by more than their reach; a line in all texts is late."""
    rng = np.random.default_rng(21)
    line, texts = " ".join(f"common{k}" for k in range(12)), []
    for k in range(600):
        n = int(rng.integers(30, 200))
        text = [f"w{i}" for i in rng.integers(0, 3000, n)]
        edited = list(text)
        for i in rng.choice(n, max(1, round(n * rng.uniform(0.005, 0.035))), replace=False):
            edited[i] = f"edited{rng.integers(0, 10**6)}"
        texts += [(2 * k, f"{line} {' '.join(text)}"), (2 * k + 1, f"{line} {' '.join(edited)}")]
    want = true_links(texts)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert len(simhash.late_shingles(frame, 5)) >= 8
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame).collect()}
    assert len(want) > 300 and got == partition(want, [i for i, _ in texts])


def test_first_shingles_alone_find_all_links(spark, monkeypatch):
    """Where the fingerprints find nothing, in a chain of near copies and at the bound itself."""
    monkeypatch.setattr(simhash.vptree, "links", lambda points, *_: points.sparkSession.createDataFrame([], "a long, b long"))
    words = [f"w{k}" for k in range(94)]
    texts = [(k, " ".join([*words[k:], *[f"more{i}" for i in range(k)]])) for k in range(0, 60, 3)]
    texts += [(100, " ".join(f"x{k}" for k in range(14))), (101, " ".join(f"x{k}" for k in range(12)))]  # 8 of 10 shingles
    texts += [(102, " ".join(f"y{k}" for k in range(13))), (103, " ".join(f"y{k}" for k in range(11)))]  # 7 of 9
    want = true_links(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == partition(want, [i for i, _ in texts]) and got[57] == 0 and got[101] == 100 and got[103] == 103


def rows_of_joins(spark, after):
    """The most rows that a join of the runs after that one made, and the number of the last run."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    numbers = [runs.apply(i).executionId() for i in range(runs.size())]
    for k in numbers:
        nodes = store.planGraph(k).allNodes() if k > after else None
        for node in [nodes.apply(i) for i in range(nodes.size())] if nodes else []:
            for m in [node.metrics().apply(i) for i in range(node.metrics().size())] if "Join" in node.name() else []:
                rows = store.executionMetrics(k).get(m.accumulatorId()) if m.name() == "number of output rows" else None
                most = max(most, int(rows.get().replace(",", ""))) if rows and rows.isDefined() else most
    return most, max(numbers, default=-1)


def test_a_group_of_near_copies_is_not_paired(spark, monkeypatch):
    """Copies with 1 to 7 changed words, all still apart when the first shingles are compared; half are no near copies."""
    monkeypatch.setattr(simhash.vptree, "links", lambda points, *_: points.sparkSession.createDataFrame([], "a long, b long"))
    rng, words, texts = np.random.default_rng(5), [f"w{k}" for k in range(150)], []
    for k in range(800):
        edited = list(words)
        for i in rng.choice(150, 1 + k % 7 if k else 0, replace=False):
            edited[i] = f"edited{rng.integers(0, 10**7)}"
        texts.append((k, " ".join(edited)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    _, last = rows_of_joins(spark, 1 << 60)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame).collect()}
    assert got == partition(true_links(texts), [i for i, _ in texts]) and len(set(got.values())) > 300
    most, _ = rows_of_joins(spark, last)
    assert len(texts) <= most < 50 * len(texts)  # at most thirty first shingles each
