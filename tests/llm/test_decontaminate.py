from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hearken.llm import decontaminate
from hearken.llm.common import table
from hearken.llm.decontaminate import Index, Searcher

SMALL = "/root/testdata/sf0.001"


def test_whole_items_are_found_over_the_whole_table(spark):
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert got == {(r.doc_id, i) for r in docs.collect() for i, t in items if r.text and t in r.text}


def hashed(text):
    found, _ = decontaminate.word_hashes()([text])
    return found[found != 0]


def parsed(item, text):
    return (item, *(hashed(half.lower().encode()) for half in decontaminate.question_and_answer(text)))


def plain_retrieval(index, text):
    """Items over the threshold for each passage, every item scored one by one without blocks."""
    words, hits = hashed(text), set()
    for at in range(0, max(1, len(words)), index.stride):
        passage = words[at : at + 2 * index.stride]
        own, scores = set(passage.tolist()), Counter()
        for t, h in enumerate(index.hashes.tolist()):
            if h in own:
                for k in range(index.offsets[t], index.offsets[t + 1]):
                    scores[int(index.items[k])] += index.impacts[k]
        for item, s in scores.items():
            seen = set(decontaminate.pair_hashes(passage).tolist()) | {int(decontaminate.pair_hashes(passage[k : k + 1])[0]) for k in range(len(passage))}
            parts = [len(seen.intersection(p.tolist())) / len(p) if len(p) else 1.0 for p in index.pairs[item]]
            if s >= decontaminate.RETRIEVE and min(parts) >= decontaminate.VERIFY:
                hits.add(int(index.ids[item]))
    return hits


def made_texts(rng, vocabulary):
    draw = lambda n: " ".join(vocabulary[int(k)] for k in rng.zipf(1.3, n) % len(vocabulary))
    items = [(k, draw(rng.integers(1, 30))) for k in range(300)]
    texts = [" ".join([draw(rng.integers(1, 300)), items[int(rng.integers(300))][1], draw(rng.integers(0, 60))]).encode() for _ in range(60)]
    return items, texts


def test_wand_loses_nothing():
    items, texts = made_texts(np.random.default_rng(0), [f"w{k}" for k in range(400)])
    index = Index.build([parsed(k, t) for k, t in items], 32)
    rows = Searcher(index).matches(texts)
    assert [{m[0] for m in r} for r in rows] == [plain_retrieval(index, t) for t in texts] and sum(map(len, rows)) > 30


def test_wand_equals_scoring_all_items():
    rng = np.random.default_rng(5)
    items, _ = made_texts(rng, [f"w{k}" for k in range(200)])
    index = Index.build([parsed(k, t) for k, t in items], 32)
    for _ in range(200):
        terms = np.sort(rng.choice(len(index.hashes), int(rng.integers(1, 40)), replace=False))
        scores = np.zeros(len(index.ids))
        for t in terms:
            at = slice(index.offsets[t], index.offsets[t + 1])
            np.add.at(scores, index.items[at], index.impacts[at])
        want = {int(k): scores[k] for k in np.flatnonzero(scores >= decontaminate.RETRIEVE)}
        got = dict(index.retrieved(terms))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_items_leave_the_hits_of_short_ones_alone(spark):
    """Passages follow the length of the items that they are compared with, not that of the longest."""
    rng = np.random.default_rng(2)
    items, texts = made_texts(rng, [f"w{k}" for k in range(3000)])
    words = [f"x{k}" for k in range(200)]
    scattered = " ".join(w for k in range(0, 20, 2) for w in (f"q{k}", f"q{k + 1}", *rng.choice(words, 300)))
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)] + [(900, scattered)], "doc_id long, text string")
    items.append((500, " ".join(f"q{k}" for k in range(20))))
    long = [(1000 + k, " ".join(rng.choice(words, n))) for k, n in enumerate((70, 5000))]
    bench = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    found = lambda rows: {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench(rows)).collect()}
    before = found(items)
    assert len(before) >= 60 and not any(i == 500 for _, i in before)
    assert {(d, i) for d, i in found(items + long) if i < 1000} == before


def test_question_and_answer_are_both_asked_for(spark):
    item = "What is the tallest peak of the northern range of this country? It is called Mount Example by those who climb it."
    other = "Some quite different words stand here and say nothing at all. " * 5
    docs = [
        (1, other + item + other), (2, other + item.upper().replace(" ", "  ")), (3, other + item.split("?")[0] + "? " + other), (4, other), (5, None), (6, ""), (1, item), (7, " ".join(item.split()[2:])),
    ]
    frame = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, item), (11, item), (12, ""), (13, None), (None, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect())
    assert got == Counter({(1, 10): 2, (1, 11): 2, (2, 10): 1, (2, 11): 1, (7, 10): 1, (7, 11): 1})
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.clean(frame, bench.where("false")).count() == len(docs) and decontaminate.contaminated(frame.where("false"), bench).count() == 0


def test_several_indexes_find_the_same(spark, monkeypatch):
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2_000)
    parts = list(decontaminate.indexes(bench))
    assert len(parts) > 3
    found = {(r.doc_id, m.item_id) for index in parts for r in decontaminate.search(docs, index).where(F.size("matches") > 0).collect() for m in r.matches}
    assert found == whole


def test_columns_of_any_name_pass_through(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, item, "a", 1.0), (2, "clean text", "b", 2.0)], "doc_id long, text string, matches string, _0 double")
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(docs, bench).collect()] == [(2, "clean text", "b", 2.0)]
    index = next(decontaminate.indexes(bench))
    assert decontaminate.search(docs, index).columns == ["doc_id", "text", "_0", "matches"]


def test_all_indexes_are_searched_by_one_worker(spark):
    """Items of two lengths have an index each; a step of each would keep as many Python workers per task."""
    bench = spark.createDataFrame([(1, "what is the capital of france? it is paris"), (2, " ".join(f"w{k}" for k in range(400)))], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"some text {k} " + (" ".join(f"w{i}" for i in range(400)) if k == 3 else "")) for k in range(5)], "doc_id long, text string")
    assert len(list(decontaminate.indexes(bench))) == 2
    kept = decontaminate.clean(docs, bench)
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4]
