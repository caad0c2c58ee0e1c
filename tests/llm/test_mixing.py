from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearken.llm import mixing
from hearken.llm.common import table
from hearken.llm.mixing import Plan, budgets, divided
from hearken.llm.queries import MIX


def test_divided():
    assert divided(90, {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1}) == {"a": 30, "b": 30, "c": 30}
    assert divided(90, {"a": 10, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 3}) == {"a": 10, "b": 20, "c": 60}
    assert divided(500, {"a": 10, "b": 20}, {"a": 1, "b": 1}) == {"a": 10, "b": 20}
    assert sum(divided(100, {k: 50 for k in "abc"}, {k: 1 for k in "abc"}).values()) == 100
    assert divided(10, {"a": 5, "b": 5}, {"a": 0, "b": 1}) == {"a": 0, "b": 5}


def test_shortages_stay_among_siblings_first():
    leaves = {("web", "en", "a"): 100, ("web", "en", "b"): 1000, ("web", "de", "a"): 1000, ("ref", "en", "c"): 1000}
    got = budgets(leaves, Plan(share=0.4, epochs=1))
    # 1240 tokens: 620 for each domain; in web 310 for each language; in web-en source a falls short and b takes the rest.
    assert got == {("web", "en", "a"): 100, ("web", "en", "b"): 210, ("web", "de", "a"): 310, ("ref", "en", "c"): 620}
    short = budgets({**leaves, ("ref", "en", "c"): 100}, Plan(share=0.5, epochs=1))
    # The whole reference domain falls short; only then does the web get its share.
    assert short[("ref", "en", "c")] == 100 and sum(short.values()) == 1100
    assert budgets({}, Plan()) == {}


def plain(spark, rows, plan):
    """All of it in plain Python; only the order's hash is Spark's."""
    leaves, members = Counter(), {}
    for i, t, lang, source in rows:
        leaf = (plan.domains.get(source, "other") if source else "other", lang or "unknown", source or "unknown")
        n = len((t or "").encode().split())
        leaves[leaf] += n
        members.setdefault(leaf, []).append((i, t, n))
    out = []
    for leaf, budget in budgets(dict(leaves), plan).items():
        whole = budget // leaves[leaf] if leaves[leaf] else 0
        rest = budget - whole * leaves[leaf]
        out += [(i, *leaf, e, n, n) for e in range(whole) for i, _, n in members[leaf]]
        frame = spark.createDataFrame(members[leaf], "i long, t string, n long").select("i", "n", mixing.order_key(F.lit(whole).cast("long"), plan.seed, F.col("i"), F.xxhash64("t")).alias("key"))
        at = 0
        for r in sorted(frame.collect(), key=lambda r: r.key):
            if at < rest:
                out.append((r.i, *leaf, whole, r.n, min(r.n, rest - at)))
            at += r.n
    return sorted(out, key=repr)


def selected(frame, plan):
    return sorted((tuple(r) for r in mixing.select(frame, plan).select("doc_id", "__domain", "__language", "__source", "__epoch", "__tokens", "__taken").collect()), key=repr)


@pytest.mark.parametrize("stretch", [50_000, 5])
def test_against_plain_python(spark, monkeypatch, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    small = Plan({"src0": "web"}, {("web",): 3, ("web", "de"): 5}, share=1.3, epochs=3)
    assert selected(docs, small) == plain(spark, rows, small)


def test_budgets_are_met_to_the_token(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {tuple(r)[:3]: r.n for r in mixing.select(docs, MIX).groupBy("__domain", "__language", "__source").agg(F.sum("__taken").alias("n")).collect()}
    leaves = Counter()
    for r in docs.collect():
        leaves[(MIX.domains.get(r.source, "other"), r.lang, r.source)] += len(r.text.split())
    assert {k: v for k, v in budgets(dict(leaves), MIX).items() if v} == {k: v for k, v in got.items() if v}


def test_edges(spark):
    rows = [(1, "a b c", None, None), (2, None, "en", "x"), (3, "", "en", "x"), (4, "d e", "en", "x"), (None, "f g h", "de", "y")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, tokens int")
    plan = Plan(share=0.8, epochs=2)
    assert selected(frame, plan) == plain(spark, rows, plan)
    assert "tokens" in mixing.select(frame, plan).columns
    twice = frame.where("doc_id = 4").unionByName(frame.where("doc_id = 4"))
    assert mixing.select(twice, Plan(share=1.0, epochs=1)).count() == 2
    assert mixing.select(frame.where("false"), plan).count() == 0


def test_columns_named_like_helpers(spark):
    names = ("rest", "whole", "last_key", "of_domain", "domain", "tokens", "epoch", "passes", "__epoch")
    rows = [(k, f"word {k} and more", "en", f"src{k % 3}", *range(len(names))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mixing.select(docs, mixing.Plan(share=0.5, epochs=1), columns=False)
    assert got.dtypes == docs.dtypes and {tuple(r)[4:] for r in got.collect()} == {tuple(range(len(names)))} and 5 < got.count() < 30
    more = mixing.select(docs, mixing.Plan(share=0.5, epochs=1))
    assert more.columns == [c for c in docs.columns if c != "__epoch"] + ["__domain", "__language", "__source", "__epoch", "__tokens", "__taken"]


def test_more_leaves_than_are_broadcast(spark, monkeypatch):
    rows = [(k, f"word {k} and more", "en", f"src{k % 9}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pick = lambda: sorted(map(tuple, mixing.select(docs, mixing.Plan(share=0.5)).collect()))
    few = pick()
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 2)
    assert pick() == few
