import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearken.llm import chat, common, language, queries, toxicity
from hearken.llm.common import table

MID = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = queries.op5_language_id(spark, MID).join(table(spark, MID, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog with this", "en"), ("der hund und die katze nicht", "de"), ("le chat et les chiens dans la", "fr"), ("el perro y los gatos para que", "es")] * 6)]
    rows += [(90, None, "en"), (91, "123 !?", None), (92, "", "fr"), (93, "THE DOG AND THE CAT WITH", None)]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.train(frame, F.lit(True), "doc_id", "text", "lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame, model).collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0) and got[93][0] == "en" and [got[k][0] for k in range(4)] == ["en", "de", "fr", "es"]
    assert language.identify(frame.where("false"), model).count() == 0
    nothing = language.train(frame, F.lit(False), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language.identify(frame, nothing).collect()} == {"und"}
    one = language.train(frame.where("lang = 'en'"), F.lit(True), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language.identify(frame.where("doc_id < 4"), one).collect()} == {"en"}


def test_lessons_cover_families_and_relatives():
    two = language.lessons({"germanic": ["de", "en"], "romance": ["fr"]}, 10)
    assert {(a, b) for a, b, *_ in two} == {("family:germanic", "family:romance"), ("de", "en")}
    many = language.lessons({"germanic": ["de", "en"], "romance": ["fr"], "only xx": ["xx"]}, 10)
    assert {(a, b) for a, b, *_ in many} == {("family:germanic", ""), ("family:romance", ""), ("family:only xx", ""), ("de", "en")}
    assert {(lang, side) for a, b, lang, side, _ in many if a == "family:romance"} == {("fr", 1), ("de", -1), ("en", -1), ("xx", -1)}


def test_more_languages_than_forty(spark):
    """Each language has letters of its own; the rarest is learned as well."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(48):
        letters = "".join(chr(0x400 + 8 * k + j) for j in range(6))
        for j in range(3 if k else 2):
            rows.append((len(rows), " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40)), f"l{k:02}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame, F.lit(True), "doc_id", "text", "lang", per_language=20)
    assert len(model.families) == 48 and len(model.machines) == 48
    got = {r.doc_id: r.lang_pred for r in language.identify(frame, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.95 * len(rows) and got[0] == "l00"


def test_rows_of_one_id_teach_once(spark):
    """Ten thousand rows share an id; the sample stays bounded and the other rows are still learned from."""
    same = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("the cat and the dog "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows = [(100 + k, t, lang) for k, (t, lang) in enumerate([("the house and this garden", "en"), ("der hund und die katze nicht", "de")] * 5)]
    frame = same.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = language.train(frame, F.lit(True), "doc_id", "text", "lang", per_language=4)
    assert set(model.machines) == {("de", "en")}
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([(1, "die katze und der hund")], "doc_id long, text string"), model).collect()} == {"de"}


def test_predictions_against_plain_sums(spark):
    """Margins, votes and products worked out text by text and n-gram by n-gram."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = language.train(docs, F.lit(True), "doc_id", "text", "lang", per_language=30)
    rows = [r for r in docs.collect() if r.text and len(r.text) < 1500][:60] + [(0, "É", "fr"), (0, "ab", "en")]
    blobs = [r[1].lower().encode() for r in rows]
    labels, scores = model.predict(blobs)
    for blob, label, score in zip(blobs, labels, scores):
        padded, sums, n = blob + language.GAP, {k: 0.0 for k in model.machines}, 0
        for at in range(len(padded)):
            for size in language.ORDERS:
                gram = (padded + language.GAP)[at : at + size]
                code = int.from_bytes(gram, "little")
                bucket = ((code * 0x9E3779B1 + (size - 1) * 0x1EBCA6B) % 2**32) >> 19
                n += 1
                for key, (weights, _) in model.machines.items():
                    sums[key] += float(weights[bucket])
        p = {k: 1 / (1 + np.exp(-3 * (s / n + model.machines[k][1]))) for k, s in sums.items()}
        g = p["family:germanic", "family:romance"]
        chances = {"de": g * p["de", "en"], "en": g * (1 - p["de", "en"]), "es": (1 - g) * p["es", "fr"], "fr": (1 - g) * (1 - p["es", "fr"])}
        family = ("de", "en") if g >= 0.5 else ("es", "fr")
        want = max(family, key=lambda k: chances[k])
        assert label == want and abs(score - chances[want]) < 1e-5


def test_language_of_texts_in_pieces(monkeypatch, spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = language.train(docs, F.lit(True), "doc_id", "text", "lang", per_language=30)
    blobs = [r.text.lower().encode() for r in docs.where("length(text) > 2000").limit(20).collect()]
    whole, scores = model.predict(blobs)
    monkeypatch.setattr(common.between_words, "__defaults__", (500,))
    parts, near = model.predict(blobs)
    assert whole == parts and np.abs(scores - near).max() < 0.05


def test_columns_of_any_name(spark):
    rows = [(k, t, lang, "x", 1, 2.0) for k, (t, lang) in enumerate([("the cat and the dog with this", "en"), ("der hund und die katze nicht", "de")] * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, __lang string, __letter int, __score double")
    model = language.train(frame, F.lit(True), "doc_id", "text", "lang")
    assert language.labelled(frame, model).columns == ["doc_id", "text", "lang", "__letter", "__lang", "__score"]
    kept = language.labelled(frame, model, least=0.0)
    assert kept.dtypes == frame.dtypes and {r["__lang"] for r in kept.collect()} == {"x"}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    bad, good = [r.predicted for r in got if r.toxic], [r.predicted for r in got if not r.toxic]
    assert sum(bad) / len(bad) > 0.8 and sum(good) / len(good) < 0.01


def test_toxicity_edges(spark):
    rng = np.random.default_rng(3)
    other = lambda: " ".join(f"word{x}" for x in rng.integers(0, 5000, 12))  # noqa: E731  copies would be one piece of evidence
    rows = [(k, f"you are {'an idiot' if k % 4 == 0 else 'a kind'} friend {other()}", int(k % 4 == 0)) for k in range(80)] + [(90, None, None), (91, "", None), (92, "IDIOT!", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(frame, frame, F.lit(True), label_col="label")
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert got[90] == got[91] < 0.5 and got[92] > 0.7 and got[0] > 0.7 > got[1]
    assert toxicity.score(frame.where("false"), model).count() == 0
    flat = toxicity.train(frame, frame, F.lit(False), label_col="label")
    assert len({r.score for r in toxicity.score(frame, flat).collect()}) == 1


def test_pairs_of_terms_say_what_single_ones_do_not():
    """Toxic only where both of two terms meet: the factors must carry it."""
    rng = np.random.default_rng(1)
    terms, labels = [], []
    for _ in range(800):
        a, b = rng.random(2) < 0.5
        terms.append(np.array(sorted([2] * int(a) + [4] * int(b) + [2 * int(x) for x in rng.integers(10, 5000, 8)]), dtype=np.int64))  # terms are even
        labels.append(int(a and b))
    model = toxicity.fit([np.unique(t) for t in terms], np.array(labels))
    score = lambda *f: 1 / (1 + np.exp(-model.raw(np.searchsorted(model.features, f), np.array([0, len(f)]))[0]))
    assert score(2, 4) > 0.7 and score(2) < 0.5 and score(4) < 0.5


def test_exclusive_or_of_two_terms_is_learned():
    """Neither term tells anything alone."""
    rng = np.random.default_rng(8)
    terms, labels = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        terms.append(np.unique([2] * int(a) + [4] * int(b) + [2 * int(x) for x in rng.integers(10, 3000, 8)]).astype(np.int64))
        labels.append(int(a != b))
    model = toxicity.fit(terms, np.array(labels))
    assert {2, 4} <= set(model.features.tolist())
    score = lambda *f: 1 / (1 + np.exp(-model.raw(np.searchsorted(model.features, f), np.array([0, len(f)]))[0]))
    assert min(score(2), score(4)) > 0.7 > 0.3 > max(score(2, 4), score())


def test_a_rare_insult_is_a_feature():
    """It stands in 30 of 3,000 toxic texts and in no clean one."""
    rng = np.random.default_rng(9)
    filler = lambda: [2 * int(x) for x in rng.integers(10, 4000, 12)]
    terms = [np.unique([*filler(), *([4] if k < 30 else [6])]).astype(np.int64) for k in range(3000)] + [np.unique(filler()).astype(np.int64) for _ in range(3000)]
    model = toxicity.fit(terms, np.array([1] * 3000 + [0] * 3000))
    assert {4, 6} <= set(model.features.tolist()) and len(model.features) < 20
    score = lambda *f: 1 / (1 + np.exp(-model.raw(np.searchsorted(model.features, f), np.array([0, len(f)]))[0]))
    assert score(4) > 0.7 and score(6) > 0.7 and score() < 0.2


def test_machine_against_a_loop_over_pairs():
    rng = np.random.default_rng(12)
    model = toxicity.Machine(np.arange(40) * 2, -0.3, rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)))
    sets = [np.sort(rng.choice(40, n, replace=False)) for n in (0, 1, 2, 7, 40)]
    got = model.raw(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for value, s in zip(got, sets):
        want = model.bias + sum(model.linear[i] for i in s) + sum(float(model.factors[i] @ model.factors[j]) for i in s for j in s if i < j)
        assert abs(value - want) < 1e-9


def test_scores_of_texts_against_their_terms(spark):
    """Each text's score from its distinct terms and stems, one by one."""
    docs, labels = table(spark, MID, "documents"), table(spark, MID, "labels")
    model = toxicity.train(docs, labels, F.lit(True))
    place = {int(h): k for k, h in enumerate(model.features)}
    rows = docs.select("doc_id", "text").limit(300).collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text in rows:
        active = sorted({place[h] for w in (text or "").encode().split() for h in toxicity.term_hashes(w) if h in place})
        raw = model.bias + sum(model.linear[k] for k in active) + sum(float(model.factors[a] @ model.factors[b]) for a in active for b in active if a < b)
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9


def test_repeated_labelled_rows_teach_once(spark):
    same = spark.range(5_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("idiot "), F.col("id").cast("string")).alias("text"))
    other = spark.createDataFrame([(10 + k, f"{'idiot' if k % 2 else 'friend'} word{k} thing{k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (3, None)] + [(10 + k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.train(same.unionByName(other), labels, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(other, model).collect()}
    assert min(got[10 + k] for k in range(1, 60, 2)) > 0.7 > 0.3 > max(got[10 + k] for k in range(0, 60, 2))


def test_models_reach_workers_without_the_package(tmp_path):
    """What is broadcast carries its classes: it loads where the package is not on the path."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "model").write_bytes(cloudpickle.dumps([language.Model(), toxicity.Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 8)))]))
    code = "import pickle; print(*(type(m).__name__ for m in pickle.load(open('model', 'rb'))))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.split() == ["Model", "Machine"], done.stderr


# ---- chat -------------------------------------------------------------------------------------------------------------------


def test_layouts(spark):
    cases = [
        ('{"prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]),
        ('{"system":"s","prompt":"p","response":"r"}', [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"system":null,"prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]),
        ('{"output":"o","instruction":"i","input":"q"}', [("system", "i"), ("user", "q"), ("assistant", "o")]),
        ('{"messages":[{"role":"tool","content":"c"},{"content":null,"role":"user"}]}', [("tool", "c"), ("user", "")]),
        ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', [("user", "h"), ("assistant", "g")]),
        ('{"messages":[]}', []), ('{"other":1}', None), ("[1]", None), ("not json", None), (None, None), ('{"prompt":"p"}', None),
    ]
    rows = spark.createDataFrame([(k, c, "x") for k, (c, _) in enumerate(cases)], "k int, record string, extra string")
    got = {r.k: r for r in chat.format_records(rows).collect()}
    for k, (_, want) in enumerate(cases):
        assert (None if got[k].turns is None else [tuple(t) for t in got[k].turns]) == want, cases[k]
    assert got[7].formatted is None and got[6].formatted == "" and got[0].extra == "x"
    assert got[0].layout_print == got[2].layout_print != got[1].layout_print


def test_nested_paths(spark):
    paths = lambda j: spark.createDataFrame([(j,)], "j string").select(chat.field_paths(F.schema_of_variant(F.try_parse_json("j"))).alias("p")).first().p
    assert paths('{"b":{"c":1,"d":{"e":true}},"a":[{"x":1},{"y":"s"}]}') == ["a", "a[].x", "a[].y", "b", "b.c", "b.d", "b.d.e"]
    assert paths('{"n":null}') == []


def test_round_trip_of_any_text(spark):
    found = []
    marks = st.sampled_from([*chat.CONTROL, chat.START, chat.MIDDLE, chat.END, "\\", "<", "|", "[", "é", "\n", "🙂"])

    @settings(max_examples=150, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(st.lists(marks, max_size=4).map("".join), st.lists(marks | st.characters(codec="utf-8"), max_size=8).map("".join)), max_size=4))
    def gather(turns):
        found.append(turns)

    gather()
    found += [[("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")], [("assistant", "a<"), ("assistant", "|done|>")]]
    rows = spark.createDataFrame([(k, [tuple(t) for t in turns]) for k, turns in enumerate(found)], f"k int, turns {chat.TURNS}")
    made = rows.withColumns(chat.formatted(F.col("turns")))
    back = made.select("k", "formatted", chat.read_back(F.col("formatted")).alias("b"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("m"), "loss_spans").collect()
    for r in back:
        assert [tuple(t) for t in r.b] == found[r.k]
        assert r.m == "".join(t for role, t in found[r.k] if role == "assistant")
        for mark in chat.CONTROL:
            if not mark.startswith("<|"):
                assert mark not in r.formatted


def test_conversations(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in queries.op7_chat_formatting(spark, sf).collect()}
    calls = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        calls.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert set(got) == set(calls)
    for k, turns in calls.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got[k].n_turns == len(turns) and got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[k].loss_chars == len(learned) and got[k].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_turns_in_odd_tables(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (1, None, "system", "s"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "n")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.format_records(chat.records_from_turns(frame)).collect()}
    assert got == {1: [("system", "s"), ("", "q"), ("assistant", "")], 2: [("user", "a"), ("user", "a")], None: [("user", "n")]}
    assert chat.records_from_turns(frame.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    in_order = lambda rows, names: sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rows)
    assert in_order(got.collect(), got.columns) == in_order(want.fetchall(), want.columns)
