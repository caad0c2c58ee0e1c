from collections import Counter
from dataclasses import replace

import corpus_pipeline
import pyarrow as pa
from hearken.llm import mixing
from hearken.llm.common import table

MID = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    docs = table(spark, MID, "documents")
    names, before = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, MID).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "sharding":
            assert after.dtypes == docs.dtypes
        kept[name], before = after, after
    whole = {r.doc_id: r for r in docs.collect()}
    rows = {n: {r.doc_id: r for r in f.collect()} for n, f in kept.items()}

    # Nearly all documents are in a language that the model knows.
    assert len(rows["language_id"]) > 0.98 * len(whole)
    # Of equal texts the smallest id stays.
    least = {}
    for i in sorted(rows["language_id"]):
        least.setdefault(whole[i].text, i)
    near = rows["simhash_near_dedup"]
    assert len({r.text for r in near.values()}) == len(near) and all(least[r.text] == i for i, r in near.items())
    # No item of the benchmark is left, and nothing else went.
    items = [r.text for r in table(spark, MID, "benchmark").collect()]
    assert set(rows["benchmark_decontamination"]) == {i for i, r in near.items() if not any(t in r.text for t in items)}
    # Each leaf keeps its budget, but for the document on its boundary.
    plan = replace(corpus_pipeline.MIX, share=corpus_pipeline.SHARE, epochs=1)
    leaf = lambda r: (plan.domains.get(r.source, "other"), r.lang, r.source)
    size = lambda r: len(r.text.split())
    have, got, largest = Counter(), Counter(), Counter()
    for r in rows["benchmark_decontamination"].values():
        have[leaf(r)] += size(r)
        largest[leaf(r)] = max(largest[leaf(r)], size(r))
    for r in rows["source_mixing"].values():
        got[leaf(r)] += size(r)
    for k, budget in mixing.budgets(dict(have), plan).items():
        assert budget <= got[k] < budget + largest[k] or budget == got[k] == 0
    # Every kept document has one place.
    assert set(rows["sharding"]) == set(rows["source_mixing"]) and len({(r.shard, r.slot) for r in rows["sharding"].values()}) == len(rows["sharding"])


def test_run_is_the_stages_in_turn(spark):
    done = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert done.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and done.count() > 0


def test_stages_on_an_empty_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "Some words in a row", "en", "src1", 3), (2, "Some words in a row", "en", "src1", 3), (2, "Some words in a row", "en", "src1", 3), (3, "", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
        stage(spark, docs, "/root/testdata/sf0.001").collect()
    assert corpus_pipeline.shard(spark, docs, "").count() == len(rows)


def test_stages_pass_columns_of_any_name(spark):
    names = ("__lang", "__score", "id", "rep", "node", "matches", "lang_pred", "rest", "whole", "_0", "epoch", "leaf", "hash")
    text = " ".join(f"the word {k} and that" for k in range(30))
    rows = [(k, f"{text} number {k % 3}", "en", f"src{k % 2}", 9, *range(len(names))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.dtypes == docs.dtypes and {tuple(r)[5:] for r in got.collect()} <= {tuple(range(len(names)))}


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    key, text = "spark.sql.execution.arrow.maxBytesPerBatch", "four words of text " * 256
    few = spark.createDataFrame([(k, f"the word {k} and that", "en", "src1", 9) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    long = spark.range(0, 2500, 1, 1).selectExpr("id doc_id", f"'{text}' text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    own = spark.conf.get(key, None)
    try:
        for _, stage in corpus_pipeline.STAGES[:3]:
            spark.conf.unset(key)
            stage(spark, few, "/root/testdata/sf0.001")
            got = long.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in got) == 2500 and max(r.bytes for r in got) < (1 << 20) + 2 * len(text)
        spark.conf.set(key, "3m")  # a session's own limit stays
        corpus_pipeline.decontaminate_benchmark(spark, few, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
