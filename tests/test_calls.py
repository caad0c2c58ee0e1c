import pytest
from pyspark.sql import functions as F

from hearken.functions.correct import Rule
from hearken.functions.scoring import SUSPECT, ModelScorer, logit_rows
from hearken.operators import calls
from hearken.plans.engine import Engine

#: A scorer that reads the score it shall give from the text: ``s900`` gives 0.9.
READ = calls.per_tile(lambda t: F.array(F.lit(0.0), F.log((F.regexp_extract(t, r"s(\d+)", 1).cast("double") / 1000) / (1 - F.regexp_extract(t, r"s(\d+)", 1).cast("double") / 1000))))


def chunks(spark, rows):
    return spark.createDataFrame([(c, k, 30.0 * k, 30.0 * k + 30, t) for c, k, t in rows], "call_id string, chunk_index int, start double, end double, transcript string")


def test_score_label_and_evidence(spark):
    row = calls.analyze(chunks(spark, [("a", 0, "first s100"), ("a", 1, "second s900"), ("a", 2, "third s700")]), (), READ).first()
    assert row.label == SUSPECT and abs(row.suspicion_score - 1.7 / 3) < 1e-9
    assert [s.transcript for s in row.reference_segments] == ["second s900", "third s700", "first s100"]
    assert row.classification_status == "classified" and row.quality.usable and row.quality.reason is None


def test_top_five_and_ties(spark):
    rows = [("a", k, f"c{k} s{s}") for k, s in enumerate((900, 800, 700, 600, 500, 100))] + [("b", 0, "x s400"), ("b", 1, "y s400")]
    got = {r.call_id: r for r in calls.analyze(chunks(spark, rows), (), READ).collect()}
    assert abs(got["a"].suspicion_score - 0.7) < 1e-9
    assert [s.start for s in got["b"].reference_segments] == [0.0, 30.0] and got["b"].label == "normal"
    top = calls.evidence(calls.prepared(chunks(spark, rows), (), READ), 2).orderBy("call_id", "rank").collect()
    assert [(r.call_id, r["rank"], r.chunk_index) for r in top] == [("a", 1, 0), ("a", 2, 1), ("b", 1, 0), ("b", 2, 1)]


def test_mixed_and_skipped_calls(spark):
    bad = "아아 아아 아아 아아 아아"
    rows = [("mixed", 0, bad), ("mixed", 1, "계좌 확인 요청 s800"), ("none", 0, bad), ("none", 1, None), ("none", 2, " ")]
    got = {r.call_id: r for r in calls.analyze(chunks(spark, rows), (), READ).collect()}
    assert got["mixed"].quality.excluded_chunk_count == 1 and got["mixed"].quality.reason == "some_chunks_unusable" and len(got["mixed"].reference_segments) == 1
    assert abs(got["mixed"].suspicion_score - 0.8) < 1e-9 and got["mixed"].raw_transcript == f"{bad} 계좌 확인 요청 s800"
    none = got["none"]
    assert (none.label, none.suspicion_score, none.classification_status, none.quality.reason) == (None, None, "skipped", "all_chunks_unusable")
    assert none.reference_segments == [] and none.quality.excluded_chunk_count == 3


def test_corrections_are_listed_in_chunk_order(spark):
    rules = (Rule("r1", "aa", "b", "s"), Rule("r2", "cc", "d", "s"))
    row = calls.analyze(chunks(spark, [("a", 1, "aa s100"), ("a", 0, "cc aa + s200")]), rules, READ).first()
    assert [c.rule_id for c in row.corrections] == ["r1", "r2", "r1"]
    assert row.corrected_transcript == "d b s200 b s100" and row.raw_transcript == "cc aa + s200 aa s100"


def test_whole_transcripts(spark):
    rows = spark.createDataFrame([("a", "피해자: s900"), ("b", "...")], "call_id string, transcript string")
    got = {r.call_id: r for r in calls.analyze_whole(rows, (), READ).collect()}
    assert got["a"].label == SUSPECT and got["a"].raw_transcript == "s900" and got["a"].reference_segments == []
    assert got["b"].classification_status == "skipped" and got["b"].quality.reason == "no_meaningful_tokens" and got["b"].quality.excluded_chunk_count == 1


def test_rolled_up_tiles(spark):
    logits = F.array(F.array(F.lit(1.0), F.lit(-1.0)), F.array(F.lit(0.0), F.lit(2.0)))
    row = spark.range(1).select(calls.rolled_up(logits).alias("r")).first().r
    assert row.label == SUSPECT and row.label_id == 1 and 0.88 < row.suspicion_score < 0.89


def test_strict_mode_and_empty_input(spark):
    with pytest.raises(Exception, match="must not be blank"):
        calls.analyze(chunks(spark, [("a", 0, "  ")]), (), READ, strict=True).collect()
    assert calls.analyze(chunks(spark, []), (), READ).count() == 0


def test_engine(spark):
    with pytest.raises(ValueError):
        Engine().analyze(chunks(spark, []))
    engine = Engine(scorer=READ)
    assert engine.status() == {"stt": "not_ready", "classifier": "ready", "analyzable": False}
    assert engine.analyze(chunks(spark, [("a", 0, "s600")])).first().label == SUSPECT


def test_numbered(spark):
    got = calls.numbered(spark.createDataFrame([("a", 30.0), ("a", 0.0)], "call_id string, start double")).orderBy("start").collect()
    assert [(r.chunk_index, r.total_chunks) for r in got] == [(1, 2), (2, 2)]


def test_one_shuffle(spark):
    plan = calls.analyze(chunks(spark, [("a", 0, "s600")]), (), READ)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_python_model(spark):
    """A model behind the plug-in: batches of eight at most, unusable chunks left out."""

    def load():
        def model(texts):
            assert 0 < len(texts) <= 8 and "@" not in "".join(texts)
            return [[0.0, float(len(t.split()))] for t in texts]

        return model

    rows = [("a", k, " ".join(f"w{k}x{i}" for i in range(300))) for k in range(12)] + [("a", 12, "@@@ ###"), ("b", 0, "@@@ ###")]
    got = {r.call_id: r for r in calls.analyze(chunks(spark, rows), (), ModelScorer(load)).collect()}
    assert got["a"].label == SUSPECT and got["a"].quality.excluded_chunk_count == 1 and got["b"].label is None
    with pytest.raises(ValueError):
        logit_rows([[1.0, 2.0, 3.0]], 1)
    assert logit_rows([[[1.0, 2.0]]], 1).tolist() == [[1.0, 2.0]]


def test_whole_transcripts_hold_all_turns(spark, tmp_path):
    """The hits stand in later turns; one call starts at another number than 0."""
    from hearken.plans import queries

    said = [(0, 0, "hello there"), (0, 2, "with that from with that"), (0, 1, "again hello"), (2, 4, "nothing"), (2, 5, "to see")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in said], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.call_id: r for r in queries.QUERIES["whole_call_analysis"](spark, str(tmp_path)).collect()}
    digest = lambda t: spark.range(1).select(F.md5(F.lit(t))).first()[0]
    assert got[0].raw_digest == digest("hello there again hello with that from with that") and got[0].label == SUSPECT
    assert got[2].raw_digest == digest("nothing to see") and got[2].label == "normal"
