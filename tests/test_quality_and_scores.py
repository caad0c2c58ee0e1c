import math

import duckdb
import pytest
from pyspark.sql import functions as F

from hearken.functions import display, metrics, quality
from hearken.functions.scoring import classified, lexicon_scorer, softmax
from hearken.operators import evaluation, tiling
from hearken.plans import queries


def test_gate(spark):
    cases = [
        ("   ", False, "empty_transcript", 0.0), ("", False, "empty_transcript", 0.0), ("아아 아아 아아 아아 아아", False, "repeated_tokens", 1.0), ("@@@ ### $$$ %%", False, "low_valid_ratio", None), ("계좌 확인", True, None, 1.0),
        ("대출", True, None, 1.0), ("...!!!", False, "no_meaningful_tokens", 1.0), ("a a a", True, None, 1.0), ("a a a b b", True, None, 1.0), ("x" * 40000, True, None, 1.0),
    ]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string").select("k", quality.check(F.col("t")).alias("q")).orderBy("k").collect()
    for row, (_, usable, reason, score) in zip(rows, cases):
        assert (row.q.usable, row.q.reason) == (usable, reason)
        assert score is None or row.q.score == score
    assert spark.range(1).select(quality.check(F.lit(None).cast("string")).alias("q")).first().q is None
    for wrong in ({"invalid_share": 2}, {"repeat_share": 0}, {"repeat_from": 1}):
        with pytest.raises(ValueError):
            quality.Gate(**wrong)


def test_softmax_and_labels(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1000.0, 1001.0]), (2, [2.0, -1.0])], "k int, l array<double>").select("k", softmax(F.col("l")).alias("p"), classified(F.col("l")).alias("c")).orderBy("k").collect()
    assert rows[0].c.label == "normal" and rows[0].p == [0.5, 0.5]
    assert rows[1].c.label_id == 1 and math.isclose(rows[1].c.suspicion_score, 1 / (1 + math.exp(-1)))
    assert rows[2].c.label == "normal"
    with pytest.raises(Exception, match="two logits"):
        spark.range(1).select(classified(F.array(F.lit(1.0)))).collect()


def test_surrogate_is_deterministic(spark):
    score = lambda t: spark.range(1).select(lexicon_scorer(["송금"])(F.lit(t)).alias("l")).first().l
    assert score("송금 하세요") == [0.0, 10.0] and score("") == [0.0, -2.0]


def test_token_tiles(spark):
    tiles = lambda t, n: spark.range(1).select(tiling.token_tiles(F.lit(t), n).alias("t")).first().t
    assert tiles("token0 token1 token2 token3 token4 token5", 5) == ["token0 token1 token2", "token3 token4 token5"]
    assert tiles("two  words", 5) == ["two  words"]
    with pytest.raises(ValueError):
        tiling.token_tiles(F.lit("x"), 2)


def test_audio_tiles(spark):
    tiles = lambda n: [(t.start, t.end, t.last - t.first) for t in spark.range(1).select(tiling.audio_tiles(F.lit(n), 10).alias("t")).first().t]
    assert tiles(650) == [(0, 30, 300), (30, 60, 300), (60, 65, 50)]
    assert tiles(10) == [(0, 1, 10)] and tiles(0) == []
    with pytest.raises(ValueError):
        tiling.audio_tiles(F.lit(1), 0)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_text(t, spaces):
    import re
    import unicodedata

    t = re.sub(r"\([^)]*\)", " ", re.sub(r"(?:사기범|피해자)\s*:\s*", " ", unicodedata.normalize("NFKC", t)))
    t = " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in t).split())
    return t if spaces else t.replace(" ", "")


def test_error_rates(spark):
    pairs = [
        ("보이스피싱 조심하세요", "보이스피시 조심하세요"), ("", ""), ("", "x"), ("abc", ""), ("피해자: 네 (잡음) ①", "네 1"), ("a b c d", "a c d e f"), ("é가 나", "e나 가"), ("x_y", "x y"), ("㈜ 은행", "주 은행"), (None, "a"),
    ]
    rows = evaluation.error_rates(spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, r string, h string"), "r", "h").orderBy("k").collect()
    assert (rows[0].cer, rows[0].wer) == (0.1, 0.5)
    for row, (r, h) in zip(rows, pairs):
        for got, spaces in ((row.cer, False), (row.wer, True)):
            a, b = plain_text(r or "", spaces), plain_text(h or "", spaces)
            a, b = (a.split(), b.split()) if spaces else (a, b)
            want = plain_distance(a, b) / len(a) if a else float(bool(b))
            assert math.isclose(got, want), (r, h)


def test_word_rate_of_many_distinct_words(spark):
    a, b = " ".join(f"w{k}" for k in range(3000)), " ".join(f"w{k}" for k in range(3000) if k % 10)
    row = evaluation.error_rates(spark.createDataFrame([(a, b)], "reference string, hypothesis string")).first()
    assert row.wer == 0.1
    words = [f"w{k}" for k in range(200_000)]
    assert len(set(metrics.coded(words, {}))) == len(words)


def test_progress(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(display.chunk_progress(lit("classifying"), lit(1), lit(3), lit(0))) == 70
    assert one(display.chunk_progress(lit("transcribing"), lit(1), lit(2), lit(0))) == 32  # 2.5 goes to even
    assert one(display.chunk_progress(lit("normalizing"), lit(1), lit(0), lit(7))) == 7
    assert one(display.chunk_progress(lit("normalizing"), lit(0), lit(5), lit(66))) == 66
    assert one(display.progress_of(lit("risk_search"))) == 80
    assert one(display.percent_text(lit(0.12345))) == "12.35%" and one(display.percent_text(lit(None).cast("double"))) == "-"
    assert one(display.file_size(lit(0))) == "0 B" and one(display.file_size(lit(2048))) == "2.0 KB" and one(display.upload_size(lit(3 * 1024 * 1024))) == "3.0 MB"


def test_upload_sizes_halfway_between_two_shown_ones(spark, tmp_path):
    """Sizes such as 1.25 MB: the query as its SQL, the screens upwards."""
    halves = [262_144 * k for k in range(5, 31, 2)]
    ids = [n * pow(4099, -1, 8_000_000) % 8_000_000 for n in [*halves, *[h + 1 for h in halves], *[h - 1 for h in halves]]]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = queries.QUERIES["display_values"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(queries.ORACLE_SQL["display_values"]).select(*got.columns).fetchall())
    shown = spark.createDataFrame([(h,) for h in halves], "n long").select(display.upload_size(F.col("n")).alias("up"), display.upload_size(F.col("n"), even=True).alias("even"))
    assert [(r.up, r.even) for r in shown.collect()][:3] == [("1.3 MB", "1.2 MB"), ("1.8 MB", "1.8 MB"), ("2.3 MB", "2.2 MB")]
