import json

import pytest
from pyspark.sql import functions as F

from hearken.llm import chat


def test_conversations_with_a_very_long_turn(spark):
    """23 million characters in one turn, more than a variant's string may hold, in both layouts that are written."""
    text = F.when(F.col("turn") == 0, F.concat(F.lit('A "q", {x}: '), F.expr("repeat('some words, ', 2000000)"))).otherwise("short")
    turns = spark.range(5).select(F.when(F.col("id") < 2, 1).otherwise(2).alias("conv_id"), F.when(F.col("id") < 2, F.col("id")).otherwise(F.col("id") - 2).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role")).withColumn("text", text)
    done = chat.format_records(chat.records_from_turns(turns)).select("conv_id", F.transform("turns", lambda t: F.concat_ws(":", t["role"], F.length(t["text"]))).alias("t"), F.length("formatted").alias("n"), F.size("loss_spans").alias("spans"))
    got = {r.conv_id: r for r in done.collect()}
    size = 12 + 12 * 2000000
    assert got[1].t == [f"user:{size}", "assistant:5"] and got[2].t == [f"user:{size}", "assistant:5", "user:5"]
    assert all(r.n > size and r.spans == 1 for r in got.values())


def test_reading_from_the_text_agrees_with_the_variant(spark, monkeypatch):
    """Long records of each layout, broken ones and one whose layout is lost."""
    monkeypatch.setattr(chat, "LONG", 0)
    rows = ['{"prompt": "p", "response": "r"}', '{"instruction": "i", "input": "", "output": "o"}', '{"conversations": [{"from": "human", "value": "v"}, {"from": "gpt", "value": null}]}', "{broken", None]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, record string")
    want = {r.k: (r.turns, r.layout_print) for r in chat.canonical_turns(frame).collect()}
    for layout, row in ((chat.LAYOUTS[0], 0), (chat.LAYOUTS[1], 1), (chat.LAYOUTS[3], 2)):
        assert frame.where(f"k = {row}").select(layout.of_text(F.col("record")).alias("t")).first().t == want[row][0]
    assert want[3][0] is None and want[4][0] is None
    lost = spark.createDataFrame([(json.dumps({"prompt": "\\" * 21_500_000, "response": "r"}),)], "record string")
    with pytest.raises(Exception, match="too long to read"):
        chat.canonical_turns(lost).collect()
