"""From timed transcript chunks to one row per call."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.functions import quality, text
from hearken.functions.correct import APPLIED, Rule, correct
from hearken.functions.expr import let
from hearken.functions.scoring import NORMAL, SUSPECT, ModelScorer, classified
from hearken.operators.tiling import token_tiles

#: Chunks whose mean is a call's score, evidence segments, and the score from which a call is suspect.
TOP, EVIDENCE, SUSPECT_FROM = 5, 3, 0.5
# Fixed value: the advice shown with every result.
GUIDANCE = "검토가 필요한 경우 금융기관 공식 채널로 확인하세요."
#: Takes a column of token tiles (array of texts, null for chunks that are not scored) and returns an array of logit pairs.
TileScorer = Callable[[Column], Column]


def per_tile(scorer: Callable[[Column], Column]) -> TileScorer:
    """A tile scorer from a column function over one text."""
    return lambda tiles: F.transform(tiles, scorer)


def rolled_up(logits: Column) -> Column:
    """struct(label, label_id, suspicion_score) over the tiles of one text: the highest score, suspect if any tile is."""

    def over(results: Column) -> Column:
        bad = F.exists(results, lambda r: r["label"] == SUSPECT)
        return F.struct(F.when(bad, SUSPECT).otherwise(NORMAL).alias("label"), bad.cast("int").alias("label_id"), F.array_max(F.transform(results, lambda r: r["suspicion_score"])).alias("suspicion_score"))

    return F.when(F.size(logits) > 0, let(F.transform(logits, classified), over))


def prepared(chunks: DataFrame, rules: Iterable[Rule] = (), scorer: TileScorer | ModelScorer | None = None, gate: quality.Gate = quality.Gate(), kinds: Iterable[str] = ("typo",), strict: bool = False, tiler: Callable[[Column], Column] = token_tiles) -> DataFrame:
    """Adds normalized, corrected, corrections, quality and result to rows with a transcript; no shuffle.

    ``tiler`` cuts a text into those that the scorer takes, such as ``WordPiece.tiles``; the default counts words.  Unusable chunks keep their row and have no result.  A blank or null transcript is unusable (``strict``: an error).
    """
    said = F.coalesce(F.col("transcript"), F.lit(""))
    done = chunks.withColumn("normalized", text.normalize(said))
    if strict:
        done = done.withColumn("normalized", F.when(F.col("normalized") != "", F.col("normalized")).otherwise(F.raise_error(F.lit("a transcript must not be blank"))))
    done = correct(done, "normalized", rules, kinds).withColumn("quality", quality.check(F.col("corrected"), gate))
    tiles = tiler(F.when(F.col("quality.usable"), F.col("corrected")))
    if scorer is None:
        return done.withColumn("result", F.lit(None).cast("struct<label:string,label_id:int,suspicion_score:double>"))
    logits = scorer.add(done, tiles, "__logits") if isinstance(scorer, ModelScorer) else done.withColumn("__logits", scorer(tiles))
    return logits.withColumn("result", rolled_up(F.col("__logits"))).drop("__logits")


#: A prepared chunk as ``one_chunk`` packs it.
CHUNK = f"struct<chunk_index:bigint,start:double,end:double,raw:string,corrected:string,corrections:{APPLIED},usable:boolean,quality:double,score:double>"


def one_chunk() -> Column:
    """What a call's row needs of a prepared chunk."""
    return F.struct(
        F.col("chunk_index"), F.col("start"), F.col("end"), F.coalesce("transcript", F.lit("")).alias("raw"), F.col("corrected"), F.col("corrections"),
        F.col("quality.usable").alias("usable"), F.col("quality.score").alias("quality"), F.col("result.suspicion_score").alias("score"),
    )


def rolled_up_calls(rows: DataFrame) -> DataFrame:
    """One row per call_id from prepared chunks, with one shuffle on call_id.

    The score is the mean of the five highest chunk scores; equal scores rank by chunk_index.  Where no chunk is usable, label
    and score are null and the status is ``skipped``.
    """
    return call_rows(rows.groupBy("call_id").agg(F.sort_array(F.collect_list(one_chunk())).alias("chunks")))


def call_rows(calls: DataFrame, *more: str) -> DataFrame:
    """Rows of calls from (call_id, chunks in order); no shuffle.  ``more`` columns are kept.

    Means are summed in the order of the chunks, so they do not depend on how rows were dealt out.
    """
    total = F.aggregate("chunks", F.lit(0.0), lambda a, c: a + c["quality"])
    calls = calls.withColumn("excluded", F.size(F.filter("chunks", lambda c: ~c["usable"])).cast("long")).withColumn("mean_quality", total / F.size("chunks"))
    by_rank = F.sort_array(F.transform(F.filter("chunks", lambda c: c["usable"]), lambda c: F.struct((-c["score"]).alias("rank"), c["chunk_index"].alias("at"), c["start"].alias("start"), c["end"].alias("end"), c["corrected"].alias("transcript"), c["score"].alias("score"))))
    ranked = calls.withColumn("ranked", by_rank)
    top = F.slice("ranked", 1, TOP)
    score = F.when(F.size("ranked") > 0, F.aggregate(top, F.lit(0.0), lambda a, c: a + c["score"]) / F.size(top))
    joined = lambda field: F.array_join(F.transform("chunks", lambda c: c[field]), " ")
    scored = ranked.withColumn("suspicion_score", score)
    segment = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["transcript"].alias("transcript"), c["score"].alias("suspicion_score"))
    skipped = F.size("ranked") == 0
    return scored.select(
        "call_id",
        F.when(F.col("suspicion_score") >= SUSPECT_FROM, SUSPECT).when(F.col("suspicion_score").isNotNull(), NORMAL).alias("label"),
        "suspicion_score",
        F.transform(F.slice("ranked", 1, EVIDENCE), segment).alias("reference_segments"),
        F.lit(GUIDANCE).alias("guidance"),
        joined("raw").alias("raw_transcript"),
        joined("corrected").alias("corrected_transcript"),
        F.flatten(F.transform("chunks", lambda c: c["corrections"])).alias("corrections"),
        F.when(skipped, "skipped").otherwise("classified").alias("classification_status"),
        F.struct(
            (F.col("excluded") == 0).alias("usable"), F.round("mean_quality", 4).alias("score"),
            F.when(skipped, "all_chunks_unusable").when(F.col("excluded") > 0, "some_chunks_unusable").alias("reason"), F.col("excluded").alias("excluded_chunk_count"),
        ).alias("quality"), *more,
    )


def analyze(chunks: DataFrame, rules: Iterable[Rule] = (), scorer: TileScorer | ModelScorer | None = None, gate: quality.Gate = quality.Gate(), kinds: Iterable[str] = ("typo",), strict: bool = False, tiler: Callable[[Column], Column] = token_tiles) -> DataFrame:
    """Calls from chunks (call_id, chunk_index, start, end, transcript)."""
    return rolled_up_calls(prepared(chunks, rules, scorer, gate, kinds, strict, tiler))


def analyze_whole(transcripts: DataFrame, rules: Iterable[Rule] = (), scorer: TileScorer | ModelScorer | None = None, gate: quality.Gate = quality.Gate(), kinds: Iterable[str] = ("typo",), tiler: Callable[[Column], Column] = token_tiles) -> DataFrame:
    """The path for calls that come as one transcript (call_id, transcript): no segments, and the label of the tiles' roll-up.

    Here raw_transcript is the normalised text.
    """
    rows = prepared(transcripts, rules, scorer, gate, kinds, tiler=tiler)
    usable = F.col("quality.usable")
    return rows.select(
        "call_id", F.col("result.label").alias("label"), F.col("result.suspicion_score").alias("suspicion_score"),
        F.array().cast("array<struct<start:double,end:double,transcript:string,suspicion_score:double>>").alias("reference_segments"), F.lit(GUIDANCE).alias("guidance"),
        F.col("normalized").alias("raw_transcript"), F.col("corrected").alias("corrected_transcript"), "corrections", F.when(usable, "classified").otherwise("skipped").alias("classification_status"),
        F.struct(usable.alias("usable"), F.col("quality.score").alias("score"), F.col("quality.reason").alias("reason"), F.when(usable, 0).otherwise(1).cast("long").alias("excluded_chunk_count")).alias("quality"),
    )


def evidence(rows: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """The k highest-scored usable chunks of each call as rows with their rank, for calls of any length.

    Unusable chunks have no score and go by that, so the gate is not evaluated again in a filter.  The limit on the rank lets
    Spark cut each task's rows to k per call before the shuffle, so few texts travel.
    """
    order = Window.partitionBy("call_id").orderBy(F.desc_nulls_last("score"), "chunk_index")
    scored = rows.select("call_id", "chunk_index", "start", "end", F.col("corrected").alias("transcript"), F.col("result.suspicion_score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where("score is not null")
    return ranked.select("call_id", "rank", "chunk_index", "start", "end", "transcript", F.col("score").alias("suspicion_score"))


def numbered(chunks: DataFrame) -> DataFrame:
    """chunk_index from 1 and total_chunks, by start time."""
    call = Window.partitionBy("call_id")
    return chunks.withColumn("chunk_index", F.row_number().over(call.orderBy("start"))).withColumn("total_chunks", F.count("*").over(call))
