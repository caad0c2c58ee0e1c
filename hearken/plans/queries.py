"""The registered queries of the engine's own operators over the driver's tables, each with its SQL counterpart.

Calls are ``conversations``: a turn is a chunk of 30 seconds.  Scores come from the lexicon surrogate, which is no trained model.
Some inputs are derived from the tables by fixed rules, since the tables themselves hold no Korean call markup.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions import display, quality, text, wordpiece
from hearken.functions.correct import Rule, correct
from hearken.functions.expr import same_float
from hearken.functions.scoring import NORMAL, SUSPECT, ModelScorer, classified, lexicon_scorer, softmax
from hearken.operators import calls, dataset, evaluation, jobs, tiling
from hearken.session import spread
from hearken.sources.audio import audio_chunks, decoded_wav, resampled_column, upload_error

#: The surrogate's lexicon, and the rules that the correction queries apply.
LEXICON = ("worthless", "with", "that", "from", "dans", "pour", "nicht", "und", "para", "que")
RULES = (
    Rule("en-1", " the and ", " the, and ", "spacing of function words"),
    Rule("en-2", "ation", "ation(s)", "plural mark"),
    Rule("en-3", " was ", " is ", "tense near a place word", context_terms=(" of ", "ere"), context_window=12),
    Rule("en-4", " of of ", " of ", "doubled word"),
    Rule("off-1", " to ", " TO ", "a kind that is not enabled", kind="spacing"),
)
RULE_SQL = {"en-1": (" the and ", " the, and "), "en-2": ("ation", "ation(s)"), "en-4": (" of of ", " of ")}
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def added(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return added


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text -------------------------------------------------------------------------------------------------------------------

#: Markup that makes every step of the normalisation act, around each document's own text.
MARKED_SQL = "'피해자: a/ ' || coalesce(text, '') || ' + (잡음) 1 2 3 4 5 6 계좌 ' || doc_id || '/일 ' || doc_id || '-x/이 끝 쏐- 음/ 7/칠 (x'"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    made = F.concat(F.lit("피해자: a/ "), F.coalesce("text", F.lit("")), F.lit(" + (잡음) 1 2 3 4 5 6 계좌 "), d, F.lit("/일 "), d, F.lit("-x/이 끝 쏐- 음/ 7/칠 (x"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", made.alias("said"))


# RE2 forms of the patterns, with its spelling of Unicode classes.
W, S, D, NOT_S = r"\p{L}\p{N}_", r"\s", r"\p{Nd}", r"[^()\s]"
DUAL_SQL, RUN_SQL, FIVE_SQL = rf"({D}[{W}-]*)/({NOT_S}+)", rf"(?:{D}[{W}-]*/{NOT_S}+\s*){{2,}}", rf"(?:{D}\s){{4,}}{D}"


def matches_sql(column: str, pattern: str, made: str) -> str:
    """Matches replaced by an expression over ``m``: gaps and matches interleaved."""
    return (
        f"(SELECT string_agg(g || coalesce(x, ''), '' ORDER BY k) FROM (SELECT unnest(range(1, len(gs) + 1)) AS k, unnest(gs) AS g, unnest(list_resize(xs, len(gs))) AS x FROM "
        f"(SELECT string_split_regex({column}, '{pattern}') AS gs, list_transform(regexp_extract_all({column}, '{pattern}'), lambda m: {made}) AS xs)))"
    )


STEP_SQL = {
    "dual_runs": lambda c: matches_sql(c, RUN_SQL, f"array_to_string(regexp_extract_all(m, '{DUAL_SQL}', 1), '')"),
    "dual": lambda c: rf"regexp_replace({c}, '{DUAL_SQL}', '\1', 'g')",
    "digits": lambda c: matches_sql(c, FIVE_SQL, "replace(m, ' ', '')"),
    "plus": lambda c: f"replace({c}, '+', ' ')",
    "parentheses": lambda c: rf"regexp_replace({c}, '\([^)]*\)', ' ', 'g')",
    "fillers": lambda c: rf"regexp_replace({c}, '(^|\s)(?:[a-z]|아|어|음|그|뭐|저|막|좀)/', '\1 ', 'g')",
    "masks": lambda c: f"regexp_replace({c}, '쏐-?', ' ', 'g')",
    "speakers": lambda c: rf"regexp_replace({c}, '(?:피해자|사기범)\s*:\s*', ' ', 'g')",
    "spaces": lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))",
}


def normalized_sql(source: str, key: str) -> str:
    """A chain of steps over ``said`` of a relation."""
    parts, last = [f"n0 AS (SELECT {key}, said AS t FROM ({source}))"], "n0"
    for k, step in enumerate(STEP_SQL.values(), 1):
        parts.append(f"n{k} AS (SELECT {key}, {step('t')} AS t FROM {last})")
        last = f"n{k}"
    return ", ".join(parts)


@query(f"WITH {normalized_sql(f'SELECT doc_id, {MARKED_SQL} AS said FROM documents', 'doc_id')} SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM n9")
def normalize_text(spark, sf_dir):
    """All steps in their order."""
    done = marked(spark, sf_dir).select("doc_id", text.normalize(F.col("said")).alias("t"))
    return done.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def step_query(name: str):
    def run(spark, sf_dir):
        return marked(spark, sf_dir).select("doc_id", F.md5(text.STEPS[name](F.col("said"))).alias("digest"))

    run.__name__ = f"normalize_{name}"
    return query(f"SELECT doc_id, md5({STEP_SQL[name]('said')}) AS digest FROM (SELECT doc_id, {MARKED_SQL} AS said FROM documents)")(run)


for _name in text.STEPS:
    step_query(_name)

CONTEXT_SQL = """
split AS (SELECT doc_id, t, string_split(t, ' was ') AS p FROM {source}),
parts AS (SELECT doc_id, t, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS gap, unnest(list_prepend(NULL, p)[1:len(p)]) AS prior FROM split),
placed AS (SELECT doc_id, t, k, gap, sum(length(prior) + 5) OVER (PARTITION BY doc_id ORDER BY k) - 5 AS pos FROM parts),
judged AS (SELECT *, substr(t, greatest(0, pos - 12)::BIGINT + 1, (pos + 17 - greatest(0, pos - 12))::BIGINT) AS near FROM placed),
{name} AS (SELECT doc_id, string_agg(CASE WHEN k = 1 THEN '' WHEN near LIKE '% of %' OR near LIKE '%ere%' THEN ' is ' ELSE ' was ' END || gap, '' ORDER BY k) AS t FROM judged GROUP BY doc_id)
"""
CORRECTED_SQL = (
    "WITH c0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c1 AS (SELECT doc_id, replace(t, ' the and ', ' the, and ') AS t FROM c0), c2 AS (SELECT doc_id, replace(t, 'ation', 'ation(s)') AS t FROM c1), "
    + CONTEXT_SQL.format(source="c2", name="c3") + ", c4 AS (SELECT doc_id, replace(t, ' of of ', ' of ') AS t FROM c3) "
)


@query(
    CORRECTED_SQL + "SELECT c0.doc_id, md5(c4.t) AS digest, concat_ws(',', CASE WHEN c0.t <> c1.t THEN 'en-1' END, CASE WHEN c1.t <> c2.t THEN 'en-2' END, CASE WHEN c2.t <> c3.t THEN 'en-3' END, CASE WHEN c3.t <> c4.t THEN 'en-4' END) AS rules "
    "FROM c0 JOIN c1 USING (doc_id) JOIN c2 USING (doc_id) JOIN c3 USING (doc_id) JOIN c4 USING (doc_id)"
)
def domain_correct(spark, sf_dir):
    """Ordered rules, one of them contextual, one of a kind that is off."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return correct(docs, "text", RULES).select("doc_id", F.md5("corrected").alias("digest"), F.array_join(F.transform("corrections", lambda c: c["rule_id"]), ",").alias("rules"))


@query(
    CORRECTED_SQL + """, fired AS (SELECT c0.doc_id, list_filter([CASE WHEN c0.t <> c1.t THEN 1 END, CASE WHEN c1.t <> c2.t THEN 2 END, CASE WHEN c2.t <> c3.t THEN 3 END, CASE WHEN c3.t <> c4.t THEN 4 END], lambda x: x IS NOT NULL) AS ks
  FROM c0 JOIN c1 USING (doc_id) JOIN c2 USING (doc_id) JOIN c3 USING (doc_id) JOIN c4 USING (doc_id)),
told AS (SELECT unnest([1, 2, 3, 4]) AS k, unnest(["""
    + ", ".join("{" + ", ".join(f"'{f}': '{getattr(r, f)}'" for f in ("rule_id", "source", "target", "reason", "kind")) + "}" for r in RULES[:4])
    + """]) AS r)
SELECT doc_id, place, r.rule_id AS rule_id, r.source AS source, r.target AS target, r.reason AS reason, r.kind AS kind FROM (SELECT doc_id, unnest(range(len(ks))) AS place, unnest(ks) AS k FROM fired) JOIN told USING (k)"""
)
def applied_corrections(spark, sf_dir):
    """Every correction of every document with all its fields, in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = correct(docs, "text", RULES).select("doc_id", F.posexplode("corrections").alias("at", "c"))
    return rows.select("doc_id", F.col("at").cast("long").alias("place"), "c.rule_id", "c.source", "c.target", "c.reason", "c.kind")


#: Two thousand rules from the documents' own words, each turning a word's first letter to its end, wherever it stands; the dialect
#: folds them one after the other, with the names of those that fired behind a mark.
MANY = 2000
MANY_SQL = f"""
WITH r AS (SELECT list(w ORDER BY md5(w)) AS rs FROM (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]{{4,10}}') AND substr(w, 2) || w[1] <> w ORDER BY md5(w) LIMIT {MANY})),
d AS (SELECT doc_id, list_reduce(list_prepend(coalesce(text, '') || chr(2), rs), lambda x, w: CASE WHEN contains(split_part(x, chr(2), 1), w) THEN replace(split_part(x, chr(2), 1), w, substr(w, 2) || w[1]) || chr(2) || split_part(x, chr(2), 2) || w || ',' ELSE x END) AS x FROM documents, r)
SELECT doc_id, md5(split_part(x, chr(2), 1)) AS digest, split_part(x, chr(2), 2) AS rules FROM d
"""


@query(MANY_SQL)
def domain_correct_many(spark, sf_dir):
    """Thousands of ordered rules, some of which only others bring about."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    w = docs.select(F.explode(F.split("text", " ")).alias("w")).where(F.col("w").rlike("^[a-z]{4,10}$")).distinct()
    turned = w.withColumn("t", F.concat(F.expr("substr(w, 2)"), F.substring("w", 1, 1))).where("w <> t")
    rules = [Rule(r.w, r.w, r.t, "a letter out of place") for r in turned.orderBy(F.md5("w")).limit(MANY).collect()]
    fired = F.transform("corrections", lambda c: F.concat(c["rule_id"], F.lit(",")))
    return correct(docs, "text", rules).select("doc_id", F.md5("corrected").alias("digest"), F.array_join(fired, "").alias("rules"))


#: Texts that fail the gate in each way, by document number.
GATED_SQL = "CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN repeat('x ', 5) || substr(text, 1, 1) WHEN 2 THEN repeat('#', 4 + (doc_id % 50)::INT) || 'ab' WHEN 3 THEN '...!' WHEN 4 THEN '   ' ELSE text || repeat(' §', (doc_id % 400)::INT) END"
RATIO_SQL = r"length(regexp_replace(regexp_replace(t, '\s+', '', 'g'), '[^가-힣A-Za-z0-9.,!?%~()\-]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(t, '\s+', '', 'g')), 0)"


@query(f"""
WITH d AS (SELECT doc_id, {GATED_SQL} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
e AS (SELECT doc_id, {RATIO_SQL} AS ratio, regexp_extract_all(t, '[가-힣A-Za-z0-9]+') AS tokens FROM d),
m AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS w FROM e) GROUP BY ALL) GROUP BY doc_id),
f AS (SELECT e.doc_id, ratio, CASE WHEN ratio IS NULL THEN 'empty_transcript' WHEN 1 - ratio > 0.4 THEN 'low_valid_ratio'
      WHEN len(tokens) >= 4 AND most::DOUBLE / len(tokens) >= 0.7 THEN 'repeated_tokens' WHEN len(tokens) = 0 THEN 'no_meaningful_tokens' END AS reason FROM e LEFT JOIN m USING (doc_id))
SELECT doc_id, reason IS NULL AS usable, reason, round(coalesce(ratio, 0), 6) AS ratio FROM f
""")
def quality_gate(spark, sf_dir):
    n = F.col("doc_id")
    t = F.coalesce("text", F.lit(""))
    made = (
        F.when(n % 6 == 0, t).when(n % 6 == 1, F.concat(F.lit("x " * 5), F.substring(t, 1, 1))).when(n % 6 == 2, F.concat(F.expr("repeat('#', int(4 + doc_id % 50))"), F.lit("ab")))
        .when(n % 6 == 3, "...!").when(n % 6 == 4, "   ").otherwise(F.concat(t, F.expr("repeat(' §', int(doc_id % 400))")))
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", quality.check(made).alias("q"))
    return docs.select("doc_id", "q.usable", "q.reason", same_float(F.col("q.ratio")).alias("ratio"))


# ---- calls ------------------------------------------------------------------------------------------------------------------


def as_chunks(turns: DataFrame, *more: str) -> DataFrame:
    """Turns as chunks; every seventh turn is made unusable, so that both kinds of calls occur."""
    said = F.when((F.col("conv_id") + F.col("turn")) % 7 == 3, "아아 아아 아아 아아 아아").when(F.col("conv_id") % 11 == 5, "@@@ ### $$$ %%").otherwise(F.col("text"))
    return turns.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("chunk_index"), (F.col("turn") * 30.0).alias("start"), (F.col("turn") * 30.0 + 30).alias("end"), said.alias("transcript"), *more)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_chunks(spread(table(spark, sf_dir, "conversations")))


LEXICON_SQL = ", ".join(f"'{w}'" for w in LEXICON)
CALL_RULES = (Rule("c-1", "ation", "ation(s)", "plural mark"), Rule("c-2", " of of ", " of ", "doubled word"))
CHUNKS_SQL = "SELECT conv_id AS call_id, turn AS chunk_index, turn * 30.0 AS start, turn * 30.0 + 30 AS end_s, CASE WHEN (conv_id + turn) % 7 = 3 THEN '아아 아아 아아 아아 아아' WHEN conv_id % 11 = 5 THEN '@@@ ### $$$ %%' ELSE coalesce(text, '') END AS said FROM conversations"
SCORED_SQL = f"""
WITH {normalized_sql(CHUNKS_SQL, "call_id, chunk_index, start, end_s, said")},
c AS (SELECT *, t AS normal, replace(replace(t, 'ation', 'ation(s)'), ' of of ', ' of ') AS fixed, contains(t, 'ation')::INT + (replace(t, 'ation', 'ation(s)') LIKE '% of of %')::INT AS fixes FROM n9),
q AS (SELECT *, {RATIO_SQL.replace("(t,", "(fixed,")} AS ratio, regexp_extract_all(fixed, '[가-힣A-Za-z0-9]+') AS tokens FROM c),
m AS (SELECT call_id, chunk_index, max(n) AS most FROM (SELECT call_id, chunk_index, w, count(*) AS n FROM (SELECT call_id, chunk_index, unnest(tokens) AS w FROM q) GROUP BY ALL) GROUP BY ALL),
g AS (SELECT q.*, coalesce(ratio, 0) AS r, NOT (ratio IS NULL OR 1 - ratio > 0.4 OR (len(tokens) >= 4 AND most::DOUBLE / len(tokens) >= 0.7) OR len(tokens) = 0) AS usable FROM q LEFT JOIN m USING (call_id, chunk_index)),
tiles AS (SELECT call_id, chunk_index, unnest(CASE WHEN len(w) <= 126 THEN [fixed] ELSE list_transform(range(0, len(w), 126), lambda k: array_to_string(w[k + 1:k + 126], ' ')) END) AS tile
          FROM (SELECT call_id, chunk_index, fixed, list_filter(string_split_regex(fixed, '\\s+'), lambda x: x <> '') AS w FROM g WHERE usable)),
hits AS (SELECT call_id, chunk_index, list_filter(string_split_regex(lower(tile), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM tiles),
s AS (SELECT call_id, chunk_index, max(1 / (1 + exp(-(24.0 * len(list_filter(w, lambda x: x IN ({LEXICON_SQL}))) / greatest(len(w), 1) - 2.0)))) AS score FROM hits GROUP BY ALL),
rows AS (SELECT g.*, s.score, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN usable THEN 0 ELSE 1 END, score DESC, chunk_index) AS rk FROM g LEFT JOIN s USING (call_id, chunk_index))
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.prepared(chunks(spark, sf_dir), CALL_RULES, calls.per_tile(lexicon_scorer(LEXICON)))


def flat_calls(done: DataFrame) -> DataFrame:
    first = F.get("reference_segments", F.lit(0))
    return done.select(
        "call_id", "label", same_float(F.col("suspicion_score")).alias("score"), F.size("reference_segments").cast("long").alias("n_segments"), first["start"].alias("first_start"), first["end"].alias("first_end"),
        F.md5("raw_transcript").alias("raw_digest"), F.md5("corrected_transcript").alias("corrected_digest"), F.size("corrections").cast("long").alias("n_corrections"),
        F.col("classification_status").alias("status"), F.col("quality.usable").alias("all_usable"), F.col("quality.reason").alias("reason"), F.col("quality.excluded_chunk_count").alias("excluded"),
        F.array_join(F.transform("corrections", lambda c: c["rule_id"]), ",").alias("rules"), same_float(F.col("quality.score"), 3).alias("quality_score"), F.md5("guidance").alias("guidance_digest"),
        F.md5(F.array_join(F.transform("reference_segments", lambda c: c["transcript"]), "|")).alias("segments_digest"),
    )


CALLS_SQL = (
    SCORED_SQL
    + """
SELECT call_id, CASE WHEN score >= 0.5 THEN 'voice_phishing' WHEN score IS NOT NULL THEN 'normal' END AS label, round(score, 6) AS score, n_segments, first_start, first_end, raw_digest, corrected_digest, n_corrections, status, all_usable, reason, excluded,
  rules, round(quality_score, 3) AS quality_score, md5('"""
+ calls.GUIDANCE
+ """') AS guidance_digest, segments_digest
FROM (SELECT call_id, coalesce(string_agg(nullif(concat_ws(',', CASE WHEN contains(t, 'ation') THEN 'c-1' END, CASE WHEN replace(t, 'ation', 'ation(s)') LIKE '% of of %' THEN 'c-2' END), ''), ',' ORDER BY chunk_index), '') AS rules,
  round(avg(round(r, 4)), 4) AS quality_score, md5(coalesce(string_agg(fixed, '|' ORDER BY rk) FILTER (WHERE rk <= 3 AND usable), '')) AS segments_digest, avg(score) FILTER (WHERE rk <= 5 AND usable) AS score, count(*) FILTER (WHERE rk <= 3 AND usable) AS n_segments, max(start) FILTER (WHERE rk = 1 AND usable)::DOUBLE AS first_start, max(end_s) FILTER (WHERE rk = 1 AND usable)::DOUBLE AS first_end,
  md5(string_agg(said, ' ' ORDER BY chunk_index)) AS raw_digest, md5(string_agg(fixed, ' ' ORDER BY chunk_index)) AS corrected_digest, sum(fixes)::BIGINT AS n_corrections,
  CASE WHEN bool_or(usable) THEN 'classified' ELSE 'skipped' END AS status, bool_and(usable) AS all_usable,
  CASE WHEN NOT bool_or(usable) THEN 'all_chunks_unusable' WHEN NOT bool_and(usable) THEN 'some_chunks_unusable' END AS reason, count(*) FILTER (WHERE NOT usable) AS excluded FROM rows GROUP BY call_id)
"""
)


@query(CALLS_SQL)
def call_analysis(spark, sf_dir):
    """The flagship: chunks to calls."""
    return flat_calls(calls.rolled_up_calls(scored(spark, sf_dir)))


@query(SCORED_SQL + "SELECT call_id, rk::INT AS rank, chunk_index, round(score, 6) AS score, md5(fixed) AS digest FROM rows WHERE usable AND rk <= 3")
def call_evidence(spark, sf_dir):
    top = calls.evidence(scored(spark, sf_dir))
    return top.select("call_id", "rank", "chunk_index", same_float(F.col("suspicion_score")).alias("score"), F.md5("transcript").alias("digest"))


@query(SCORED_SQL + "SELECT call_id, chunk_index, usable, round(score, 6) AS score, CASE WHEN score > 0.5 THEN 'voice_phishing' WHEN score IS NOT NULL THEN 'normal' END AS label FROM rows")
def chunk_scores(spark, sf_dir):
    """Token tiles scored and rolled up per chunk."""
    return scored(spark, sf_dir).select("call_id", "chunk_index", F.col("quality.usable").alias("usable"), same_float(F.col("result.suspicion_score")).alias("score"), F.col("result.label").alias("label"))


def lexicon_model():
    """The surrogate as a Python model behind the plug-in: texts in, two logits each; a single text's come with a batch axis more."""

    def model(texts: list[str]) -> list:
        if len(texts) > 8:
            raise ValueError("a batch has eight texts at most")
        rows = []
        for t in texts:
            found = [w for w in re.split(r"[\W_]+", t.lower()) if w]
            rows.append([0.0, 24.0 * sum(w in LEXICON for w in found) / max(len(found), 1) - 2.0])
        return [rows] if len(texts) == 1 else rows

    return model


@query(ORACLE_SQL["chunk_scores"])
def model_scores(spark, sf_dir):
    """Chunk scores by a Python model, in batches of eight across rows."""
    rows = calls.prepared(chunks(spark, sf_dir), CALL_RULES, ModelScorer(lexicon_model))
    return rows.select("call_id", "chunk_index", F.col("quality.usable").alias("usable"), same_float(F.col("result.suspicion_score")).alias("score"), F.col("result.label").alias("label"))


WHOLE_SQL = SCORED_SQL.replace(CHUNKS_SQL, f"SELECT call_id, 0 AS chunk_index, 0.0 AS start, 0.0 AS end_s, string_agg(said, ' ' ORDER BY chunk_index, said) AS said FROM ({CHUNKS_SQL}) GROUP BY call_id")


@query(WHOLE_SQL + "SELECT call_id, CASE WHEN usable THEN 'classified' ELSE 'skipped' END AS status, CASE WHEN score > 0.5 THEN 'voice_phishing' WHEN score IS NOT NULL THEN 'normal' END AS label, round(score, 6) AS score, md5(normal) AS raw_digest FROM rows")
def whole_call_analysis(spark, sf_dir):
    """The single-transcript path, over all turns of each call in their order."""
    turns = chunks(spark, sf_dir).select("call_id", F.struct("chunk_index", F.coalesce("transcript", F.lit("")).alias("said")).alias("m"))
    whole = turns.groupBy("call_id").agg(F.sort_array(F.collect_list("m")).alias("ms")).select("call_id", F.array_join(F.transform("ms", lambda m: m["said"]), " ").alias("transcript"))
    done = calls.analyze_whole(whole, CALL_RULES, calls.per_tile(lexicon_scorer(LEXICON)))
    return done.select("call_id", F.col("classification_status").alias("status"), "label", same_float(F.col("suspicion_score")).alias("score"), F.md5("raw_transcript").alias("raw_digest"))


@query("SELECT conv_id AS call_id, turn * 30.0::DOUBLE AS start, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS total_chunks FROM conversations")
def chunk_numbers(spark, sf_dir):
    return calls.numbered(chunks(spark, sf_dir).select("call_id", "start")).select("call_id", "start", "chunk_index", "total_chunks")


@query("SELECT doc_id, k // 480000 AS tile, k::BIGINT AS first, least(k + 480000, n)::BIGINT AS last, round(k / 16000.0, 6)::DOUBLE AS start, round(least(k + 480000, n) / 16000.0, 6)::DOUBLE AS end_s FROM (SELECT doc_id, n_chars * 500 AS n, unnest(range(0, n_chars * 500, 480000)) AS k FROM documents)")
def audio_tiles(spark, sf_dir):
    """Documents' lengths as sample counts at 16 kHz."""
    tiles = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tiling.audio_tiles(F.col("n_chars") * 500, 16_000)).alias("tile", "t"))
    return tiles.select("doc_id", F.col("tile").cast("long").alias("tile"), "t.first", "t.last", same_float(F.col("t.start")).alias("start"), same_float(F.col("t.end")).alias("end_s"))


#: A vocabulary from the documents' own words: single letters but z, the commonest starts of words, and pieces that go on with them.
PIECES = 300
ALONE_SQL = r"[!-/:-@\[-`{-~\p{P}]"
CLEANED_SQL = "x"
for _spaced, _closed in wordpiece.CLEANED:
    CLEANED_SQL = f"replace({CLEANED_SQL}, {_spaced.replace(chr(39), chr(39) * 2)!r}, {_closed.replace(chr(39), chr(39) * 2)!r})".replace('"', chr(39))
PIECE_SQL = rf"""
WITH RECURSIVE w AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents),
lower AS (SELECT w FROM w WHERE regexp_full_match(w, '[a-z]+')),
starts AS (SELECT substr(w, 1, 3) AS p FROM lower WHERE length(w) > 2 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {PIECES}),
later AS (SELECT '##' || substr(w, 4, 2) AS p FROM lower WHERE length(w) > 4 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {PIECES}),
letters AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxy.', '')) AS c),
vocabulary AS (SELECT DISTINCT p FROM (SELECT p FROM starts UNION ALL SELECT p FROM later UNION ALL SELECT c FROM letters UNION ALL SELECT '##' || c FROM letters WHERE c <> '.')),
given AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{ALONE_SQL}|[^\s{ALONE_SQL[1:-1]}]+') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM given),
walk AS (SELECT word, 1 AS pos, []::VARCHAR[] AS ps FROM (SELECT DISTINCT word FROM placed WHERE length(word) <= 100)
  UNION ALL SELECT word, pos + n, list_append(ps, p) FROM (
    SELECT word, pos, ps, v.p, length(v.p) - CASE WHEN pos > 1 THEN 2 ELSE 0 END AS n, row_number() OVER (PARTITION BY word, pos ORDER BY length(v.p) DESC) AS k
    FROM walk JOIN (SELECT unnest([1, 2, 3]) AS size) ON pos + size - 1 <= length(word) JOIN vocabulary v ON v.p = CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(word, pos, size)) WHERE k = 1),
made AS (SELECT word, ps FROM walk WHERE pos = length(word) + 1 AND len(ps) > 0),
tokens AS (SELECT doc_id, i, unnest(range(len(coalesce(ps, ['[UNK]'])))) AS j, unnest(coalesce(ps, ['[UNK]'])) AS p FROM placed LEFT JOIN made USING (word)),
counted AS (SELECT doc_id, p, pos, pos // 14 AS tile FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS pos FROM tokens)),
tiles AS (SELECT doc_id, tile, count(*) AS n, replace(coalesce(string_agg(p, ' ' ORDER BY pos) FILTER (WHERE p <> '[UNK]'), ''), ' ##', '') AS x FROM counted GROUP BY doc_id, tile),
said AS (SELECT doc_id, tile, {CLEANED_SQL} AS t FROM tiles),
per AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE p = '[UNK]') AS n_unknown FROM counted GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n_tiles, md5(string_agg(t, '|' ORDER BY tile)) AS digest FROM said WHERE trim(t) <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_unknown, 0)::BIGINT AS n_unknown, CASE WHEN coalesce(n_tokens, 0) <= 14 THEN 1 ELSE coalesce(n_tiles, 0) END::BIGINT AS n_tiles,
  CASE WHEN coalesce(n_tokens, 0) <= 14 THEN md5(coalesce(text, '')) ELSE coalesce(digest, md5('')) END AS digest
FROM documents LEFT JOIN per USING (doc_id) LEFT JOIN cut USING (doc_id)
"""


def piece_vocabulary(docs: DataFrame) -> list[str]:
    w = docs.select(F.explode(F.split("text", " ")).alias("w")).where(F.col("w").rlike("^[a-z]+$"))
    common = lambda of: [r.p for r in of.groupBy("p").count().orderBy(F.desc("count"), "p").limit(PIECES).collect()]
    starts = common(w.where("length(w) > 2").select(F.substring("w", 1, 3).alias("p")))
    later = common(w.where("length(w) > 4").select(F.concat(F.lit("##"), F.substring("w", 4, 2)).alias("p")))
    letters = "abcdefghijklmnopqrstuvwxy"
    return list(dict.fromkeys(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, ".", *("##" + c for c in letters), *starts, *later]))


@query(PIECE_SQL)
def piece_tiles(spark, sf_dir):
    """Tiles of 14 pieces; words with capitals, accents or z are unknown, so some tiles are blank and go."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("said"))
    pieces = wordpiece.WordPiece(piece_vocabulary(docs.select(F.col("said").alias("text"))))
    made = docs.select("doc_id", pieces.encode(F.col("said")).alias("ids"), pieces.tiles(F.col("said"), 16).alias("tiles"))
    unknown = F.size(F.filter("ids", lambda k: k == pieces.none))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), unknown.cast("long").alias("n_unknown"), F.size("tiles").cast("long").alias("n_tiles"), F.md5(F.array_join("tiles", "|")).alias("digest"))


#: Characters as samples at 24 kHz: two filters, of 23 taps, make 16 kHz of them.
RESAMPLED_SQL = """
WITH s AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: (ord(c) % 256 - 128) / 128.0::DOUBLE) AS x FROM documents),
taps AS (SELECT p, k, d, CASE WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) END * cos(pi() * d / 12) ** 2 * 0.66 AS w
  FROM (SELECT p, k, greatest(-6, least(6, (k / 3.0::DOUBLE - p / 2.0::DOUBLE) * 1.98)) AS d FROM (SELECT unnest(range(2)) AS p), (SELECT unnest(range(-10, 13)) AS k))),
bank AS (SELECT p, list(k ORDER BY k) AS ks, list(w ORDER BY k) AS ws FROM taps GROUP BY p),
o AS (SELECT doc_id, x, unnest(range((2 * len(x) + 2) // 3)) AS n FROM s),
y AS (SELECT doc_id, list_sum(list_transform(ks, lambda k, i: CASE WHEN 3 * (n // 2) + k >= 0 THEN coalesce(x[3 * (n // 2) + k + 1], 0) * ws[i] ELSE 0 END)) AS y FROM o JOIN bank ON p = n % 2)
SELECT s.doc_id, count(y) AS n_samples, round(coalesce(sum(y * y), 0), 4) AS energy, round(coalesce(max(abs(y)), 0), 6) AS peak FROM s LEFT JOIN y USING (doc_id) GROUP BY s.doc_id
"""


@query(RESAMPLED_SQL)
def resampled_audio(spark, sf_dir):
    """Documents' characters as sound at 24 kHz, resampled to 16 kHz."""
    given = F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "")
    sound = spread(table(spark, sf_dir, "documents")).select("doc_id", F.transform(given, lambda c: (F.ascii(c) % 256 - 128) / 128.0).alias("samples"))
    made = sound.select("doc_id", resampled_column(F.col("samples"), 24_000).alias("y"))
    energy = F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v)
    peak = F.coalesce(F.array_max(F.transform("y", F.abs)), F.lit(0.0))
    return made.select("doc_id", F.size("y").cast("long").alias("n_samples"), same_float(energy, 4).alias("energy"), same_float(peak).alias("peak"))


#: Characters as two channels of 16 bits at 16 kHz, the second silent, in tiles of a twentieth of a second.
WAV_SQL = """
WITH s AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: ord(c) % 256 - 128) AS x FROM documents),
t AS (SELECT doc_id, x, unnest(range(0, len(x), 800)) AS a FROM s)
SELECT doc_id::VARCHAR || '.wav' AS filename, (a // 800 + 1)::INT AS chunk_index, ((len(x) + 799) // 800)::INT AS total_chunks, round(a / 16000.0::DOUBLE, 7) AS start, round(least(a + 800, len(x)) / 16000.0::DOUBLE, 7) AS end_s,
  (44 + 2 * len(x[a + 1:a + 800]))::BIGINT AS wav_bytes, len(x[a + 1:a + 800])::BIGINT AS n_samples, (128 * list_sum(x[a + 1:a + 800]))::BIGINT AS total FROM t
"""


@query(WAV_SQL)
def wav_tiles(spark, sf_dir):
    """Documents' characters as stereo WAV files, decoded to one channel, cut into tiles, each written as WAV and read again."""
    given = F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "")
    hexed = F.transform(given, lambda c: F.concat(F.lit("00"), F.lpad(F.hex(F.pmod(F.ascii(c) % 256 - 128, F.lit(256))), 2, "0"), F.lit("0000")))
    data = F.array_join(hexed, "")
    size = F.size(given) * 4
    little = lambda n: F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])
    head = F.concat(F.lit("52494646"), little(size + 36), F.lit("57415645666D74201000000001000200803E000000FA000004001000"), F.lit("64617461"), little(size))
    files = spread(table(spark, sf_dir, "documents")).select(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("filename"), F.unhex(F.concat(head, data)).alias("content"))
    tiles = audio_chunks(files, 0.05).where("error is null")
    return tiles.select(
        "filename", "chunk_index", "total_chunks", same_float(F.col("start"), 7).alias("start"), same_float(F.col("end"), 7).alias("end_s"), F.length("wav").cast("long").alias("wav_bytes"),
        *[sample_sums(F.col("wav"))[k].alias(k) for k in ("n_samples", "total")],
    )


def sample_sums(wav: Column) -> Column:
    """struct(n_samples, total) of a WAV's samples as whole numbers of 16 bits."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sounds = [decoded_wav(x) for x in column.to_pylist()]
            yield pa.array([{"n_samples": len(x), "total": round(float((x.astype("float64") * 32768).sum()))} for x in sounds], pa.struct([("n_samples", pa.int64()), ("total", pa.int64())]))

    return F.arrow_udf(run, "struct<n_samples:long,total:long>")(wav)


@query("""
WITH w AS (SELECT doc_id, said, list_filter(string_split_regex(said, '\\s+'), lambda x: x <> '') AS w FROM (SELECT doc_id, coalesce(text, '') AS said FROM documents)),
t AS (SELECT doc_id, len(w) AS n_tokens, CASE WHEN len(w) <= 126 THEN [said] ELSE list_transform(range(0, len(w), 126), lambda k: array_to_string(w[k + 1:k + 126], ' ')) END AS tiles FROM w)
SELECT doc_id, n_tokens, len(tiles) AS n_tiles, md5(array_to_string(tiles, '|')) AS digest FROM t
""")
def token_tiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("said"))
    tiles = docs.select("doc_id", F.size(tiling.split_words(F.col("said"))).cast("long").alias("n_tokens"), tiling.token_tiles(F.col("said")).alias("tiles"))
    return tiles.select("doc_id", "n_tokens", F.size("tiles").cast("long").alias("n_tiles"), F.md5(F.array_join("tiles", "|")).alias("digest"))


@query("SELECT event_id, round(exp(a - m) / (exp(a - m) + exp(b - m)), 6) AS p0, round(exp(b - m) / (exp(a - m) + exp(b - m)), 6) AS p1, CASE WHEN b > a THEN 'voice_phishing' ELSE 'normal' END AS label, (b > a)::INT AS label_id FROM (SELECT event_id, a, b, greatest(a, b) AS m FROM (SELECT event_id, value AS a, (user_id % 7) * 20.0 AS b FROM events))")
def logits(spark, sf_dir):
    """Softmax, first-index argmax and label."""
    pair = F.array(F.col("value").cast("double"), (F.col("user_id") % 7) * 20.0)
    rows = table(spark, sf_dir, "events").select("event_id", softmax(pair).alias("p"), classified(pair).alias("c"))
    return rows.select("event_id", same_float(F.col("p")[0]).alias("p0"), same_float(F.col("p")[1]).alias("p1"), "c.label", "c.label_id")


# ---- evaluation -------------------------------------------------------------------------------------------------------------

PREDICTED_SQL = "CASE WHEN contains(d.text, 'worthless') OR contains(d.text, 'idiot') OR d.doc_id % 97 = 0 THEN 'voice_phishing' ELSE 'normal' END"


@query(f"""
WITH c AS (SELECT CASE WHEN toxic = 1 THEN 'voice_phishing' ELSE 'normal' END AS e, {PREDICTED_SQL} AS p FROM labels l JOIN documents d USING (doc_id)),
n AS (SELECT count(*) AS total, count(*) FILTER (e = p AND e <> 'normal') AS true_positive, count(*) FILTER (e = p AND e = 'normal') AS true_negative, count(*) FILTER (e <> p AND e = 'normal') AS false_positive, count(*) FILTER (e <> p AND e <> 'normal') AS false_negative FROM c),
r AS (SELECT *, coalesce((true_positive + true_negative)::DOUBLE / nullif(total, 0), 0) AS accuracy, coalesce(true_positive::DOUBLE / nullif(true_positive + false_positive, 0), 0) AS precision, coalesce(true_positive::DOUBLE / nullif(true_positive + false_negative, 0), 0) AS recall,
  coalesce(false_positive::DOUBLE / nullif(false_positive + true_negative, 0), 0) AS false_positive_rate, coalesce(false_negative::DOUBLE / nullif(false_negative + true_positive, 0), 0) AS false_negative_rate FROM n)
SELECT total, true_positive, true_negative, false_positive, false_negative, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(false_positive_rate, 6) AS false_positive_rate, round(false_negative_rate, 6) AS false_negative_rate,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM r
""")
def classification_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("text").contains("worthless") | F.col("text").contains("idiot") | (F.col("doc_id") % 97 == 0)).alias("hit"))
    expected = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, SUSPECT).otherwise(NORMAL).alias("expected_label"))
    cases = evaluation.joined_cases(expected, docs.select("doc_id", F.when(F.col("hit"), SUSPECT).otherwise(NORMAL).alias("predicted_label")), "doc_id")
    return evaluation.confusion(cases.where("predicted_label is not null")).select(*[c if c.startswith(("total", "true", "false_positive", "false_negative")) and "rate" not in c else same_float(F.col(c)).alias(c) for c in ("total", "true_positive", "true_negative", "false_positive", "false_negative", "accuracy", "precision", "recall", "false_positive_rate", "false_negative_rate", "f1")])


def stt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against themselves with fixed slips."""
    turns = table(spark, sf_dir, "conversations").where("length(text) > 0")
    heard = F.replace(F.replace(F.col("text"), F.lit("ation"), F.lit("asion")), F.lit(" the "), F.when(F.col("turn") % 2 == 0, " ").otherwise(" tha "))
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), F.col("text").alias("reference"), F.when(F.col("conv_id") % 5 == 0, F.col("text")).otherwise(heard).alias("hypothesis"))


def cleaned_sql(column: str) -> str:
    """Metric text of a column; the compatibility composition is the identity on the tables' texts."""
    return rf"trim(regexp_replace(regexp_replace({column}, '\([^)]*\)', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


SLIPS_SQL = "SELECT conv_id, turn, text AS reference, CASE WHEN conv_id % 5 = 0 THEN text ELSE replace(replace(text, 'ation', 'asion'), ' the ', CASE WHEN turn % 2 = 0 THEN ' ' ELSE ' tha ' END) END AS hypothesis FROM conversations WHERE length(text) > 0"


def bare_sql(pairs: str) -> str:
    """Cleaned characters and words of pairs (sample_id, version, reference, hypothesis).

    The dialect's distance counts bytes, so every letter beyond ASCII that occurs is first renamed to a byte that no cleaned text
    holds.
    """
    return f"""
WITH RECURSIVE given AS ({pairs}),
clean AS (SELECT sample_id, version, {cleaned_sql("reference")} AS r, {cleaned_sql("hypothesis")} AS h FROM given),
letters AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS wide, coalesce(string_agg(chr((CASE WHEN k < 32 THEN k WHEN k < 47 THEN k + 1 ELSE k + 45 END)::INT), '' ORDER BY c), '') AS narrow
  FROM (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT unnest(string_split(r || h, '')) AS c FROM clean) WHERE ord(c) > 127)),
bare AS (SELECT sample_id, version, translate(replace(r, ' ', ''), wide, narrow) AS rc, translate(replace(h, ' ', ''), wide, narrow) AS hc,
  list_filter(string_split(r, ' '), lambda x: x <> '') AS rw, list_filter(string_split(h, ' '), lambda x: x <> '') AS hw FROM clean, letters)
"""


def rated_sql(pairs: str) -> str:
    """Rates of pairs.

    The distance of words is a walk over the reference's words with one row of the table of distances as its state.
    """
    return bare_sql(pairs) + """,
walk AS (SELECT sample_id, version, 0 AS i, rw, hw, range(0, len(hw) + 1) AS d FROM bare WHERE rw <> hw
  UNION ALL SELECT sample_id, version, i, rw, hw, list_transform(range(1, len(s) + 1), lambda j: j + list_min(s[1:j])) FROM (
    SELECT sample_id, version, i, rw, hw, list_transform(c, lambda x, k: x - k) AS s FROM (
      SELECT sample_id, version, i + 1 AS i, rw, hw, list_prepend(i + 1, list_transform(range(1, len(hw) + 1), lambda j: least(d[j + 1] + 1, d[j] + (CASE WHEN hw[j] = rw[i + 1] THEN 0 ELSE 1 END)))) AS c FROM walk WHERE i < len(rw)))),
ends AS (SELECT sample_id, version, d[len(hw) + 1] AS wd FROM walk WHERE i = len(rw)),
rated AS (SELECT b.sample_id, b.version,
  CASE WHEN length(rc) = 0 THEN (length(hc) > 0)::INT ELSE levenshtein(rc, hc)::DOUBLE / length(rc) END AS cer,
  CASE WHEN len(rw) = 0 THEN (len(hw) > 0)::INT ELSE coalesce(wd, 0)::DOUBLE / len(rw) END AS wer FROM bare b LEFT JOIN ends e ON e.sample_id = b.sample_id AND e.version = b.version)
"""


RAW_SQL = rated_sql(f"SELECT conv_id || '-' || turn AS sample_id, 'raw' AS version, reference, hypothesis FROM ({SLIPS_SQL})")


@query(RAW_SQL + "SELECT sample_id, round(cer, 6) AS cer, round(wer, 6) AS wer FROM rated")
def error_rates(spark, sf_dir):
    """Character and word error rates of every sample."""
    rated = evaluation.error_rates(stt_pairs(spark, sf_dir))
    return rated.select("sample_id", same_float(F.col("cer")).alias("cer"), same_float(F.col("wer")).alias("wer"))


@query(RAW_SQL + "SELECT count(*) AS n_samples, round(avg(cer), 6) AS mean_cer, round(avg(wer), 6) AS mean_wer FROM rated")
def mean_error_rates(spark, sf_dir):
    """Means over all samples."""
    means = evaluation.mean_error_rates(evaluation.error_rates(stt_pairs(spark, sf_dir)))
    return means.select(F.col("sample_count").alias("n_samples"), same_float(F.col("mean_cer")).alias("mean_cer"), same_float(F.col("mean_wer")).alias("mean_wer"))


WHOLE_PAIRS_SQL = f"SELECT conv_id::VARCHAR AS sample_id, 'raw' AS version, string_agg(reference, ' ' ORDER BY turn, reference) AS reference, string_agg(hypothesis, ' ' ORDER BY turn, reference) AS hypothesis FROM ({SLIPS_SQL}) GROUP BY conv_id"


@query(bare_sql(WHOLE_PAIRS_SQL) + "SELECT sample_id, round(CASE WHEN length(rc) = 0 THEN (length(hc) > 0)::INT ELSE levenshtein(rc, hc)::DOUBLE / length(rc) END, 6) AS cer FROM bare")
def whole_call_error_rates(spark, sf_dir):
    """Character error rates of whole calls, whose texts are long; the walk over words would take the dialect minutes there."""
    turn = F.split("sample_id", "-")
    said = stt_pairs(spark, sf_dir).select(turn[0].alias("sample_id"), F.struct(turn[1].cast("long").alias("turn"), "reference", "hypothesis").alias("m"))
    whole = said.groupBy("sample_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    joined = lambda c: F.array_join(F.transform("ms", lambda m: m[c]), " ").alias(c)
    rated = evaluation.error_rates(whole.select("sample_id", joined("reference"), joined("hypothesis")))
    return rated.select("sample_id", same_float(F.col("cer")).alias("cer"))


STT_RULES = (Rule("s-1", "asion", "ation", "slip of a consonant"), Rule("s-2", " tha ", " the ", "slip of a vowel"), Rule("s-3", "ing ", "in ", "a harmful rule"))
STEPS_SQL = f"SELECT *, replace(h1, ' tha ', ' the ') AS h2, replace(replace(h1, ' tha ', ' the '), 'ing ', 'in ') AS h3 FROM (SELECT *, replace(hypothesis, 'asion', 'ation') AS h1 FROM ({SLIPS_SQL}))"
FIXED_SQL = rated_sql(f"SELECT conv_id || '-' || turn AS sample_id, 'raw' AS version, reference, hypothesis FROM ({STEPS_SQL}) UNION ALL SELECT conv_id || '-' || turn, 'fixed', reference, h3 FROM ({STEPS_SQL})") + f"""
, fired AS (SELECT conv_id || '-' || turn AS sample_id, list_filter([CASE WHEN hypothesis <> h1 THEN 's-1' END, CASE WHEN h1 <> h2 THEN 's-2' END, CASE WHEN h2 <> h3 THEN 's-3' END], lambda x: x IS NOT NULL) AS rules FROM ({STEPS_SQL})),
sample AS (SELECT sample_id, rules, a.cer AS raw_cer, a.wer AS raw_wer, b.cer AS fixed_cer, b.wer AS fixed_wer FROM fired JOIN rated a USING (sample_id) JOIN rated b USING (sample_id) WHERE a.version = 'raw' AND b.version = 'fixed')
"""


@query(FIXED_SQL + """
SELECT count(*) AS sample_count, count(*) FILTER (len(rules) > 0) AS changed_sample_count, round(avg(raw_cer), 6) AS average_raw_cer, round(avg(fixed_cer), 6) AS average_corrected_cer, round(avg(raw_wer), 6) AS average_raw_wer,
  round(avg(fixed_wer), 6) AS average_corrected_wer, round(avg(fixed_cer - raw_cer), 6) AS cer_delta, round(avg(fixed_wer - raw_wer), 6) AS wer_delta FROM sample
""")  # fmt: skip
def correction_impact(spark, sf_dir):
    samples = evaluation.corrected_pairs(stt_pairs(spark, sf_dir), STT_RULES)
    return evaluation.correction_summary(samples).select(*[F.col(c) if c.endswith("count") else same_float(F.col(c)).alias(c) for c in ("sample_count", "changed_sample_count", "average_raw_cer", "average_corrected_cer", "average_raw_wer", "average_corrected_wer", "cer_delta", "wer_delta")])


@query(FIXED_SQL + """
SELECT rule_id, count(*) AS application_count, count(*) AS sample_count, count(*) FILTER (better) AS improved_sample_count, count(*) FILTER (NOT better AND worse) AS worsened_sample_count, count(*) FILTER (NOT better AND NOT worse) AS unchanged_sample_count
FROM (SELECT unnest(rules) AS rule_id, fixed_cer < raw_cer OR fixed_wer < raw_wer AS better, fixed_cer > raw_cer OR fixed_wer > raw_wer AS worse FROM sample) GROUP BY rule_id
""")  # fmt: skip
def rule_impact(spark, sf_dir):
    return evaluation.rule_impact(evaluation.corrected_pairs(stt_pairs(spark, sf_dir), STT_RULES))


@query("SELECT event_id, regexp_extract(spec, '^(.*)=([^=]*)$', 1) AS path, regexp_extract(spec, '^(.*)=([^=]*)$', 2) AS label FROM (SELECT event_id, 'a=b/' || event_id || '.wav=' || event_type AS spec FROM events)")
def parsed_cases(spark, sf_dir):
    spec = F.concat(F.lit("a=b/"), F.col("event_id").cast("string"), F.lit(".wav="), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", evaluation.parsed_case(spec).alias("c")).select("event_id", "c.path", "c.label")


# ---- dataset ----------------------------------------------------------------------------------------------------------------

STEM_SQL = "CASE doc_id % 4 WHEN 0 THEN 'D' || doc_id // 8 || '_merged__chunk_' || lpad((doc_id % 10000)::VARCHAR, 4, '0') WHEN 1 THEN 'phish_' || doc_id // 12 || '_' || lpad((doc_id % 10000)::VARCHAR, 4, '0') WHEN 2 THEN 'S' || doc_id // 20 || '__' || lpad((doc_id % 10000)::VARCHAR, 4, '0') ELSE 'plain' || doc_id // 40 END"
GROUP_SQL = r"CASE WHEN contains(stem, '__chunk_') THEN string_split(stem, '__chunk_')[1] ELSE coalesce(nullif(regexp_extract(stem, '(?i)^(PHISH_\d+)_\d{4}$', 1), ''), nullif(regexp_extract(stem, '^(.+?)__\d{4}$', 1), ''), stem) END"


def stem() -> Column:
    n = F.col("doc_id")
    part = lambda k: F.floor(n / k).cast("string")
    number = F.lpad((n % 10000).cast("string"), 4, "0")
    return (
        F.when(n % 4 == 0, F.concat(F.lit("D"), part(8), F.lit("_merged__chunk_"), number)).when(n % 4 == 1, F.concat(F.lit("phish_"), part(12), F.lit("_"), number))
        .when(n % 4 == 2, F.concat(F.lit("S"), part(20), F.lit("__"), number)).otherwise(F.concat(F.lit("plain"), part(40)))
    )


@query(f"SELECT source_group, count(*) AS n FROM (SELECT {GROUP_SQL} AS source_group FROM (SELECT {STEM_SQL} AS stem FROM documents)) GROUP BY 1")
def source_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(text.source_group(stem()).alias("source_group")).groupBy("source_group").agg(F.count("*").alias("n"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio files for all documents, a second format for some; texts for most, some broken, empty, short or in other case."""
    docs = table(spark, sf_dir, "documents")
    folder = F.concat(F.lit("calls/"), (F.col("doc_id") % 10).cast("string"), F.lit("/"))
    name = F.concat(folder, F.lit("Rec"), F.col("doc_id").cast("string"))
    body = (
        F.when(F.col("doc_id") % 13 == 1, F.lit(bytearray(b"\xff\xfe\xfa"))).when(F.col("doc_id") % 13 == 2, F.lit(bytearray(b" \n ")))
        .when(F.col("doc_id") % 13 == 3, F.lit(bytearray(b"ab"))).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    )
    nothing = F.lit(None).cast("binary")
    wav = docs.select(F.concat(name, F.lit(".wav")).alias("path"), nothing.alias("content"))
    mp3 = docs.where("doc_id % 5 = 0").select(F.concat(name, F.lit(".MP3")).alias("path"), nothing.alias("content"))
    txt = docs.where("doc_id % 7 <> 6").select(F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(folder, F.lit("rec"), F.col("doc_id").cast("string"))).otherwise(name), F.lit(".txt")).alias("path"), body.alias("content"))
    return wav.unionByName(mp3).unionByName(txt)


#: mp3 precedes wav in path order, as upper-case letters precede lower-case ones.
ISSUE_SQL = "CASE WHEN doc_id % 7 = 6 THEN 'missing_text' WHEN doc_id % 13 = 1 THEN 'invalid_text_encoding' WHEN doc_id % 13 = 2 OR trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 'empty_text' WHEN doc_id % 13 = 3 OR length(trim(text)) < 5 THEN 'short_text' END"
FILES_SQL = f"""
WITH d AS (SELECT *, {ISSUE_SQL} AS own FROM documents),
a AS (SELECT doc_id, 'calls/' || doc_id % 10 || '/Rec' || doc_id || '.wav' AS audio, CASE WHEN own IS NULL AND doc_id % 5 = 0 THEN 'duplicate_pair' ELSE own END AS issue, text FROM d
      UNION ALL SELECT doc_id, 'calls/' || doc_id % 10 || '/Rec' || doc_id || '.MP3', own, text FROM d WHERE doc_id % 5 = 0)
"""


def paired(spark, sf_dir):
    return dataset.pair_files(files(spark, sf_dir), least_chars=5)


@query(FILES_SQL + "SELECT audio, regexp_replace(audio, '\\.[^.]+$', '') AS identifier, 'calls/' || doc_id % 10 || CASE WHEN doc_id % 3 = 0 THEN '/rec' ELSE '/Rec' END || doc_id || '.txt' AS text FROM a WHERE issue IS NULL")
def audio_text_pairs(spark, sf_dir):
    return paired(spark, sf_dir).where("issue is null").select("audio", "identifier", "text")


@query(FILES_SQL + "SELECT audio, issue FROM a WHERE issue IS NOT NULL")
def dataset_issues(spark, sf_dir):
    return paired(spark, sf_dir).where("issue is not null").select("audio", "issue")


@query(FILES_SQL + "SELECT audio FROM a WHERE issue = 'missing_text'")
def missing_text(spark, sf_dir):
    """The same by an anti join."""
    known = files(spark, sf_dir).select("path", *(c.alias(k) for k, c in dataset.path_parts(F.col("path")).items()))
    texts = known.where("suffix = '.txt'").select("folder", F.lower("stem").alias("key"))
    sounds = known.where(F.col("suffix").isin(*dataset.AUDIO)).withColumn("key", F.lower("stem"))
    return sounds.join(texts, ["folder", "key"], "left_anti").select(F.col("path").alias("audio"))


RATIOS = dataset.Ratios(0.8, 0.1, 0.1)
SEED = 42


@query(f"""
WITH RECURSIVE g AS (SELECT source_group, n, row_number() OVER (ORDER BY md5('{SEED}:' || source_group)) AS k FROM (SELECT source_group, count(*) AS n FROM (SELECT {GROUP_SQL} AS source_group FROM (SELECT {STEM_SQL} AS stem FROM documents)) GROUP BY 1)),
t AS (SELECT greatest(sum(n) * 0.8::DOUBLE, 1) AS a, greatest(sum(n) * 0.1::DOUBLE, 1) AS b FROM g),
w AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS source_group, 0::BIGINT AS n, NULL::INT AS s, 0::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS z
  UNION ALL SELECT k, source_group, n, s, x + CASE WHEN s = 0 THEN n ELSE 0 END, y + CASE WHEN s = 1 THEN n ELSE 0 END, z + CASE WHEN s = 2 THEN n ELSE 0 END FROM (
    SELECT g.k, g.source_group, g.n, x, y, z, CASE WHEN g.k <= 3 THEN g.k::INT - 1 WHEN x / a <= y / b AND x / a <= z / b THEN 0 WHEN y / b <= z / b THEN 1 ELSE 2 END AS s FROM w JOIN g ON g.k = w.k + 1, t))
SELECT source_group, n, (['train', 'validation', 'test'])[s + 1] AS split, k - 1 AS position FROM w WHERE k > 0
""")
def grouped_split(spark, sf_dir):
    """The split of every group: whole groups in a seeded order, each to the split that is least filled."""
    docs = table(spark, sf_dir, "documents").select(stem().alias("stem"), F.col("doc_id").cast("string").alias("identifier"))
    done = dataset.split_groups(docs.select("identifier", text.source_group(F.col("stem")).alias("source_group")), RATIOS, SEED, by_hash=True)
    return done.groupBy("source_group", "split", "position").agg(F.count("*").alias("n")).select("source_group", "n", "split", "position")


@query(f"""
WITH o AS (SELECT doc_id::VARCHAR AS identifier, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id)) - 1 AS k, count(*) OVER () AS n FROM documents),
c AS (SELECT *, greatest(1, floor(n * 0.8::DOUBLE)) AS a, greatest(1, floor(n * 0.1::DOUBLE)) AS b, n * 0.8::DOUBLE - greatest(1, floor(n * 0.8::DOUBLE)) AS fa, n * 0.1::DOUBLE - greatest(1, floor(n * 0.1::DOUBLE)) AS fb FROM o),
s AS (SELECT *, greatest(0, n - a - 2 * b) AS spare FROM c),
e AS (SELECT identifier, k, a + CASE WHEN spare > 0 AND (fa >= fb OR spare > 2) THEN 1 ELSE 0 END AS a, b + CASE WHEN spare > 0 AND (fb > fa OR spare > 1) THEN 1 ELSE 0 END AS b FROM s)
SELECT identifier, CASE WHEN k < a THEN 'train' WHEN k < a + b THEN 'validation' ELSE 'test' END AS split FROM e
""")
def random_split(spark, sf_dir):
    """The split of every pair: a seeded order, cut by exact sizes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("identifier"))
    return dataset.split_by_hash(docs, RATIOS, SEED).select("identifier", "split")


# ---- jobs and requests ------------------------------------------------------------------------------------------------------


def requests(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").cast("string").alias("owner_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("request_id"), "event_type").withColumn("seconds", F.col("us") / 1e6)


#: The state of the fold travels in a list of allowed times; a day's window and five requests make refusals common.
LIMIT_SQL = """
WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS owner_key, event_id AS request_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
w AS (SELECT owner_key, request_id, k, t, true AS allowed, [t] AS log FROM o WHERE k = 1
      UNION ALL SELECT o.owner_key, o.request_id, o.k, o.t, len(list_filter(w.log, lambda x: o.t - x < 86400)) < 5,
        CASE WHEN len(list_filter(w.log, lambda x: o.t - x < 86400)) < 5 THEN list_append(list_filter(w.log, lambda x: o.t - x < 86400), o.t) ELSE list_filter(w.log, lambda x: o.t - x < 86400) END
      FROM w JOIN o ON o.owner_key = w.owner_key AND o.k = w.k + 1)
SELECT owner_key, request_id, allowed FROM w
"""


@query(LIMIT_SQL)
def rate_limit(spark, sf_dir):
    return jobs.rate_limited(requests(spark, sf_dir).select("owner_key", "request_id", "seconds"), most=5, window=86400.0).select("owner_key", "request_id", "allowed")


STAGE_LIST_SQL = "[" + ", ".join(f"'{k}'" for k in display.STAGES) + "]"
BASE_SQL = "[" + ", ".join(map(str, display.STAGES.values())) + "]"
#: Events of a user as one job's log, and the walk over them; a refused event leaves the state as it is.
JOBS_SQL = f"""
WITH RECURSIVE e AS (SELECT 'job_' || user_id AS job_id, event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 'cancel' WHEN event_type = 'view' OR event_id % 4 = 0 THEN 'create' ELSE 'update' END AS op, (event_id * 7 + user_id) % 9 AS c,
  ({STAGE_LIST_SQL})[1 + (event_id * 5 + user_id * 3) % 8] AS stage, CASE WHEN (event_id * 7 + user_id) % 9 = 1 THEN (event_id % 120)::INT END AS given,
  'r' || event_id AS result, CASE WHEN event_id % 2 = 0 THEN 'JOB.NOT_FOUND' ELSE 'ANALYSIS.FAILED' END AS error, CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR END AS details FROM events),
o AS (SELECT *, CASE WHEN c < 5 THEN 'running' WHEN c = 5 THEN 'completed' WHEN c = 6 THEN 'failed' WHEN c = 7 THEN 'queued' ELSE 'paused' END AS status, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM e),
w AS (SELECT job_id, NULL::BIGINT AS seq, 0::BIGINT AS k, NULL::BOOLEAN AS accepted, NULL::VARCHAR AS now_status, NULL::VARCHAR AS now_stage, NULL::INT AS now_progress, NULL::VARCHAR AS now_result, NULL::VARCHAR AS now_error, NULL::VARCHAR AS now_details FROM o WHERE k = 1
  UNION ALL SELECT job_id, seq, k, ok, CASE WHEN ok THEN next_status ELSE now_status END, CASE WHEN ok THEN next_stage ELSE now_stage END, CASE WHEN ok THEN next_progress ELSE now_progress END,
    CASE WHEN ok THEN CASE WHEN next_status = 'completed' AND op = 'update' THEN result END ELSE now_result END, CASE WHEN ok THEN CASE WHEN next_status = 'failed' AND op = 'update' THEN error END ELSE now_error END, CASE WHEN ok AND op = 'update' THEN coalesce(details, now_details) ELSE now_details END FROM (
    SELECT *, CASE op WHEN 'create' THEN now_status IS NULL WHEN 'cancel' THEN coalesce(now_status IN ('queued', 'running'), false)
      ELSE now_status IS NOT NULL AND status <> 'paused' AND (given IS NULL OR given <= 100)
        AND (status = now_status OR (now_status = 'queued' AND status IN ('running', 'failed')) OR (now_status = 'running' AND status IN ('completed', 'failed'))) AND (status = 'failed' OR next_progress >= now_progress) END AS ok
    FROM (SELECT o.job_id, o.seq, o.k, o.op, o.status, o.given, o.result, o.error, o.details, w.now_status, w.now_stage, w.now_progress, w.now_result, w.now_error, w.now_details,
      CASE o.op WHEN 'create' THEN 'queued' WHEN 'cancel' THEN 'cancelled' ELSE o.status END AS next_status, CASE o.op WHEN 'create' THEN 'queued' WHEN 'cancel' THEN 'cancelled' ELSE o.stage END AS next_stage,
      CASE o.op WHEN 'create' THEN 0 WHEN 'cancel' THEN w.now_progress ELSE coalesce(o.given, CASE WHEN o.status = 'failed' THEN w.now_progress ELSE ({BASE_SQL})[list_position({STAGE_LIST_SQL}, o.stage)] END) END AS next_progress
      FROM w JOIN o ON o.job_id = w.job_id AND o.k = w.k + 1)))
"""
STATES_SQL = JOBS_SQL + "SELECT job_id, seq, accepted, now_status, now_stage, coalesce(now_progress, -1) AS now_progress, coalesce(now_result, '-') AS now_result, coalesce(now_error, '-') AS now_error, coalesce(now_details, '-') AS now_details FROM w WHERE k > 0"


def job_events(spark, sf_dir):
    """Events of a user as one job's log, with moves named by the event's number."""
    n, u = F.col("event_id"), F.col("user_id")
    choice = (n * 7 + u) % 9
    op = F.when(n % 17 == 0, "cancel").when((F.col("event_type") == "view") | (n % 4 == 0), "create").otherwise("update")
    status = F.when(choice < 5, "running").when(choice == 5, "completed").when(choice == 6, "failed").when(choice == 7, "queued").otherwise("paused")
    stage = F.element_at(F.array(*map(F.lit, display.STAGES)), ((n * 5 + u * 3) % 8 + 1).cast("int"))
    events = table(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("job_"), u.cast("string")).alias("job_id"), n.alias("seq"), op.alias("op"), status.alias("status"), stage.alias("stage"), F.when(choice == 1, (n % 120).cast("int")).alias("progress"), F.concat(F.lit("r"), n.cast("string")).alias("result"), F.when(n % 2 == 0, "JOB.NOT_FOUND").otherwise("ANALYSIS.FAILED").alias("error"), F.when(n % 3 == 0, F.create_map(F.lit("details"), n.cast("string"))).alias("metadata"))


@query(STATES_SQL)
def job_states(spark, sf_dir):
    """Every event's verdict and the job's state after it, with what it holds as result, error and details."""
    shown = lambda c: F.coalesce(c, F.lit("-"))
    done = jobs.job_states(job_events(spark, sf_dir))
    return done.select("job_id", "seq", "accepted", "now_status", "now_stage", F.coalesce("now_progress", F.lit(-1)).alias("now_progress"), shown(F.col("now_result")).alias("now_result"), shown(F.col("now_error")).alias("now_error"), shown(F.col("now_metadata")["details"]).alias("now_details"))


ADMIT_SQL = """
WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS owner_key, event_id AS n, epoch_us(ts) / 1e6 AS t, event_id % 3 = 0 AS finish, event_id % 19 = 0 AS broken, event_id % 23 <> 0 AS ready, event_id % 4 AS job, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
w AS (SELECT owner_key, NULL::BIGINT AS n, 0::BIGINT AS k, NULL::VARCHAR AS outcome, []::DOUBLE[] AS log, NULL::BIGINT AS active FROM o WHERE k = 1
  UNION ALL SELECT owner_key, n, k, outcome, CASE WHEN outcome IN ('released', 'not_held', 'AUDIO.EMPTY') THEN log WHEN outcome = 'SERVICE.RATE_LIMITED' THEN fresh ELSE list_append(fresh, t) END,
    CASE WHEN outcome = 'released' THEN NULL WHEN outcome = 'queued' THEN job ELSE active END
  FROM (SELECT *, CASE WHEN finish THEN CASE WHEN active = job THEN 'released' ELSE 'not_held' END WHEN broken THEN 'AUDIO.EMPTY' WHEN len(fresh) >= 5 THEN 'SERVICE.RATE_LIMITED' WHEN NOT ready THEN 'MODEL.NOT_READY' WHEN active IS NOT NULL THEN 'JOB.DUPLICATE' ELSE 'queued' END AS outcome
    FROM (SELECT o.*, w.log, w.active, list_filter(w.log, lambda x: o.t - x < 86400) AS fresh FROM w JOIN o ON o.owner_key = w.owner_key AND o.k = w.k + 1)))
SELECT owner_key, n AS request_id, outcome FROM w WHERE k > 0
"""


@query(ADMIT_SQL)
def admissions(spark, sf_dir):
    asked = requests(spark, sf_dir).select(
        "owner_key", "seconds", "request_id", (F.col("request_id") % 4).alias("job_id"), F.when(F.col("request_id") % 3 == 0, "finish").otherwise("analyze").alias("op"),
        F.when(F.col("request_id") % 19 == 0, "AUDIO.EMPTY").alias("error"), (F.col("request_id") % 23 != 0).alias("ready"),
    )
    return jobs.admissions(asked, most=5, window=86400.0).select("owner_key", "request_id", "outcome")


STAGE_SQL = "CASE event_id % 5 WHEN 0 THEN 'transcribing' WHEN 1 THEN 'normalizing' ELSE 'classifying' END"


@query(f"""
WITH r AS (SELECT user_id AS job_id, event_id AS seq, {STAGE_SQL} AS stage, (event_id % 9)::INT AS done, (user_id % 9)::INT AS total FROM events),
p AS (SELECT *, CASE WHEN total = 0 THEN 0 WHEN stage = 'transcribing' THEN 30 + round_even(5.0 * done / total, 0) WHEN stage = 'normalizing' THEN 45 + round_even(5.0 * done / total, 0) ELSE 65 + round_even(15.0 * done / total, 0) END AS progress,
      CASE stage WHEN 'transcribing' THEN 3 WHEN 'normalizing' THEN 4 ELSE 5 END AS rung FROM r)
SELECT job_id, seq, max(progress) OVER w AS shown_progress, ['queued', 'preprocessing', 'transcribing', 'normalizing', 'classifying'][max(rung) OVER w] AS shown_stage FROM (SELECT job_id, seq, progress::INT AS progress, rung FROM p) WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)
""")
def job_progress(spark, sf_dir):
    n = F.col("event_id")
    stage = F.when(n % 5 == 0, "transcribing").when(n % 5 == 1, "normalizing").otherwise("classifying")
    reports = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), n.alias("seq"), stage.alias("stage"), (n % 9).cast("int").alias("done"), (F.col("user_id") % 9).cast("int").alias("total"))
    made = reports.withColumn("progress", display.chunk_progress(F.col("stage"), F.col("done"), F.col("total"), F.lit(0)))
    return jobs.shown_progress(made).select("job_id", "seq", "shown_progress", "shown_stage")


CODES_SQL = "(VALUES " + ", ".join(f"('{c}', {s}, '{g}', {str(r).lower()})" for c, s, g, r in jobs.ERRORS) + ") AS t(error_code, status_code, stage, retryable)"
CODE_LIST_SQL = "[" + ", ".join(f"'{c}'" for c, *_ in jobs.ERRORS) + ", 'NO.SUCH_CODE']"


@query(f"SELECT event_id, e.error_code, coalesce(status_code, 0) AS status_code, stage, coalesce(retryable, false) AS retryable FROM (SELECT event_id, ({CODE_LIST_SQL})[1 + event_id % {len(jobs.ERRORS) + 1}] AS error_code FROM events) e LEFT JOIN {CODES_SQL} USING (error_code)")
def error_codes(spark, sf_dir):
    """What is answered to every event's error: status, stage and whether a retry can help; nothing for unknown codes."""
    names = F.array(*[F.lit(c) for c, *_ in jobs.ERRORS], F.lit("NO.SUCH_CODE"))
    seen = table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % (len(jobs.ERRORS) + 1) + 1).cast("int")).alias("error_code"))
    return seen.join(F.broadcast(jobs.error_codes(spark)), "error_code", "left").select("event_id", "error_code", F.coalesce("status_code", F.lit(0)).alias("status_code"), "stage", F.coalesce("retryable", F.lit(False)).alias("retryable"))  # a row per code


@query(JOBS_SQL + """
, last AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS back FROM w WHERE k > 0)
SELECT job_id, now_status AS status, now_stage AS stage, now_progress AS progress, CASE WHEN now_status = 'failed' THEN coalesce(now_error, 'ANALYSIS.FAILED') WHEN now_status <> 'completed' THEN 'JOB.NOT_COMPLETED' END AS error_code,
  CASE WHEN now_status = 'completed' THEN now_result END AS result, now_details AS details FROM last WHERE back = 1 AND now_status IS NOT NULL
""")  # fmt: skip
def job_views(spark, sf_dir):
    """What result and status requests return for every job after its last event."""
    latest = jobs.latest_jobs(jobs.job_states(job_events(spark, sf_dir)))
    told = jobs.result_view(latest).select(F.col("job_id").alias("of_job"), "error_code", "result")
    seen = jobs.status_view(latest).join(told, F.col("job_id") == F.col("of_job"))
    return seen.select("job_id", "status", "stage", "progress", "error_code", "result", F.col("progress_details")["details"].alias("details"))


@query(JOBS_SQL + """
, last AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k DESC) AS back FROM w WHERE k > 0)
SELECT e.event_id AS request_id, e.job_id, now_status AS status, coalesce(now_progress, -1) AS progress, CASE WHEN now_status IS NULL THEN 'JOB.NOT_FOUND' END AS error_code
FROM (SELECT event_id, 'job_' || CASE WHEN event_id % 10 = 0 THEN -user_id ELSE user_id END AS job_id FROM events) e LEFT JOIN (SELECT * FROM last WHERE back = 1 AND now_status IS NOT NULL) l ON l.job_id = e.job_id
""")  # fmt: skip
def job_lookups(spark, sf_dir):
    """Every event as a request for its job's status, of which each tenth names no job; both tables lie in the same buckets."""
    from hearken.session import work_folder
    from hearken.sources import jobstore

    out, name = work_folder(spark, "lookups"), f"hearken_{uuid.uuid4().hex}"
    stored = jobstore.write_jobs(jobs.latest_jobs(jobs.job_states(job_events(spark, sf_dir))), f"{name}_jobs", buckets=16, path=f"{out}/jobs")
    user = F.when(F.col("event_id") % 10 == 0, -F.col("user_id")).otherwise(F.col("user_id")).cast("string")
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("job_"), user).alias("job_id"))
    requests = jobstore.write_jobs(asked, f"{name}_requests", buckets=16, path=f"{out}/requests")
    found = jobstore.lookup_all(requests, stored)
    return found.select("request_id", "job_id", "status", F.coalesce("progress", F.lit(-1)).alias("progress"), F.when(F.col("status").isNull(), "JOB.NOT_FOUND").alias("error_code"))


@query("SELECT event_id, 'see [REDACTED] and [REDACTED]' AS message FROM events")
def redaction(spark, sf_dir):
    said = F.concat(F.lit("see hf_aB"), F.col("event_id").cast("string"), F.lit("-x and s3cr3t"))
    return table(spark, sf_dir, "events").select("event_id", text.redact(said, ("s3cr3t",)).alias("message"))


def padded_sql(byte: int) -> str:
    """A blob of the padded key of HMAC for the secret below."""
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in b"local-secret".ljust(64, b"\0")) + "'::BLOB"


@query(f"SELECT address, sha256({padded_sql(0x5C)} || unhex(sha256({padded_sql(0x36)} || encode(address)))) AS owner_key FROM (SELECT DISTINCT '10.0.0.' || user_id % 256 AS address FROM events)")
def owner_keys(spark, sf_dir):
    """Keyed digests of addresses."""
    address = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))
    return table(spark, sf_dir, "events").select(address.alias("address")).distinct().select("address", text.hmac_sha256("local-secret", F.col("address")).alias("owner_key"))


@query("SELECT event_id, CASE WHEN k IN (0, 4) THEN 'AUDIO.UNSUPPORTED_FORMAT' WHEN k = 1 THEN 'AUDIO.EMPTY' WHEN k IN (2, 6) THEN 'AUDIO.INVALID_FORMAT' END AS error_code FROM (SELECT event_id, event_id % 8 AS k FROM events)")
def upload_validation(spark, sf_dir):
    k = F.col("event_id") % 8
    pick = lambda *values: F.element_at(F.array(*values), (k + 1).cast("int"))
    wav, text_bytes = bytearray(b"RIFF\0\0\0\0WAVE" + bytes(8)), bytearray(b"not a wav")
    name = pick(*map(F.lit, ("call.txt", "call.wav", "a.wav", "b.WAV", "wav", "c.mp3", "d.mp3", "e.m4a")))
    kind = pick(*map(F.lit, ("text/plain", "audio/wav", "audio/wav", "audio/x-wav", "audio/wav", "audio/mpeg", "audio/wav", "audio/mp4")))
    body = pick(*(F.lit(bytearray(b)) for b in (b"x", b"", text_bytes, wav, wav, b"ID3xx", b"ID3xx", b"\0\0\0\x18ftypM4A ")))
    return table(spark, sf_dir, "events").select("event_id", upload_error(name, kind, body).alias("error_code"))


@query("""
SELECT event_id, round(floor(s * 10000 + 0.5) / 100, 6) AS percent, floor(s * 10000 + 0.5) / 100 >= 50 AS suspicious, CASE WHEN floor(s * 10000 + 0.5) / 100 >= 50 THEN '매우 높음' ELSE '낮음' END AS risk, CASE WHEN floor(s * 10000 + 0.5) / 100 >= 50 THEN 'red' ELSE 'emerald' END AS band,
  CASE WHEN n = 0 THEN '' WHEN n < 1048576 THEN ceil(n / 1024)::BIGINT || ' KB' ELSE format('{:.1f}', n / 1048576) || ' MB' END AS upload,
  CASE WHEN e < 1 THEN 'queued' WHEN e < 3 THEN 'preprocessing' WHEN e < 6 THEN 'transcribing' WHEN e < 8 THEN 'normalizing' WHEN e < 10 THEN 'classifying' WHEN e < 12 THEN 'risk_search' WHEN e < 14 THEN 'finalizing' ELSE 'completed' END AS demo
FROM (SELECT event_id, (event_id % 1001) / 1000.0::DOUBLE AS s, (event_id * 4099) % 8000000 AS n, event_id % 16 AS e FROM events)
""")
def display_values(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", ((n % 1001) / 1000.0).alias("s"), ((n * 4099) % 8000000).alias("n"), (n % 16).alias("e"))
    percent = display.percent_score(F.lit(None).cast("double"), F.col("s"))
    bad = display.is_suspicious(F.lit(None).cast("string"), percent)
    return rows.select("event_id", same_float(percent).alias("percent"), bad.alias("suspicious"), display.risk_label(bad).alias("risk"), display.level_band(display.risk_level(bad)).alias("band"), display.upload_size(F.col("n"), even=True).alias("upload"), display.demo_stage(F.col("e")).alias("demo"))


@query("SELECT event_id, format('{:.2f}%', (event_id % 1001) / 1000.0::DOUBLE * 100) AS shown, CASE WHEN event_id % 5 = 0 THEN '-' ELSE format('{:.2f}%', (event_id % 97) / 100.0::DOUBLE * 100) END AS other FROM events")
def percent_texts(spark, sf_dir):
    """Scores as they are shown, and the mark of those that are missing."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", display.percent_text((n % 1001) / 1000.0).alias("shown"), display.percent_text(F.when(n % 5 != 0, (n % 97) / 100.0)).alias("other"))


@query("SELECT count(*) AS n, count(*) AS n_jobs, count(*) AS n_requests, true AS well_formed FROM events")
def new_ids(spark, sf_dir):
    """Random identifiers for every event: all of their form, no two alike."""
    made = table(spark, sf_dir, "events").select(text.new_id("job", 32).alias("job"), text.new_id("req", 12).alias("request"))
    formed = F.col("job").rlike("^job_[0-9a-f]{32}$") & F.col("request").rlike("^req_[0-9a-f]{12}$")
    return made.agg(F.count("*").alias("n"), F.countDistinct("job").alias("n_jobs"), F.countDistinct("request").alias("n_requests"), F.bool_and(formed).alias("well_formed"))


@query(f"""
WITH s AS (SELECT event_id, 1 + event_id % 8 AS i, ({STAGE_LIST_SQL})[1 + event_id % 8] AS stage, (['running', 'failed', 'completed'])[1 + event_id % 3] AS status FROM events),
k AS (SELECT *, unnest(range(1, 9)) AS j FROM s)
SELECT event_id, ({STAGE_LIST_SQL})[j] AS step, CASE WHEN status = 'completed' THEN 'completed' WHEN status = 'failed' AND j = i THEN 'failed' WHEN j < i THEN 'completed' WHEN j = i THEN 'running' ELSE 'pending' END AS state FROM k
""")
def step_states(spark, sf_dir):
    """The list of steps as it is shown for every event's stage and status."""
    names = F.array(*map(F.lit, display.STAGES))
    pick = lambda values, n: F.element_at(values, (F.col("event_id") % n + 1).cast("int"))
    told = table(spark, sf_dir, "events").select("event_id", pick(names, 8).alias("stage"), pick(F.array(*map(F.lit, ("running", "failed", "completed"))), 3).alias("status"))
    rows = told.withColumn("step", F.explode(names))
    return rows.select("event_id", "step", display.step_state(F.col("step"), F.col("stage"), F.col("status")).alias("state"))


@query(CALLS_SQL)
def stream_call_analysis(spark, sf_dir):
    """The flagship from the stream itself: turns come file by file, and a call's row leaves with its last chunk."""
    from hearken.session import work_folder
    from hearken.streaming import rollup

    name = f"{sf_dir}/conversations.parquet"
    turns = spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 8).parquet(f"{name}*")
    totals = spark.read.parquet(name).groupBy(F.col("conv_id").alias("of_call")).agg(F.count("*").alias("total_chunks"))
    out = work_folder(spark, "calls")

    def prepare(df: DataFrame) -> DataFrame:
        known = df.join(totals, df["conv_id"] == F.col("of_call"), "left")
        return calls.prepared(as_chunks(known, "total_chunks"), CALL_RULES, calls.per_tile(lexicon_scorer(LEXICON)))

    rollup.run_calls(turns, prepare, f"{out}/calls", f"{out}/log").awaitTermination()
    return flat_calls(spark.read.parquet(f"{out}/calls"))
