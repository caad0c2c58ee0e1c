"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm import chat, decontaminate, fourier, language, lmscore, mixing, periodic, prefixtrie, quality, sharding, simhash, substring, toxicity
from hearken.llm.common import id_bucket, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.assess(table(spark, sf_dir, "documents"), trusted)


#: Sources belong to domains by number: the first is the open web, the others are reference works and forums in turn.
MIX = mixing.Plan(
    domains={"src0": "web"} | {f"src{k}": ("forum", "reference")[k % 2] for k in range(1, 20)},
    weights={("web",): 5, ("reference",): 3, ("forum",): 2} | {(d, lang): w for d in ("web", "reference", "forum") for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))},
)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.select(docs, MIX).select(
        "doc_id", F.col("__domain").alias("domain"), F.col("__language").alias("lang"), F.col("__source").alias("source"),
        F.col("__epoch").alias("epoch"), F.col("__tokens").alias("n_tokens"), F.col("__taken").alias("taken_tokens"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_size(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, id_bucket("doc_id", 5) != 0, "doc_id", "text", "lang")
    return language.identify(docs, model).select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = id_bucket("doc_id", 7)
    scored = lmscore.score(table(spark, sf_dir, "documents"), fold != 2)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    done = chat.format_records(chat.records_from_turns(turns.unionByName(extra)))
    back = done.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learned", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 3) != 1)
    return toxicity.score(docs, model).select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fourier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_bucket("doc_id", 5) != 0)
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(periodic.with_repeats(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_mixing, op3_substring_dedup, op4_sharding, op5_language_id, op6_lm_scoring, op7_chat_formatting, op8_simhash, op9_decontamination, op10_toxicity,
        op11_quality_classifier, op12_periodic_runs, op13_prefix_trie,
    )
}


def escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP7_SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({escaped_sql("role")}) + length({escaped_sql("text")}) + {len(chat.START + chat.MIDDLE + chat.END)})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM d)),
early AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM win JOIN early USING (g) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII string, a byte and then a bit at a time; the factor is the polynomial's reversed bits."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: {bits}), 4294967295)"


#: Five words that stand again at a distance, in a row, are a run; one of which a shorter period divides is that one's.
OP12_SQL = rf"""
WITH h AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, {crc_sql("doc_id::VARCHAR")} AS h FROM documents),
a AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE ws END AS ws FROM a),
five AS (SELECT doc_id, n, i, array_to_string(ws[i + 1:i + 5], ' ') AS f FROM (SELECT doc_id, n, ws, unnest(range(n - 4)) AS i FROM d)),
again AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.f = y.f AND y.i > x.i AND y.i - x.i <= x.n // 4),
rows AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM again),
long AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS k FROM rows GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.k >= x.s + x.k)),
best AS (SELECT doc_id, s, k, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k::DOUBLE / q DESC, s, q) = 1),
lists AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || k || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + k)) AS i FROM runs),
words AS (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n_kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.k::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.k // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, n::BIGINT AS n_words, (n - coalesce(n_kept, 0))::BIGINT AS n_dropped
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13_SQL = rf"""
WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS k, t, n FROM (
    SELECT conv_id, turn, md5(length(r) || ' ' || r || x) AS t, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL))),
ids AS (SELECT c, c - c % 20 AS base, {crc_sql("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
made AS (SELECT ids.c, 0 AS part, 0 AS k, '' AS t, 0 AS n FROM ids
    UNION ALL SELECT ids.c, 1, own.k, t, n FROM ids JOIN own ON own.c = base AND k <= h
    UNION ALL SELECT ids.c, 2, own.k, t, n FROM ids JOIN own ON own.c = ids.c AND k > h),
path AS (SELECT c, row_number() OVER w - 1 AS d, n, string_agg(t, '') OVER w AS key, lead(k) OVER w IS NULL AS last FROM made WINDOW w AS (PARTITION BY c ORDER BY part, k)),
node AS (SELECT d, key, min(c) AS c, count(*) AS n_convs, max(n) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last) AS ends FROM path GROUP BY d, key),
met AS (SELECT x.*, above.c AS parent, (SELECT count(*) FROM node z WHERE z.d = x.d + 1 AND z.key[:32 * x.d] = x.key) AS n_children FROM node x LEFT JOIN node above ON above.d = x.d - 1 AND above.key = x.key[:32 * (x.d - 1)]),
sums AS (SELECT p.d, p.key, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * met.n)::BIGINT AS saved FROM met JOIN path p ON p.c = met.c AND p.d <= met.d GROUP BY p.d, p.key)
SELECT c AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM met JOIN sums USING (d, key)
"""

ORACLE_SQL = {"op3_substring_dedup": OP3_SQL, "op7_chat_formatting": OP7_SQL, "op12_periodic_runs": OP12_SQL, "op13_prefix_trie": OP13_SQL}
