"""Quality rules: fixed counts of each text, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Built-in functions only.  Two passes over the texts: the first counts hashed unigrams and bigrams of the whole corpus and of
the trusted documents (combined before a shuffle of ``buckets`` rows), the second scores each document against the table of
log ratios, which has ``buckets`` entries whatever the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import let, words

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the likelihood ratio.

    buckets: size of the hashed n-gram space.  broadcast_ids: trusted ids up to which their list is broadcast; beyond it
    documents and ids are joined by a shuffle of the documents' buckets.  smoothing: pseudo-count per bucket.  threshold: a document
    is kept if its mean log ratio per n-gram is at least this.
    """

    buckets: int = 10_000
    broadcast_ids: int = 1_000_000
    smoothing: float = 1.0
    threshold: float = -0.06
    min_words: int = 50
    repeat_percent: int = 50


def hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def joined_with_next(left: Column, right: Column, skip: int) -> Column:
    """Hashes of left[i] with right[i + skip], as long as both exist."""
    n = F.greatest(F.size(right) - skip, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, 1 + skip, n), lambda a, b: F.xxhash64(a, b))


def repeated_words(n_windows: Column, windows: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are sorted by hash with their positions, so that equal ones are neighbours; the positions of repeated ones,
    sorted again, each add up to three words, fewer where the next one begins sooner.  n log n for a text of any length.
    """

    def positions(p: Column) -> Column:
        same = lambda k: F.get(p, k)["h"]
        marked = F.transform(p, lambda s, k: F.when((F.when(k > 0, same(k - 1)) == s["h"]) | (same(k + 1) == s["h"]), s["p"]))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    def covered(d: Column) -> Column:
        steps = F.transform(d, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    ordered = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == n_windows, F.lit(0).cast("long")).otherwise(let(let(ordered, positions), covered))


def base_columns(text: Column, found: Column, windows: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
        "n_dup_lines": F.coalesce(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long"),
        "n_repeat_words": repeated_words(F.size(windows), windows),
    }


def log_ratios(docs: DataFrame, trusted: DataFrame, rules: Rules) -> list[float]:
    """log p_trusted - log p_raw of every bucket, with ``docs`` (doc_id, text) and ``trusted`` (doc_id)."""
    chosen = trusted.where("doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()
    few = chosen.limit(rules.broadcast_ids + 1).count() <= rules.broadcast_ids
    h = hashes(words(F.col("text")))
    grams = let(h, lambda x: F.transform(F.concat(x, joined_with_next(x, x, 1)), lambda g: F.pmod(g, F.lit(rules.buckets)).cast("int")))
    flagged = docs.select("doc_id", grams.alias("grams")).join(F.broadcast(chosen) if few else chosen, F.col("doc_id") == F.col("trusted_id"), "left")
    counted = (
        flagged.select(F.col("trusted_id").isNotNull().alias("good"), F.explode("grams").alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count_if("good").alias("good"))
        .collect()  # as many rows as buckets
    )
    raw, good = [rules.smoothing] * rules.buckets, [rules.smoothing] * rules.buckets
    for row in counted:
        raw[row.bucket] += row.raw
        good[row.bucket] += row.good
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [math.log(g) - math.log(r) + shift for g, r in zip(good, raw)]


def assess(docs: DataFrame, trusted: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept and llr.

    ``trusted`` lists the ids of trusted documents in ``doc_id``.  A null or empty text has no words, llr 0 and fails the base
    rules.  With no trusted documents all ratios are those of a uniform target.  Repeated rows are each counted and judged.
    Ties with the threshold are kept.  Other columns of the input are not read.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ratios = log_ratios(docs, trusted.select("doc_id"), rules)
    lookup = F.from_json(F.lit("[" + ",".join(map(repr, ratios)) + "]"), "array<double>")
    found = docs.withColumn("w", words(F.col("text"))).withColumn("h", hashes(F.col("w")))
    paired = found.withColumn("h2", joined_with_next(F.col("h"), F.col("h"), 1))
    windows = paired.withColumn("h3", joined_with_next(F.col("h2"), F.col("h"), 2))
    total = lambda grams: F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(lookup, F.pmod(g, F.lit(rules.buckets)).cast("int")))
    scored = windows.select(
        "doc_id", *(c.alias(k) for k, c in base_columns(F.col("text"), F.col("w"), F.col("h3")).items()),
        F.coalesce((total(F.col("h")) + total(F.col("h2"))) / F.nullif(F.size("h") + F.size("h2"), F.lit(0)), F.lit(0.0)).alias("llr"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    return scored.select(*scored.columns[:-1], failed.alias("base_failed"), (~failed & (F.col("llr") >= rules.threshold)).alias("kept"), "llr")
