"""Offline evaluation: confusion metrics, transcript error rates, and what corrections did to them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions.correct import Rule, correct
from hearken.functions.metrics import rates, ready
from hearken.functions.scoring import NORMAL, SUSPECT
from hearken.session import spread


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion(cases: DataFrame, expected: str = "expected_label", predicted: str = "predicted_label") -> DataFrame:
    """One row of counts and rates; a rate over nothing is 0, an unknown label an error.  One row of zeros for no cases."""
    known = lambda c: F.when(F.col(c).isin(NORMAL, SUSPECT), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(c, F.lit("null")))))
    marked = cases.select(known(expected).alias("e"), known(predicted).alias("p"))
    cell = lambda e, p: F.count_if((F.col("e") == e) & (F.col("p") == p))
    counts = marked.agg(F.count("*").alias("total"), cell(SUSPECT, SUSPECT).alias("true_positive"), cell(NORMAL, NORMAL).alias("true_negative"), cell(NORMAL, SUSPECT).alias("false_positive"), cell(SUSPECT, NORMAL).alias("false_negative"))
    tp, tn, fp, fn = (F.col(c) for c in ("true_positive", "true_negative", "false_positive", "false_negative"))
    rates = counts.withColumns({"accuracy": ratio(tp + tn, F.col("total")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp)})
    return rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def joined_cases(expected: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Expected labels with predictions; a case without a prediction, such as a skipped call, has null there."""
    return expected.join(predicted, key, "left")


def parsed_case(spec: Column) -> Column:
    """struct(path, label) of ``PATH=LABEL``, cut at the last equals sign; null where there is none or a half is empty."""
    path, label = (F.regexp_extract(spec, r"(?s)^(.*)=([^=]*)$", k) for k in (1, 2))
    return F.when((path != "") & (label != ""), F.struct(path.alias("path"), label.alias("label")))


def error_rates(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``pairs`` with cer and wer."""
    return spread(pairs).withColumn("__pair", ready(F.col(reference), F.col(hypothesis))).withColumns(rates(F.col("__pair"))).drop("__pair")


def mean_error_rates(rated: DataFrame) -> DataFrame:
    """Means of the samples' rates; null for no samples."""
    return rated.agg(F.count("*").alias("sample_count"), F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"))


def corrected_pairs(pairs: DataFrame, rules: Iterable[Rule], kinds: Iterable[str] = ("typo",)) -> DataFrame:
    """Per sample: rates before and after correction, and the ids of the rules that changed it.  No text leaves.

    Samples that no rule changed keep their rates; only the others are measured again.
    """
    full = F.when((F.coalesce("sample_id", F.lit("")) != "") & (F.coalesce("reference", F.lit("")) != "") & (F.coalesce("hypothesis", F.lit("")) != ""), F.col("hypothesis"))
    checked = spread(pairs).withColumn("hypothesis", F.coalesce(full, F.raise_error(F.lit("a pair needs sample_id, reference and hypothesis"))))
    fixed = correct(checked, "hypothesis", rules, kinds).withColumn("raw", ready(F.col("reference"), F.col("hypothesis"))).withColumn("after", ready(F.col("reference"), F.col("corrected")))
    raw = fixed.withColumns({f"raw_{k}": c for k, c in rates(F.col("raw")).items()})
    same = F.size("corrections") == 0
    done = raw.withColumns({f"corrected_{k}": F.when(same, F.col(f"raw_{k}")).otherwise(c) for k, c in rates(F.col("after")).items()})
    return done.select("sample_id", "raw_cer", "corrected_cer", "raw_wer", "corrected_wer", F.transform("corrections", lambda x: x["rule_id"]).alias("rules"))


def correction_summary(samples: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(c)
    return samples.agg(
        F.count("*").alias("sample_count"), F.count_if(F.size("rules") > 0).alias("changed_sample_count"), mean("raw_cer").alias("average_raw_cer"), mean("corrected_cer").alias("average_corrected_cer"),
        mean("raw_wer").alias("average_raw_wer"), mean("corrected_wer").alias("average_corrected_wer"), mean(F.col("corrected_cer") - F.col("raw_cer")).alias("cer_delta"), mean(F.col("corrected_wer") - F.col("raw_wer")).alias("wer_delta"),
    )


def rule_impact(samples: DataFrame) -> DataFrame:
    """Per rule that applied: samples, and how many of them either rate improved, or else worsened, or left."""
    c, w = F.col("corrected_cer") - F.col("raw_cer"), F.col("corrected_wer") - F.col("raw_wer")
    better, worse = (c < 0) | (w < 0), (c > 0) | (w > 0)
    rows = samples.select(F.explode("rules").alias("rule_id"), better.alias("better"), worse.alias("worse"))
    return rows.groupBy("rule_id").agg(
        F.count("*").alias("application_count"), F.count("*").alias("sample_count"), F.count_if("better").alias("improved_sample_count"),
        F.count_if(~F.col("better") & F.col("worse")).alias("worsened_sample_count"), F.count_if(~F.col("better") & ~F.col("worse")).alias("unchanged_sample_count"),
    )
