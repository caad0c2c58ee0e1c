"""Command line: ``python -m hearken prepare`` and ``python -m hearken evaluate``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.operators import dataset, evaluation
from hearken.sources import audio, files


def prepare(spark: SparkSession, settings: str, data: str, out: str, seed: int | None = None) -> dict[str, object]:
    """Pairs below a folder, checked and split as the settings say; writes ``manifest`` and, if there are any, ``issues``."""
    chosen = files.load_settings(spark, settings)["data"]
    known = audio.uploads(spark, data).select(F.col("filename").alias("path"), "content")
    paired = dataset.pair_files(known, tuple(chosen.get("extensions", dataset.AUDIO)), int(chosen.get("min_transcript_chars", 1)))
    good = dataset.with_group(paired.where("issue is null"))
    if (n := good.count()) < 3:
        raise ValueError(f"at least 3 good pairs are needed, not {n}")
    split = dataset.split_groups if chosen.get("group_by_source") else dataset.split_pairs
    ratios = dataset.Ratios(*(float(chosen[f"{k}_ratio"]) for k in dataset.SPLITS))
    done = split(good, ratios, int(chosen.get("seed", 42)) if seed is None else seed)
    files.write_manifest(done, f"{out}/manifest")
    files.write_issues(paired, f"{out}/issues")
    counts = {r["split"]: r["count"] for r in done.groupBy("split").count().collect()}
    return {"counts": {k: counts.get(k, 0) for k in dataset.SPLITS}, "issues": paired.where("issue is not null").count(), "output": out}


def evaluate(cases: list[str], calls: DataFrame) -> dict[str, object]:
    """Metrics of analysed calls (call_id, label) against ``PATH=LABEL`` cases; skipped and missing calls are counted apart."""
    spark = calls.sparkSession
    parsed = spark.createDataFrame([(c,) for c in cases], "spec string").select(F.col("spec"), evaluation.parsed_case(F.col("spec")).alias("c"))
    bad = [r.spec for r in parsed.where("c is null").collect()]  # a row per argument
    if bad:
        raise ValueError(f"not PATH=LABEL: {', '.join(bad)}")
    expected = parsed.select(F.col("c.path").alias("call_id"), F.col("c.label").alias("expected_label"))
    joined = evaluation.joined_cases(expected, calls.select("call_id", F.col("label").alias("predicted_label")), "call_id")
    metrics = evaluation.confusion(joined.where("predicted_label is not null")).first().asDict()
    return {"metrics": metrics, "without_label": joined.where("predicted_label is null").count()}


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="hearken")
    commands = parser.add_subparsers(dest="command", required=True)
    made = commands.add_parser("prepare", help="pair, check and split audio and texts")
    for name in ("settings", "data", "out"):
        made.add_argument(f"--{name}", required=True)
    made.add_argument("--seed", type=int)
    judged = commands.add_parser("evaluate", help="hold analysed calls against labels")
    judged.add_argument("--calls", required=True, help="table of analysed calls")
    judged.add_argument("--case", action="append", required=True, metavar="PATH=LABEL")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if given.command == "prepare":
        told = prepare(spark, given.settings, given.data, given.out, given.seed)
    else:
        told = evaluate(given.case, spark.read.parquet(given.calls))
    print(json.dumps(told, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
