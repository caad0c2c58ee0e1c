"""Rules, run settings and model manifests read through Spark, so that any store it knows will do; results written as JSON."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions.correct import Rule, rules_from_json
from hearken.operators.dataset import Ratios, manifest

# What a run's settings must hold.
REQUIRED = ("data", "model_name", "language", "task", "lora", "training")
TARGETS = ["q_proj", "v_proj"]


def text_of(spark: SparkSession, path: str) -> str:
    """One small file as text."""
    return spark.read.text(path, wholetext=True).first()[0]


def load_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    try:
        return rules_from_json(text_of(spark, path))
    except json.JSONDecodeError as error:
        raise ValueError(f"{path} is not JSON: {error}") from error


def checked_settings(settings: Any) -> dict[str, Any]:
    """A run's settings, or an error that names what is wrong."""
    if not isinstance(settings, dict):
        raise ValueError("settings must be a mapping")
    missing = sorted(k for k in REQUIRED if k not in settings)
    if missing:
        raise ValueError(f"settings lack {', '.join(missing)}")
    if settings["language"] != "ko":
        raise ValueError("language must be ko")
    if settings["lora"].get("target_modules") != TARGETS:
        raise ValueError(f"target_modules must be {TARGETS}")
    ratios = [settings["data"].get(f"{k}_ratio") for k in ("train", "validation", "test")]
    if not all(isinstance(r, (int, float)) and not isinstance(r, bool) for r in ratios):
        raise ValueError("ratios must be numbers")
    Ratios(*ratios)
    return settings


def load_settings(spark: SparkSession, path: str) -> dict[str, Any]:
    import yaml

    return checked_settings(yaml.safe_load(text_of(spark, path)))


def model_manifest_problems(found: dict[str, Any], base_model: str, adapter_model: str, files: list[str]) -> list[str]:
    """What keeps a converted model from being used: settings that differ, or missing weights."""
    wanted = {"base_model": base_model, "adapter_model": adapter_model, "merged": True, "quantization": "int8"}
    problems = [f"{k} is {found.get(k)!r}, not {v!r}" for k, v in wanted.items() if found.get(k) != v]
    return problems + ([] if "model.bin" in files else ["model.bin is missing"])


def write_manifest(split: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines in the manifest's order, characters as they are.

    The order runs through the part files by name, so no task holds all transcripts; ``one_file`` sends them through one.
    """
    rows = manifest(split)
    (rows.coalesce(1) if one_file else rows).write.json(path)


def write_issues(pairs: DataFrame, path: str) -> bool:
    """Issues as JSON, if there are any; tells whether it wrote."""
    issues = pairs.where("issue is not null").select(F.col("issue").alias("code"), F.coalesce("text", "audio").alias("path"))
    if not issues.take(1):
        return False
    issues.write.json(path)
    return True


def write_transcripts(calls: DataFrame, path: str) -> None:
    """Per call a folder ``call_id=...`` in ``transcripts``, its stripped transcript as text, and one in ``segments``, its segments as
    JSON lines in their order."""
    calls.select("call_id", F.trim("raw_transcript").alias("value")).write.partitionBy("call_id").text(f"{path}/transcripts")
    calls.select("call_id", F.explode("reference_segments").alias("s")).select("call_id", "s.*").write.partitionBy("call_id").json(f"{path}/segments")
