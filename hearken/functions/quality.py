"""The gate that keeps meaningless transcripts from the scorer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.expr import let

# The characters that count as valid, and those that make tokens.
VALID = r"가-힣A-Za-z0-9.,!?%~()\-"
TOKEN = "[가-힣A-Za-z0-9]+"


@dataclass(frozen=True)
class Gate:
    invalid_share: float = 0.4
    repeat_share: float = 0.7
    repeat_from: int = 4

    def __post_init__(self) -> None:
        if not 0 <= self.invalid_share <= 1:
            raise ValueError("invalid_share must lie in [0, 1]")
        if not 0 < self.repeat_share <= 1:
            raise ValueError("repeat_share must lie in (0, 1]")
        if self.repeat_from < 2:
            raise ValueError("repeat_from must be at least 2")


def valid_ratio(text: Column) -> Column:
    """Share of valid characters among those that are not white space; null for blank texts."""
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    return F.length(F.regexp_replace(compact, f"[^{VALID}]", "")) / F.nullif(F.length(compact), F.lit(0))


def top_count(tokens: Column) -> Column:
    """Occurrences of the most frequent token: the longest run once the tokens are sorted."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(s["last"] == t, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(F.sort_array(tokens), start, step, lambda s: s["most"])


def check(text: Column, gate: Gate = Gate()) -> Column:
    """struct(usable, score, reason, ratio); the first reason that applies.  A null text is null: it is an error of the caller."""

    def judged(x: Column) -> Column:
        ratio, n = x["ratio"], F.size(x["tokens"])
        reason = (
            F.when(ratio.isNull(), "empty_transcript").when(1 - ratio > gate.invalid_share, "low_valid_ratio")
            .when((n >= gate.repeat_from) & (top_count(x["tokens"]) / n >= gate.repeat_share), "repeated_tokens").when(n == 0, "no_meaningful_tokens")
        )
        return F.struct(reason.isNull().alias("usable"), F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("score"), reason.alias("reason"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"))

    parts = F.struct(valid_ratio(text).alias("ratio"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens"))
    return F.when(text.isNotNull(), let(parts, judged))
