"""What the screens show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stages of an analysis in order, with the progress each one starts at.
STAGES = {"queued": 0, "preprocessing": 10, "transcribing": 30, "normalizing": 45, "classifying": 65, "risk_search": 80, "finalizing": 90, "completed": 100}
#: Seconds at which the demonstration's stages end.
DEMO_ENDS = (1, 3, 6, 8, 10, 12, 14)


def percent_score(direct: Column, suspicion: Column) -> Column:
    """A direct score as it is, else the suspicion in percent with two decimals, halves up."""
    return F.coalesce(direct, F.floor(F.coalesce(suspicion, F.lit(0.0)) * 10000 + 0.5) / 100)


def is_suspicious(label: Column, percent: Column) -> Column:
    return F.coalesce(label, F.lit("")).contains("의심") | (percent >= 50)


def risk_level(suspicious: Column) -> Column:
    return F.when(suspicious, 5).otherwise(1)


def risk_label(suspicious: Column) -> Column:
    return F.when(suspicious, "매우 높음").otherwise("낮음")


def percent_text(score: Column) -> Column:
    return F.when(score.isNull(), "-").otherwise(F.concat(F.format_string("%.2f", score * 100), F.lit("%")))


def level_band(level: Column) -> Column:
    return F.when(level >= 4, "red").when(level >= 3, "amber").otherwise("emerald")


def stage_index(stage: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), stage).cast("int") - 1


def step_state(step: Column, stage: Column, status: Column) -> Column:
    """State of one step of the list, given where the job is."""
    order = F.when(stage_index(step) < stage_index(stage), "completed").when(stage_index(step) == stage_index(stage), "running").otherwise("pending")
    return F.when(status == "completed", "completed").when((status == "failed") & (step == stage), "failed").otherwise(order)


def upload_size(n: Column, even: bool = False) -> Column:
    """Halves of the last digit go up, as on the screens, or to the even digit, as DuckDB's ``format`` takes them."""
    size = n / (1024 * 1024)
    mb = F.concat(F.format_string("%.1f", F.bround(size, 1) if even else size), F.lit(" MB"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").when(n < 1024 * 1024, F.concat(F.ceil(n / 1024).cast("string"), F.lit(" KB"))).otherwise(mb)


def file_size(n: Column) -> Column:
    sized = F.lit("0 B")
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        sized = F.when(n >= 1024**k, F.concat(F.format_string("%.0f" if k == 0 else "%.1f", n / float(1024**k)), F.lit(f" {unit}"))).otherwise(sized)
    return sized


def demo_stage(elapsed: Column) -> Column:
    stage = F.lit("completed")
    for end, name in reversed(list(zip(DEMO_ENDS, STAGES))):
        stage = F.when(elapsed < end, name).otherwise(stage)
    return stage


def progress_of(stage: Column) -> Column:
    """The progress that a stage starts at; null for other names."""
    return F.coalesce(*[F.when(stage == k, F.lit(v)) for k, v in STAGES.items()])


def chunk_progress(stage: Column, done: Column, total: Column, current: Column) -> Column:
    """Progress within a stage by its finished chunks; halves round to even; without chunks it stays where it is."""
    span = lambda base, width: base + F.bround(width * done / total).cast("int")
    inside = F.when(stage == "transcribing", span(30, 5)).when(stage == "normalizing", span(45, 5)).otherwise(span(65, 15))
    return F.greatest(F.when(total > 0, inside).otherwise(current), current)
