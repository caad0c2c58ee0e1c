"""Building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression, so that ``body`` can name it often without evaluating it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_matches(text: Column, pattern: str, made: Callable[[Column], Column]) -> Column:
    """Replace each match of a pattern by an expression over the match: a regular expression with a callback, in the JVM."""

    def joined(parts: Column) -> Column:
        gap = lambda g, k: F.concat(g, F.coalesce(made(F.get(parts["found"], k)), F.lit("")))
        return F.array_join(F.transform(parts["gaps"], gap), "")

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), joined)


def same_float(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines."""
    return F.round(value, digits)
