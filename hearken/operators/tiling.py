"""Cutting audio by time and text by tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.expr import let

#: Longest input of the scorer in tokens, its two marks included.
MAX_LENGTH = 128
SECONDS = 30.0


def audio_tiles(samples: Column, sample_rate: int, seconds: float = SECONDS) -> Column:
    """array of struct(first, last, start, end): sample range and seconds of each tile; the last may be short, none if empty."""
    if sample_rate <= 0 or seconds <= 0:
        raise ValueError("sample_rate and seconds must be positive")
    size = max(1, int(sample_rate * seconds))
    end = lambda first: F.least(first + size, samples)
    tile = lambda first: F.struct(first.alias("first"), end(first).alias("last"), (first / sample_rate).alias("start"), (end(first) / sample_rate).alias("end"))
    return F.when(samples > 0, F.transform(F.sequence(F.lit(0).cast("long"), samples.cast("long") - 1, F.lit(size).cast("long")), tile)).otherwise(F.array())


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def join_words(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def token_tiles(text: Column, max_length: int = MAX_LENGTH, encode: Callable[[Column], Column] = split_words, decode: Callable[[Column], Column] = join_words) -> Column:
    """Texts of at most max_length - 2 tokens each, without overlap; a text that fits stays as it is.  Blank tiles go."""
    size = max_length - 2
    if size <= 0:
        raise ValueError("max_length must be greater than 2")

    def cut(tokens: Column) -> Column:
        tiles = F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(size)), lambda at: decode(F.slice(tokens, at + 1, F.lit(size))))
        return F.when(F.size(tokens) <= size, F.array(text)).otherwise(F.filter(tiles, lambda t: F.trim(t) != ""))

    return F.when(text.isNotNull(), let(encode(text), cut))
