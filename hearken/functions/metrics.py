"""Edit-distance metrics of transcripts.

One Arrow step per pair of texts composes, cleans and codes them: Spark has no built-in for NFKC, and one character per distinct
word lets the built-in distance apply to words.  The distances of usual pairs run in the JVM, whose work is the product of their
lengths; those of long ones run in the same Arrow step, bit-parallel and banded.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.functions.distance import edit_distance
from hearken.functions.text import SPEAKERS

_SPEAKER = re.compile(r"(?:" + "|".join(SPEAKERS) + r")\s*:\s*")
_NOTE, _OTHER = re.compile(r"\([^)]*\)"), re.compile(r"[\W_]+")
#: The first code of a word; those from here on but for the surrogates, a million and more, can each be one character.
_FIRST = 0x10000
#: Pairs whose lengths have a larger product are long; the built-in takes milliseconds up to here.
LONG = 1 << 20
DISTANCES = ("distance", "word_distance")
READY = T.StructType([T.StructField(name, T.StringType()) for name in ("reference", "hypothesis", "reference_words", "hypothesis_words")] + [T.StructField(name, T.LongType()) for name in DISTANCES])


def metric_text(text: str | None) -> str:
    """Composed, without speakers and notes, letters and digits only, single spaces between words."""
    text = _NOTE.sub(" ", _SPEAKER.sub(" ", unicodedata.normalize("NFKC", text or "")))
    return _OTHER.sub(" ", text).strip()


def coded(words: list[str], codes: dict[str, int]) -> str:
    """A character per word: its number among the words seen so far."""
    return "".join([chr(_FIRST + codes.setdefault(w, len(codes))) for w in words])


@F.pandas_udf(READY)
def ready(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    rows = []
    for r, h in zip(reference, hypothesis):
        left, right = metric_text(r).split(), metric_text(h).split()
        if left == right:
            rows.append(("".join(left), "".join(left), "w" * len(left), "w" * len(left), None, None))
            continue
        whole, heard = "".join(left), "".join(right)
        if len(whole) * len(heard) > LONG:
            rows.append((whole, "", "w" * len(left), "", edit_distance(whole, heard), edit_distance(left, right)))
            continue
        codes: dict[str, int] = {}
        rows.append((whole, heard, coded(left, codes), coded(right, codes), None, None))
    made = pd.DataFrame(rows, columns=READY.names)
    return made.astype(dict.fromkeys(DISTANCES, "Int64"))


def rate(reference: Column, hypothesis: Column, distance: Column) -> Column:
    """Distance per unit of the reference, known already for long pairs; 0 or 1 where the reference is empty."""
    empty = F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)
    return F.when(distance.isNotNull(), distance / F.length(reference)).when(reference == hypothesis, 0.0).when(F.length(reference) == 0, empty).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def rates(pair: Column) -> dict[str, Column]:
    """cer and wer of a column of ``ready``."""
    return {"cer": rate(pair["reference"], pair["hypothesis"], pair["distance"]), "wer": rate(pair["reference_words"], pair["hypothesis_words"], pair["word_distance"])}
