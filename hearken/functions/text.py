"""Normalisation of call transcripts, one column function per step; Unicode classes throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions.expr import replace_matches

# Patterns and word lists that results depend on.
DUAL = r"(?U)(\d[\w-]*)/([^()\s]+)"
DUAL_RUN = r"(?U)(?:\d[\w-]*/[^()\s]+\s*){2,}"
SPACED_DIGITS = r"(?U)(?:\d\s){4,}\d"
FILLERS = ("아", "어", "음", "그", "뭐", "저", "막", "좀")
SPEAKERS = ("피해자", "사기범")
MASK = "쏐-?"


def merge_dual_runs(text: Column) -> Column:
    """Runs of two or more spoken/written pairs that start with a digit become their first halves, joined."""
    return replace_matches(text, DUAL_RUN, lambda m: F.array_join(F.regexp_extract_all(m, F.lit(DUAL), F.lit(1)), ""))


def keep_first_of_pairs(text: Column) -> Column:
    return F.regexp_replace(text, DUAL, "$1")


def join_spaced_digits(text: Column) -> Column:
    """Five or more digits set apart by single spaces close up; only U+0020 goes."""
    return replace_matches(text, SPACED_DIGITS, lambda m: F.replace(m, F.lit(" "), F.lit("")))


def drop_plus(text: Column) -> Column:
    return F.replace(text, F.lit("+"), F.lit(" "))


def drop_parentheses(text: Column) -> Column:
    return F.regexp_replace(text, r"\([^)]*\)", " ")


def drop_fillers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<!\S)(?:[a-z]|" + "|".join(FILLERS) + ")/", " ")


def drop_masks(text: Column) -> Column:
    return F.regexp_replace(text, MASK, " ")


def drop_speakers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?:" + "|".join(SPEAKERS) + r")\s*:\s*", " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: In the order in which they apply.
STEPS = {
    "dual_runs": merge_dual_runs,
    "dual": keep_first_of_pairs,
    "digits": join_spaced_digits,
    "plus": drop_plus,
    "parentheses": drop_parentheses,
    "fillers": drop_fillers,
    "masks": drop_masks,
    "speakers": drop_speakers,
    "spaces": squeeze,
}


def normalize(text: Column) -> Column:
    for step in STEPS.values():
        text = step(text)
    return text


def source_group(stem: Column) -> Column:
    """The call that a chunk's file stem belongs to; the first rule that applies."""
    numbered = F.nullif(F.regexp_extract(stem, r"(?iU)^(PHISH_\d+)_\d{4}$", 1), F.lit(""))
    doubled = F.nullif(F.regexp_extract(stem, r"(?U)^(.+?)__\d{4}$", 1), F.lit(""))
    return F.when(stem.contains("__chunk_"), F.substring_index(stem, "__chunk_", 1)).otherwise(F.coalesce(numbered, doubled, stem))


def redact(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Hub tokens, and the secrets given, become a fixed mark."""
    for secret in secrets:
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return F.regexp_replace(text, r"(?U)\bhf_[A-Za-z0-9_-]+\b", "[REDACTED]")


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of a text; the padded keys are constants, the rest are two digests."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256))), 256)


def new_id(prefix: str, digits: int) -> Column:
    """A random identifier: prefix, underscore, hex digits."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, digits))
