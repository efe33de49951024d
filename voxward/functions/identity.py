"""Phone numbers and keyword matches as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxward.params import MIN_PHONE_DIGITS, VOIP_KEYWORDS

# Java's \s and \D know ASCII only unless (?U) is set, and even then \s leaves
# out the four separators U+001C to U+001F, which count as blanks here.
_BLANK_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_NOT_DIGIT = r"(?U)\D"


def validate_number(text: Column) -> Column:
    """``+`` and the digits of an unsaved number; NULL for names and anything short."""
    bare = F.regexp_replace(text, _BLANK_ENDS, "")
    digits = F.regexp_replace(bare, _NOT_DIGIT, "")
    unsaved = bare.startswith("+") & ~bare.rlike("[A-Za-z]")
    return F.when(unsaved & (F.length(digits) >= MIN_PHONE_DIGITS), F.concat(F.lit("+"), digits))


def hash_number(number: Column) -> Column:
    """SHA-256 of the number, as hex."""
    return F.sha2(number, 256)


def keyword_pattern(keywords: Iterable[str] = VOIP_KEYWORDS) -> str:
    return "|".join(re.escape(k) for k in keywords)


def is_voip_name(name: Column, keywords: Iterable[str] = VOIP_KEYWORDS) -> Column:
    """The process name contains a keyword."""
    return F.lower(name).rlike(keyword_pattern(keywords))


def is_voip(name: Column, chain: Column, keywords: Iterable[str] = VOIP_KEYWORDS) -> Column:
    """The process or one of its ancestors has a name that contains a keyword."""
    pattern = keyword_pattern(keywords)
    family = F.exists(F.coalesce(chain, F.array().cast("array<string>")), lambda p: F.lower(p).rlike(pattern))
    return is_voip_name(name, keywords) | F.coalesce(family, F.lit(False))
