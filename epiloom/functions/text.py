"""Text predicates and label rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Lower case, trimmed, without all but a-z, 0-9 and single inner spaces as they are."""
    return F.regexp_replace(F.trim(F.lower(text)), "[^a-z0-9 ]", "")


def word_count(text: Column) -> Column:
    """The number of tokens between white space; 0 for an empty text."""
    t = F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("bigint")


def contains_word(text: Column, literal: str) -> Column:
    """Whether the text holds the literal between word boundaries, in any case; the literal is [a-z ] only."""
    return text.rlike(rf"(?i)\b{literal}\b")


def issues(*tests: tuple[Column, str]) -> Column:
    """The codes whose test holds, in the given order; a test that is NULL doesn't."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in tests]), lambda x: x.isNotNull())
