"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cantillation marks; the vowel points follow them.
MARKS = r"[\u0591-\u05AF]"


def strip_marks(text: Column) -> Column:
    """Text without cantillation marks; vowel points stay."""
    return F.regexp_replace(text, MARKS, "")


def strip_space(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
