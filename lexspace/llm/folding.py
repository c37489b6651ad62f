"""Text folding shared by the text operators: case, accents, points and invisible characters are ignored."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

WORD = re.compile(r"[^\W_]+")


@cache
def _ignored() -> re.Pattern:
    """All combining marks and format characters, as one character class."""
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf")]
    parts, start = [], points[0]
    for a, b in zip(points, [*points[1:], -1], strict=True):
        if b != a + 1:
            parts.append(f"{chr(start)}-{chr(a)}")
            start = b
    return re.compile("[" + "".join(parts) + "]+")


def fold(text: str) -> str:
    """Case-folded, compatibility-decomposed text without combining marks and format characters."""
    if text.isascii():
        return text.lower()
    return _ignored().sub("", unicodedata.normalize("NFKD", text.casefold())).casefold()


def fold_words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the folded text; null has none."""
    return WORD.findall(fold(text)) if text else []
