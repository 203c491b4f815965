"""Words as the problems define them: maximal runs of Unicode letters and digits, in lower case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")  # letters and numbers of any script


def words(text: Column) -> Column:
    """Array of the words of ``text``; null for null, empty for a text without words."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())
