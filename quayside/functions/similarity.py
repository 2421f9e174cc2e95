"""How alike two titles are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_chars(a: str, b: str) -> int:
    """Characters in common: the longest common substring (leftmost of the longest), then left and right of it."""
    from difflib import SequenceMatcher

    todo, total = [(0, len(a), 0, len(b))], 0
    matcher = SequenceMatcher(None, a, b, autojunk=False)
    while todo:
        lo1, hi1, lo2, hi2 = todo.pop()
        m = matcher.find_longest_match(lo1, hi1, lo2, hi2)
        if m.size:
            total += m.size
            todo += [(lo1, m.a, lo2, m.b), (m.a + m.size, hi1, m.b + m.size, hi2)]
    return total


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [None if x is None or y is None else 200.0 * common_chars(x, y) / (len(x) + len(y)) if x or y else 0.0 for x, y in zip(a, b, strict=True)]
    return pd.Series(out, dtype="float64")


# not deterministic only by name: filters on it then stay above what gives each pair once, and it is worked out once
similar_text = F.pandas_udf(_similar, DoubleType()).asNondeterministic()
"""Percentage of characters in common. Not symmetric. 0 for two empty texts, null for null."""


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """0 to 100 by edit distance; 100 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise((F.lit(1.0) - F.levenshtein(a, b) / longest) * 100)


def title_similarity(a: Column, b: Column) -> Column:
    """0 to 100 of two normalised titles: the larger of both measures."""
    return F.when(a == b, F.lit(100.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(similar_text(a, b), levenshtein_similarity(a, b)))
