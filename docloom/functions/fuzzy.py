"""Similarity of strings by insertions and deletions (0 to 100), and its forms over tokens.

Spark's levenshtein counts substitutions and so is another measure. The longest common subsequence is found
by bit operations on whole integers; texts come in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text and a stretch of the longer of its length, or of its beginning or end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = 0.0
    for k in range(1 - len(a), len(b)):
        part = b[max(0, k) : k + len(a)]
        if part[0] in a or part[-1] in a:
            best = max(best, ratio(a, part))
            if best == 100.0:
                break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of: what both share against each whole, and both wholes; 100 where one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, rest_a, rest_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not rest_a or not rest_b):
        return 100.0
    s = " ".join(both)
    sa, sb = " ".join([*both, *rest_a]), " ".join([*both, *rest_b])
    best = ratio(sa, sb)
    return max(best, ratio(s, sa), ratio(s, sb)) if both else best


def _pairwise(f):
    def column(a: Column | str, b: Column | str) -> Column:
        def over(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if s is None or t is None else f(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

        return F.pandas_udf(over, "double")(a, b)

    return column


ratio_of, partial_ratio_of, token_sort_ratio_of, token_set_ratio_of = map(_pairwise, (ratio, partial_ratio, token_sort_ratio, token_set_ratio))
