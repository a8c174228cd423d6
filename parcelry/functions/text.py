"""The two text functions that Spark has no expression for, as Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """The share of characters that match within half the longer length, less half the transposed."""
    m, n = len(a), len(b)
    if not m or not n:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(m, n) // 2 - 1)
    free = [True] * n
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, f in zip(b, free, strict=True) if not f]
    c = len(left)
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (c / m + c / n + (c - moved) / c) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1, above: float = 0.7) -> float:
    """jaro, raised by the length of the common prefix (4 at most) where it is above a floor."""
    s = jaro(a, b)
    if s <= above:
        return s
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return s + p * scale * (1 - s)


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], int] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = int(jaro_winkler(pair[0].upper(), pair[1].upper()) * 100 + 0.5)
        out.append(known[pair])
    return pd.Series(out, dtype="Int32")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Case-insensitive Jaro-Winkler similarity, 0 to 100; NULL if either is."""
    return F.pandas_udf(_similarity, T.IntegerType())(a, b)


def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def folded(s: Column | str) -> Column:
    """NFKC and case folding, for comparisons that spelling tricks should not escape."""
    return F.pandas_udf(_folded, T.StringType())(s)
