"""Similarities of two strings or vectors as column expressions; only Jaro-Winkler leaves the JVM, in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: two empty ones are equal, one empty one is unlike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_shared(a, b) / (F.size(a) + F.size(b) - _shared(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


@lru_cache(maxsize=100_000)
def char_ngrams(s: str, n: int) -> frozenset[str]:
    """Set of n-grams; a shorter string is its own n-gram, and the empty one has none."""
    return frozenset(s[i : i + n] for i in range(max(1, len(s) - n + 1))) if s else frozenset()


def char_ngram_jaccard(a: str, b: str, n: int) -> float:
    """Two empty strings are equal, one empty one is unlike."""
    x, y = char_ngrams(a, n), char_ngrams(b, n)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("name3", "name4", "addr3")]))
def gram_jaccards(n1: pd.Series, n2: pd.Series, a1: pd.Series, a2: pd.Series) -> pd.DataFrame:
    """The three n-gram comparisons of a pair in one crossing to Python; the sets of a text are built once for its pairs."""
    each = lambda x, y, n: [1.0 if u and u == v else char_ngram_jaccard(u or "", v or "", n) for u, v in zip(x, y)]
    return pd.DataFrame({"name3": each(n1, n2, 3), "name4": each(n1, n2, 4), "addr3": each(a1, a2, 3)})


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger of two counts; 1 for two zeros, 0 for one."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def word_count(s: Column) -> Column:
    return F.size(F.array_remove(F.split(s, " "), ""))


@lru_cache(maxsize=200_000)
def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler without a threshold for the prefix bonus and with half transpositions kept; equal is 1, one empty 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = list(b)
    from_a, taken = [], []
    for i, c in enumerate(a):
        lo = max(i - reach, 0)
        try:
            j = free.index(c, lo, min(i + reach + 1, len(b)))
        except ValueError:
            continue
        free[j] = None
        from_a.append(c)
        taken.append(j)
    m = len(from_a)
    if not m:
        return 0.0
    half = sum(c != b[j] for c, j in zip(from_a, sorted(taken)))
    jaro = (m / len(a) + m / len(b) + (m - half / 2) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


_FOUR = T.StructType([T.StructField(n, T.DoubleType()) for n in ("name", "name_raw", "addr", "addr_raw")])


@F.pandas_udf(_FOUR)
def jaro_winkler_four(n1: pd.Series, n2: pd.Series, r1: pd.Series, r2: pd.Series, a1: pd.Series, a2: pd.Series, w1: pd.Series, w2: pd.Series) -> pd.DataFrame:
    """The four comparisons of a pair in one crossing to Python; strings are cut to 128 characters by the caller."""
    each = lambda x, y: [jaro_winkler_of(u or "", v or "") for u, v in zip(x, y)]
    return pd.DataFrame({"name": each(n1, n2), "name_raw": each(r1, r2), "addr": each(a1, a2), "addr_raw": each(w1, w2)})


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
