"""Similarity scores of names, 0 to 100; the join takes any of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance / longer length), JVM-side."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(100.0 * (longest - F.levenshtein(a, b)) / longest)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit vector of one string against the letters of the other."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    free = every = (1 << len(a)) - 1
    for c in b:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & every
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / both lengths)."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a part of the longer one that is as long, or cut short by its ends."""
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    ways = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
    return max(ratio(x, y[max(at, 0) : at + len(x)]) for x, y in ways for at in range(1 - len(x), len(y)))


def words_apart(a: str, b: str) -> tuple[str, str, str]:
    """(shared words, words of a alone, words of b alone), each sorted and joined."""
    one, two = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(x)) for x in (one & two, one - two, two - one))


def token_ratio(a: str, b: str) -> float:
    """Best of the ratio of sorted words and those of shared words with and without the rest."""
    shared, left, right = words_apart(a, b)
    if not (shared or left) or not (shared or right):
        return 0.0
    if shared and not (left and right):
        return 100.0
    best = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if not shared:
        return max(best, ratio(left, right))
    return max(best, ratio(shared, f"{shared} {left}"), ratio(shared, f"{shared} {right}"), ratio(f"{shared} {left}", f"{shared} {right}"))


def partial_token_ratio(a: str, b: str) -> float:
    """Best partial ratio of sorted words, and of the words that the names do not share; 100 if they share one."""
    shared, left, right = words_apart(a, b)
    if shared:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(left, right))


def composite(a: str, b: str) -> float:
    """Weighted ratio: the best of ratio and word ratios at 95 %; where lengths differ by half or more, of partial ones at 90 % (60 % beyond eight times)."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if times <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


@F.pandas_udf(T.DoubleType())
def composite_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([composite(x or "", y or "") for x, y in zip(a, b)])
