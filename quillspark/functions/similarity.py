"""Similarities of strings and sets."""

from __future__ import annotations

import math
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 0 if one is blank."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def ratio(a: str, b: str) -> float:
    """Share of matching blocks: twice the matched length by both lengths."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of the longer of its length, tried where blocks match."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 1.0
    best = 0.0
    for s in sorted({max(0, m.b - m.a) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()}):
        part = SequenceMatcher(None, a, b[s : s + len(a)], autojunk=False)
        if part.quick_ratio() > best:  # a bound: what the letters alone allow
            best = max(best, part.ratio())
    return best


def _lift(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        for x, y in zip(a, b):
            if (x, y) not in known:
                known[x, y] = f(x or "", y or "")
        return pd.Series([known[x, y] for x, y in zip(a, b)], dtype="float64")

    return run


def fuzzy(a: Column, b: Column) -> Column:
    return _lift(ratio)(a, b)


def fuzzy_partial(a: Column, b: Column) -> Column:
    return _lift(partial)(a, b)


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")), " ")


def fuzzy_sorted(a: Column, b: Column) -> Column:
    return _lift(ratio)(sorted_words(a), sorted_words(b))


def _pieces(word: str) -> tuple[str, ...]:
    w = f" {word} "
    return tuple(w[i : i + n] for n in (2, 3, 4) for i in range(max(len(w) - n + 1, 1)))


_known_pieces = lru_cache(20_000)(_pieces)
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")  # what \s is to Spark


def pieces(text: str) -> Counter[str]:
    """How often each piece of 2 to 4 characters stands in the words of a text; as matching.char_terms cuts them."""
    return Counter(chain.from_iterable([_known_pieces(w) if len(w) < 30 else _pieces(w) for w in _SPACE.split(text) if w]))


def cosines(pairs: list[tuple[str, str]], min_df: int = 1, fitted: tuple[int, dict[str, int]] | None = None) -> list[float]:
    """Cosine of each two texts by the TF-IDF of their pieces, fitted on the distinct texts of all pairs; 0 where one is empty or nothing is shared.

    `fitted`: the number of texts and in how many each piece stands (1 is left out), if they are more than those of the pairs.
    """
    counts = {t: pieces(t) for t in {t for pair in pairs for t in pair} if t}
    total = len(counts) if fitted is None else fitted[0]
    if fitted is not None:
        shared = fitted[1]
    elif total == 2:  # as where a pair is its own scope
        x, y = counts.values()
        shared = dict.fromkeys(x.keys() & y.keys(), 2)
    else:
        shared = {x: k for x, k in Counter(chain.from_iterable(counts.values())).items() if k > 1}
    square = {k: (math.log((1 + total) / (1 + k)) + 1) ** 2 if k >= min_df else 0.0 for k in {1, *shared.values()}}  # of the idf
    own = square[1]
    norms = {t: math.sqrt(own * sum([n * n for n in tf.values()]) + math.fsum([tf[x] ** 2 * (square[shared[x]] - own) for x in tf.keys() & shared.keys()])) for t, tf in counts.items()}
    known: dict[tuple[str, str], float] = {}
    for a, b in pairs:
        if (a, b) not in known:
            known[a, b] = 0.0
            if a and b and norms[a] and norms[b]:
                x, y = counts[a], counts[b]
                known[a, b] = 1.0 if a == b else math.fsum([x[k] * y[k] * square[shared[k]] for k in x.keys() & y.keys()]) / (norms[a] * norms[b])
    return [known[pair] for pair in pairs]
