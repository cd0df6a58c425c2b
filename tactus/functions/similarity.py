"""Similarities of strings as Spark columns."""

from __future__ import annotations

from collections import Counter
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lev_sim(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def bigrams(c: Column) -> Column:
    """The character pairs of a string, in order."""
    size = F.length(c)
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(size < 2, F.array().cast("array<string>")).otherwise(pairs)


@F.pandas_udf(DoubleType())
def _dice(a: pd.Series, b: pd.Series) -> pd.Series:
    """Built-in functions on arrays can count a kind of pair only by a pass over all pairs, quadratic in a line's length."""
    kinds = lambda t: Counter(map(add, t, t[1:]))
    found = [None if x is None or y is None or len(x) + len(y) < 3 else 2.0 * (kinds(x) & kinds(y)).total() / (len(x) + len(y) - 2) for x, y in zip(a, b, strict=True)]
    return pd.Series(found, dtype=object)


def bigram_sim(a: Column, b: Column) -> Column:
    """Dice on multisets of character pairs; equality below two letters; 0 if one is empty."""
    short = (F.length(a) < 2) | (F.length(b) < 2)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(short, F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(_dice(a, b))


def composite(a: Column, b: Column, romaji_a: Column, romaji_b: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    return weights[0] * lev_sim(a, b) + weights[1] * bigram_sim(a, b) + weights[2] * lev_sim(romaji_a, romaji_b)


def recall_sim(line: Column, other: Column) -> Column:
    """Share of the line's distinct character pairs that the other has."""
    own = F.array_distinct(bigrams(line))
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(own, bigrams(other))) / F.size(own), 4))


def token_overlap(a: Column, b: Column) -> Column:
    own = F.array_distinct(F.split(a, ""))
    return F.when(F.length(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, F.split(b, ""))) / F.size(own))
