"""BM25 settings and expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.errors import InvalidInput


@dataclass(frozen=True)
class Bm25Config:
    """k1 must be finite and positive, b finite and in [0, 1]."""

    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        if not (math.isfinite(self.k1) and self.k1 > 0):
            raise InvalidInput("k1 must be finite and positive")
        if not (math.isfinite(self.b) and 0 <= self.b <= 1):
            raise InvalidInput("b must be finite and between 0 and 1")


def accepted(k1: Column, b: Column) -> Column:
    """The same test on columns; null settings are not accepted."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(finite(k1) & (k1 > 0) & finite(b) & b.between(0, 1), F.lit(False))


def idf(n: Column, df: Column) -> Column:
    """Rarity of a term that ``df`` of ``n`` records hold; never negative."""
    return F.log(n.cast("double") + F.lit(1.0)) - F.log(df.cast("double") + F.lit(0.5))


def contribution(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: Column, b: Column) -> Column:
    """One term's part of a record's score.

    The two forms are equal in exact arithmetic; each stays finite on its side of
    k1 = 1, from the smallest positive number to the largest.
    """
    one = F.lit(1.0)
    tf = tf.cast("double")
    length = (one - b) + b * (dl.cast("double") / avgdl)
    small = idf * (tf * (one + k1)) / (tf + k1 * length)
    inverse = one / k1
    large = idf * (tf * (one + inverse)) / (tf * inverse + length)
    return F.when(k1 <= one, small).otherwise(large)
