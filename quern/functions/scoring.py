"""Ranking formulas, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.params import Bm25

SCORE_DIGITS = 6
NOISE_DIGITS = 9


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_saturation(tf: Column, length: Column, avg_length: Column, bm25: Bm25) -> Column:
    k1, b = bm25.k1_column(), bm25.b_column()
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_length))


def smoothed_idf(n_docs: Column, df: Column) -> Column:
    """Inverse document frequency of the document-term matrix."""
    return F.log((1 + n_docs) / (1 + df)) + 1


def collection_weight(tf: Column, n_docs: Column, df: Column) -> Column:
    """tf times log10(N / df): the score of an expansion term."""
    return F.round(tf * F.log10(n_docs / df), SCORE_DIGITS)


def to_digits(value: Column, digits: int) -> Column:
    """Round half up, after dropping binary noise that would decide a tie by summation order."""
    return F.round(F.round(value, NOISE_DIGITS), digits)


def discounted(gain: Column, rank: Column) -> Column:
    return gain / F.log2(rank + 1)
