"""Ranking formulas as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def _num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def idf_bm25(n: Column | float, df: Column | float) -> Column:
    """0 for an empty collection or an unknown term."""
    n, df = _num(n), _num(df)
    value = F.greatest(F.log(1 + (n - df + 0.5) / (df + 0.5)), F.lit(1e-9))
    return F.when((n == 0) | (df == 0), F.lit(0.0)).otherwise(value)


def idf_tfidf(n: Column | float, df: Column | float) -> Column:
    """0 for an empty collection or an unknown term."""
    n, df = _num(n), _num(df)
    return F.when((n == 0) | (df == 0), F.lit(0.0)).otherwise(F.log(n / F.nullif(df, F.lit(0))) + 1)


def score_tfidf(tf: Column | float, idf: Column | float) -> Column:
    tf = _num(tf)
    return F.when(tf > 0, (1 + F.log(tf)) * _num(idf)).otherwise(F.lit(0.0))


def score_bm25(tf: Column | float, idf: Column | float, length: Column | float, avgdl: Column | float, k1: float = K1, b: float = B) -> Column:
    """An average length of 0 or less counts as 1; a denominator of 0 or less scores 0."""
    tf, avgdl = _num(tf), _num(avgdl)
    average = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    below = tf + k1 * (1 - b + b * _num(length) / average)
    return F.when((tf > 0) & (below > 0), _num(idf) * tf * (k1 + 1) / F.nullif(below, F.lit(0))).otherwise(F.lit(0.0))
