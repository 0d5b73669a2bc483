"""Vector algebra on array<double> columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalize(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def bhattacharyya_similarity(a: Column, b: Column) -> Column:
    """1 less the Bhattacharyya distance of two histograms, between 0 and 1; empty ones have similarity 0."""
    mass = F.sqrt(total(a) * total(b))
    shared = total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    return F.when(mass > 0, clamp01(1 - F.sqrt(F.greatest(F.lit(0.0), 1 - shared / mass)))).otherwise(F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms; 1 if either is constant."""
    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    top = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    bottom = F.sqrt(total(F.transform(a, lambda x: (x - ma) * (x - ma))) * total(F.transform(b, lambda y: (y - mb) * (y - mb))))
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(1.0))


def entropy(hist: Column) -> Column:
    """Shannon entropy in bits of a histogram, which is normalised first; 1e-10 keeps empty bins harmless."""
    mass = total(hist) + F.lit(1e-10)
    return -total(F.transform(hist, lambda x: (x / mass) * F.log2(x / mass + F.lit(1e-10))))
