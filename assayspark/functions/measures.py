"""Similarity and distance measures on bit sets and on real vectors.

A bit set is a sorted ``array<int>`` of set positions in ``[0, n_bits)``.  Every
set measure follows from three counts: |A|, |B| and |A and B|.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SET_MEASURES = ("tanimoto", "dice", "cosine", "hamming", "manhattan")


def from_counts(measure: str, a: Column, b: Column, common: Column, n_bits: int = 2048) -> Column:
    """One measure from |A|, |B| and the number of shared bits.

    Two empty sets are equal, so Tanimoto and Dice give 1.0; the cosine of a
    zero vector is undefined and gives NULL.
    """
    if measure == "tanimoto":
        union = a + b - common
        return F.when(union == 0, F.lit(1.0)).otherwise(common / union)
    if measure == "dice":
        total = a + b
        return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * common / total)
    if measure == "cosine":
        product = a.cast("double") * b
        return F.when(product > 0, common / F.sqrt(product))
    differing = a + b - F.lit(2) * common
    if measure == "hamming":
        return differing / F.lit(float(n_bits))
    if measure == "manhattan":
        return differing.cast("double")
    raise ValueError(f"unknown measure {measure!r}")


def similarity(a: Column, b: Column, measure: str = "tanimoto", n_bits: int = 2048) -> Column:
    """A set measure on two bit-set columns."""
    return from_counts(measure, F.size(a), F.size(b), F.size(F.array_intersect(a, b)), n_bits)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def vector_measure(a: Column, b: Column, measure: str = "cosine") -> Column:
    """Cosine, Hamming or Manhattan on two ``array<double>`` columns."""
    if measure == "cosine":
        dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
        norms = F.sqrt(_sum(F.transform(a, lambda x: x * x)) * _sum(F.transform(b, lambda x: x * x)))
        return F.when(norms > 0, dot / norms)
    if measure == "hamming":
        return _sum(F.zip_with(a, b, lambda x, y: (x != y).cast("double"))) / F.size(a)
    if measure == "manhattan":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    raise ValueError(f"unknown measure {measure!r}")
