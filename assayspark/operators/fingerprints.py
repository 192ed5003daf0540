"""Fingerprints and token profiles as DataFrame operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from assayspark.functions.text import fingerprint_expr, pattern_count, weighted_tokens
from assayspark.operators.spread import attach_by_key


def fingerprint(
    df: DataFrame,
    c: str,
    k: int = 3,
    n_bits: int = 2048,
    unit: str = "word",
    method: str = "md5",
    name: str = "bits",
) -> DataFrame:
    """Add the sorted set-bit positions of the hashed k-shingles of the whole text.

    Row-local: no shuffle, no Python.  2048 bits suit short strings; long texts
    need a wide space (2**30) to stay apart."""
    return df.withColumn(name, fingerprint_expr(c, k, n_bits, unit, method))


def _profile(keys: DataFrame, c: str, classes: Mapping[str, str], weights: Mapping[str, float] | None) -> DataFrame:
    cols = {"n_chars": F.char_length(F.col(c)).cast("int")}
    cols |= {name: pattern_count(c, pattern) for name, pattern in classes.items()}
    if weights:
        cols["mass"] = weighted_tokens(c, dict(weights))
    return keys.withColumns(cols)


def token_profile(
    df: DataFrame,
    c: str,
    classes: Mapping[str, str],
    weights: Mapping[str, float] | None = None,
    valid: str = r".",
    on_invalid: str = "drop",
) -> DataFrame:
    """Descriptors of each *distinct* string: length, counts per pattern, weighted mass.

    A string without a match of ``valid`` is left out (``on_invalid='drop'``) or
    kept with NULL descriptors (``'null'``)."""
    keys = df.select(c).where(F.col(c).isNotNull()).distinct()
    profile = _profile(keys, c, classes, weights)
    good = F.col(c).rlike(valid)
    if on_invalid == "drop":
        return profile.where(good)
    if on_invalid == "null":
        return profile.select(c, *[F.when(good, F.col(x)).alias(x) for x in profile.columns if x != c])
    raise ValueError("on_invalid must be 'drop' or 'null'")


def attach_features(features: DataFrame, meta: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Features left-joined to the distinct (key, cols...) rows; a key in several groups fans out.

    The distinct step keeps at most one row per key and group on the right, so
    the join never sees the multiplicity of the raw rows."""
    return features.join(meta.select(key, *cols).distinct(), key, "left")


def describe_rows(
    df: DataFrame, c: str, classes: Mapping[str, str], weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Every row with its descriptors, computed once per distinct string."""
    counted = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_rows"))
    return attach_by_key(df, _profile(counted, c, classes, weights), c, "_rows", "left").drop("_rows")
