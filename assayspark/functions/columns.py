"""Small column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside the JVM and
work unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as a number in a text column.  Spark's own cast is laxer: it also
# takes Java suffixes such as "12d" and hexadecimal floats.
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Text to double; anything that is not a number becomes NULL, as does NaN."""
    text = col(c).cast("string")
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def nan_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c: str | Column) -> Column:
    """The value where it is an ordinary number, else NULL (drops NaN and +-inf)."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def activity_label(c: str | Column, cutoff: float, active: str = "active", inactive: str = "inactive") -> Column:
    """``active`` strictly below the cutoff.  NULL and NaN are ``inactive``; Spark
    orders NaN above every number, so the strict comparison already says so."""
    return F.when(col(c) < F.lit(float(cutoff)), F.lit(active)).otherwise(F.lit(inactive))


def split_labels(c: str | Column, sep: str = ",") -> Column:
    return F.split(col(c), "\\Q" + sep + "\\E")


def last_part(c: str | Column, sep: str = "/") -> Column:
    return F.element_at(F.split(col(c), "\\Q" + sep + "\\E"), -1)


def run_name(c: str | Column) -> Column:
    """``.../metrics_<name>.json`` to ``<name>``."""
    return F.regexp_extract(col(c), r"metrics_(.*?)\.json", 1)


def slug(c: str | Column) -> Column:
    """Lower case, with blanks and slashes as underscores."""
    return F.lower(F.translate(col(c), " /", "__"))


def capitalise(c: str | Column) -> Column:
    """First letter upper case, the rest lower case."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def zip_to_map(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def argmax_index(c: str | Column) -> Column:
    """Zero-based position of the first largest element."""
    c = col(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def sigmoid(c: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def predicted(score: str | Column, cut: float = 0.5) -> Column:
    return (col(score) > F.lit(float(cut))).cast("int")


def shift_non_negative(c: str | Column, minimum: Column | None = None) -> Column:
    """Add |minimum| to every element when the minimum is below zero."""
    c = col(c)
    low = F.array_min(c) if minimum is None else minimum
    return F.when(low < 0, F.transform(c, lambda x: x + F.abs(low))).otherwise(c)
