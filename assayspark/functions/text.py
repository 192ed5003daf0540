"""Text expressions: parts, shingles, hashed bit fingerprints, token profiles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assayspark.functions.columns import col


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    An expression used inside a lambda is otherwise evaluated again for every
    element, which turns work linear in the text length into quadratic work.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(c: str | Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: w != "")


def strip_parts_expr(c: str | Column, removable: Column, sep: str = ".") -> Column:
    """Drop the parts of a ``sep``-joined string that occur in ``removable``.

    Repeated parts are kept, and so is the whole input when nothing else would
    remain."""
    c = col(c)
    kept = F.filter(F.split(c, "\\Q" + sep + "\\E"), lambda part: ~F.array_contains(removable, part))
    return bind(kept, lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, sep)).otherwise(c))


def shingles(c: str | Column, k: int = 3, unit: str = "word") -> Column:
    """Runs of ``k`` words or characters; a shorter text is one shingle, an empty one none."""
    if unit == "word":
        units, glue = words(c), " "
    elif unit == "char":
        units, glue = F.filter(F.split(F.lower(col(c)), ""), lambda ch: ch != ""), ""
    else:
        raise ValueError("unit must be 'word' or 'char'")

    def cut(u: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(u) - F.lit(k), F.lit(0)))
        # positions past the end are NULL and left out, so a short text is one run
        runs = F.transform(starts, lambda i: F.concat_ws(glue, *[F.get(u, i + j) for j in range(k)]))
        return F.when(F.size(u) > 0, runs).otherwise(F.array().cast("array<string>"))

    return bind(units, cut)


def hash_number(c: Column) -> Column:
    """The first 32 bits of the md5 of a string; its remainder by a width is `hash_bit`."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def hash_bit(c: Column, n_bits: int, method: str = "md5") -> Column:
    """Bit position of a string.  ``md5`` gives the same position in any engine;
    ``xxhash64`` is the faster choice when only Spark reads the result."""
    if method == "md5":
        return F.pmod(hash_number(c), F.lit(n_bits)).cast("int")
    if method == "xxhash64":
        return F.pmod(F.xxhash64(c), F.lit(n_bits)).cast("int")
    raise ValueError("method must be 'md5' or 'xxhash64'")


def fingerprint_expr(
    c: str | Column, k: int = 3, n_bits: int = 2048, unit: str = "word", method: str = "md5"
) -> Column:
    """Sorted positions of the bits set by the shingles of a text; NULL gives no bits."""
    if not 0 < n_bits <= 2**31 - 1:
        raise ValueError("n_bits must fit an int")
    bits = F.transform(shingles(c, k, unit), lambda s: hash_bit(s, n_bits, method))
    return F.coalesce(F.sort_array(F.array_distinct(bits)), F.array().cast("array<int>"))


def pattern_count(c: str | Column, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("int")


def weighted_tokens(c: str | Column, weights: dict[str, float]) -> Column:
    """Sum of per-token weights; longer tokens win over their own prefixes.

    ``weights`` is a dictionary in the program, so its size does not grow with
    the data."""
    tokens = sorted(weights, key=lambda t: (-len(t), t))
    pattern = "(" + "|".join("\\Q" + t + "\\E" for t in tokens) + ")"
    table = F.create_map(*[x for t in tokens for x in (F.lit(t), F.lit(float(weights[t])))])
    found = F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1))
    return F.aggregate(found, F.lit(0.0), lambda acc, t: acc + F.element_at(table, t))
