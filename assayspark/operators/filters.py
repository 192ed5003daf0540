"""Row filters, schema checks and clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayspark.functions.columns import activity_label, col
from assayspark.functions.text import strip_parts_expr
from assayspark.operators.spread import attach_by_key

INLINE_VALUES = 1_000


def drop_nulls(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    """Drop rows with a missing value (NULL or NaN) in any of ``cols``, or in any column."""
    return df.na.drop(how="any", subset=[cols] if isinstance(cols, str) else cols)


def split_by_cutoff(df: DataFrame, value: str, cutoff: float = 10_000.0) -> tuple[DataFrame, DataFrame]:
    """(value <= cutoff, value > cutoff); a missing value is in neither.

    Spark orders NaN above every number, so NaN is excluded by name."""
    v = F.col(value)
    return df.where(v <= F.lit(cutoff)), df.where((v > F.lit(cutoff)) & ~F.isnan(v.cast("double")))


def keep_groups(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Rows whose group is in the list; a NULL group is dropped."""
    if len(values) <= INLINE_VALUES:
        return df.where(F.col(group).isin(list(values)))
    listed = df.sparkSession.createDataFrame([(v,) for v in set(values)], [group])
    return df.join(listed, group, "left_semi")


def drop_groups(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Rows whose group is not in the list; a NULL group is kept."""
    if len(values) <= INLINE_VALUES:
        return df.where(F.coalesce(~F.col(group).isin(list(values)), F.lit(True)))
    listed = df.sparkSession.createDataFrame([(v,) for v in set(values)], [group])
    return df.join(listed, group, "left_anti")


def label_activity(df: DataFrame, value: str, cutoff: float, name: str = "label") -> DataFrame:
    return df.withColumn(name, activity_label(value, cutoff))


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def require_columns(df: DataFrame, spec: Mapping[str, T.DataType]) -> DataFrame:
    """``df`` itself when every named column is there with its type, else an error."""
    for name, kind in spec.items():
        if name not in df.columns:
            raise ValueError(f"column {name!r} is required")
        if df.schema[name].dataType != kind:
            raise ValueError(f"column {name!r} must be {kind.simpleString()}, is {df.schema[name].dataType.simpleString()}")
    return df


def having_min_size(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the groups with at least ``n`` rows.

    Counting combines before the shuffle, and the join back splits large groups."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    return attach_by_key(df, sizes.where(F.col("_size") >= n), key, "_size").select(*df.columns)


def with_computed(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """Append computed columns to the same rows; nothing is matched by position."""
    return df.withColumns(dict(cols))


def strip_parts(
    df: DataFrame, c: str, salts: DataFrame, sep: str = ".", flag: str = "contains_salt", inline: int = INLINE_VALUES
) -> DataFrame:
    """Remove the salt parts of a ``sep``-joined string and flag the changed rows.

    ``salts`` is a one-column table.  Up to ``inline`` entries are compared in
    place; a longer table is joined to the parts of the distinct strings."""
    entries = salts.select(F.col(salts.columns[0]).alias("_part")).where(F.col("_part").isNotNull()).distinct()
    listed = entries.limit(inline + 1).collect()
    if len(listed) <= inline:
        removable = F.array(*[F.lit(r["_part"]) for r in listed]).cast("array<string>")
        return (
            df.withColumn("_stripped", strip_parts_expr(c, removable, sep))
            .withColumn(flag, ~F.col("_stripped").eqNullSafe(F.col(c)))
            .withColumn(c, F.col("_stripped"))
            .drop("_stripped")
        )
    keys = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_rows"))
    parts = keys.select(c, F.posexplode(F.split(F.col(c), "\\Q" + sep + "\\E")).alias("_pos", "_part"))
    kept = parts.join(entries, "_part", "left_anti")
    joined = kept.groupBy(c).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_part"))), lambda s: s["_part"]), sep).alias(
            "_kept"
        )
    )
    clean = keys.join(joined, c, "left")
    out = attach_by_key(df, clean, c, "_rows", "left").withColumn("_stripped", F.coalesce(F.col("_kept"), F.col(c)))
    return out.select(
        *[F.col("_stripped").alias(c) if x == c else F.col(x) for x in df.columns],
        (~F.col("_stripped").eqNullSafe(F.col(c))).alias(flag),
    )


def deduplicate(df: DataFrame, key: str, value: str, tie: str, target: str, targets: str = "targets") -> DataFrame:
    """Per key the row with the lowest value (then lowest ``tie``), with all its targets.

    Both halves are aggregations that combine before the shuffle, so a key with
    a large share of the rows costs no more than any other.  A missing value
    loses to any number."""
    rest = [c for c in df.columns if c != key]
    missing = F.coalesce(F.col(value).isNull() | F.isnan(F.col(value).cast("double")), F.lit(True))
    best = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(missing.cast("int"), F.col(value), F.col(tie))).alias("_best")
    )
    # distinct (key, target) first: the list is as long as the target vocabulary, not the group
    lists = (
        df.where(F.col(target).isNotNull())
        .select(key, F.col(target).alias("_t"))
        .distinct()
        .groupBy(key)
        .agg(F.sort_array(F.collect_list("_t")).alias(targets))
    )
    return (
        best.join(lists, key, "left")
        .select(key, *[F.col(f"_best.{c}").alias(c) for c in rest], targets)
        .withColumn(targets, F.coalesce(F.col(targets), F.array().cast(T.ArrayType(df.schema[target].dataType))))
    )


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def union_labelled(frames: Mapping[str, DataFrame], name: str = "series") -> DataFrame:
    """Stack frames with the same columns, each marked with its name."""
    out = None
    for label, frame in frames.items():
        part = frame.withColumn(name, F.lit(label))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no frames")
    return out


def matches_any(c: str | Column, value) -> Column:
    """``c IS NULL OR c = value``."""
    return col(c).isNull() | (col(c) == F.lit(value))
