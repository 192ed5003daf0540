"""Class counts, cross-tabs and balance statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

LABELS = ("active", "inactive")


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows per value; missing values are not counted."""
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, group: str, label: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows per group (down) and label (across), zero-filled; a NULL group is dropped."""
    cells = [F.count(F.when(F.col(label) == F.lit(v), 1)).alias(v) for v in labels]
    return df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group).agg(*cells)


def _statistics(counts: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """Ratio, entropy and variation from a (by..., label, n) table of present classes."""
    total = counts.groupBy(*by).agg(
        F.max(F.when(F.col(label) == LABELS[0], F.col("n"))).alias("_a"),
        F.max(F.when(F.col(label) == LABELS[1], F.col("n"))).alias("_i"),
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * F.log2("n")).alias("_nlog"),
        F.stddev_pop("n").alias("_sd"),
        F.avg("n").alias("_mean"),
    )
    # -sum(p log2 p) with p = n/N is log2 N - sum(n log2 n)/N; 0 for one class
    return total.select(
        *by,
        F.when(F.col("_a").isNotNull() & F.col("_i").isNotNull(), F.col("_a") / F.col("_i"))
        .otherwise(F.lit(float("inf")))
        .alias("Class Ratio"),
        (F.log2("_n") - F.col("_nlog") / F.col("_n")).alias("Entropy of Distribution"),
        (F.col("_sd") / F.col("_mean")).alias("Coefficient of Variation"),
    )


METRICS = ("Class Ratio", "Entropy of Distribution", "Coefficient of Variation")


def balance_metrics(df: DataFrame, label: str = "label") -> DataFrame:
    """The three balance statistics as (Metric, Value) rows.

    The ratio is active/inactive, infinite when either is absent; entropy is
    base 2; the variation uses the population standard deviation."""
    wide = _statistics(value_counts(df, label), label, [])
    return wide.unpivot([], list(METRICS), "Metric", "Value")


def class_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    return _statistics(value_counts(df, label), label, []).select(F.col("Class Ratio").alias("class_ratio"))


def class_entropy(df: DataFrame, label: str = "label") -> DataFrame:
    return _statistics(value_counts(df, label), label, []).select(
        F.col("Entropy of Distribution").alias("class_entropy")
    )


def class_cv(df: DataFrame, label: str = "label") -> DataFrame:
    return _statistics(value_counts(df, label), label, []).select(F.col("Coefficient of Variation").alias("class_cv"))


def label_counts(df: DataFrame, value: str, group: str, cutoffs: Mapping[str, float]) -> DataFrame:
    """Rows (threshold, group, label, n) for several cutoffs in one pass over the data.

    The pass counts the actives of every cutoff per group; only the small
    result is unfolded into rows.  Absent classes give no row."""
    names = list(cutoffs)
    below = [F.count(F.when(F.col(value) < F.lit(float(cutoffs[t])), 1)).alias(f"_c{i}") for i, t in enumerate(names)]
    per_group = df.groupBy(group).agg(F.count(F.lit(1)).alias("_all"), *below)
    cells = []
    for i, t in enumerate(names):
        hit = F.col(f"_c{i}")
        for label, n in ((LABELS[0], hit), (LABELS[1], F.col("_all") - hit)):
            cells.append(F.struct(F.lit(t).alias("threshold"), F.lit(label).alias("label"), n.alias("n")))
    return (
        per_group.select(group, F.explode(F.array(*cells)).alias("_c"))
        .select("_c.threshold", group, "_c.label", "_c.n")
        .where(F.col("n") > 0)
    )


def balance_report(df: DataFrame, value: str, group: str, cutoffs: Mapping[str, float]) -> DataFrame:
    """(threshold, Metric, Value) for several cutoffs; filter the groups first."""
    counts = label_counts(df, value, group, cutoffs).groupBy("threshold", "label").agg(F.sum("n").alias("n"))
    return _statistics(counts, "label", ["threshold"]).unpivot(["threshold"], list(METRICS), "Metric", "Value")
