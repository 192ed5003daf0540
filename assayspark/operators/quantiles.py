"""Exact quantiles and the operators built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayspark.functions.columns import finite
from assayspark.operators.spread import ROWS_PER_BUCKET, attach_by_key, checked_broadcast, running_totals
from assayspark.sources.stages import cut

DIRECT_ROWS = 1_000_000


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(series, value) rows for several numeric columns, so one pass serves all of them."""
    pairs = [F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(*keep, "_p.series", "_p.value")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
    direct_rows: int = DIRECT_ROWS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Linear-interpolated quantiles per group as rows (by..., prob, value).

    ``weight`` counts a row that many times.

    The built-in exact ``percentile`` keeps all distinct values of a group in
    one task.  It is used only when the largest group has at most
    ``direct_rows`` rows.  Larger groups are reduced to distinct values with
    counts, ranked in two levels, and the rows at the wanted ranks picked out.
    """
    by = list(by)
    probs = [float(p) for p in probs]
    w = (F.col(weight) if weight else F.lit(1)).cast("long")
    rows = df.select(*by, finite(value).alias("_v"), w.alias("_w")).where(F.col("_v").isNotNull())
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    prob_array = F.array(*[F.lit(p) for p in probs])
    if largest <= direct_rows:
        found = rows.groupBy(*by).agg(F.percentile("_v", prob_array, F.col("_w")).alias("_q"))
        at = F.explode(F.arrays_zip(prob_array.alias("prob"), F.col("_q").alias("value"))).alias("_r")
        return found.select(*by, at).select(*by, "_r.prob", "_r.value")

    # read by several passes: written once
    distinct = cut(rows.groupBy(*by, "_v").agg(F.sum("_w").alias("_n")))
    ranked = running_totals(
        distinct, ["_v"], {"_upto": F.col("_n")}, by, rows_per_bucket=rows_per_bucket, with_total=True
    )
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    def holds(rank: Column) -> Column:
        return (rank >= first) & (rank <= last)

    def place(p: Column) -> Column:
        return p * (F.col("_upto_total") - 1)

    wanted = F.filter(prob_array, lambda p: holds(F.floor(place(p))) | holds(F.ceil(place(p))))
    hits = ranked.select("*", F.explode(wanted).alias("prob"))
    ends = hits.groupBy(*by, "prob").agg(
        F.max(F.when(holds(F.floor(place(F.col("prob")))), F.col("_v"))).alias("_lo"),
        F.max(F.when(holds(F.ceil(place(F.col("prob")))), F.col("_v"))).alias("_hi"),
        F.max(place(F.col("prob"))).alias("_at"),
    )
    share = F.col("_at") - F.floor("_at")
    return ends.select(*by, "prob", (F.col("_lo") + share * (F.col("_hi") - F.col("_lo"))).alias("value"))


def quantile_columns(quantiles: DataFrame, names: Mapping[float, str], by: Sequence[str] = ()) -> DataFrame:
    """Turn (prob, value) rows into one named column per probability."""
    picks = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(n) for p, n in names.items()]
    return quantiles.groupBy(*by).agg(*picks)


def impute_median(df: DataFrame, c: str, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Infinite and missing values become the median of the ordinary ones."""
    median = exact_quantiles(df, c, [0.5], direct_rows=direct_rows).select("value")
    return df.withColumn(c, F.coalesce(finite(c), median.scalar()))


def trim_band(
    df: DataFrame,
    cols: Sequence[str],
    factors: Mapping[str, float] | None = None,
    low: float = 0.01,
    high: float = 0.99,
    margin: float = 0.10,
) -> DataFrame:
    """Long form (series, value) of the values inside a widened quantile band.

    The band is [q_low - e, q_high + e] with e = margin * (q_high - q_low),
    times the column's factor if it has one.  Each column is cut by itself."""
    values = long_form(df, cols).where(F.col("value").isNotNull())
    found = exact_quantiles(values, "value", [low, high], ["series"])
    # one row per named column
    bands = quantile_columns(found, {low: "lo", high: "hi"}, ["series"]).collect()
    inside = F.lit(False)
    for band in bands:
        e = (band["hi"] - band["lo"]) * margin * (factors or {}).get(band["series"], 1.0)
        inside |= (F.col("series") == band["series"]) & F.col("value").between(band["lo"] - e, band["hi"] + e)
    return values.where(inside)


def histogram(
    df: DataFrame,
    value: str,
    bins: int = 50,
    by: Sequence[str] = (),
    weight: str | None = None,
    density: bool = False,
) -> DataFrame:
    """Equal-width bins from the least to the greatest value; the last bin is closed.

    Rows are (by..., bin, lo, hi, n[, density]) with empty bins included.  A
    single-valued series gets a unit-wide range around the value.  ``weight``
    counts a row that many times.
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    rows = df.select(*by, finite(value).alias("_v"), w.cast("long").alias("_w")).where(F.col("_v").isNotNull())
    ends = rows.groupBy(*by).agg(
        F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_rows")
    )
    flat = F.col("_a") == F.col("_b")
    ends = ends.select(
        *by,
        F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_a"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_b"),
        "_total",
        "_rows",
    )
    if by:
        small = checked_broadcast(ends)
        placed = rows.join(small, by, "inner") if small is not ends else attach_by_key(rows, ends, by, "_rows")
        low, high = F.col("_a"), F.col("_b")
    else:
        small = ends.sparkSession.createDataFrame(ends.collect(), ends.schema)
        placed = rows
        low, high = small.select("_a").scalar(), small.select("_b").scalar()
    number = F.least(F.floor((F.col("_v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*by, number.alias("bin")).agg(F.sum("_w").alias("n"))
    width = (F.col("_b") - F.col("_a")) / bins
    # the empty frame of bins; an empty input has no range and no bins
    frame = small.where(F.col("_total").isNotNull()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = frame.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_a") + F.col("bin") * width).alias("lo"),
        (F.col("_a") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        (F.coalesce(F.col("n"), F.lit(0)) / (F.col("_total") * width)).alias("density"),
    )
    return out if density else out.drop("density")


def density_histogram(series: DataFrame, bins: int = 30) -> DataFrame:
    """Density per series of a long table (series, value), each over its own range."""
    return histogram(series, "value", bins, ["series"], density=True)


def box_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Box-plot numbers per group: quartiles, 1.5-IQR whiskers, outlier count."""
    by = list(by)
    rows = df.select(*by, finite(value).alias("_v")).where(F.col("_v").isNotNull())
    quartiles = quantile_columns(
        exact_quantiles(rows, "_v", [0.25, 0.5, 0.75], by), {0.25: "q1", 0.5: "median", 0.75: "q3"}, by
    )
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("_v").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    small = checked_broadcast(quartiles)
    if small is not quartiles:
        placed = rows.join(small, by, "inner")
    else:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
        placed = attach_by_key(rows, quartiles.join(sizes, by), by, "_rows")
    return (
        placed.groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
            F.sum((~inside).cast("long")).alias("outliers"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def violin_summary(
    df: DataFrame, value: str, by: Sequence[str], bins: int = 30, weight: str | None = None
) -> DataFrame:
    """Quartiles with the binned density, one row per group and bin."""
    by = list(by)
    quartiles = quantile_columns(
        exact_quantiles(df, value, [0.25, 0.5, 0.75], by, weight), {0.25: "q1", 0.5: "median", 0.75: "q3"}, by
    )
    return histogram(df, value, bins, by, weight, density=True).join(checked_broadcast(quartiles), by, "inner")


def minmax_rescale(df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Rescale a column to [0, 1] by its global range; NULL when the range is empty."""
    ends = df.agg(F.min(finite(c)).alias("lo"), F.max(finite(c)).alias("hi"))
    ends = ends.sparkSession.createDataFrame(ends.collect(), ends.schema)
    low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    scaled = F.when(high > low, (F.col(c) - low) / (high - low))
    return df.withColumn(name or c, scaled)
