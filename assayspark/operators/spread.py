"""Joins and ranks that stay balanced when one key holds much of the data.

Three rules are kept here and used by the other operators:

* a side is broadcast only after its row count was checked (`checked_broadcast`);
* a join of rows to per-key values splits the keys known to be hot over many
  tasks (`attach_by_key`);
* a rank or running total inside a group is computed in as many levels as the
  rows need, so that neither a large group nor an ungrouped table is sorted by
  one task (`running_totals`).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayspark.sources.stages import cut

BROADCAST_ROWS = 100_000
ROWS_PER_TASK = 1_000_000
ROWS_PER_BUCKET = 250_000
#: Ranges that one level cuts; more rows take more levels.
LEVEL_BUCKETS = 10_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast table when it has at most ``limit`` rows, else ``df``.

    The rows that were fetched for the check become the broadcast table, so the
    query behind ``df`` runs once in the small case.  Use it for narrow rows
    (keys and a few numbers)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def attach_by_key(
    left: DataFrame,
    per_key: DataFrame,
    key: str | Sequence[str],
    rows: str,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    left_rows: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``per_key`` (one row per ``key``) without a hot task.

    ``rows`` names the column of ``per_key`` with the number of left rows of the
    key.  A key with more than ``rows_per_task`` rows is cut into
    ``ceil(rows / rows_per_task)`` salted pieces on both sides.  The hot keys go to the tasks as
    a 64-bit digest and a number of pieces, whatever the keys are, and there is at most one per ``rows_per_task``
    rows of the table; keys that share a digest are cut alike.  A known ``left_rows`` within one
    task's share saves the search.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if left_rows is not None and left_rows <= rows_per_task:
        return left.join(per_key, keys, how)
    digest = F.xxhash64(*[F.col(k) for k in keys])
    hot = per_key.where(F.col(rows) > rows_per_task).groupBy(digest.alias("_hot"))
    hot = cut(hot.agg(F.ceil(F.max(rows) / F.lit(rows_per_task)).cast("int").alias("_pieces")))
    if hot.isEmpty():
        return left.join(per_key, keys, how)
    hot = F.broadcast(hot)
    # A row's piece depends on its values only, so a task that runs again deals alike.
    others = [F.col(c) for c in left.columns if c not in keys] or [F.spark_partition_id()]
    pieces = F.coalesce("_pieces", F.lit(1))
    salted_left = (
        left.withColumn("_hot", digest)
        .join(hot, "_hot", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*others), pieces).cast("int"))
        .drop("_hot", "_pieces")
    )
    salted_right = per_key.withColumn("_hot", digest).join(hot, "_hot", "left")
    salted_right = salted_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_hot", "_pieces")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def bucket_by_range(
    df: DataFrame, order: str, name: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, int]:
    """Add ``name``: the number of the value range ``order`` falls into.

    The bounds come from a quantile sketch and are only a way to cut the work:
    any bounds give the same ranks.  They are fixed before the query runs, so a
    task that is run again after a lost executor sees the same buckets.  The driver
    holds the bounds of LEVEL_BUCKETS ranges; where the rows need more, each of these
    is cut again by bounds of its own, which stay a table.
    """
    n = df.count()
    buckets = max(1, math.ceil(n / rows_per_bucket))
    if buckets == 1:
        return df.withColumn(name, F.lit(0)), 1
    first = min(buckets, LEVEL_BUCKETS)
    at = F.col(order).cast("double")
    as_double = df.select(at.alias("_cut_at"))
    probs = [i / first for i in range(1, first)]
    bounds = sorted(set(as_double.approxQuantile("_cut_at", probs, min(max(0.25 / first, 1e-4), 0.01))))
    splits = [-math.inf, *bounds, math.inf]
    cutter = Bucketizer(splits=splits, inputCol="_cut_at", outputCol=name, handleInvalid="keep")
    out = cutter.transform(df.withColumn("_cut_at", at))
    out = out.withColumn(name, F.col(name).cast("long"))
    if buckets == first:
        return out.drop("_cut_at"), len(splits) - 1
    parts = min(math.ceil(buckets / first), LEVEL_BUCKETS)
    inner = F.percentile_approx("_cut_at", [i / parts for i in range(1, parts)], 10 * parts)
    finer = cut(out.groupBy(F.col(name).alias("_outer")).agg(inner.alias("_inner")))  # at most LEVEL_BUCKETS + 1 rows
    out = out.join(F.broadcast(finer), F.col(name) == F.col("_outer"), "left")
    below = F.size(F.filter(F.coalesce("_inner", F.array().cast("array<double>")), lambda b: b < F.col("_cut_at")))
    return out.withColumn(name, F.col(name) * parts + below).drop("_cut_at", "_outer", "_inner"), (len(splits) - 1) * parts


def bucket_by_hash_prefix(
    df: DataFrame, order: str, name: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, int]:
    """As `bucket_by_range` for a hexadecimal digest: its leading digits are already even ranges."""
    n = df.count()
    digits = min(15, max(0, math.ceil(math.log(max(n / rows_per_bucket, 1.0), 16) - 1e-9)))
    if digits == 0:
        return df.withColumn(name, F.lit(0)), 1
    return df.withColumn(name, F.conv(F.substring(F.col(order), 1, digits), 16, 10).cast("long")), 16**digits


def number_rows(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with gapless numbers from 0 along ``order``, which may be of any type that sorts.

    The rows are written in ranges of ``order``; a range is numbered by its own task and
    shifted by the rows of the ranges before it."""
    ranged = cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))  # one row per range
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    out = ranged.withColumn(name, place).join(F.broadcast(shifts), "_range")
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def _offsets(totals: DataFrame, group: Sequence[str], names: Sequence[str], buckets: int, with_total: bool) -> DataFrame:
    """What stands before each bucket of its group, and the group's totals; keys are renamed to ``_k_<key>``.

    One sort per group adds up at most LEVEL_BUCKETS buckets; more of them are first put together by their number."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    keys = [F.col(k).alias(f"_k_{k}") for k in (*group, "_bucket")]
    if buckets <= LEVEL_BUCKETS:
        before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *keys,
            *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in names],
            *([F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in names] if with_total else []),
        )
    totals = cut(totals.withColumn("_up", F.floor(F.col("_bucket") / F.lit(LEVEL_BUCKETS))))
    upper = totals.groupBy(*group, F.col("_up").alias("_bucket")).agg(*[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in names])
    upper = _offsets(upper, group, names, math.ceil(buckets / LEVEL_BUCKETS), with_total)
    upper = upper.withColumnsRenamed({f"_before_{n}": f"_above_{n}" for n in names})
    near = Window.partitionBy(*group, "_up").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    local = totals.withColumns({f"_near_{n}": F.coalesce(F.sum(f"_sum_{n}").over(near), F.lit(0)) for n in names})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in group] + [F.col("_up") == F.col("_k__bucket")]
    joined = local.join(upper, reduce(lambda a, b: a & b, same))
    return joined.select(
        *keys,
        *[(F.col(f"_near_{n}") + F.col(f"_above_{n}")).alias(f"_before_{n}") for n in names],
        *([f"{n}_total" for n in names] if with_total else []),
    )


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    group: Sequence[str] = (),
    bucket: str = "range",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    with_total: bool = False,
) -> DataFrame:
    """Inclusive running sums along ``order`` inside each ``group``, in levels.

    Level one sorts and sums inside (group, bucket); the totals per bucket, a
    table of at most groups x buckets rows, are added up by one sort per group, or by a
    level of their own where there are more than LEVEL_BUCKETS of them.  ``order`` must
    be a total order inside the group; its first column is cut into buckets
    (``bucket='range'`` for numbers, ``'digest'`` for hex digests).  With
    ``with_total`` each sum also gets ``<name>_total`` for its group.
    """
    by = bucket_by_range if bucket == "range" else bucket_by_hash_prefix
    group = list(group)
    df = df.withColumns({f"_add_{n}": c for n, c in sums.items()})
    df, buckets = by(df, order[0], "_bucket", rows_per_bucket)
    within = (
        Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.withColumns({n: F.sum(f"_add_{n}").over(within) for n in sums})
    extra = [f"{n}_total" for n in sums] if with_total else []
    drop = [f"_add_{n}" for n in sums] + ["_bucket"]
    if buckets == 1:
        # at most one bucket of rows in all: the group's total is in the same sort
        if with_total:
            group_rows = Window.partitionBy(*group, "_bucket")
            local = local.withColumns({f"{n}_total": F.sum(f"_add_{n}").over(group_rows) for n in sums})
        return local.drop(*drop)

    keys = [*group, "_bucket"]
    totals = df.groupBy(*keys).agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in sums])
    offsets = _offsets(totals, group, list(sums), buckets, with_total)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    joined = local.join(offsets, on, "inner")
    joined = joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums})
    keep = [c for c in df.columns if c not in drop] + list(sums) + extra
    return joined.select(*keep)
