"""Row positions, blocks, splits and folds, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayspark.operators.spread import ROWS_PER_BUCKET, running_totals


def with_position(df: DataFrame, order: str, name: str = "position", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Zero-based position of each row along a unique numeric ``order``."""
    out = running_totals(df, [order], {name: F.lit(1)}, rows_per_bucket=rows_per_bucket)
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def with_block_id(
    df: DataFrame, order: str, block_size: int = 1024, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Blocks of ``block_size`` consecutive rows: ``position`` and ``block_id``."""
    out = with_position(df, order, "position", rows_per_bucket)
    return out.withColumn("block_id", F.floor(F.col("position") / F.lit(block_size)).cast("long"))


def split_digest(key: Sequence[str | Column] | str, seed: int = 42) -> Column:
    """Digest that orders rows for splits; it depends on the key and seed only."""
    key = [key] if isinstance(key, str) else list(key)
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _ranked(df: DataFrame, label: str, key: str, seed: int, rows_per_bucket: int) -> DataFrame:
    df = df.withColumn("_digest", split_digest(key, seed))
    return running_totals(
        df, ["_digest"], {"_rank": F.lit(1)}, [label], "digest", rows_per_bucket, with_total=True
    )


def stratified_split(
    df: DataFrame, label: str, key: str, fraction: float = 0.8, seed: int = 42, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``split``: the first ``round(n * fraction)`` rows of each class, in digest order, are 'train'.

    ``key`` must be unique; the split does not depend on partitioning."""
    ranked = _ranked(df, label, key, seed, rows_per_bucket)
    train = F.col("_rank") <= F.floor(F.col("_rank_total") * F.lit(fraction) + F.lit(0.5))
    return ranked.withColumn("split", F.when(train, "train").otherwise("test")).drop("_digest", "_rank", "_rank_total")


def hash_split(df: DataFrame, key: str, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``split`` from the key's digest alone: no shuffle, stable when rows are added."""
    share = F.conv(F.substring(split_digest(key, seed), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    return df.withColumn("split", F.when(share < F.lit(fraction), "train").otherwise("test"))


def stratified_folds(
    df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``fold`` in 0..k-1; every class is dealt out evenly over the folds."""
    ranked = _ranked(df, label, key, seed, rows_per_bucket)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop(
        "_digest", "_rank", "_rank_total"
    )


def split_distribution(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Rows per split and class."""
    return df.groupBy(split, target).agg(F.count(F.lit(1)).alias("n"))


def split_distribution_map(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """One map class -> rows per split (as large as the class list)."""
    counts = split_distribution(df, target, split)
    entries = F.sort_array(F.collect_list(F.struct(F.col(target), F.col("n"))))
    return counts.groupBy(split).agg(F.map_from_entries(entries).alias("distribution"))


def rank_models(results: DataFrame, by: str = "test_accuracy", name: str = "model") -> DataFrame:
    return results.orderBy(F.col(by).desc(), F.col(name))


def top_k(results: DataFrame, k: int = 3, by: str = "test_accuracy", name: str = "model") -> DataFrame:
    """The k best rows; sort and limit become one bounded heap per task."""
    return rank_models(results, by, name).limit(k)
