"""The compound jobs from end to end: clean, describe, cluster, compare, balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from assayspark.operators import balance, cluster, filters, pairs, quantiles
from assayspark.operators.fingerprints import fingerprint
from assayspark.plans import fixed
from assayspark.sources.stages import cut


def clean_compounds(
    df: DataFrame,
    salts: DataFrame,
    structure: str = "canonical_smiles",
    value: str = "standard_value",
    cutoff: float = fixed.POSITIVE_CUTOFF,
    keep_original: bool = False,
) -> dict[str, DataFrame]:
    """Strip and flag salts, then split by activity.

    ``salt_free`` has the stripped structures and the flag; ``positive`` and
    ``negative`` are its two sides.  ``with_salt`` holds the stripped structures
    too, as its users expect, or the original ones with ``keep_original``."""
    flagged = filters.strip_parts(df.withColumn("_original", F.col(structure)), structure, salts)
    salt_free = flagged.drop("_original")
    with_salt = salt_free
    if keep_original:
        with_salt = flagged.withColumn(structure, F.col("_original")).drop("_original")
    positive, negative = filters.split_by_cutoff(salt_free, value, cutoff)
    return {"with_salt": with_salt, "salt_free": salt_free, "positive": positive, "negative": negative}


def cluster_compounds(
    df: DataFrame,
    id: str,
    structure: str = "canonical_smiles",
    weight: str = "molecular_weight",
    threshold: float = 0.8,
    min_size: int = 3,
    k: int = 3,
    n_bits: int = 2048,
    unit: str = "char",
) -> dict[str, DataFrame]:
    """Fingerprint, cluster, and list the members and the lightest hit of clusters of ``min_size`` rows."""
    rows = df.where(F.col(structure).isNotNull())
    bits = fingerprint(rows.select(id, structure), structure, k, n_bits, unit).select(id, "bits")
    clustered = cut(cluster.leader_cluster(bits, id, "bits", threshold))
    members = cluster.cluster_members(df, clustered.select(id, "cluster_id"), id, min_size)
    hits = cluster.cluster_hits(members, "cluster_id", weight, id, min_size)
    return {"clustered": clustered, "members": members, "hits": hits}


def compare_compounds(
    df: DataFrame,
    order: str,
    structure: str = "canonical_smiles",
    activity: str = "pchembl_value",
    block_size: int = 1024,
    k: int = 3,
    n_bits: int = 2048,
    unit: str = "char",
) -> dict[str, DataFrame]:
    """Distributions of the five pair measures within blocks, and of the activity."""
    rows = fingerprint(df.where(F.col(structure).isNotNull()), structure, k, n_bits, unit)
    blocks = pairs.pack_blocks(rows, order, "bits", n_bits, block_size)
    return {
        "histograms": pairs.pair_histograms(blocks, 50),
        "violins": pairs.pair_violins(blocks),
        "activity": quantiles.histogram(df, activity, 20),
    }


def check_balance(
    df: DataFrame,
    value: str = "standard_value",
    group: str = "kinase_group",
    keep: Sequence[str] | None = None,
    drop: Sequence[str] | None = fixed.DROPPED_FOR_TEXT,
    cutoffs: Mapping[str, float] = fixed.BALANCE_CUTOFFS,
) -> dict[str, DataFrame]:
    """Filter the groups, then the balance statistics and counts of every cut-off."""
    rows = filters.keep_groups(df, group, keep) if keep is not None else df
    rows = filters.drop_groups(rows, group, drop) if drop is not None else rows
    counts = balance.label_counts(rows, value, group, cutoffs)
    return {
        "filtered": rows,
        "metrics": balance.balance_report(rows, value, group, cutoffs),
        "counts": counts,
        "overall": counts.groupBy("threshold", "label").agg(F.sum("n").alias("n")),
    }
