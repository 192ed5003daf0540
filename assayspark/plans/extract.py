"""The extract: a multi-way join of activity tables to distinct compound rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from assayspark.functions.columns import nan_to_null
from assayspark.operators.filters import matches_any
from assayspark.operators.spread import attach_by_key, checked_broadcast
from assayspark.plans import fixed


def extract_compounds(
    tables: Mapping[str, DataFrame],
    target_like: str = fixed.TARGET_LIKE,
    types: Sequence[str] = fixed.ACTIVITY_TYPES,
    units: str = fixed.ACTIVITY_UNITS,
    comment: str = fixed.VALIDATED,
    validated_only: bool = False,
    max_value: float = fixed.POSITIVE_CUTOFF,
) -> DataFrame:
    """Distinct compound-target-activity rows.

    Tables: ``compound_structures``, ``activities``, ``assays``,
    ``target_dictionary`` (inner) and ``molecule_dictionary`` (left, for optional
    names).  Filters stand before the joins, so they reach the scans.  The assays
    of the wanted targets are found first: the large activity table then meets
    one selective side, whose keys Spark can also push into its scan as a
    runtime filter.  Every join is on a key that is unique on the other side,
    so a hot assay or compound only makes one side's partition large, which
    adaptive execution splits.  ``validated_only`` keeps only rows below
    ``max_value`` that carry the validation comment.
    """
    act = tables["activities"].where(
        F.col("standard_type").isin(list(types))
        & F.col("standard_value").isNotNull()
        & nan_to_null("standard_value").isNotNull()
        & (F.col("standard_units") == units)
        & matches_any("data_validity_comment", comment)
    )
    if validated_only:
        act = act.where((F.col("standard_value") < max_value) & (F.col("data_validity_comment") == comment))
    structures = tables["compound_structures"].where(F.col("canonical_smiles").isNotNull())
    targets = tables["target_dictionary"].where(F.col("pref_name").like(target_like))
    names = tables["molecule_dictionary"].select("molregno", "chembl_id", F.col("pref_name").alias("compound_name"))
    wanted = (
        tables["assays"]
        .select("assay_id", "tid")
        .join(targets.select("tid", F.col("pref_name").alias("target_kinase"), "organism"), "tid")
        .drop("tid")
    )
    return (
        act.join(wanted, "assay_id")
        .join(structures.select("molregno", "canonical_smiles"), "molregno")
        .join(names, "molregno", "left")
        .select(
            "chembl_id",
            "molregno",
            "target_kinase",
            "canonical_smiles",
            nan_to_null("standard_value").alias("standard_value"),
            "standard_type",
            "pchembl_value",
            "compound_name",
            "organism",
        )
        .distinct()
    )


def group_activity_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Activities per target group: ``kinase_groups`` x ``assays`` x ``activities``.

    Activities are counted per assay first, so the join sees one row per assay."""
    per_assay = tables["activities"].groupBy("assay_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        tables["assays"]
        .select("assay_id", "tid")
        .join(per_assay, "assay_id")
        .groupBy("tid")
        .agg(F.sum("_n").alias("_n"))
        .join(tables["kinase_groups"].select("tid", "kinase_group"), "tid")
        .groupBy("kinase_group")
        .agg(F.sum("_n").alias("count_kinase_group"))
    )


def enrich_groups(df: DataFrame, groups: DataFrame, counts: DataFrame, key: str = "tid") -> DataFrame:
    """Add ``kinase_group`` and ``count_kinase_group`` to rows that carry the target key.

    Both dimensions are joined to each other first; the result is broadcast
    when its checked size allows, else the rows of frequent targets are spread."""
    dimension = groups.select(key, "kinase_group").join(counts.select("kinase_group", "count_kinase_group"), "kinase_group", "left")
    small = checked_broadcast(dimension)
    if small is not dimension:
        return df.join(small, key, "left")
    load = df.groupBy(key).agg(F.count(F.lit(1)).alias("_load"))
    return attach_by_key(df, dimension.join(load, key), key, "_load", "left").drop("_load")
