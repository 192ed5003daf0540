"""Extract and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayspark.operators.balance import crosstab
from assayspark.operators.filters import label_activity
from assayspark.plans.extract import enrich_groups, extract_compounds, group_activity_counts
from assayspark.sources.tables import load_tables
from catalog.registry import query, rounded

COMMENTS = "CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'Manually validated' ELSE 'Outside typical range' END"


def star(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The test tables in the roles of the activity database."""
    t = load_tables(spark, sf, ["part", "lineitem", "orders", "customer", "nation", "supplier"])
    located = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return {
        "compound_structures": t["part"].select(
            F.col("p_partkey").alias("molregno"), F.col("p_name").alias("canonical_smiles")
        ),
        "activities": t["lineitem"].select(
            F.col("l_orderkey").alias("assay_id"),
            F.col("l_partkey").alias("molregno"),
            F.col("l_extendedprice").alias("standard_value"),
            F.col("l_returnflag").alias("standard_type"),
            F.col("l_linestatus").alias("standard_units"),
            F.col("l_quantity").alias("pchembl_value"),
            F.expr(COMMENTS).alias("data_validity_comment"),
        ),
        "assays": t["orders"].select(F.col("o_orderkey").alias("assay_id"), F.col("o_custkey").alias("tid")),
        "target_dictionary": located.select(
            F.col("c_custkey").alias("tid"), F.col("n_name").alias("pref_name"), F.col("c_mktsegment").alias("organism")
        ),
        "molecule_dictionary": t["supplier"]
        .where(F.col("s_acctbal") > 0)
        .select(
            F.col("s_suppkey").alias("molregno"),
            F.concat(F.lit("ID"), F.col("s_suppkey").cast("string")).alias("chembl_id"),
            F.col("s_name").alias("pref_name"),
        ),
        "kinase_groups": located.select(F.col("c_custkey").alias("tid"), F.col("n_name").alias("kinase_group")),
    }


def bound_extract(spark: SparkSession, sf: str, **more) -> DataFrame:
    return extract_compounds(star(spark, sf), target_like="%TION_1%", types=["A", "R"], units="F", **more)


_EXTRACT = f"""
SELECT DISTINCT 'ID' || s_suppkey AS chembl_id, p_partkey AS molregno, n_name AS target_kinase,
       p_name AS canonical_smiles, l_extendedprice AS standard_value, l_returnflag AS standard_type,
       l_quantity AS pchembl_value, s_name AS compound_name, c_mktsegment AS organism
FROM part
JOIN lineitem ON p_partkey = l_partkey
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN supplier ON p_partkey = s_suppkey AND s_acctbal > 0
WHERE n_name LIKE '%TION_1%' AND p_name IS NOT NULL AND l_returnflag IN ('A', 'R')
  AND l_extendedprice IS NOT NULL AND l_linestatus = 'F'
  AND (({COMMENTS}) IS NULL OR ({COMMENTS}) = 'Manually validated')
"""


@query("extract_compounds", _EXTRACT)
def _(spark, sf):
    return bound_extract(spark, sf)


@query(
    "extract_validated",
    _EXTRACT + f" AND l_extendedprice < 30000 AND ({COMMENTS}) = 'Manually validated'",
)
def _(spark, sf):
    return bound_extract(spark, sf, validated_only=True, max_value=30_000.0)


@query(
    "extract_label_crosstab",
    f"""WITH e AS ({_EXTRACT})
SELECT target_kinase, count(*) FILTER (standard_value < 50000) AS active,
       count(*) FILTER (NOT coalesce(standard_value < 50000, false)) AS inactive
FROM e GROUP BY target_kinase""",
)
def flagship(spark, sf):
    """Extract, label by cut-off, count labels per target."""
    return crosstab(label_activity(bound_extract(spark, sf), "standard_value", 50_000), "target_kinase", "label")


_COUNTS = """SELECT n_name AS kinase_group, count(*)::BIGINT AS count_kinase_group
FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name"""


@query("group_activity_counts", _COUNTS)
def _(spark, sf):
    return group_activity_counts(star(spark, sf))


@query(
    "enrich_groups",
    f"""WITH g AS ({_COUNTS})
SELECT o_orderkey, n_name AS kinase_group, count_kinase_group
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN g ON g.kinase_group = n_name""",
)
def _(spark, sf):
    s = star(spark, sf)
    out = enrich_groups(s["assays"], s["kinase_groups"], group_activity_counts(s))
    return out.select(F.col("assay_id").alias("o_orderkey"), "kinase_group", "count_kinase_group")
