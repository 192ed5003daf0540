"""The shape of the plans: no cross joins, no Python workers, filters in the scans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayspark.operators import simjoin
from catalog import extract
from catalog.similar import doc_bits

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")
PLAIN = [n for n, q in entry.queries().items() if q.__module__ in ("catalog.clean", "catalog.stats", "catalog.ranking", "catalog.extract", "catalog.evaluate")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_and_no_python(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert not [word for word in FORBIDDEN if word in text]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 90


def test_extract_pushes_filters_and_prunes_columns(spark, sf, capsys):
    extract.bound_extract(spark, sf).explain("formatted")
    text = capsys.readouterr().out
    assert "EqualTo(l_linestatus,F)" in text and "In(l_returnflag, [A,R])" in text
    assert "GreaterThan(s_acctbal,0.0)" in text
    assert "l_shipdate" not in text and "o_totalprice" not in text


def test_candidates_are_an_equi_join(spark, sf):
    index = simjoin.prefix_index(simjoin.distinct_sets(doc_bits(spark, sf), "doc_id"), 0.8)
    text = plan(simjoin._candidates(index.prefix, index.prefix, 0.8, 100))
    assert "SortMergeJoin" in text or "HashJoin" in text
    assert not [word for word in FORBIDDEN if word in text]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["target_kinase", "active", "inactive"]
    assert df.count() > 0


def test_extract_keeps_unmatched_names_and_drops_duplicates(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "compound_structures": frame([(1, "C"), (2, None), (3, "CC")], "molregno long, canonical_smiles string"),
        "activities": frame(
            [
                (10, 1, 5.0, "IC50", "nM", 8.3, None),
                (10, 1, 5.0, "IC50", "nM", 8.3, None),
                (10, 3, 20000.0, "Ki", "nM", None, "Manually validated"),
                (10, 3, 7.0, "Kd", "nM", None, "Manually validated"),
                (10, 3, 7.0, "EC50", "nM", None, None),
                (10, 3, 7.0, "Ki", "uM", None, None),
                (10, 3, 7.0, "Ki", None, None, None),
                (10, 3, 7.0, "Ki", "nM", None, "Outside typical range"),
                (10, 3, None, "Ki", "nM", None, None),
                (10, 2, 7.0, "Ki", "nM", None, None),
                (11, 1, 7.0, "Ki", "nM", None, None),
                (12, 1, 7.0, "Ki", "nM", None, None),
            ],
            "assay_id long, molregno long, standard_value double, standard_type string, standard_units string, pchembl_value double, data_validity_comment string",
        ),
        "assays": frame([(10, 100), (11, 101), (12, 102)], "assay_id long, tid long"),
        "target_dictionary": frame(
            [(100, "protein kinase A", "human"), (101, "Kinase B", "human"), (102, None, None)], "tid long, pref_name string, organism string"
        ),
        "molecule_dictionary": frame([(1, "ID1", "first")], "molregno long, chembl_id string, pref_name string"),
        "kinase_groups": frame([(100, "AGC"), (101, "CMGC"), (100, "TK")], "tid long, kinase_group string"),
    }
    from assayspark.plans.extract import enrich_groups, extract_compounds, group_activity_counts

    got = sorted((r["molregno"], r["standard_value"], r["chembl_id"]) for r in extract_compounds(tables).collect())
    assert got == [(1, 5.0, "ID1"), (3, 7.0, None), (3, 20000.0, None)]
    validated = extract_compounds(tables, validated_only=True).collect()
    assert [(r["molregno"], r["standard_value"]) for r in validated] == [(3, 7.0)]
    counts = group_activity_counts(tables)
    assert sorted(counts.collect()) == [("AGC", 10), ("CMGC", 1), ("TK", 10)]
    rows = enrich_groups(tables["assays"], tables["kinase_groups"].where("kinase_group <> 'TK'"), counts)
    assert sorted(((r["assay_id"], r["kinase_group"], r["count_kinase_group"]) for r in rows.collect())) == [
        (10, "AGC", 10), (11, "CMGC", 1), (12, None, None)]
    assert rows.where(F.col("kinase_group").isNull()).count() == 1


def test_compound_jobs(spark):
    from assayspark.plans import compounds

    codes = ["CCOCCN.Cl", "CCOCCN", "CCOCCN.Na", "c1ccccc1", "c1ccccc1C", "NCCNCCNCC", None]
    rows = [(i, c, v, g, 10.0 - i, float(i)) for i, (c, v, g) in enumerate(zip(codes, [1.0, 10000.0, 10001.0, None, 5.0, 900.0, 2.0], ["AGC", "Other", None, "STE", "AGC", "TKL", "AGC"]))]
    df = spark.createDataFrame(rows, "id long, canonical_smiles string, standard_value double, kinase_group string, molecular_weight double, pchembl_value double")
    salts = spark.createDataFrame([("Cl",), ("Na",)], "part string")
    parts = compounds.clean_compounds(df, salts)
    original = compounds.clean_compounds(df, salts, keep_original=True)["with_salt"].collect()
    assert {r["canonical_smiles"] for r in original} == set(codes)
    assert parts["with_salt"].where("contains_salt").select("canonical_smiles").distinct().collect() == [("CCOCCN",)]
    assert sorted(r["id"] for r in parts["positive"].collect()) == [0, 1, 4, 5, 6]
    assert sorted(r["id"] for r in parts["negative"].collect()) == [2]
    out = compounds.cluster_compounds(parts["salt_free"], "id")
    assert {r["id"] for r in out["members"].collect()} == {0, 1, 2}
    assert [(r["id"], r["molecular_weight"]) for r in out["hits"].collect()] == [(2, 8.0)]
    assert out["clustered"].count() == 6
    compared = compounds.compare_compounds(parts["salt_free"], "id")
    totals = compared["histograms"].groupBy("metric").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in totals} == {36} and len(totals) == 5
    assert compared["violins"].select("metric").distinct().count() == 5
    assert compared["activity"].agg(F.sum("n")).first()[0] == 7
    checked = compounds.check_balance(df)
    assert checked["filtered"].count() == 6
    assert {(r["threshold"], r["label"]): r["n"] for r in checked["overall"].collect()} == {
        ("1 uM", "active"): 4, ("1 uM", "inactive"): 2, ("10 uM", "active"): 4, ("10 uM", "inactive"): 2}
    assert compounds.check_balance(df, keep=["AGC"], drop=None)["filtered"].count() == 3
    assert checked["metrics"].count() == 6
