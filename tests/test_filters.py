import math

import pytest
from pyspark.sql import functions as F, types as T

from assayspark.functions import columns as X
from assayspark.operators import filters, fingerprints, quantiles

NAN, INF = float("nan"), float("inf")


def ids(df, key="id"):
    return sorted(r[key] for r in df.collect())


@pytest.fixture(scope="module")
def values(spark):
    rows = [(1, 999.0, "a"), (2, 1000.0, "b"), (3, 1001.0, None), (4, 10000.0, "a"), (5, 10000.5, "b"), (6, None, "c"), (7, NAN, None), (8, INF, "c")]
    return spark.createDataFrame(rows, "id int, v double, g string")


def test_cutoff_is_inclusive_and_missing_is_in_neither(values):
    pos, neg = filters.split_by_cutoff(values, "v")
    assert ids(pos) == [1, 2, 3, 4]
    assert ids(neg) == [5, 8]


def test_label_is_strict_and_missing_is_inactive(values):
    got = {r["id"]: r["label"] for r in filters.label_activity(values, "v", 1000).collect()}
    assert [k for k, v in got.items() if v == "active"] == [1]
    assert got[6] == got[7] == "inactive"


def test_keep_drops_and_drop_keeps_null_groups(spark, values):
    assert ids(filters.keep_groups(values, "g", ["a", "c"])) == [1, 4, 6, 8]
    assert ids(filters.drop_groups(values, "g", ["a", "c"])) == [2, 3, 5, 7]
    many = ["a", "c"] + [f"x{i}" for i in range(2000)]
    assert ids(filters.keep_groups(values, "g", many)) == [1, 4, 6, 8]
    assert ids(filters.drop_groups(values, "g", many)) == [2, 3, 5, 7]


def test_drop_nulls_counts_nan(values):
    assert ids(filters.drop_nulls(values)) == [1, 2, 4, 5, 8]
    assert ids(filters.drop_nulls(values, "v")) == [1, 2, 3, 4, 5, 8]


def test_impute_median(values):
    got = {r["id"]: r["v"] for r in quantiles.impute_median(values, "v").collect()}
    assert got[6] == got[7] == got[8] == 1001.0


def test_to_number(spark):
    texts = ["1.5", " 2 ", "1e3", "abc", "12d", "0x1p3", "", None, "inf", "nan", ".5", "-3."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [r["n"] for r in df.select("id", X.to_number("t").alias("n")).orderBy("id").collect()]
    assert got == [1.5, 2.0, 1000.0, None, None, None, None, None, INF, None, 0.5, -3.0]


def test_require_columns(values):
    assert filters.require_columns(values, {"g": T.StringType()}) is values
    with pytest.raises(ValueError):
        filters.require_columns(values, {"missing": T.StringType()})
    with pytest.raises(ValueError):
        filters.require_columns(values, {"v": T.StringType()})


CODES = ["CCN.Cl", "Cl", "CC.CC", "Cl.CCO.Cl", "Na.Cl", "CCO", None]
STRIPPED = [("CCN", True), ("Cl", False), ("CC.CC", False), ("CCO", True), ("Na.Cl", False), ("CCO", False), (None, False)]


@pytest.mark.parametrize("inline", [100, 1])
def test_strip_parts(spark, inline):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CODES)], "id int, code string")
    salts = spark.createDataFrame([("Cl",), ("Na",), ("Cl",), (None,)], "part string")
    out = filters.strip_parts(df, "code", salts, inline=inline).orderBy("id").collect()
    assert [(r["code"], r["contains_salt"]) for r in out] == STRIPPED


def test_deduplicate_keeps_lowest_with_all_targets(spark):
    rows = [("x", 5.0, 1, "t1"), ("x", 2.0, 2, "t2"), ("x", 2.0, 3, "t1"), ("y", None, 4, "t9"), ("y", 7.0, 5, None), ("z", NAN, 6, "t3")]
    df = spark.createDataFrame(rows, "k string, v double, tie int, t string")
    got = {r["k"]: (r["tie"], list(r["targets"])) for r in filters.deduplicate(df, "k", "v", "tie", "t").collect()}
    assert got == {"x": (2, ["t1", "t2"]), "y": (5, ["t9"]), "z": (6, ["t3"])}


def test_having_min_size(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, k string")
    assert ids(filters.having_min_size(df, "k", 2)) == [1, 2]


def test_union_labelled(spark):
    a = spark.createDataFrame([(1, "p")], "id int, n string")
    b = spark.createDataFrame([("q", 2)], "n string, id int")
    got = {(r["id"], r["n"], r["series"]) for r in filters.union_labelled({"a": a, "b": b}).collect()}
    assert got == {(1, "p", "a"), (2, "q", "b")}
    with pytest.raises(ValueError):
        filters.union_labelled({})


def test_token_profile_invalid_rows(spark):
    df = spark.createDataFrame([("abba",), ("abba",), ("???",), (None,)], "s string")
    classes, weights = {"n_a": "a"}, {"a": 1.0, "bb": 10.0}
    dropped = fingerprints.token_profile(df, "s", classes, weights, valid="[a-z]").collect()
    assert [(r["s"], r["n_chars"], r["n_a"], r["mass"]) for r in dropped] == [("abba", 4, 2, 12.0)]
    kept = {r["s"]: r["n_a"] for r in fingerprints.token_profile(df, "s", classes, weights, "[a-z]", "null").collect()}
    assert kept == {"abba": 2, "???": None}
    with pytest.raises(ValueError):
        fingerprints.token_profile(df, "s", classes, on_invalid="other")


def test_attach_features_fans_out_once_per_group(spark):
    feats = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "s string, w double")
    meta = spark.createDataFrame([("m", "g1"), ("m", "g1"), ("m", "g2")], "s string, g string")
    got = sorted((r["s"], r["g"] or "") for r in fingerprints.attach_features(feats, meta, "s", ["g"]).collect())
    assert got == [("m", "g1"), ("m", "g2"), ("n", "")]


def test_scalar_expressions(spark):
    df = spark.createDataFrame([("org/Some Model", [0.0, 1.0, 1.0], [-2.0, 1.0], 0.0)], "s string, a array<double>, b array<double>, x double")
    r = df.select(
        X.last_part("s").alias("last"), X.slug("s").alias("slug"), X.capitalise(F.lit("hELLO wORLD")).alias("cap"),
        X.argmax_index("a").alias("arg"), X.shift_non_negative("b").alias("shift"), X.shift_non_negative("a").alias("same"),
        X.sigmoid("x").alias("sig"), X.predicted(F.lit(0.5)).alias("p"), X.run_name(F.lit("/a/metrics_X_y.json")).alias("run"),
        X.zip_to_map(F.array(F.lit("k")), F.array(F.lit(1))).alias("m"), X.split_labels(F.lit("a,b,a")).alias("l"),
    ).first()
    assert (r["last"], r["slug"], r["cap"], r["arg"], r["run"]) == ("Some Model", "org_some_model", "Hello world", 1, "X_y")
    assert (r["shift"], r["same"], r["sig"], r["p"]) == ([0.0, 3.0], [0.0, 1.0, 1.0], 0.5, 0)
    assert r["m"] == {"k": 1} and r["l"] == ["a", "b", "a"]
    assert math.isclose(r["sig"], 0.5)
