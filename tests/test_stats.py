import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from assayspark.operators import balance, quantiles, ranking, spread
from assayspark.sources import stages


def two_classes(spark, active, inactive):
    rows = [("active",)] * active + [("inactive",)] * inactive
    return spark.createDataFrame(rows, "label string")


@pytest.mark.parametrize("ratio, entropy, cv", [(0.900504, 0.998022, 0.052352), (3.999887, 0.721937, 0.599991)])
def test_published_balance_values(spark, ratio, entropy, cv):
    """The published statistics follow from the ratio of two classes: base-2 entropy, population deviation."""
    inactive = 1_000_000
    counts = spark.createDataFrame([("active", round(ratio * inactive)), ("inactive", inactive)], "label string, n long")
    got = balance._statistics(counts, "label", []).first()
    assert math.isclose(got["Class Ratio"], ratio, abs_tol=1e-6)
    assert math.isclose(got["Entropy of Distribution"], entropy, abs_tol=2e-6)
    assert math.isclose(got["Coefficient of Variation"], cv, abs_tol=2e-6)


def test_single_class_balance(spark):
    got = {r["Metric"]: r["Value"] for r in balance.balance_metrics(two_classes(spark, 5, 0)).collect()}
    assert got["Class Ratio"] == math.inf
    assert got["Entropy of Distribution"] == 0.0
    assert got["Coefficient of Variation"] == 0.0


def test_balance_report_equals_one_cutoff_at_a_time(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("v"), F.concat(F.lit("g"), F.col("id") % 4).alias("g"))
    cutoffs = {"low": 20.0, "high": 70.0}
    got = {(r["threshold"], r["Metric"]): r["Value"] for r in balance.balance_report(df, "v", "g", cutoffs).collect()}
    for name, cut in cutoffs.items():
        one = df.withColumn("label", F.when(F.col("v") < cut, "active").otherwise("inactive"))
        for r in balance.balance_metrics(one).collect():
            assert math.isclose(got[(name, r["Metric"])], r["Value"], rel_tol=1e-12)


def test_crosstab_fills_zero_and_drops_null_group(spark):
    df = spark.createDataFrame([("a", "active"), ("a", "active"), ("b", "inactive"), (None, "active")], "g string, label string")
    got = {r["g"]: (r["active"], r["inactive"]) for r in balance.crosstab(df, "g", "label").collect()}
    assert got == {"a": (2, 0), "b": (0, 1)}


@pytest.mark.parametrize("direct_rows, per_bucket", [(10**6, 10**6), (10, 40), (10, 10**6)])
def test_exact_quantiles_match_numpy(spark, direct_rows, per_bucket):
    rng = random.Random(3)
    data = [("hot", float(rng.randint(0, 50))) for _ in range(400)] + [("cold", rng.gauss(0, 1)) for _ in range(31)] + [("one", 4.0)]
    df = spark.createDataFrame(data + [("hot", None), ("hot", float("nan"))], "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    out = quantiles.exact_quantiles(df, "v", probs, ["g"], direct_rows=direct_rows, rows_per_bucket=per_bucket).collect()
    got = {(r["g"], r["prob"]): r["value"] for r in out}
    assert len(got) == 3 * len(probs)
    for g in ("hot", "cold", "one"):
        want = np.quantile([v for k, v in data if k == g], probs)
        assert np.allclose([got[(g, p)] for p in probs], want)


@pytest.mark.parametrize("direct_rows", [10**6, 1])
def test_weighted_quantiles(spark, direct_rows):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4)], "v double, w long")
    out = quantiles.exact_quantiles(df, "v", [0.25, 0.5, 0.9], weight="w", direct_rows=direct_rows, rows_per_bucket=1)
    got = {r["prob"]: r["value"] for r in out.collect()}
    want = np.quantile([1, 1, 1, 2, 10, 10, 10, 10], [0.25, 0.5, 0.9])
    assert np.allclose([got[0.25], got[0.5], got[0.9]], want)


def test_histogram_matches_numpy(spark):
    data = [float(x * x % 101) for x in range(300)]
    df = spark.createDataFrame([(v,) for v in data] + [(None,), (float("inf"),)], "v double")
    out = quantiles.histogram(df, "v", 20).orderBy("bin").collect()
    counts, edges = np.histogram(data, 20)
    assert [r["n"] for r in out] == list(counts)
    assert np.allclose([r["lo"] for r in out] + [out[-1]["hi"]], edges)


def test_histogram_of_constant_and_empty(spark):
    same = spark.createDataFrame([(7.0,)] * 4, "v double")
    out = quantiles.histogram(same, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in out] == list(np.histogram([7.0] * 4, 4)[0])
    assert quantiles.histogram(same.where("v < 0"), "v", 4).count() == 0


def test_density_integrates_to_one(spark):
    rows = [("a", float(i)) for i in range(50)] + [("b", float(i * i)) for i in range(20)]
    out = quantiles.density_histogram(spark.createDataFrame(rows, "series string, value double"), 30)
    for r in out.groupBy("series").agg(F.sum(F.col("density") * (F.col("hi") - F.col("lo"))).alias("area")).collect():
        assert math.isclose(r["area"], 1.0)


def test_box_summary(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]]
    r = quantiles.box_summary(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).first()
    assert (r["q1"], r["median"], r["q3"]) == (3.25, 5.5, 7.75)
    assert (r["whisker_lo"], r["whisker_hi"], r["outliers"], r["n"]) == (1.0, 9.0, 1, 10)


def test_trim_band_uses_factor(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    out = quantiles.trim_band(df, ["x", "y"], {"y": 0.0}, low=0.1, high=0.9, margin=0.05)
    got = {r["series"]: (r["a"], r["b"]) for r in out.groupBy("series").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect()}
    assert got == {"x": (6.0, 94.0), "y": (10.0, 90.0)}


def test_minmax_rescale(spark):
    df = spark.createDataFrame([(2.0, 5.0), (4.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert sorted(r["x"] for r in quantiles.minmax_rescale(df, "x").collect()) == [0.0, 0.5, 1.0]
    assert {r["c"] for r in quantiles.minmax_rescale(df, "c").collect()} == {None}


@pytest.mark.parametrize("per_bucket", [10**6, 37])
def test_running_totals(spark, per_bucket):
    rows = [(("hot" if i % 3 else "cold"), (i * 7919) % 1009, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    out = spread.running_totals(df, ["o"], {"s": F.col("v"), "n": F.lit(1)}, ["g"], rows_per_bucket=per_bucket, with_total=True)
    got = {(r["g"], r["o"]): (r["s"], r["n"], r["s_total"], r["n_total"]) for r in out.collect()}
    for g in ("hot", "cold"):
        mine = sorted((o, v) for k, o, v in rows if k == g)
        total, run = sum(v for _, v in mine), 0
        for n, (o, v) in enumerate(mine, 1):
            run += v
            assert got[(g, o)] == (run, n, total, len(mine))


@pytest.mark.parametrize("per_bucket", [10**6, 20])
def test_block_ids(spark, per_bucket):
    df = spark.range(0, 1000, 3).repartition(5)
    out = ranking.with_block_id(df, "id", 100, per_bucket).orderBy("id").collect()
    assert [r["position"] for r in out] == list(range(334))
    assert [r["block_id"] for r in out] == [p // 100 for p in range(334)]


@pytest.mark.parametrize("per_bucket", [10**6, 25])
def test_splits_are_stable_partitions(spark, per_bucket):
    df = spark.range(300).withColumn("label", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    one = ranking.stratified_split(df, "label", "id", rows_per_bucket=per_bucket)
    two = ranking.stratified_split(df.repartition(7), "label", "id", rows_per_bucket=per_bucket)
    assert sorted(one.collect()) == sorted(two.collect())
    counts = {(r["split"], r["label"]): r["n"] for r in ranking.split_distribution(one, "label").collect()}
    assert counts == {("train", "a"): 80, ("test", "a"): 20, ("train", "b"): 160, ("test", "b"): 40}
    folds = ranking.stratified_folds(df, "label", "id", 5, rows_per_bucket=per_bucket).groupBy("label", "fold").count().collect()
    assert sorted((r["label"], r["fold"], r["count"]) for r in folds) == [(k, f, n) for k, n in (("a", 20), ("b", 40)) for f in range(5)]


def test_hash_split_needs_no_shuffle(spark):
    out = ranking.hash_split(spark.range(2000), "id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    share = out.where("split = 'train'").count() / 2000
    assert 0.75 < share < 0.85


def test_attach_by_key_splits_hot_keys(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    per = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    plain = left.join(per, "k").select("k", "id", "m", "n")
    hot = spread.attach_by_key(left, per, "k", "n", rows_per_task=50).select("k", "id", "m", "n")
    assert sorted(hot.collect()) == sorted(plain.collect())
    missing = spread.attach_by_key(left, per.where("k <> 1"), "k", "n", "left", rows_per_task=50)
    assert missing.count() == 1000 and missing.where("m IS NULL").count() == 1


def test_attach_by_key_with_many_hot_keys(spark):
    left = spark.range(900).select("id", (F.col("id") % 6).alias("k"), (F.col("id") % 2).alias("j"))
    left = left.union(spark.range(900, 1500).select("id", F.lit(0).alias("k"), F.lit(0).alias("j")))
    per = left.groupBy("k", "j").agg(F.count(F.lit(1)).alias("n"))
    got = spread.attach_by_key(left, per, ["k", "j"], "n", rows_per_task=20).select("id", "k", "j", "n").collect()
    assert sorted(got) == sorted(left.join(per, ["k", "j"]).select("id", "k", "j", "n").collect())


def test_one_long_key_with_half_the_rows(spark):
    text = F.repeat(F.lit("long "), 20_000)
    left = stages.cut(spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, text).otherwise(F.col("id").cast("string")).alias("k")))
    per = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = spread.attach_by_key(left, per, "k", "n", rows_per_task=100)
    assert got.groupBy("n").count().orderBy("n").collect() == [(1, 1000), (1000, 1000)]
    assert "long long" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("level", [3, 4])
def test_running_totals_in_three_levels(spark, monkeypatch, level):
    monkeypatch.setattr(spread, "LEVEL_BUCKETS", level)
    rows = spark.range(300).select("id", (F.col("id") * 7919 % 300).alias("v"), (F.col("id") % 2).alias("g"))
    rows = rows.withColumn("d", F.md5(F.col("v").cast("string")))
    for group in ([], ["g"]):
        for order, kind in (("v", "range"), ("d", "digest")):
            got = spread.running_totals(rows, [order], {"s": F.col("id")}, group, kind, 5, with_total=True)
            window = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
            want = rows.select(
                "id", F.sum("id").over(window.orderBy(order)).alias("s"), F.sum("id").over(window).alias("s_total")
            )
            assert sorted(got.select("id", "s", "s_total").collect()) == sorted(want.collect())


def test_attach_by_key_with_the_key_column_only(spark):
    left = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("k"))
    per = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert spread.attach_by_key(left, per, "k", "n", rows_per_task=30).count() == 300


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spread.checked_broadcast, "__defaults__", (3,))
    monkeypatch.setattr(spread.attach_by_key, "__defaults__", ("inner", 20, None))
    df = spark.range(400).select((F.col("id") % 40).alias("g"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    hot = df.union(spark.range(200).select(F.lit(0).alias("g"), F.col("id").cast("double").alias("v")))
    total = quantiles.histogram(hot, "v", 5, ["g"]).groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert sorted((r["g"], r["n"]) for r in total) == [(0, 210)] + [(g, 10) for g in range(1, 40)]
    assert quantiles.box_summary(hot, "v", ["g"]).agg(F.sum("n")).first()[0] == 600


def test_checked_broadcast(spark):
    small = spark.range(10)
    assert spread.checked_broadcast(small, 10) is not small
    assert spread.checked_broadcast(small, 9) is small


def test_top_k(spark):
    df = spark.createDataFrame([("m1", 0.5), ("m2", 0.9), ("m3", 0.9), ("m4", 0.1)], "model string, test_accuracy double")
    assert [r["model"] for r in ranking.top_k(df, 3).collect()] == ["m2", "m3", "m1"]
