import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from assayspark.operators import evaluate, spread
from assayspark.plans import prepare


@pytest.fixture(scope="module")
def pred(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        label = rng.choice([0.0, 0.0, 0.0, 1.0, 2.0])
        guess = label if rng.random() < 0.6 else rng.choice([0.0, 1.0, 2.0, 3.0])
        rows.append((i, label, guess, "train" if i % 4 else "test", "m"))
    return spark.createDataFrame(rows, "row_id int, label double, prediction double, split string, model string")


NAMES = {"accuracy": "accuracy", "weighted_precision": "weightedPrecision", "weighted_recall": "weightedRecall", "f1": "f1"}


def test_multiclass_equals_spark_evaluator(pred):
    got = evaluate.multiclass_metrics(pred).first()
    sides = evaluate.metrics_by_split(pred).first()
    for mine, theirs in NAMES.items():
        judge = MulticlassClassificationEvaluator(metricName=theirs)
        assert math.isclose(got[mine], judge.evaluate(pred), rel_tol=1e-9)
        for split in ("train", "test"):
            assert math.isclose(sides[f"{split}_{mine}"], judge.evaluate(pred.where(F.col("split") == split)), rel_tol=1e-9)


def test_confusion_and_counts(pred):
    rows = pred.collect()
    matrix = {r["label"]: r for r in evaluate.confusion_matrix(evaluate.confusion(pred)).collect()}
    for t in (0.0, 1.0, 2.0):
        for p in (0, 1, 2, 3):
            assert matrix[t][f"p_{p}"] == sum(r["label"] == t and r["prediction"] == p for r in rows)
    for r in evaluate.one_vs_rest_counts(evaluate.confusion(pred)).collect():
        c = r["class"]
        assert r["tp"] == sum(x["label"] == c == x["prediction"] for x in rows)
        assert r["fp"] == sum(x["label"] != c == x["prediction"] for x in rows)
        assert r["fn"] == sum(x["prediction"] != c == x["label"] for x in rows)
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == len(rows)


def test_balanced_metrics(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    r = evaluate.balanced_metrics(df).first()
    assert math.isclose(r["balanced_accuracy"], (0.5 + 0.75) / 2)
    assert math.isclose(r["geometric_mean"], math.sqrt(0.5 * 0.75))
    missed = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert evaluate.balanced_metrics(missed).first()["geometric_mean"] == 0.0


def multilabel(spark, seed=7, n=60, classes=4, levels=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for c in range(classes):
            label = int(rng.random() < (0.5, 0.1, 0.9, 0.3)[c])
            score = round(min(max(0.3 * label + rng.randint(0, levels) / (levels * 1.4), 0.0), 1.0), 3)
            rows.append((i, c, label, score, int(score > 0.5)))
    return rows, spark.createDataFrame(rows, "row_id int, class_id int, label int, score double, predicted int")


def pairwise_auc(rows):
    pos = [s for _, _, y, s, _ in rows if y]
    neg = [s for _, _, y, s, _ in rows if not y]
    return np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg]) if pos and neg else None


def average_precision(rows):
    pos = [s for _, _, y, s, _ in rows if y]
    return np.mean([sum(y for _, _, y, s, _ in rows if s >= a) / sum(1 for r in rows if r[3] >= a) for a in pos]) if pos else None


@pytest.mark.parametrize("per_bucket", [10**6, 5])
def test_score_areas(spark, per_bucket):
    rows, df = multilabel(spark)
    for r in evaluate.score_areas(df, rows_per_bucket=per_bucket).collect():
        mine = [x for x in rows if x[1] == r["class_id"]]
        assert math.isclose(r["roc_auc"], pairwise_auc(mine))
        assert math.isclose(r["pr_auc"], average_precision(mine))
        assert r["support"] == sum(x[2] for x in mine)


def test_areas_of_one_sided_classes(spark):
    rows = [(i, c, c, i / 10, 1) for i in range(5) for c in (0, 1)]
    df = spark.createDataFrame(rows, "row_id int, class_id int, label int, score double, predicted int")
    got = {r["class_id"]: (r["roc_auc"], r["pr_auc"]) for r in evaluate.score_areas(df).collect()}
    assert got == {0: (None, None), 1: (None, 1.0)}
    assert evaluate.pr_auc(df).first()["pr_auc"] == 1.0


def test_multilabel_metrics(spark):
    rows, df = multilabel(spark)
    y = np.array([r[2] for r in rows]).reshape(60, 4)
    p = np.array([r[4] for r in rows]).reshape(60, 4)
    tp, fp, fn = (y & p).sum(0), ((1 - y) & p).sum(0), (y & (1 - p)).sum(0)
    support = y.sum(0)
    precision = np.where(tp + fp > 0, tp / np.maximum(tp + fp, 1), 0)
    recall = np.where(support > 0, tp / np.maximum(support, 1), 0)
    f1 = np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0)
    got = evaluate.multilabel_prf(df).first()
    for name, want in (("precision", precision), ("recall", recall), ("f1", f1)):
        assert math.isclose(got[name], (want * support).sum() / support.sum())
    assert math.isclose(evaluate.subset_accuracy(df).first()[0], (y == p).all(axis=1).mean())
    assert math.isclose(evaluate.class_precision_mean(df).first()[0], precision.mean())
    counts = {r["class_id"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in evaluate.multilabel_confusion(df).collect()}
    for c in range(4):
        assert counts[c] == (60 - tp[c] - fp[c] - fn[c], fp[c], fn[c], tp[c])
    s = np.clip(np.array([r[3] for r in rows]), 1e-15, 1 - 1e-15)
    t = np.array([r[2] for r in rows])
    assert math.isclose(evaluate.log_loss(df).first()[0], -(t * np.log(s) + (1 - t) * np.log(1 - s)).mean())


def test_nothing_predicted_gives_zero(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.2, 0), (2, 0, 0, 0.1, 0)], "row_id int, class_id int, label int, score double, predicted int")
    assert evaluate.class_precision(df).first()["class_precision"] == 0.0
    assert evaluate.multilabel_prf(df).first()["f1"] == 0.0


def test_labels(spark):
    df = spark.createDataFrame([(1, "b,a"), (2, "c"), (3, "a")], "id int, t string")
    assert [r["labels"] for r in prepare.binarize_labels(df, "t").orderBy("id").collect()] == [[1, 1, 0], [0, 0, 1], [1, 0, 0]]
    assert prepare.label_count(df, "t").first()["n_labels"] == 3
    assert sorted(prepare.label_rows(df, "id", "t").collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "a")]


def test_binarize_labels_without_a_limit(spark, monkeypatch):
    rows = [(i, ",".join(f"L{(i * 37 + j * 211) % 1500:05d}" for j in range(40)) + ",common" if i % 9 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, t string")
    listed = prepare.binarize_labels(df, "t").orderBy("id").collect()
    monkeypatch.setattr(prepare, "LISTED_LABELS", 100)
    joined = prepare.binarize_labels(df, "t")
    assert joined.columns == ["id", "t", "labels"]
    got = joined.orderBy("id").collect()
    assert [sum(r["labels"]) for r in got if r["t"]] == [41 for i in range(120) if i % 9]
    assert [r["labels"] for r in got] == [r["labels"] for r in listed]


def test_number_rows(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(5)
    got = spread.number_rows(df, "k", "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(500))
