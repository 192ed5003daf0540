import threading

import pytest
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from assayspark.operators import ranking
from assayspark.plans import models, prepare
from assayspark.plans.fixed import SWEEP_WIDTHS
from assayspark.sources import stages
from catalog import learn
from catalog.registry import QUERIES


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.range(240).select(
        F.col("id"),
        (F.col("id") % 3).cast("double").alias("label"),
        F.array(*[((F.col("id") % 3 == i).cast("double") * 0.8 + F.rand(3) * 0.3) for i in range(3)]).alias("v"),
    )
    rows = ranking.stratified_split(rows, "label", "id")
    return stages.cut(rows.select("id", "label", "split", array_to_vector("v").alias("features")))


def test_grids(spark):
    assert {n: len(g) for n, (_, g) in models.models().items()} == {
        "Random Forest": 1, "Logistic Regression": 4, "Decision Tree": 1, "Naive Bayes": 1, "One-vs-Rest": 4}
    assert len(models.lr_deep_grid()[1]) == 288
    lr = LogisticRegression()
    space = {"regParam": ("log", 1e-5, 3e-5), "maxIter": ("int", 3, 6), "tol": ("uniform", 0.1, 0.2)}
    draws = models.random_search(lr, space, 3, seed=1)
    assert draws == models.random_search(lr, space, 3, seed=1)
    for d in draws:
        assert 1e-5 <= d[lr.regParam] <= 3e-5 and d[lr.maxIter] in (3, 4, 5, 6) and 0.1 <= d[lr.tol] <= 0.2


def test_train_rank_save(data, tmp_path):
    chosen = {n: m for n, m in models.models().items() if n in ("Decision Tree", "Naive Bayes", "Random Forest")}
    done = models.train_and_evaluate(data, "id", chosen)
    rows = done.ranked().collect()
    assert len(rows) == 3
    assert all(r["test_accuracy"] > 0.8 and r["fit_seconds"] > 0 for r in rows)
    assert [r["test_accuracy"] for r in rows] == sorted((r["test_accuracy"] for r in rows), reverse=True)
    assert done.confusions().agg(F.sum("n")).first()[0] == 3 * data.where("split = 'test'").count()
    saved = done.save_best(str(tmp_path / "m"), 3)
    assert len(saved) == 3
    loaded = DecisionTreeClassificationModel.load(str(tmp_path / "m" / "model_decision_tree"))
    assert loaded.numNodes == done.fitted["Decision Tree"].numNodes
    assert not stages.run_once(data.sparkSession, str(tmp_path / "m" / "model_decision_tree"), lambda: 1 / 0)


def test_cross_validation_uses_the_fold_column(data):
    lr = LogisticRegression(maxIter=3)
    train = ranking.stratified_folds(data.where("split = 'train'"), "label", "id", 3)
    cv = models.cross_validate(train, lr, [{lr.regParam: 0.1}, {lr.regParam: 5.0}], folds=3)
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.8


class Meeting(Estimator):
    """Naive Bayes that is fitted as soon as so many fits have begun."""

    meeting = None

    def _fit(self, rows):
        self.meeting.wait(60)
        return NaiveBayes().fit(rows)


def test_folds_and_refit_of_one_point_run_side_by_side(data):
    train = ranking.stratified_folds(data.where("split = 'train'"), "label", "id", 3)
    Meeting.meeting = threading.Barrier(4)  # three folds and the refit: one after the other they would never meet
    cv = models.cross_validate(train, Meeting(), [{}], folds=3, parallelism=4)
    assert len(cv.avgMetrics) == 1 and cv.bestModel.numClasses == 3


def test_cross_validation_scores_as_spark_does(data):
    lr = LogisticRegression(maxIter=4)
    train = stages.cut(ranking.stratified_folds(data.where("split = 'train'"), "label", "id", 3))
    grid = [{lr.regParam: 5.0}, {lr.regParam: 0.1}]
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    for points in (grid, [{}]):
        theirs = CrossValidator(estimator=lr, estimatorParamMaps=points, evaluator=evaluator, numFolds=3, foldCol="fold").fit(train)
        ours = models.cross_validate(train, lr, points, folds=3, parallelism=8)
        assert ours.avgMetrics == theirs.avgMetrics and ours.stdMetrics == theirs.stdMetrics
        assert ours.bestModel.coefficientMatrix == theirs.bestModel.coefficientMatrix
        assert ours.getNumFolds() == 3


def test_cross_validation_asks_for_rows_in_every_fold(data):
    lr = LogisticRegression(maxIter=2)
    train = ranking.stratified_folds(data.where("split = 'train'"), "label", "id", 3)
    for bad in (train.where("fold < 2"), train.where("fold = 0"), train.withColumn("fold", F.col("fold") + 1), train.withColumn("fold", F.lit(None).cast("int"))):
        with pytest.raises(ValueError, match="fold"):
            models.cross_validate(bad, lr, [{}], folds=3)


def test_training_rows_come_without_their_lineage(data, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "cross_validate", lambda train, *_: seen.append(train) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        models.train_and_evaluate(data, "id", {"Naive Bayes": models.models()["Naive Bayes"]})
    steps = seen[0].rdd.toDebugString().decode()
    assert "ReliableCheckpointRDD" in steps and "Shuffled" not in steps and "InMemory" not in steps


def test_multilabel(spark):
    rows = spark.range(120).select(
        "id",
        F.concat_ws(",", F.when(F.col("id") % 2 == 0, "even"), F.when(F.col("id") % 3 == 0, "three"), F.lit("all")).alias("t"),
        F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "e"), F.when(F.col("id") % 3 == 0, "t"), F.lit("x")).alias("text"),
    )
    rows = prepare.binarize_labels(rows, "t", classes=["even", "three"])
    rows = ranking.hash_split(prepare.hash_tokens(rows, "text", 64), "id")
    pred = models.fit_multilabel(rows, "id", ["even", "three"])
    assert pred.count() == 240
    assert pred.where(F.col("label") != F.col("predicted")).count() == 0


def test_minmax_constant_columns(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>").select(array_to_vector("v").alias("raw_features"))
    half = prepare.fit_minmax(df).transform(df).select(vector_to_array("features").alias("f")).collect()
    zero = prepare.fit_minmax(df, constant="zero").transform(df).select(vector_to_array("features").alias("f")).collect()
    assert sorted(r["f"] for r in half) == [[0.0, 0.5], [1.0, 0.5]]
    assert sorted(r["f"] for r in zero) == [[0.0, 0.0], [1.0, 0.0]]
    assert isinstance(prepare.fit_minmax(df), PipelineModel)


def test_bits_to_vector_is_sparse(spark):
    df = spark.createDataFrame([([0, 3],), ([],), ([9],)], "bits array<int>")
    got = [r["features"] for r in prepare.bits_to_vector(df, "bits", 10).collect()]
    assert [list(v.indices) for v in got] == [[0, 3], [], [9]]
    assert all(v.size == 10 and set(v.values) <= {1.0} for v in got)


def test_drop_constant_bits(spark):
    df = spark.createDataFrame([([0, 3],), ([0],), ([0, 9],)], "bits array<int>")
    assert sorted(r["bits"] for r in prepare.drop_constant_bits(df, "bits", df).collect()) == [[], [3], [9]]


def test_hash_tokens_reads_whole_text(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(900)),), (None,)], "t string")
    whole = prepare.hash_tokens(df, "t", 4096).select(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)).collect()
    assert [r[0] for r in whole] == [900.0, 0.0]


def test_require_target(spark):
    with pytest.raises(ValueError):
        prepare.require_target(spark.range(1).withColumn("target", F.lit(1)))


def test_model_queries_run_the_whole_job(spark, sf, monkeypatch):
    asked = {}

    class Stop(Exception):
        pass

    def note(name):
        def instead(*args, **kwargs):
            asked[name] = (args, kwargs)
            raise Stop

        return instead

    for query, part in (("lr_deep_grid", "deep_grid"), ("width_sweep", "width_sweep"), ("save_best_models", "train_and_evaluate")):
        with monkeypatch.context() as patch:
            patch.setattr(learn.models, part, note(query))
            with pytest.raises(Stop):
                QUERIES[query](spark, sf)
    assert len(asked["lr_deep_grid"][0]) == 2 and not asked["lr_deep_grid"][1]  # all axes, five folds
    args, kwargs = asked["width_sweep"]
    assert len(args) == 3 and "widths" not in kwargs and len(SWEEP_WIDTHS) == 18
    assert set(kwargs["candidates"]) == set(models.models())
    assert set(asked["save_best_models"][0][2]) == set(models.models())
