import json
import os

import pytest
from pyspark.sql import functions as F

from assayspark.plans import runs
from assayspark.sources import files, stages, tables


def epoch(fold, n, f1, **more):
    base = {f"{p}_{m}": 0.1 * n for p in ("train", "val", "test") for m in ("loss", "accuracy", "precision", "recall", "f1", "class_avg_accuracy")}
    base |= {"fold": fold, "epoch": n, "val_f1": f1, "roc_auc": 0.5 + n / 10, "pr_auc": 0.4, "epoch_duration": 1.5}
    base["conf_matrix"] = [[[n, 1], [2, 3]], [[4, 5], [6, 7]]]
    return base | more


@pytest.fixture(scope="module")
def run_dir(tmp_path_factory):
    path = tmp_path_factory.mktemp("runs")
    for name, f1s in (("org_model-A", [0.5, 0.9, 0.9]), ("org_model-B", [0.8, 0.2])):
        doc = {
            "epoch_metrics": [epoch(1, i + 1, f) for i, f in enumerate(f1s)],
            # shifted by one place, as some writers store them
            "accuracy": 0.31, "precision": 0.71, "recall": 0.61, "f1": 0.51, "test_loss": 0.41,
            "best_params": {"learning_rate": 2e-5, "epochs": len(f1s)},
            "training_time": 12.5,
        }
        (path / f"metrics_{name}.json").write_text(json.dumps(doc, indent=4))
    return path


def test_run_reports(spark, run_dir, capsys):
    paths = [str(run_dir / f"metrics_{m}.json") for m in ("org_model-A", "org_model-B", "gone")]
    got = files.read_run_metrics(spark, paths)
    assert "gone" in capsys.readouterr().out
    assert sorted(r["model"] for r in got.collect()) == ["org_model-A", "org_model-B"]
    best = {r["model"]: (r["epoch"], r["val_f1"]) for r in runs.best_epoch(got).collect()}
    assert best == {"org_model-A": (2, 0.9), "org_model-B": (1, 0.8)}
    summed = {(r["model"], r["i"], r["j"]): r["n"] for r in runs.sum_confusion(runs.best_epoch(got)).collect()}
    assert summed[("org_model-A", 0, 0)] == 2 + 4 and summed[("org_model-B", 1, 1)] == 10
    means = {r["model"]: r for r in runs.mean_metrics(got).collect()}
    assert abs(means["org_model-A"]["precision"] - 0.2) < 1e-12
    assert abs(means["org_model-A"]["val_roc_auc"] - 0.7) < 1e-12
    report = {r["model"]: r for r in runs.consolidated_report(got).collect()}
    assert report["org_model-B"]["best_params"]["epochs"] == 2
    assert report["org_model-B"]["final_metrics"]["test_loss"] == 0.41
    glob = files.read_run_metrics(spark, str(run_dir / "metrics_*.json"), fix_order=True).first()
    assert (glob["test_loss"], glob["accuracy"], glob["precision"], glob["recall"], glob["f1"]) == (0.31, 0.71, 0.61, 0.51, 0.41)
    assert files.read_run_metrics(spark, [str(run_dir / "nothing.json")]).count() == 0


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 1.5), (2, None, None), (3, "tab\there", -2.0)], "id int, s string, v double")
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(files.read_tsv(spark, str(tmp_path / "t"), df.schema).collect()) == sorted(df.collect())
    one = files.read_tsv(spark, str(tmp_path / "t"), df.schema, columns=["v"])
    assert one.columns == ["v"]
    (tmp_path / "bad.tsv").write_text("id\tv\n1\tabc\n2\t3.5\n")
    assert files.read_tsv(spark, str(tmp_path / "bad.tsv"), "id int, v double").orderBy("id").collect() == [(1, None), (2, 3.5)]


def test_confusion_without_a_label_column(spark, tmp_path):
    (tmp_path / "cm.csv").write_text("0,1,2\n5,1,0\n2,7,3\n0,0,9\n")
    got = {(r["label"], r["prediction"]): r["n"] for r in files.read_confusion(spark, str(tmp_path / "cm.csv")).collect()}
    assert got == {(i, j): n for i, row in enumerate([[5, 1, 0], [2, 7, 3], [0, 0, 9]]) for j, n in enumerate(row)}


def test_clusters_get_one_folder_each_and_hot_ones_several_files(spark, tmp_path):
    df = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5 + 1).alias("cluster_id"), (F.col("id") * 37 % 101).cast("double").alias("weight"))
    path = str(tmp_path / "clusters")
    # tiny partitions would otherwise be merged into one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_clusters(df, path, rows_per_task=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.option("sep", "\t").option("header", True).schema("id long, weight double, cluster_id int").csv(path)
    assert back.count() == 600 and back.select("id").distinct().count() == 600
    parts = {d: [f for f in os.listdir(f"{path}/{d}") if f.endswith(".csv")] for d in os.listdir(path) if d.startswith("cluster_id=")}
    assert len(parts) == 6 and len(parts["cluster_id=0"]) > 1
    assert all(len(names) <= 2 for d, names in parts.items() if d != "cluster_id=0")
    for d, names in parts.items():
        for name in names:
            with open(f"{path}/{d}/{name}") as f:
                weights = [float(line.split("\t")[1]) for line in f.read().splitlines()[1:]]
            assert weights == sorted(weights)


def test_materialize_resumes_only_finished_stages(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build():
        calls.append(1)
        return spark.range(5)

    assert stages.materialize(spark, path, build).count() == 5
    assert stages.materialize(spark, path, build).count() == 5
    assert len(calls) == 1
    os.remove(f"{path}/_SUCCESS")
    assert stages.materialize(spark, path, build).count() == 5
    assert len(calls) == 2


def test_cut_uses_the_configured_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert stages.shared_dir(spark) == folder
    df = stages.cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert os.listdir(folder)


def test_table_and_views(spark, sf, tmp_path):
    tables.load_tables(spark, sf, ["nation", "region"], views=True)
    df = spark.sql("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
    stored = tables.create_table_as(df, "nations_by_region", str(tmp_path / "tbl"))
    assert stored.agg(F.sum("n")).first()[0] == 25


def test_spread_scan(spark, sf):
    scan = tables.load_table(spark, sf, "documents")
    assert tables.spread_scan(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = scan.repartition(16)
    assert tables.spread_scan(many) is many


def test_names_and_results(spark, tmp_path):
    (tmp_path / "names.txt").write_text("org/a\n\n  org/b \n")
    assert [r["name"] for r in files.read_names(spark, str(tmp_path / "names.txt")).collect()] == ["org/a", "org/b"]
    one = spark.createDataFrame([("a", 0.5)], "model string, score double")
    for _ in range(2):
        files.append_results(one, str(tmp_path / "log"))
    assert files.read_tsv(spark, str(tmp_path / "log"), one.schema).collect() == [("a", 0.5), ("a", 0.5)]


def test_saved_model_scores_alike_after_loading(spark, tmp_path):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.linalg import Vectors

    from assayspark.sources import stages

    points = [(0.0, Vectors.dense(1.0, 0.0)), (1.0, Vectors.dense(0.0, 3.0))] * 5
    rows = spark.createDataFrame(points, ["label", "features"])
    model = NaiveBayes().fit(rows)
    stages.save_model(model, str(tmp_path / "nb"))
    again = stages.load_model(spark, str(tmp_path / "nb"))
    assert type(again) is type(model)
    assert again.transform(rows).select("prediction").collect() == model.transform(rows).select("prediction").collect()


def test_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from assayspark.sources import stages

    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://head:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_a_run_is_logged_once(spark, tmp_path):
    log, schema = str(tmp_path / "runs"), "model string, score double"
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.25)], schema)
    assert files.append_results(rows, log, "run-1") and not files.append_results(rows, log, "run-1")
    with pytest.raises(Exception):  # a run that fails on the way
        files.append_results(rows.select("model", F.raise_error("lost").alias("score")), log, "run-2")
    assert sorted(tuple(r) for r in files.read_results(spark, log, schema).collect()) == [("a", 0.5), ("b", 0.25)]
    assert files.append_results(rows.limit(1), log, "run-2")
    assert files.read_results(spark, log, schema).count() == 3
