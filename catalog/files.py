"""Sources, sinks and stages: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayspark.operators import cluster, evaluate, ranking
from assayspark.plans import runs
from assayspark.sources import files, stages, tables
from assayspark.sources.tables import load_table
from catalog.evaluate import PRED, pred
from catalog.ranking import _SPLIT
from catalog.registry import query, rounded

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("tsv_round_trip", "SELECT * FROM part")
def _(spark, sf):
    path = stages.fresh_path(spark, "tsv")
    files.write_tsv(load_table(spark, sf, "part"), path)
    return files.read_tsv(spark, path, PART)


@query("tsv_columns", "SELECT p_partkey, p_retailprice FROM part")
def _(spark, sf):
    path = stages.fresh_path(spark, "tsv")
    files.write_tsv(load_table(spark, sf, "part"), path)
    return files.read_tsv(spark, path, PART, columns=["p_partkey", "p_retailprice"])


@query("parquet_splits", f"SELECT doc_id, lang FROM ({_SPLIT}) WHERE split = 'test'")
def _(spark, sf):
    path = stages.fresh_path(spark, "splits")
    docs = load_table(spark, sf, "documents").select("doc_id", "lang")
    files.write_splits(ranking.stratified_split(docs, "lang", "doc_id"), path)
    return files.read_split(spark, path, "test")


@query(
    "confusion_csv",
    f"""SELECT l::DOUBLE AS label, p::DOUBLE AS prediction, count(vec_id)::BIGINT AS n
FROM (SELECT unnest(range(10)) AS l) CROSS JOIN (SELECT unnest(range(10)) AS p)
LEFT JOIN ({PRED}) ON label = l AND prediction = p GROUP BY ALL""",
)
def _(spark, sf):
    path = stages.fresh_path(spark, "confusion")
    files.write_confusion(evaluate.confusion_matrix(evaluate.confusion(pred(spark, sf))), path)
    return files.read_confusion(spark, path)


@query("cluster_files", "SELECT p_partkey, p_retailprice, p_size AS cluster_id FROM part")
def _(spark, sf):
    path = stages.fresh_path(spark, "clusters")
    part = load_table(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_size").alias("cluster_id"))
    files.write_clusters(part, path, order="p_retailprice")
    schema = "p_partkey bigint, p_retailprice double, cluster_id int"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


@query("names_list", "SELECT DISTINCT n_name AS name FROM nation")
def _(spark, sf):
    path = stages.fresh_path(spark, "names")
    load_table(spark, sf, "nation").select("n_name").write.text(path)
    return files.read_names(spark, path)


@query("create_table_as", "SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def _(spark, sf):
    path = stages.fresh_path(spark, "table")
    counts = load_table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    return tables.create_table_as(counts, "nations_per_region", path)


@query("materialize", "SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(spark, sf):
    """The second call finds the finished stage and reads it."""
    path = stages.fresh_path(spark, "stage")

    def build():
        return load_table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))

    stages.materialize(spark, path, build)
    return stages.materialize(spark, path, build)


@query("append_results", "SELECT event_type AS model, round(avg(value), 6) AS score FROM events GROUP BY 1 UNION ALL SELECT 'all', round(avg(value), 6) FROM events")
def _(spark, sf):
    path = stages.fresh_path(spark, "log")
    e = load_table(spark, sf, "events")
    files.append_results(rounded(e.groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("score"))), path)
    files.append_results(rounded(e.agg(F.avg("value").alias("score")).select(F.lit("all").alias("model"), "score")), path)
    return files.read_tsv(spark, path, "model string, score double")


# --- run metrics: one document per event type, one epoch per user residue --------

_BASE = """SELECT event_type AS model, (user_id % 10)::INT AS pos, round(avg(value) / 100, 4) AS a,
  round(count(*) / 2000.0, 4)::DOUBLE AS b, count(*)::BIGINT AS n FROM events GROUP BY ALL"""
_NUMBERS = ("loss", "accuracy", "precision", "recall", "f1", "class_avg_accuracy")


def base(spark, sf):
    return (
        load_table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 10).cast("int").alias("pos"))
        .agg(
            F.round(F.avg("value") / 100, 4).alias("a"),
            F.round(F.count(F.lit(1)) / 2000.0, 4).alias("b"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def run_documents(spark, sf):
    """Nested run documents built from per-type aggregates of the events."""
    numbers = [
        (F.col("a") + i / 10 + F.col("b") * j).alias(f"{part}_{name}")
        for i, part in enumerate(("train", "val", "test"))
        for j, name in enumerate(_NUMBERS)
    ]
    n = F.col("n")
    matrix = F.array(F.array(F.array(n, n + 1), F.array(n + 2, n + 3)), F.array(F.array(n * 2, n), F.array(n, n * 3)))
    epoch = F.struct(
        (F.floor(F.col("pos") / 5) + 1).cast("int").alias("fold"),
        (F.col("pos") % 5 + 1).cast("int").alias("epoch"),
        *numbers,
        F.array("a", "b").alias("test_class_accuracies"),
        F.col("a").alias("roc_auc"),
        F.col("b").alias("pr_auc"),
        matrix.alias("conf_matrix"),
    )
    epochs = F.transform(F.array_sort(F.collect_list(F.struct("pos", epoch.alias("e")))), lambda x: x["e"])
    # ten epochs per model
    return base(spark, sf).groupBy("model").agg(
        epochs.alias("epoch_metrics"),
        F.max("a").alias("accuracy"),
        F.max("b").alias("precision"),
        F.min("a").alias("recall"),
        F.min("b").alias("f1"),
        F.avg("a").alias("test_loss"),
        F.struct(F.lit(1e-5).alias("learning_rate"), F.count(F.lit(1)).cast("int").alias("epochs")).alias("best_params"),
    )


def stored_runs(spark, sf, **more):
    path = stages.fresh_path(spark, "runs")
    return files.read_run_metrics(spark, files.write_run_metrics(run_documents(spark, sf), path), **more)


@query(
    "run_metrics",
    f"""SELECT model, count(*)::BIGINT AS epochs, round(max(a), 6) AS accuracy, round(avg(a), 6) AS test_loss FROM ({_BASE}) GROUP BY model""",
)
def _(spark, sf):
    r = stored_runs(spark, sf)
    return rounded(r.select("model", F.size("epoch_metrics").cast("long").alias("epochs"), "accuracy", "test_loss"))


@query(
    "run_metrics_fixed_order",
    f"""SELECT model, round(max(a), 6) AS test_loss, round(max(b), 6) AS accuracy, round(min(a), 6) AS precision,
  round(min(b), 6) AS recall, round(avg(a), 6) AS f1 FROM ({_BASE}) GROUP BY model""",
)
def _(spark, sf):
    r = stored_runs(spark, sf, fix_order=True)
    return rounded(r.select("model", "test_loss", "accuracy", "precision", "recall", "f1"))


_MEANS = f"""SELECT model, round(avg(a + 0.2 + b * 5), 6) AS class_avg_accuracy, round(avg(a + 0.2 + b * 2), 6) AS precision,
  round(avg(a + 0.2 + b * 3), 6) AS recall, round(avg(a + 0.2 + b * 4), 6) AS f1, round(avg(a), 6) AS val_roc_auc,
  round(avg(b), 6) AS val_pr_auc FROM ({_BASE}) GROUP BY model"""


@query("mean_metrics", _MEANS)
def _(spark, sf):
    return rounded(runs.mean_metrics(stored_runs(spark, sf)))


_BEST = f"""SELECT *, round(a + 0.1 + b * 4, 6) AS val_f1
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY a + 0.1::DOUBLE + b * 4 DESC, pos) AS rn FROM ({_BASE})) WHERE rn = 1"""


@query("best_epoch", f"SELECT model, pos // 5 + 1 AS fold, pos % 5 + 1 AS epoch, val_f1 FROM ({_BEST})")
def _(spark, sf):
    return rounded(runs.best_epoch(stored_runs(spark, sf)).select("model", "fold", "epoch", "val_f1"))


@query(
    "sum_confusion",
    f"""SELECT model, i, j, (CASE WHEN i = 0 AND j = 0 THEN 3 * n WHEN i = 0 THEN 2 * n + 1
  WHEN j = 0 THEN 2 * n + 2 ELSE 4 * n + 3 END)::BIGINT AS n
FROM ({_BEST}), (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j)""",
)
def _(spark, sf):
    return runs.sum_confusion(runs.best_epoch(stored_runs(spark, sf)))


@query(
    "consolidated_report",
    f"""SELECT m.*, e.epochs, e.test_loss FROM ({_MEANS}) m
JOIN (SELECT model, count(*)::INT AS epochs, round(avg(a), 6) AS test_loss FROM ({_BASE}) GROUP BY 1) e USING (model)""",
)
def _(spark, sf):
    """The report is written as JSON and read back."""
    path = stages.fresh_path(spark, "report")
    files.write_report(runs.consolidated_report(stored_runs(spark, sf)), path)
    names = ["test_loss", *runs.REPORT]
    metrics = ", ".join(f"{n}: double" for n in names)
    schema = f"model string, best_params struct<learning_rate: double, epochs: int>, final_metrics struct<{metrics}>"
    report = spark.read.schema(schema).json(path)
    return rounded(report.select("model", F.col("best_params.epochs").alias("epochs"), *[f"final_metrics.{n}" for n in names]))
