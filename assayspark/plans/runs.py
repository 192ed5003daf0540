"""Reports over run metrics (see ``sources.files.read_run_metrics``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayspark.functions.columns import last_part

# report name -> per-epoch field; the per-epoch AUCs are those of the validation part
REPORT = {
    "class_avg_accuracy": "test_class_avg_accuracy",
    "precision": "test_precision",
    "recall": "test_recall",
    "f1": "test_f1",
    "val_roc_auc": "roc_auc",
    "val_pr_auc": "pr_auc",
}


def epochs(runs: DataFrame) -> DataFrame:
    """One row per model and epoch, with the position in the file."""
    return runs.select("model", F.posexplode("epoch_metrics").alias("pos", "e")).select("model", "pos", "e.*")


def mean_metrics(runs: DataFrame) -> DataFrame:
    """Means over all epochs, one row per model."""
    return epochs(runs).groupBy("model").agg(*[F.avg(source).alias(name) for name, source in REPORT.items()])


def best_epoch(runs: DataFrame) -> DataFrame:
    """The epoch with the highest validation F1 per model; the first one wins ties."""
    rows = epochs(runs).where(F.col("val_f1").isNotNull())
    rest = [c for c in rows.columns if c != "model"]
    # max_by on (f1, -position) combines before the shuffle
    best = rows.groupBy("model").agg(F.max_by(F.struct(*rest), F.struct("val_f1", -F.col("pos"))).alias("_b"))
    return best.select("model", *[F.col(f"_b.{c}").alias(c) for c in rest])


def sum_confusion(best: DataFrame) -> DataFrame:
    """Element-wise sum of the per-class 2x2 matrices, as (model, i, j, n)."""
    rows = best.select("model", F.explode("conf_matrix").alias("m"))
    rows = rows.select("model", F.posexplode("m").alias("i", "row"))
    cells = rows.select("model", "i", F.posexplode("row").alias("j", "v"))
    return cells.groupBy("model", "i", "j").agg(F.sum("v").alias("n"))


def consolidated_report(runs: DataFrame) -> DataFrame:
    """One document per model: best parameters and final metrics."""
    names = list(REPORT)
    top = runs.select("model", "best_params", "test_loss")
    joined = top.join(mean_metrics(runs), "model", "left")
    return joined.select(
        "model",
        last_part("model").alias("display_name"),
        "best_params",
        F.struct("test_loss", *names).alias("final_metrics"),
    )
