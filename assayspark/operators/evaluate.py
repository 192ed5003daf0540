"""Evaluation of prediction tables.

Multi-class tables have (label, prediction); multi-label tables are in long
form (row_id, class_id, label 0/1, score, predicted 0/1).  Everything is
reduced to counts per class first, so only the first aggregation sees the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayspark.operators.spread import ROWS_PER_BUCKET, running_totals
from assayspark.sources.stages import cut


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


# --- multi-class -----------------------------------------------------------


def confusion(pred: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(by..., label, prediction, n), counted from one table: label and prediction stay on their row."""
    return pred.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, classes: Sequence | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per true label, one column ``p_<class>`` per predicted class."""
    if classes is None:
        seen = counts.select(F.explode(F.array(F.col("label").cast("double"), F.col("prediction").cast("double"))).alias("c"))
        classes = sorted(r["c"] for r in seen.distinct().collect())
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction") == F.lit(c), F.col("n"))), F.lit(0)).alias(
            f"p_{int(c) if float(c).is_integer() else c}"
        )
        for c in classes
    ]
    return counts.groupBy(*by, "label").agg(*cells)


def one_vs_rest_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, TN per class from the confusion counts."""
    hit = F.col("label") == F.col("prediction")
    n, zero = F.col("n"), F.lit(0).cast("long")

    def cell(name: str, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(
            F.col(name).cast("double").alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
        )

    both = F.array(
        cell("label", F.when(hit, n).otherwise(zero), zero, F.when(hit, zero).otherwise(n)),
        cell("prediction", zero, F.when(hit, zero).otherwise(n), zero),
    )
    per_class = (
        counts.select(*by, F.explode(both).alias("_c"))
        .groupBy(*by, "_c.class")
        .agg(F.sum("_c.tp").alias("tp"), F.sum("_c.fp").alias("fp"), F.sum("_c.fn").alias("fn"))
    )
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
        whole = per_class.join(totals, list(by))
    else:
        whole = per_class.withColumn("_total", counts.agg(F.sum("n").alias("t")).scalar())
    tn = F.col("_total") - F.col("tp") - F.col("fp") - F.col("fn")
    return whole.select(*by, "class", "tp", "fp", "fn", tn.alias("tn"))


def multiclass_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, per ``by`` group."""
    return metrics_from_counts(confusion(pred, by), by)


def metrics_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = _ratio(F.lit(2.0) * precision * recall, precision + recall)
    support = tp + fn
    total = F.sum(support)
    return (
        one_vs_rest_counts(counts, by)
        .groupBy(*by)
        .agg(
            (F.sum(tp) / total).alias("accuracy"),
            (F.sum(support * precision) / total).alias("weighted_precision"),
            (F.sum(support * recall) / total).alias("weighted_recall"),
            (F.sum(support * f1) / total).alias("f1"),
        )
    )


def metrics_by_split(pred: DataFrame, model: str = "model", split: str = "split") -> DataFrame:
    """Train and test metrics side by side, one row per model."""
    long = multiclass_metrics(pred, [model, split])
    names = ["accuracy", "weighted_precision", "weighted_recall", "f1"]
    cells = [
        F.max(F.when(F.col(split) == part, F.col(m))).alias(f"{part}_{m}") for m in names for part in ("train", "test")
    ]
    return long.groupBy(model).agg(*cells)


def balanced_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Balanced accuracy and geometric mean of the per-class recall (classes that occur)."""
    recall = F.col("tp") / (F.col("tp") + F.col("fn"))
    rows = one_vs_rest_counts(confusion(pred, by), by).where(F.col("tp") + F.col("fn") > 0)
    # ln 0 is NULL in Spark, so a class that is never found is handled apart
    geometric = F.when(F.min(recall) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(recall))))
    return rows.groupBy(*by).agg(F.avg(recall).alias("balanced_accuracy"), geometric.alias("geometric_mean"))


# --- multi-label -----------------------------------------------------------


def multilabel_confusion(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TN, FP, FN, TP per class: the 2x2 matrix [[tn, fp], [fn, tp]]."""
    y, p = F.col("label") == 1, F.col("predicted") == 1

    def count(c: Column) -> Column:
        return F.count(F.when(c, 1))

    return pred.groupBy(*by, "class_id").agg(
        count(~y & ~p).alias("tn"), count(~y & p).alias("fp"), count(y & ~p).alias("fn"), count(y & p).alias("tp")
    )


def class_precision(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP / (TP + FP) per class, 0 where nothing was predicted."""
    return multilabel_confusion(pred, by).select(*by, "class_id", _precision().alias("class_precision"))


def class_precision_mean(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return class_precision(pred, by).groupBy(*by).agg(F.avg("class_precision").alias("class_avg_precision"))


def _precision() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def subset_accuracy(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose whole label vector is right."""
    rows = pred.groupBy(*by, "row_id").agg(F.min((F.col("label") == F.col("predicted")).cast("int")).alias("_ok"))
    return rows.groupBy(*by).agg(F.avg("_ok").alias("subset_accuracy"))


def _weighted_prf() -> list[Column]:
    """Support-weighted means over a table of class counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    support = tp + fn
    parts = {
        "precision": _precision(),
        "recall": _ratio(tp, support),
        "f1": _ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn),
    }
    return [_ratio(F.sum(support * c), F.sum(support)).alias(n) for n, c in parts.items()]


def multilabel_prf(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted precision, recall and F1; 0 on empty denominators."""
    return multilabel_confusion(pred, by).groupBy(*by).agg(*_weighted_prf())


def score_steps(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., class_id, score, pos, neg, tp, fp): the rows reduced to distinct scores, so ties are one step."""
    y, p = F.col("label").cast("long"), F.col("predicted").cast("long")
    return pred.groupBy(*by, "class_id", "score").agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp")
    )


def score_areas(pred: DataFrame, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """ROC-AUC and average precision per class, with the class support.

    A class without both outcomes has no ROC-AUC (NULL)."""
    return areas_from_steps(score_steps(pred, by), by, rows_per_bucket)


def areas_from_steps(steps: DataFrame, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The areas from distinct scores.  The running totals along the score are
    taken in two levels: a class of any size is sorted by many tasks."""
    group = [*by, "class_id"]
    sums = {"_cpos": F.col("pos"), "_cneg": F.col("neg")}
    run = running_totals(steps, ["score"], sums, group, rows_per_bucket=rows_per_bucket, with_total=True)
    pos, neg = F.col("pos"), F.col("neg")
    all_pos, all_neg = F.col("_cpos_total"), F.col("_cneg_total")
    below = F.col("_cneg") - neg + neg / F.lit(2.0)
    at_or_above_pos = all_pos - F.col("_cpos") + pos
    at_or_above_neg = all_neg - F.col("_cneg") + neg
    precision_here = at_or_above_pos / (at_or_above_pos + at_or_above_neg)
    sides = (F.col("support") > 0) & (F.col("_negatives") > 0)
    return (
        run.groupBy(*group)
        .agg(
            F.sum(pos * below).alias("_wins"),
            F.sum(pos * precision_here).alias("_area"),
            F.max(all_pos).alias("support"),
            F.max(all_neg).alias("_negatives"),
        )
        .select(
            *group,
            F.when(sides, F.col("_wins") / F.col("support") / F.col("_negatives")).alias("roc_auc"),
            F.when(F.col("support") > 0, F.col("_area") / F.col("support")).alias("pr_auc"),
            "support",
        )
    )


def _support_mean(c: str) -> Column:
    """Support-weighted mean over the classes for which the measure exists."""
    known = F.when(F.col(c).isNotNull(), F.col("support"))
    return (F.sum(F.col(c) * known) / F.sum(known)).alias(c)


def roc_auc(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted ROC-AUC over the classes."""
    return score_areas(pred, by).groupBy(*by).agg(_support_mean("roc_auc"))


def pr_auc(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support-weighted average precision over the classes."""
    return score_areas(pred, by).groupBy(*by).agg(_support_mean("pr_auc"))


def _losses(eps: float) -> tuple[Column, Column]:
    """The loss of a positive and of a negative cell at ``score``."""
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1.0 - eps))
    return -F.log(p), -F.log(F.lit(1.0) - p)


def log_loss(pred: DataFrame, by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    """Mean binary cross-entropy over all (row, class) cells; scores are probabilities."""
    of_pos, of_neg = _losses(eps)
    return pred.groupBy(*by).agg(F.avg(F.col("label") * of_pos + (1 - F.col("label")) * of_neg).alias("log_loss"))


def fold_metrics(pred: DataFrame, fold: str = "fold", split: str = "split", eps: float = 1e-15) -> DataFrame:
    """All multi-label metrics, one row per fold and split.

    Two passes over the predictions: one per row for the subset accuracy, and
    one into distinct scores, from which everything else follows."""
    by = [fold, split]
    steps = cut(score_steps(pred, by))
    of_pos, of_neg = _losses(eps)
    classes = steps.groupBy(*by, "class_id").agg(
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        (F.sum("pos") - F.sum("tp")).alias("fn"),
        F.sum(F.col("pos") * of_pos + F.col("neg") * of_neg).alias("_loss"),
        F.sum(F.col("pos") + F.col("neg")).alias("_cells"),
    )
    loss = (F.sum("_loss") / F.sum("_cells")).alias("log_loss")
    counted = classes.groupBy(*by).agg(*_weighted_prf(), F.avg(_precision()).alias("class_avg_precision"), loss)
    areas = areas_from_steps(steps, by).groupBy(*by).agg(_support_mean("roc_auc"), _support_mean("pr_auc"))
    return counted.join(subset_accuracy(pred, by), by, "left").join(areas, by, "left")
