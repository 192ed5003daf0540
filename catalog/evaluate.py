"""Evaluation of prediction tables made from the labels in the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayspark.operators import evaluate
from assayspark.plans import prepare
from assayspark.sources.tables import load_table
from catalog.registry import query, rounded

PRED = """SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS prediction,
  CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings"""


def pred(spark, sf):
    return load_table(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        F.expr("CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END").alias("prediction"),
        F.expr("CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END").alias("split"),
    )


@query("confusion", f"SELECT label, prediction, count(*)::BIGINT AS n FROM ({PRED}) GROUP BY ALL")
def _(spark, sf):
    return evaluate.confusion(pred(spark, sf))


@query(
    "confusion_matrix",
    "SELECT label, " + ", ".join(f"count(*) FILTER (prediction = {c}) AS p_{c}" for c in range(10)) + f" FROM ({PRED}) GROUP BY label",
)
def _(spark, sf):
    return evaluate.confusion_matrix(evaluate.confusion(pred(spark, sf)))


_OVR = f"""p AS ({PRED}), o AS (SELECT c::DOUBLE AS class, count(*) FILTER (label = c AND prediction = c) AS tp,
  count(*) FILTER (label <> c AND prediction = c) AS fp, count(*) FILTER (label = c AND prediction <> c) AS fn,
  count(*) FILTER (label <> c AND prediction <> c) AS tn FROM p, (SELECT unnest(range(10)) AS c) GROUP BY c)"""


@query("one_vs_rest_counts", f"WITH {_OVR} SELECT * FROM o")
def _(spark, sf):
    return evaluate.one_vs_rest_counts(evaluate.confusion(pred(spark, sf)))


def _weighted(by: str = "") -> str:
    on, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""p AS ({PRED}), o AS (SELECT {on} c AS class, count(*) FILTER (label = c AND prediction = c) AS tp,
  count(*) FILTER (label <> c AND prediction = c) AS fp, count(*) FILTER (label = c AND prediction <> c) AS fn
  FROM p, (SELECT unnest(range(10)) AS c) GROUP BY {on} c),
x AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re FROM o),
y AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f FROM x),
m AS (SELECT {on} sum(tp) / sum(tp + fn) AS accuracy, sum((tp + fn) * pr) / sum(tp + fn) AS weighted_precision,
  sum((tp + fn) * re) / sum(tp + fn) AS weighted_recall, sum((tp + fn) * f) / sum(tp + fn) AS f1 FROM y {grp})"""


@query(
    "multiclass_metrics",
    f"""WITH {_weighted()} SELECT round(accuracy, 6) AS accuracy, round(weighted_precision, 6) AS weighted_precision,
round(weighted_recall, 6) AS weighted_recall, round(f1, 6) AS f1 FROM m""",
)
def _(spark, sf):
    return rounded(evaluate.multiclass_metrics(pred(spark, sf)))


_SIDES = ", ".join(
    f"round(max({m}) FILTER (split = '{s}'), 6) AS {s}_{m}"
    for m in ("accuracy", "weighted_precision", "weighted_recall", "f1")
    for s in ("train", "test")
)


@query("metrics_by_split", f"WITH {_weighted('split')} SELECT 'guess' AS model, {_SIDES} FROM m")
def _(spark, sf):
    return rounded(evaluate.metrics_by_split(pred(spark, sf).withColumn("model", F.lit("guess"))))


@query(
    "balanced_metrics",
    f"""WITH {_OVR} SELECT round(avg(tp / (tp + fn)), 6) AS balanced_accuracy,
  round(exp(avg(ln(tp / (tp + fn)))), 6) AS geometric_mean FROM o WHERE tp + fn > 0""",
)
def _(spark, sf):
    return rounded(evaluate.balanced_metrics(pred(spark, sf)))


# --- multi-label: users and the event types they have ------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]
_TARGETS = """SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS target
FROM events GROUP BY user_id"""
_ML = f"""ml AS (SELECT user_id AS row_id, c::INT AS class_id, list_contains(string_split(target, ','), names[c + 1])::INT AS label,
  ((user_id * 37 + c * 11) % 101) / 100.0::DOUBLE AS score,
  (((user_id * 37 + c * 11) % 101) / 100.0::DOUBLE > 0.5)::INT AS predicted,
  (user_id % 3)::INT AS fold, CASE WHEN user_id % 4 = 0 THEN 'test' ELSE 'train' END AS split
  FROM ({_TARGETS}), (SELECT unnest(range(5)) AS c), (SELECT ['click','error','purchase','signup','view'] AS names))"""


def targets(spark, sf):
    e = load_table(spark, sf, "events").select("user_id", "event_type").distinct()
    return e.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("target"))


def multilabel(spark, sf):
    rows = prepare.binarize_labels(targets(spark, sf), "target", classes=TYPES)
    long = rows.select(F.col("user_id").alias("row_id"), F.posexplode("labels").alias("class_id", "label"))
    score = ((F.col("row_id") * 37 + F.col("class_id") * 11) % 101) / 100.0
    return long.withColumns(
        {
            "score": score,
            "predicted": (score > 0.5).cast("int"),
            "fold": (F.col("row_id") % 3).cast("int"),
            "split": F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"),
        }
    )


_MC = """mc AS (SELECT class_id, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM ml GROUP BY class_id)"""


@query("multilabel_confusion", f"WITH {_ML}, {_MC} SELECT * FROM mc")
def _(spark, sf):
    return evaluate.multilabel_confusion(multilabel(spark, sf))


@query(
    "class_precision",
    f"WITH {_ML}, {_MC} SELECT class_id, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS class_precision FROM mc",
)
def _(spark, sf):
    return rounded(evaluate.class_precision(multilabel(spark, sf)))


@query(
    "class_precision_mean",
    f"WITH {_ML}, {_MC} SELECT round(avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END), 6) AS class_avg_precision FROM mc",
)
def _(spark, sf):
    return rounded(evaluate.class_precision_mean(multilabel(spark, sf)))


@query(
    "subset_accuracy",
    f"""WITH {_ML} SELECT round(avg(ok), 6) AS subset_accuracy
FROM (SELECT row_id, min((label = predicted)::INT) AS ok FROM ml GROUP BY row_id)""",
)
def _(spark, sf):
    return rounded(evaluate.subset_accuracy(multilabel(spark, sf)))


_PRF = """prf AS (SELECT sum((tp + fn) * CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) / sum(tp + fn) AS precision,
  sum((tp + fn) * CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) / sum(tp + fn) AS recall,
  sum((tp + fn) * CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) / sum(tp + fn) AS f1 FROM mc)"""


@query(
    "multilabel_prf",
    f"WITH {_ML}, {_MC}, {_PRF} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf",
)
def _(spark, sf):
    return rounded(evaluate.multilabel_prf(multilabel(spark, sf)))


# pairwise definition of the ROC area; precision at each score for the other
_AREAS = """areas AS (SELECT c.class_id,
  (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) FROM ml a JOIN ml b
    ON a.class_id = b.class_id WHERE a.class_id = c.class_id AND a.label = 1 AND b.label = 0) AS roc_auc,
  (SELECT avg((SELECT count(*) FILTER (label = 1) / count(*) FROM ml b WHERE b.class_id = a.class_id AND b.score >= a.score))
    FROM ml a WHERE a.class_id = c.class_id AND a.label = 1) AS pr_auc,
  c.support FROM (SELECT class_id, sum(label)::BIGINT AS support FROM ml GROUP BY 1) c)"""


@query(
    "score_areas",
    f"WITH {_ML}, {_AREAS} SELECT class_id, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, support FROM areas",
)
def _(spark, sf):
    return rounded(evaluate.score_areas(multilabel(spark, sf)))


@query(
    "score_areas_two_levels",
    f"WITH {_ML}, {_AREAS} SELECT class_id, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, support FROM areas",
)
def _(spark, sf):
    return rounded(evaluate.score_areas(multilabel(spark, sf), rows_per_bucket=50))


@query("roc_auc", f"WITH {_ML}, {_AREAS} SELECT round(sum(roc_auc * support) / sum(support), 6) AS roc_auc FROM areas WHERE roc_auc IS NOT NULL")
def _(spark, sf):
    return rounded(evaluate.roc_auc(multilabel(spark, sf)))


@query("pr_auc", f"WITH {_ML}, {_AREAS} SELECT round(sum(pr_auc * support) / sum(support), 6) AS pr_auc FROM areas WHERE pr_auc IS NOT NULL")
def _(spark, sf):
    return rounded(evaluate.pr_auc(multilabel(spark, sf)))


_LOSS = """avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15))
  + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))))"""


@query("log_loss", f"WITH {_ML} SELECT round({_LOSS}, 5) AS log_loss FROM ml")
def _(spark, sf):
    return rounded(evaluate.log_loss(multilabel(spark, sf)), 5)


_FOLD = f"""g AS (SELECT DISTINCT fold, split FROM ml),
mcf AS (SELECT fold, split, class_id, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM ml GROUP BY ALL),
prf AS (SELECT fold, split, sum((tp + fn) * CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) / sum(tp + fn) AS precision,
  sum((tp + fn) * CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) / sum(tp + fn) AS recall,
  sum((tp + fn) * CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) / sum(tp + fn) AS f1,
  avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) AS class_avg_precision FROM mcf GROUP BY ALL),
sub AS (SELECT fold, split, avg(ok) AS subset_accuracy
  FROM (SELECT fold, split, row_id, min((label = predicted)::INT) AS ok FROM ml GROUP BY ALL) GROUP BY ALL),
roc AS (SELECT a.fold, a.split, a.class_id, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS v
  FROM ml a JOIN ml b USING (fold, split, class_id) WHERE a.label = 1 AND b.label = 0 GROUP BY ALL),
pr AS (SELECT fold, split, class_id, avg(p) AS v FROM (SELECT a.fold, a.split, a.class_id, a.row_id,
  count(*) FILTER (b.label = 1) / count(*) AS p FROM ml a JOIN ml b ON a.fold = b.fold AND a.split = b.split
  AND a.class_id = b.class_id AND b.score >= a.score WHERE a.label = 1 GROUP BY ALL) GROUP BY ALL),
sup AS (SELECT fold, split, class_id, sum(label) AS w FROM ml GROUP BY ALL),
rocw AS (SELECT fold, split, sum(v * w) / sum(w) AS roc_auc FROM roc JOIN sup USING (fold, split, class_id) GROUP BY ALL),
prw AS (SELECT fold, split, sum(v * w) / sum(w) AS pr_auc FROM pr JOIN sup USING (fold, split, class_id) GROUP BY ALL),
los AS (SELECT fold, split, {_LOSS} AS log_loss FROM ml GROUP BY ALL)"""


@query(
    "fold_metrics",
    f"""WITH {_ML}, {_FOLD} SELECT fold, split, round(precision, 5) AS precision, round(recall, 5) AS recall, round(f1, 5) AS f1,
  round(subset_accuracy, 5) AS subset_accuracy, round(class_avg_precision, 5) AS class_avg_precision,
  round(roc_auc, 5) AS roc_auc, round(pr_auc, 5) AS pr_auc, round(log_loss, 5) AS log_loss
FROM prf LEFT JOIN sub USING (fold, split) LEFT JOIN rocw USING (fold, split) LEFT JOIN prw USING (fold, split) LEFT JOIN los USING (fold, split)""",
)
def _(spark, sf):
    return rounded(evaluate.fold_metrics(multilabel(spark, sf)), 5)


# --- labels ------------------------------------------------------------------


@query(
    "label_vocabulary",
    f"SELECT DISTINCT unnest(string_split(target, ',')) AS label FROM ({_TARGETS})",
)
def _(spark, sf):
    return prepare.label_vocabulary(targets(spark, sf), "target")


@query(
    "label_count",
    f"SELECT count(DISTINCT l)::BIGINT AS n_labels FROM (SELECT unnest(string_split(target, ',')) AS l FROM ({_TARGETS}))",
)
def _(spark, sf):
    return prepare.label_count(targets(spark, sf), "target")


@query("label_rows", f"SELECT DISTINCT user_id, unnest(string_split(target, ',')) AS label FROM ({_TARGETS})")
def _(spark, sf):
    return prepare.label_rows(targets(spark, sf), "user_id", "target")


@query(
    "binarize_labels",
    f"""SELECT user_id, array_to_string(list_transform(['click','error','purchase','signup','view'],
  lambda c: list_contains(string_split(target, ','), c)::INT), '') AS labels FROM ({_TARGETS})""",
)
def _(spark, sf):
    rows = prepare.binarize_labels(targets(spark, sf), "target")
    return rows.select("user_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"))
