"""File formats of the hand-offs: TSV, CSV, Parquet, JSON, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayspark.functions.columns import run_name
from assayspark.operators.spread import ROWS_PER_TASK, attach_by_key
from assayspark.sources.stages import publish


def read_tsv(
    spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None, sep: str = "\t"
) -> DataFrame:
    """Delimited text with a header and a declared schema; only ``columns`` are parsed if given.

    A cell that does not fit its type becomes NULL."""
    df = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .option("multiLine", False)
        .csv(path)
    )
    return df.select(*columns) if columns else df


def write_tsv(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited text with a header, one file per task."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet with one folder per split (train, test)."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, which: str, split: str = "split") -> DataFrame:
    """One split; the others are pruned by their folder."""
    return spark.read.parquet(path).where(F.col(split) == which).drop(split)


def write_confusion(matrix: DataFrame, path: str) -> None:
    """A confusion matrix as CSV, ordered by true label (as many rows as classes)."""
    matrix.orderBy("label").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    """A confusion-matrix CSV in long form (label, prediction, n).

    The file either names its labels (`write_confusion`) or has one plain column
    per class, in class order, with the true label given by the row number."""
    wide = spark.read.option("header", True).csv(path)
    if "label" not in wide.columns:
        # one small file, read in order by one task
        wide = wide.coalesce(1).withColumn("label", F.monotonically_increasing_id())
    cells = [c for c in wide.columns if c != "label"]
    numbers = wide.select(F.col("label").cast("double"), *[F.col(f"`{c}`").cast("long").alias(c) for c in cells])
    long = numbers.unpivot(["label"], [F.col(f"`{c}`") for c in cells], "prediction", "n")
    return long.select("label", F.regexp_extract("prediction", r"(?:p_)?(.+)", 1).cast("double").alias("prediction"), "n")


def write_clusters(
    members: DataFrame,
    path: str,
    cluster: str = "cluster_id",
    order: str = "weight",
    rows_per_task: int = ROWS_PER_TASK,
) -> None:
    """One folder per cluster, rows sorted by ``order`` inside each file.

    A cluster goes to one file unless it has more than ``rows_per_task`` rows;
    a larger one is dealt out by hash to several tasks, each of which writes a
    sorted file into its folder, so no task holds a whole hot cluster."""
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"))
    spread = attach_by_key(members, sizes, cluster, "_size", rows_per_task=rows_per_task)
    pieces = F.greatest(F.ceil(F.col("_size") / F.lit(rows_per_task)), F.lit(1))
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in members.columns]), pieces)
    (
        spread.withColumn("_piece", piece)
        .repartition(F.col(cluster), F.col("_piece"))
        .sortWithinPartitions(cluster, order)
        .drop("_piece", "_size")
        .write.mode("overwrite")
        .partitionBy(cluster)
        .option("sep", "\t")
        .option("header", True)
        .csv(path)
    )


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where(F.col("name") != "")


def append_results(results: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Add rows to a result log with a header.

    With ``run_id`` the rows of a run appear together or not at all, and a run that is in the log already
    changes nothing (False); such a log is read by `read_results`."""

    def write(to: str) -> None:
        results.write.mode("append").option("sep", "\t").option("header", True).csv(to)

    if run_id is None:
        write(path)
        return True
    return publish(results.sparkSession, f"{path.rstrip('/')}/run={run_id}", write)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All rows of the committed runs of a log, without those of unfinished ones."""
    return read_tsv(spark, f"{path.rstrip('/')}/run=*", schema)


# --- run metrics -----------------------------------------------------------

_PARTS = ("train", "val", "test")
_EPOCH_NUMBERS = ("loss", "accuracy", "precision", "recall", "f1")
_MATRICES = T.ArrayType(T.ArrayType(T.ArrayType(T.LongType())))


def epoch_schema() -> T.StructType:
    fields = [T.StructField("fold", T.IntegerType()), T.StructField("epoch", T.IntegerType())]
    for part in _PARTS:
        fields += [T.StructField(f"{part}_{n}", T.DoubleType()) for n in _EPOCH_NUMBERS]
        fields.append(T.StructField(f"{part}_class_accuracies", T.ArrayType(T.DoubleType())))
        fields.append(T.StructField(f"{part}_class_avg_accuracy", T.DoubleType()))
    fields += [T.StructField(n, T.DoubleType()) for n in ("roc_auc", "pr_auc")]
    fields += [T.StructField("conf_matrix", _MATRICES), T.StructField("epoch_duration", T.DoubleType())]
    return T.StructType(fields)


def run_schema() -> T.StructType:
    numbers = ["test_loss", "accuracy", "precision", "recall", "f1"]
    params = T.StructType([T.StructField("learning_rate", T.DoubleType()), T.StructField("epochs", T.IntegerType())])
    return T.StructType(
        [T.StructField("epoch_metrics", T.ArrayType(epoch_schema()))]
        + [T.StructField(n, T.DoubleType()) for n in numbers]
        + [
            T.StructField("class_accuracies", T.ArrayType(T.DoubleType())),
            T.StructField("class_avg_accuracy", T.DoubleType()),
            T.StructField("roc_auc", T.DoubleType()),
            T.StructField("pr_auc", T.DoubleType()),
            T.StructField("conf_matrix", _MATRICES),
            T.StructField("best_params", params),
            T.StructField("training_time", T.DoubleType()),
        ]
    )


def read_run_metrics(spark: SparkSession, paths: str | Sequence[str], fix_order: bool = False) -> DataFrame:
    """Run metrics, one JSON document per model file, with ``model`` from the file name.

    Paths that do not exist are skipped when several are listed.  Some writers
    store the five top-level numbers one place off: loss, accuracy, precision,
    recall and F1 under the names accuracy, precision, recall, f1 and test_loss.
    ``fix_order`` puts them back."""
    reader = spark.read.schema(run_schema()).option("multiLine", True)
    if isinstance(paths, str):
        runs = reader.json(paths)
    else:
        present = existing_paths(spark, paths)
        runs = reader.json(present) if present else spark.createDataFrame([], run_schema())
        if not present:
            return runs.withColumn("model", F.lit(None).cast("string"))
    runs = runs.withColumn("model", run_name(F.col("_metadata.file_path")))
    if fix_order:
        shifted = {"test_loss": "accuracy", "accuracy": "precision", "precision": "recall", "recall": "f1", "f1": "test_loss"}
        runs = runs.withColumns({name: F.col(source) for name, source in shifted.items()})
    return runs


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist; each missing one is reported."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    present = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            present.append(path)
        else:
            print(f"skipped, does not exist: {path}")
    return present


def write_run_metrics(runs: DataFrame, path: str) -> list[str]:
    """One ``metrics_<model>.json`` per model under ``path``; returns their paths.

    The models of a study are few, and each document is one row."""
    names = [r["model"] for r in runs.select("model").distinct().collect()]
    paths = []
    for name in names:
        target = f"{path}/metrics_{name.replace('/', '_')}.json"
        runs.where(F.col("model") == name).drop("model").coalesce(1).write.mode("overwrite").json(target)
        paths.append(target)
    return paths


def write_report(report: DataFrame, path: str) -> None:
    """A report with one JSON document per model."""
    report.write.mode("overwrite").json(path)
