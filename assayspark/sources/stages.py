"""Stages written to the shared folder, so that work survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where nothing is configured, a session that runs in one process (``local[n]``) gets
    a folder of its own; on a cluster that is an error, since executors would
    not see each other's files."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None and configured is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if current is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="assayspark-"))
        current = context.getCheckpointDir()
    return configured or current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows.

    Ends the lineage, so a lost executor costs one read and not the whole chain.  What the executors kept on
    their disks to build the rows goes as soon as these are written."""
    shared_dir(df.sparkSession)
    return tidy(df).checkpoint(eager=True)


def tidy(df: DataFrame) -> DataFrame:
    """``df`` for one action only, after which its shuffle files are removed from the executors' disks.

    Otherwise they stay until the driver collects its garbage.  The plan is a new one, so no other action reads them."""
    spark = df.sparkSession
    kinds = spark.sparkContext._jvm.org.apache.spark.sql
    remove = getattr(getattr(kinds.execution, "RemoveShuffleFiles$"), "MODULE$")
    return DataFrame(kinds.classic.Dataset.ofRows(df._jdf.sparkSession(), df._jdf.logicalPlan(), remove), spark)


def release(*stages: DataFrame) -> None:
    """Delete the files of stages from `cut` that nothing reads any more."""
    for df in stages:
        context = df.sparkSession.sparkContext
        path = df._jdf.logicalPlan().rdd().getCheckpointFile().get()
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_done(spark: SparkSession, path: str) -> bool:
    """True when a stage at ``path`` was written to its end."""
    return _exists(spark, path.rstrip("/") + "/_SUCCESS")


def publish(spark: SparkSession, target: str, write: Callable[[str], None]) -> bool:
    """Let ``write`` fill a folder of its own and move that to ``target`` in one step; False if ``target`` is there already.

    A job that fails on the way leaves no part of its rows behind, and one that is repeated adds nothing."""
    if _exists(spark, target):
        return False
    draft = f"{target.rstrip('/').rpartition('/')[0]}/_draft-{uuid.uuid4().hex}"
    write(draft)
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(draft)
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if _exists(spark, target) or not system.rename(source, jvm.org.apache.hadoop.fs.Path(target)):
        system.delete(source, True)  # the draft of this call
        return False
    return True


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage stored at ``path``; built and written first unless it is already complete."""
    if not is_done(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """A model saved by `save_model`, whatever its class."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


def run_once(spark: SparkSession, path: str, build: Callable[[], object]) -> bool:
    """Fit and save a model unless ``path`` already holds one; says whether it ran."""
    if is_done(spark, path.rstrip("/") + "/metadata"):
        return False
    save_model(build(), path)
    return True
