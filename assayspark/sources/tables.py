"""Table scans and tables made from queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def load_tables(
    spark: SparkSession, directory: str, names: Sequence[str] = tuple(TABLES), views: bool = False
) -> dict[str, DataFrame]:
    """The named Parquet tables of a folder; with ``views`` also as temporary views for SQL."""
    tables = {name: load_table(spark, directory, name) for name in names}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def spread_scan(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan out over all cores when the files make fewer tasks than that.

    For CPU-heavy work on a few small files; a large table has more file splits
    than cores and is returned as it is, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_database_tables(spark: SparkSession, url: str, names: Sequence[str], **options: str) -> dict[str, DataFrame]:
    """Tables of a relational database over JDBC; filters and columns are pushed to it."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return {name: reader.option("dbtable", name).load() for name in names}


def create_table_as(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """CREATE TABLE AS SELECT: store ``df`` as a table and return the table."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
