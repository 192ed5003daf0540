"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayspark.llm import byte_bpe, decontamination, near_dedup, personal_data, quality_rules
from assayspark.llm.queries import _vocabulary
from assayspark.sources.stages import fresh_path
from assayspark.sources.tables import load_table

#: Percent of shingles that two documents share to be near-duplicates here.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.drop_contaminated(docs, load_table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return personal_data.mask_personal_data(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of all documents, checked by decoding."""
    ranks, pattern = _vocabulary()
    encoded = byte_bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    decoded = byte_bpe.decode_ids(encoded, ranks, pattern)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", byte_bpe.id_count(F.col("ids")).alias("n_tokens"), "ids", same.alias("exact"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", mask),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = load_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL cannot express the stages.
ORACLE_SQL = None
