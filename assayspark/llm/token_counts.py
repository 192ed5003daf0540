"""Token counts as rollups that signed changes keep up to date.

A batch is a set of signed rows: +1 for an inserted document, -1 for a deleted one, and both for
a revised count.  A batch is summed by source, language and tokenizer version and written
as one small Parquet folder named after the batch.  Totals are the sums over committed batches,
so they are additive and batches may come in any order.  A batch is committed
when Spark has written its success file: repeating a committed batch changes
nothing, and one that broke off half-way is written again.

Null source or language are groups of their own.  A document without text has 0 tokens and still
counts as a document; rows with a null doc_id are compared by value of null like any other id.
Repeated rows count each when inserted; to compare snapshots, (doc_id, tokenizer) must be unique.  Groups
whose documents have all gone are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayspark.sources.stages import is_done

from .byte_bpe import tokenizer
from .common import BLANKS, packs

KEYS = ["source", "lang", "tokenizer"]


def word_counts(docs: DataFrame, version: str, separators: str = f"[{BLANKS}]+") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) for a version that cuts at ``separators``."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), separators), lambda w: w != "")
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.size(parts).cast("long").alias("n_tokens"))


def bpe_counts(docs: DataFrame, ranks: Mapping[str, str], pattern: str) -> DataFrame:
    """The same for rank files: ``ranks`` maps a version to its file."""
    ranks = dict(ranks)
    schema = docs.select("doc_id", "source", "lang").schema.add("tokenizer", "string").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packs(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for version, path in ranks.items():
                encode = tokenizer(path, pattern).encode_to_numpy
                counts = pa.array([len(encode(t, disallowed_special=())) for t in texts], pa.int64())
                named = pa.array([version] * len(texts), pa.string())
                kept = [batch.column(n) for n in ("doc_id", "source", "lang")]
                yield pa.RecordBatch.from_arrays([*kept, named, counts], names=schema.names)

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, schema)


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Insert (+1) or delete (-1) all rows of ``counts``."""
    return counts.withColumn("sign", F.lit(sign))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that lead from one snapshot of counts to the next; unchanged rows give none."""
    columns = [*KEYS, "n_tokens"]
    old = before.select("doc_id", *columns, F.lit(-1).alias("sign"))
    new = after.select("doc_id", *columns, F.lit(1).alias("sign"))
    net = old.unionByName(new).groupBy("doc_id", *columns).agg(F.sum("sign").cast("int").alias("sign"))
    return net.where("sign <> 0")


def commit_batch(spark: SparkSession, path: str, batch: str, rows: DataFrame) -> bool:
    """Add a batch of signed rows to the rollup at ``path``; False if it was committed before."""
    at = f"{path.rstrip('/')}/batch={batch}"
    if is_done(spark, at):
        return False
    summed = rows.groupBy(*KEYS).agg(
        F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens")
    )
    summed.write.mode("overwrite").parquet(at)
    return True


def totals(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    """Totals over those of ``batches`` that are committed."""
    done = [f"{path.rstrip('/')}/batch={b}" for b in batches if is_done(spark, f"{path.rstrip('/')}/batch={b}")]
    schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
    rows = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.where("n_docs <> 0 OR n_tokens <> 0")


def compact(spark: SparkSession, path: str, batches: list[str], into: str) -> bool:
    """Replace ``batches`` by one batch with their totals; list it in their place from then on."""
    at = f"{path.rstrip('/')}/batch={into}"
    if is_done(spark, at):
        return False
    totals(spark, path, batches).write.mode("overwrite").parquet(at)
    return True
