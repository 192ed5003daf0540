"""Shared by the operators: words and their hashes inside tasks, stages in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayspark.sources.stages import fresh_path

#: Characters between words.
BLANKS = "\\x20\\x09-\\x0D"
#: Bytes of text that a task holds in numpy at a time (a longer text is held alone).
PACK_BYTES = 1 << 20
#: Distinct words whose hashes a task remembers.
REMEMBERED_WORDS = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word."""
    known = _HASHES
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def run_hashes(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words, by its start."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(odd_numbers(size, seed)):
        total += hashes[i : i + n] * factor
    return mix(total)


def packs(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices with about PACK_BYTES of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        pack = np.cumsum(sizes) // PACK_BYTES
        starts = [0, *(np.flatnonzero(np.diff(pack)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            yield batch.slice(lo, hi - lo)


def words_of(batch: pa.RecordBatch, text: str = "text") -> list[list[bytes]]:
    """The words of each binary text, cut at ASCII blanks; none for a null."""
    return [t.split() if t else [] for t in batch.column(text).to_pylist()]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost one read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text as a string, empty for null."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def tasks(spark: SparkSession) -> int:
    """The number of tasks that a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, component), the component being its smallest node.

    Alternating large and small stars: each round points nodes at the smallest
    neighbour; rounds follow the logarithm of the longest path.  Links and labels stay in
    Spark; every round is written to the shared folder.  A node with many links
    is never gathered: its smallest neighbour is an aggregate."""
    links = staged(
        links.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where("hi <> lo").distinct(),
        "links",
    )
    mark, before = _mark(links), None
    while mark != before and mark[0]:
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("least"))
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct()
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("least")), "hi")
        hi = F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo"))
        links = staged(small.select(hi.alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct(), "links")
        before, mark = mark, _mark(links)
    named = links.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    return named.unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Number of links and a sum over their hashes: equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
