"""Near-duplicates by MinHash: bands propose, odd sketches sift, full sets confirm.

A document is its set of distinct five-word shingles (A-Z lower-cased).  Equal sets become one class first.  Each class gets
bands of MinHash samples, as many as the threshold needs (``banding``).  Samples agree in a band for similar sets, so a pair with similarity
0.85 misses all 33 bands of 6 with probability (1 - 0.85**6)**33, under 1.7e-7, and one with 0.8 all 39 bands of 5, under 1.9e-7.  The samples are also folded into an odd
sketch, a bitmap of parities: the population count of the XOR of two sketches tells how many samples differ, and does so
most precisely when few do.  Within a band bucket all sketches are compared; a pair is sifted out only if its count is
beyond what six standard deviations allow at the threshold.  Buckets keep a spanning
forest of the pairs left, not the pairs, and its components are families, which hold every linked pair.
In each family the full sets are compared, sets already connected are not compared again, and a
spanning forest of the confirmed links leaves the task.

Large buckets and families are dealt out as pairs of chunks, so no task holds a whole group, and what a task sends on
grows with its rows, not with their pairs.

Defined results: null or empty texts have no shingles, are linked with nothing and are their own component; texts with fewer
than five words are one shingle, the whole sequence.  A row with a null doc_id is never linked and its component is null, kept is true.
Repeated rows with one doc_id are each returned and have the same component.  Ties go to the smallest doc_id.  An empty table gives an empty
result; further columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, mix, odd_numbers, packs, run_hashes, staged, text_column, word_hashes

SHINGLE = 5
#: Similarity of a link: 100 * common >= THRESHOLD * union.
THRESHOLD = 85
#: Probability that a pair at the threshold may miss every band.
MISS = 2e-7
#: Bands and samples in each from a threshold of 85 on.
BANDS, ROWS = 33, 6
#: Bits of the odd sketch.
SKETCH_BITS = 512
#: Standard deviations that the number of differing samples may exceed its mean at the threshold by.
MARGIN = 6.0
#: Rows in a chunk of a bucket or family.
CHUNK = 512

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    size = min(SHINGLE, len(words))
    return np.unique(run_hashes(hashes, size, seed=size))


def banding(threshold: int = THRESHOLD) -> tuple[int, int]:
    """Bands, and samples in each, with which a pair at the threshold is missed with a probability under MISS."""
    if threshold >= 85:
        return BANDS, ROWS
    rows = ROWS - 1
    return math.ceil(math.log(MISS) / math.log1p(-((threshold / 100) ** rows))), rows


@lru_cache(maxsize=8)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of n hash functions."""
    factors = (odd_numbers(n, 11) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
    return factors, (odd_numbers(n, 12) >> np.uint64(32)).astype(np.uint32)


def samples(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The MinHash samples of a set: 32-bit minima under n hash functions."""
    low = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    factors, shifts = _functions(n)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 256):
        block = low[start : start + 256, None] * factors
        block ^= block >> np.uint32(15)
        block += shifts
        block *= np.uint32(0x846CA68B)
        np.minimum(least, block.min(0), out=least)
    return least


def odd_sketch(least: np.ndarray) -> bytes:
    """Parities of the hashed (sample number, value) pairs."""
    at = mix(least.astype(np.uint64) | (np.arange(len(least), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def band_keys(least: np.ndarray, size: int = ROWS) -> np.ndarray:
    rows = least.reshape(-1, size).astype(np.uint64)
    keys = np.arange(len(rows), dtype=np.uint64)
    for i in range(size):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return keys.view(np.int64)


def sketch_limit(threshold: int = THRESHOLD) -> int:
    """The largest XOR count that a pair at the threshold can be expected to have."""
    p = 1 - threshold / 100
    n = math.prod(banding(threshold))
    differ = n * p + MARGIN * (n * p * (1 - p)) ** 0.5
    flips = 2 * differ
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    return int(np.ceil(mean + 3 * (SKETCH_BITS / 4 * (1 - (1 - 4 / SKETCH_BITS) ** flips)) ** 0.5))


def signatures(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch, bands) of every row; the last three null for an empty set or a null id."""

    n_bands, size = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packs(batches):
            ids = batch.column("doc_id")
            counts, digests, sketches, bands = [], [], [], []
            for doc, text in zip(ids.to_pylist(), batch.column("text").to_pylist()):
                found = shingle_set(text)
                counts.append(len(found))
                if doc is None or not len(found):
                    digests.append(None), sketches.append(None), bands.append(None)
                    continue
                least = samples(found, n_bands * size)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketches.append(odd_sketch(least))
                bands.append(band_keys(least, size))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "sketch", "bands"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), text_column(docs).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>")


def chunked(rows: DataFrame, group: str, size: str, by: str) -> DataFrame:
    """Deal each group out as pairs of chunks: adds ``block`` (group and pair) and ``side`` (0, 1, or 2 for both).

    A group of ``size`` rows has k = ceil(size / CHUNK) chunks by hash; a row goes to the k blocks of
    its chunk, where every two rows of the group meet once at least."""
    k = F.ceil(F.col(size) / F.lit(CHUNK)).cast("int")
    out = rows.withColumn("_k", k).withColumn("_chunk", F.pmod(F.xxhash64(by, group), F.col("_k")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    side = F.when(F.col("_other") == F.col("_chunk"), 2).when(F.col("_chunk") < F.col("_other"), 0).otherwise(1)
    block = F.xxhash64(group, F.least("_chunk", "_other"), F.greatest("_chunk", "_other"))
    return out.withColumns({"side": side, "block": block}).drop("_k", "_chunk", "_other")


class _Forest:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows of one (group, block) at a time, from rows sorted by them; each is a tuple of the columns after."""
    current, rows = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in batch.schema.names]
        for row in zip(*columns):
            key = row[: len(keys)]
            if key != current:
                if len(rows) > 1:
                    yield rows
                current, rows = key, []
            rows.append(row[len(keys) :])
    if len(rows) > 1:
        yield rows


def _close(sketches: np.ndarray, sides: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows of the block, on the other side, whose sketch is near."""
    for i in range(len(sketches) - 1):
        ok = np.bitwise_count(sketches[i + 1 :] ^ sketches[i]).sum(1, dtype=np.int64) <= limit
        if sides[i] != 2:
            ok &= sides[i + 1 :] != sides[i]
        near = np.flatnonzero(ok)
        if len(near):
            yield i, near + i + 1


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=_LINKS)


def _sift(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, ("bucket", "block")):
            ids = [r[0] for r in rows]
            sides = np.array([r[1] for r in rows])
            sketches = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), -1)
            forest, pairs = _Forest(len(rows)), []
            for i, near in _close(sketches, sides, limit):
                pairs += [(ids[i], ids[j]) for j in near.tolist() if forest.join(i, j)]
            if pairs:
                yield _link_batch(pairs)

    return run


def _confirm(limit: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, ("family", "block")):
            rows.sort(key=lambda r: r[0])
            ids = [r[0] for r in rows]
            sides = np.array([r[1] for r in rows])
            sketches = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), -1)
            sets = [shingle_set(r[3]) for r in rows]
            forest, pairs = _Forest(len(rows)), []
            for i, near in _close(sketches, sides, limit):
                for j in near.tolist():
                    small, large = sorted((len(sets[i]), len(sets[j])))
                    if 100 * small < threshold * large or forest.root(i) == forest.root(j):
                        continue
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= threshold * (small + large - common) and forest.join(i, j):
                        pairs.append((ids[i], ids[j]))
            if pairs:
                yield _link_batch(pairs)

    return run


def _families(classes: DataFrame, limit: int) -> DataFrame:
    """(node, component) over classes that share a bucket and are near by their sketches."""
    spread = classes.select("rep", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = spread.join(sizes, "bucket").groupBy("rep").agg(F.collect_list(F.struct("bucket", "size")).alias("buckets"))
    members = classes.select("rep", "sketch").join(shared, "rep").select("rep", "sketch", F.explode("buckets").alias("b"))
    members = members.select("rep", "sketch", F.col("b.bucket").alias("bucket"), F.col("b.size").alias("size"))
    blocks = chunked(members, "bucket", "size", "rep").select("bucket", "block", "rep", "side", "sketch")
    blocks = blocks.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "rep")
    return components(blocks.mapInArrow(_sift(limit), "a long, b long"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    limit = sketch_limit(threshold)
    signed = staged(signatures(docs, threshold), "signatures")
    # equal sets: one class, named by its smallest id
    first = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    first = staged(first, "classes")
    classes = signed.join(first.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
    classes = classes.dropDuplicates(["doc_id", "digest"]).withColumnRenamed("doc_id", "rep")
    family = _families(classes, limit)
    sizes = family.groupBy("component").agg(F.count("*").alias("size"))
    members = family.join(sizes, "component").select(F.col("node").alias("rep"), F.col("component").alias("family"), "size")
    members = classes.select("rep", "sketch", "n_shingles").join(members, "rep")
    text = docs.select(F.col("doc_id").cast("long").alias("rep"), text_column(docs).cast("binary").alias("text")).where("rep IS NOT NULL")
    members = members.join(text, "rep")
    blocks = chunked(members, "family", "size", "rep").select("family", "block", "rep", "side", "sketch", "text")
    blocks = blocks.repartition("family", "block").sortWithinPartitions("family", "block", "rep")
    linked = components(blocks.mapInArrow(_confirm(limit, threshold), "a long, b long"))
    named = first.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("_component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; repeated rows of it become one."""
    drop = near_duplicates(docs, threshold).where("NOT kept").select("doc_id").distinct()
    out = docs.join(drop, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id IS NULL"))
