"""Hard-negative mining with exact scores by the method of the Four Russians.

Vectors become integers (``floor(scale * x)``).  A candidate is kept as packed bit planes: eight
dimensions of one plane are one byte.  For an anchor and each group of eight dimensions
all 256 subset sums are tabled, so a byte looks up what its eight bits add, and the planes are
joined by shift and add (two's complement, the top plane counts negative).  Scores are exact.

Anchors and candidates are dealt into cells of bounded size (``CELL_ANCHORS`` x ``CELL_CANDIDATES``);
each cell returns its best rows per anchor, and the best of these are taken by a window.
The first pass scores an anchor against the rows of its own label (positives), the second against all rows
for the score windows below its positives.  Cells depend on row numbers alone, so common labels,
equal vectors and repeated rows do not make a cell larger.  The work is anchors x rows, as the task asks for.

Defined results: a row with a null id, label, vector or component, or with a component that is not finite or
reaches 2**25 after scaling (scores would leave 64 bits), takes no part.  Shorter vectors count as padded with zeros, an
empty vector scores 0.  Ties go to the smaller id.  Every row counts, so a repeated row can be found
twice; a repeated anchor is one anchor; rows with the anchor's own id are not its positives.  Long vectors are used whole.
An empty table, or one without anchors, gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged, tasks

CELL_ANCHORS = 16_384
CELL_CANDIDATES = 131_072
#: Anchors whose tables are held at a time, and candidates that are looked up at a time.
TABLES, CHUNK = 64, 4_096
_LIMIT = 2**25
_KEY = ["anchor_id", "anchor_label", "anchor_planes"]


def pack_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Two's-complement bit planes of (rows, dims) integers, top plane first: (rows, bits, groups) bytes."""
    rows, dims = values.shape
    groups = max(1, -(-dims // 8))
    wide = np.zeros((rows, groups * 8), np.int64)
    wide[:, :dims] = values
    out = np.empty((rows, bits, groups), np.uint8)
    for i in range(bits):
        plane = ((wide >> (bits - 1 - i)) & 1).astype(np.uint8)
        out[:, i] = np.packbits(plane, axis=1, bitorder="little")
    return out


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    """The integers of `pack_planes`, (rows, groups * 8)."""
    rows, bits, groups = planes.shape
    out = np.zeros((rows, groups * 8), np.int64)
    for i in range(bits):
        plane = np.unpackbits(planes[:, i], axis=1, bitorder="little").astype(np.int64)
        out = out * 2 + (-plane if i == 0 else plane)
    return out


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of eight dimensions."""
    count, dims = anchors.shape
    columns = anchors.T.reshape(dims // 8, 8, count).astype(dtype)
    table = np.zeros((dims // 8, 256, count), dtype)
    for j in range(8):
        table[:, 1 << j : 2 << j] = table[:, : 1 << j] + columns[:, j : j + 1]
    return table


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (anchors, candidates) by table look-ups alone."""
    count, bits, groups = planes.shape
    most = int(np.abs(anchors).sum(axis=1).max(initial=0))
    small = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    large = np.int32 if most << bits < 2**31 else np.int64
    table = subset_sums(anchors, small)
    out = np.empty((len(anchors), count), large)
    for lo in range(0, count, CHUNK):
        part = planes[lo : lo + CHUNK]
        found = np.empty((len(part), len(anchors)), small)
        total = np.zeros((len(part), len(anchors)), large)
        for i in range(bits):
            plane = np.zeros((len(part), len(anchors)), small)
            for g in range(groups):
                np.take(table[g], part[:, i, g], axis=0, out=found, mode="clip")
                plane += found
            total <<= 1
            if i:
                total += plane
            else:
                total -= plane
        out[:, lo : lo + CHUNK] = total.T
    return out


def _best(found: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the positions ``found``: by score downwards, then by id."""
    if len(found) > most:
        kept = score[found]
        found = found[kept >= np.partition(kept, len(kept) - most)[len(kept) - most]]
    return found[np.lexsort((ids[found], -score[found].astype(np.int64)))][:most]


def _matrix(table: pa.Table, name: str, bits: int) -> np.ndarray:
    column = table.column(name).combine_chunks()
    if not len(column):
        return np.zeros((0, bits, 1), np.uint8)
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return flat.reshape(len(column), bits, -1)


def _int(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _positives(bits: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, planes = _int(right, "vec_id"), _int(right, "label"), _matrix(right, "planes", bits)
        order = np.argsort(labels, kind="stable")
        ids, labels, planes = ids[order], labels[order], planes[order]
        anchor_ids, anchor_labels = _int(left, "anchor_id"), _int(left, "anchor_label")
        vectors = unpack_planes(_matrix(left, "anchor_planes", bits))
        rows, found_ids, found_scores = [], [], []
        for label in np.unique(anchor_labels):
            lo, hi = np.searchsorted(labels, [label, label + 1])
            members = np.flatnonzero(anchor_labels == label)
            for start in range(0, len(members) if hi > lo else 0, TABLES):
                block = members[start : start + TABLES]
                for at, score in zip(block, scores(vectors[block], planes[lo:hi])):
                    best = _best(np.flatnonzero(ids[lo:hi] != anchor_ids[at]), score, ids[lo:hi], most)
                    rows += [at] * len(best)
                    found_ids += ids[lo:hi][best].tolist()
                    found_scores += score[best].tolist()
        taken = left.select(_KEY).take(pa.array(rows, pa.int64()))
        taken = taken.append_column("positive_id", pa.array(found_ids, pa.int64()))
        return taken.append_column("positive_score", pa.array(found_scores, pa.int64()))

    return run


def _negatives(bits: int, most: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, planes = _int(right, "vec_id"), _int(right, "label"), _matrix(right, "planes", bits)
        anchor_labels = _int(left, "anchor_label")
        vectors = unpack_planes(_matrix(left, "anchor_planes", bits))
        wanted = left.column("positives").to_pylist()
        rows, out = [], {"positive": [], "positive_id": [], "positive_score": [], "negative_id": [], "negative_score": []}
        for start in range(0, len(vectors) if len(ids) else 0, TABLES):
            for at, score in enumerate(scores(vectors[start : start + TABLES], planes), start):
                windows = [p for p in wanted[at] if low * p["positive_score"] <= high * p["positive_score"]]
                if not windows:
                    continue
                top = max(p["positive_score"] for p in windows)
                floor = -(-low * min(p["positive_score"] for p in windows) // 100)
                ceiling = high * top // 100
                near = np.flatnonzero((score >= floor) & (score <= ceiling) & (labels != anchor_labels[at]))
                for p in windows:
                    score_of = p["positive_score"]
                    kept = score[near]
                    inside = near[(kept >= -(-low * score_of // 100)) & (kept <= high * score_of // 100)]
                    for i in _best(inside, score, ids, most).tolist():
                        rows.append(at)
                        for name, value in zip(out, (p["positive"], p["positive_id"], score_of, int(ids[i]), int(score[i]))):
                            out[name].append(value)
        taken = left.select(_KEY).take(pa.array(rows, pa.int64()))
        for name, values in out.items():
            taken = taken.append_column(name, pa.array(values, pa.int32() if name == "positive" else pa.int64()))
        return taken

    return run


def _packer(dims: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("values")
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            values = np.zeros((batch.num_rows, dims), np.int64)
            values[np.arange(dims) < sizes[:, None]] = np.asarray(lists.flatten())
            packed = [row.tobytes() for row in pack_planes(values, bits)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["vec_id", "label", "planes"]
            )

    return run


def whole_numbers(df: DataFrame, vec_id: Column, vector: Column, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, values) of the rows that take part, ``values`` being floor(scale * x)."""
    sized = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    rows = df.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), sized.alias("_sized"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND _sized IS NOT NULL")
    # a comparison with null or NaN is not true
    rows = rows.where(F.forall("_sized", lambda x: F.coalesce((F.abs(x) < F.lit(float(_LIMIT))) & ~F.isnan(x), F.lit(False))))
    return rows.select("vec_id", "label", F.transform("_sized", lambda x: F.floor(x).cast("long")).alias("values"))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """Hard negatives of `whole_numbers`: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first ``positives`` other rows of the same label.  Each of them gives the
    first ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of it."""
    spark = rows.sparkSession
    facts = rows.agg(
        F.count("*").alias("rows"), F.sum(is_anchor.cast("long")).alias("anchors"), F.max(F.size("values")).alias("dims"),
        F.min(F.array_min("values")).alias("least"), F.max(F.array_max("values")).alias("most"),
    ).first()
    dims = max(1, facts["dims"] or 0)
    bits = 1 + max(1, (-1 - (facts["least"] or 0)).bit_length() if (facts["least"] or 0) < 0 else 0, (facts["most"] or 0).bit_length())
    packed = staged(
        rows.mapInArrow(_packer(dims, bits), "vec_id long, label long, planes binary"),
        "planes",
    )
    blocks = max(1, math.ceil((facts["anchors"] or 0) / CELL_ANCHORS))
    parts = max(tasks(spark), math.ceil(facts["rows"] / CELL_CANDIDATES))
    # rows are dealt by their place in the written table: stable when read again, and blind to copies
    dealt = packed.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    candidates = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    anchors = packed.where(is_anchor).dropDuplicates()
    anchors = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("planes").alias("anchor_planes"))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64(*_KEY), F.lit(blocks)).cast("int"))
    key = ", ".join(f"{k} {t}" for k, t in zip(_KEY, ("long", "long", "binary")))

    def in_cells(left: DataFrame, run: Callable, schema: str) -> DataFrame:
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return left.groupBy("block", "part").cogroup(candidates.groupBy("block", "part")).applyInArrow(run, f"{key}, {schema}")

    first = in_cells(anchors, _positives(bits, positives), "positive_id long, positive_score long")
    order = Window.partitionBy(*_KEY).orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("positive", F.row_number().over(order)).where(F.col("positive") <= positives)
    with_positives = staged(
        first.groupBy(*_KEY)
        .agg(F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("positives"))
        .withColumn("block", F.pmod(F.xxhash64(*_KEY), F.lit(blocks)).cast("int")),
        "positives",
    )
    second = in_cells(
        with_positives, _negatives(bits, negatives, low, high),
        "positive int, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy(*_KEY, "positive").orderBy(F.desc("negative_score"), "negative_id")
    second = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return second.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH valid AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label,
    CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
  FROM valid a, valid c WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE label = anchor_label AND vec_id <> anchor_id
), negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
   AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
  WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""
