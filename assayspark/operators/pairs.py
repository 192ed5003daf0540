"""Pair measures inside blocks of consecutive rows, or over a whole table.

Blocks have a fixed number of rows, so the work is rows x block size.  A whole table is one block: its
rows are packed in tiles of like sizes, tiles meet two by two in tasks of their own, and the work grows
with the square of the rows.  Pairs are never written out: the task that forms them reduces them to counts, since a
distribution over the pairs is what is wanted.  All five measures follow from
|A|, |B| and the number of shared bits, a product of 0/1 rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayspark.functions.measures import SET_MEASURES, from_counts
from assayspark.operators.quantiles import violin_summary
from assayspark.operators.ranking import with_block_id
from assayspark.operators.spread import ROWS_PER_BUCKET
from assayspark.sources.stages import cut

WORD = 64
GROUP = 6
PACKED_BITS = 16_384
#: Rows of a block that are multiplied at once to count pairs by a key and to bin them, keys that a task holds, keys that it hands on at once.
TILE_ROWS = 1_024
BIN_ROWS = 256
HELD_KEYS = 4_000_000
EMIT = 100_000
#: Tiles of a whole table that are wanted, least and most rows of one, rows of two tiles that are multiplied at once.
WHOLE_TILES = 16
WHOLE_ROWS = (4_096, 32_768)
SQUARE_ROWS = 1_024


def pack_bits(df: DataFrame, bits: str, n_bits: int) -> DataFrame:
    """Replace a bit set by 64-bit words ``w0, w1, ...``, one column each.

    The set is first cut into runs of GROUP words, then each run into its words,
    so an element is looked at by a few expressions and not by all of them."""
    words = (n_bits + WORD - 1) // WORD
    groups = range((words + GROUP - 1) // GROUP)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def between(values: Column, low: int, high: int) -> Column:
        return F.filter(values, lambda b: (b >= low) & (b < high))

    def word(k: int) -> Column:
        inside = between(F.col(f"_g{k // GROUP}"), WORD * k, WORD * (k + 1))
        packed = F.aggregate(
            inside, zero, lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, b - WORD * k))
        )
        # never NULL: without NULL checks the pair loop stays small enough for the JIT compiler
        return F.coalesce(packed, zero)

    span = WORD * GROUP
    others = [c for c in df.columns if c != bits]
    grouped = df.select(*others, *[between(F.col(bits), span * g, span * (g + 1)).alias(f"_g{g}") for g in groups])
    return grouped.select(*others, *[word(k).alias(f"w{k}") for k in range(words)])


@dataclass
class PackedBlocks:
    """Written rows (block_id, position, s, t, w0, w1, ...): size, tile and bit words of each set.

    Sets from a space of more than PACKED_BITS bits stay lists (``bits`` in place of the words).  Without a block
    size all rows are one block, of which ``position`` only tells the rows apart."""

    rows: DataFrame
    n_bits: int
    block_size: int | None
    tile: int


def pack_blocks(
    df: DataFrame,
    order: str,
    bits: str = "bits",
    n_bits: int = 2048,
    block_size: int | None = 1024,
    tile: int = 128,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> PackedBlocks:
    """Number the rows along ``order``, cut them into blocks and tiles, pack their bits.

    Rows without a fingerprint are left out before they are numbered.  Written
    once; the passes over the pairs read it.  With ``block_size=None`` every row meets every row."""
    # packed where the rows are, before they are sorted into blocks
    valid = df.where(F.col(bits).isNotNull())
    rows = valid.select(F.col(order).alias("_o"), F.size(bits).cast("long").alias("s"), F.col(bits).alias("_bits"))
    packed = pack_bits(rows, "_bits", n_bits) if n_bits <= PACKED_BITS else rows.withColumnRenamed("_bits", "bits")
    if block_size is None:
        one = packed.drop("_o").withColumns({"block_id": F.lit(0).cast("long"), "position": F.monotonically_increasing_id()})
        return PackedBlocks(cut(one), n_bits, None, tile)
    packed = with_block_id(packed, "_o", block_size, rows_per_bucket).drop("_o")
    in_block = F.col("position") - F.col("block_id") * block_size
    packed = packed.withColumn("t", F.floor(in_block / F.lit(tile)).cast("int"))
    return PackedBlocks(cut(packed), n_bits, block_size, tile)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their numbers."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys, n = keys[order], np.concatenate([n for _, n in parts])[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block together; rows come sorted by block."""
    block, rows = None, []
    for batch in batches:
        numbers = np.asarray(batch.column("block_id"))
        starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for lo, hi in zip(starts, starts[1:]):
            if lo == hi:
                continue
            if numbers[lo] != block and rows:
                yield pa.Table.from_batches(rows)
                rows = []
            block = numbers[lo]
            rows.append(batch.slice(lo, hi - lo))
    if rows:
        yield pa.Table.from_batches(rows)


def _block_pairs(block: pa.Table, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(sizes a, sizes b, shared bits, weight) of a block, tile by tile; shared bits are products of 0/1 rows."""
    sizes = np.asarray(block.column("s").combine_chunks(), np.int64)
    words = np.column_stack([np.asarray(block.column(c).combine_chunks(), np.int64) for c in block.column_names if c.startswith("w")])
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    yield sizes, sizes, sizes, 1
    for i in range(0, len(sizes), tile):
        left = bits[i : i + tile].astype(np.float32)
        for j in range(i, len(sizes), tile):
            right = left if i == j else bits[j : j + tile].astype(np.float32)
            common = (left @ right.T).astype(np.int64)
            at = np.triu_indices(len(left), 1) if i == j else tuple(x.ravel() for x in np.indices(common.shape))
            yield sizes[i + at[0]], sizes[j + at[1]], common[at], 2


#: (sizes a, sizes b, shared bits, how many ordered pairs each entry stands for, one number or one per entry) of the rows of a task.
Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, "int | np.ndarray"]]


def _in_blocks(tile: int) -> Callable[[Iterator[pa.RecordBatch]], Pairs]:
    """The pairs of blocks; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Pairs:
        for block in _whole_blocks(batches):
            yield from _block_pairs(block, tile)

    return run


def _one_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition as one row (tile, sizes, words), along their sizes."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        rows = pa.Table.from_batches(parts)
        sizes = np.asarray(rows.column("s").combine_chunks(), np.int64)
        words = np.column_stack([np.asarray(rows.column(c).combine_chunks(), np.int64) for c in rows.column_names if c.startswith("w")])
        order = np.argsort(sizes, kind="stable")
        yield pa.RecordBatch.from_pydict({
            "tile": pa.array([rows.column("_tile")[0].as_py()], pa.int32()), "sizes": [sizes[order].tobytes()], "words": [words[order].tobytes()],
        })


def _cells(left: np.ndarray, right: np.ndarray, common: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | np.ndarray]:
    """The pairs of two runs of rows, equal ones counted where there are fewer kinds of them than pairs."""
    (a, i), (b, j) = (np.unique(x, return_inverse=True) for x in (left, right))
    least = int(common.min())
    deep = int(common.max()) - least + 1
    if len(a) * len(b) * deep > common.size:
        return np.repeat(left, len(right)), np.tile(right, len(left)), common.astype(np.int64).ravel(), w
    key = common.astype(np.int64)
    key += ((i[:, None] * len(b) + j[None, :]) * deep - least).astype(np.int64)
    n = np.bincount(key.ravel(), minlength=len(a) * len(b) * deep)
    at = np.flatnonzero(n)
    sizes, c = np.divmod(at, deep)
    return a[sizes // len(b)], b[sizes % len(b)], c + least, w * n[at]


def _in_rows(row: dict, part: slice | None = None) -> Pairs:
    """The pairs between two tiles, or within one; with ``part``, of these rows of the first with all of the second."""

    def bits(words: np.ndarray) -> np.ndarray:
        return np.unpackbits(words, axis=1).astype(np.float32)

    a, b = (np.frombuffer(row[f"sizes_{x}"], np.int64) for x in "ij")
    words_a, words_b = (np.frombuffer(row[f"words_{x}"], np.uint8).reshape(len(s), -1) for x, s in (("i", a), ("j", b)))
    itself = row["tile_i"] == row["tile_j"] and part is None
    if part is not None:
        a, words_a = a[part], words_a[part]
    for lo in range(0, len(a), SQUARE_ROWS):
        left = bits(words_a[lo : lo + SQUARE_ROWS])
        for at in range(lo if itself else 0, len(b), SQUARE_ROWS):
            # a run with itself holds both orders and each row with itself
            own = itself and at == lo
            right = left if own else bits(words_b[at : at + SQUARE_ROWS])
            yield _cells(a[lo : lo + SQUARE_ROWS], b[at : at + SQUARE_ROWS], left @ right.T, 1 if own else 2)


def _in_tiles(batches: Iterator[pa.RecordBatch]) -> Pairs:
    for batch in batches:
        for row in batch.to_pylist():
            yield from _in_rows(row)


def _at_the_ends(smallest: int, largest: int) -> Callable[[Iterator[pa.RecordBatch]], Pairs]:
    """Pairs of the smallest sets and of the largest with all, not each of them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Pairs:
        for batch in batches:
            for row in batch.to_pylist():
                if row["tile_i"] == smallest:
                    yield from _in_rows(row, slice(0, SQUARE_ROWS))
                if row["tile_i"] == largest:
                    yield from _in_rows(row, slice(-SQUARE_ROWS, None))

    return run


def _written_tiles(blocks: PackedBlocks) -> DataFrame:
    """(tile, sizes, words) of a whole table, a row and a partition each; neighbouring tiles have neighbouring sizes."""
    n = blocks.rows.count()
    tiles = max(1, math.ceil(n / min(max(n // WHOLE_TILES, WHOLE_ROWS[0]), WHOLE_ROWS[1])))
    ranged = blocks.rows.repartitionByRange(tiles, "s", "position").withColumn("_tile", F.spark_partition_id())
    return cut(ranged.drop("block_id", "position").mapInArrow(_one_tile, "tile int, sizes binary, words binary"))


def _tile_pairs(tiles: DataFrame, few: Column | None = None) -> DataFrame:
    """Every two tiles in a task of their own, read where they lie; or ``few`` of them with each."""
    i, j = (tiles.select(*[F.col(c).alias(f"{c}_{x}") for c in tiles.columns]) for x in "ij")
    if few is not None:
        return j.join(F.broadcast(i.where(few)))
    return i.join(j.hint("shuffle_replicate_nl"), F.col("tile_i") <= F.col("tile_j"))


def _block_counts(n_bits: int, pairs: Callable, kinds: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the ordered pairs of a task by the keys of ``kinds``."""
    wide = n_bits + 1

    def keys(kind: str, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        if kind == "sum":
            return (a + b) * wide + c
        if kind == "product":
            return a * b * wide + c
        return (np.minimum(a, b) * wide + np.maximum(a, b)) * wide + c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {kind: [] for kind in kinds}

        def flush(limit: int) -> Iterator[pa.RecordBatch]:
            for kind in kinds:
                if sum(len(k) for k, _ in held[kind]) <= limit:
                    continue
                found, n = _merged(held[kind])
                held[kind] = [(found, n)]
                if len(found) > limit // 2:
                    held[kind] = []
                    for lo in range(0, len(found), EMIT):
                        part = found[lo : lo + EMIT]
                        yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(part)), "key": part, "n": n[lo : lo + EMIT]})

        for a, b, c, w in pairs(batches):
            for kind in kinds:
                held[kind].append(_merged([(keys(kind, a, b, c), np.broadcast_to(w, c.shape))]))
            yield from flush(HELD_KEYS)
        yield from flush(0)

    return run


def _dealt(blocks: PackedBlocks, least: int) -> DataFrame:
    """Sizes and words of the rows, block by block, in ``least`` tasks at least (of a block each)."""
    last = blocks.rows.agg(F.max("block_id")).first()[0] or 0
    return blocks.rows.drop("position", "t").repartition(min(last + 1, max(least, last // 16)), "block_id").sortWithinPartitions("block_id")


def _counted(blocks: PackedBlocks, *kinds: str) -> DataFrame:
    """(kind, key, n): the ordered pairs of all blocks by key, counted in the tasks that form them."""
    if blocks.block_size is None:
        rows, pairs = _tile_pairs(_written_tiles(blocks)), _in_tiles
    else:
        rows = _dealt(blocks, blocks.rows.sparkSession.sparkContext.defaultParallelism)
        pairs = _in_blocks(min(blocks.block_size, TILE_ROWS))
    found = rows.mapInArrow(_block_counts(blocks.n_bits, pairs, kinds), "kind string, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _measured(pairs: Pairs, n_bits: int) -> Iterator[tuple[dict[str, np.ndarray], int | np.ndarray]]:
    """The measures of pairs as in `from_counts`, NaN where undefined, and the weights of these pairs."""
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b, c, w in pairs:
            total, product = (a + b).astype(float), a.astype(float) * b
            union, differing = total - c, total - 2 * c
            yield {
                "tanimoto": np.where(union == 0, 1.0, c / union), "dice": np.where(total == 0, 1.0, 2.0 * c / total),
                "cosine": np.where(product > 0, c / np.sqrt(product), np.nan), "hamming": differing / float(n_bits), "manhattan": differing,
            }, w


_FOUND = "metric string, bin int, n long, lo double, hi double"


def _bins(
    n_bits: int, bins: int, pairs: Callable, ranges: dict[str, tuple[float, float]], ends: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(metric, bin, n) of the task's pairs for the measures in ``ranges``, with ``ends`` also (metric, lo, hi) of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = {m: (np.nan, np.nan) for m in SET_MEASURES} if ends else {}
        counts = {m: np.zeros(bins, np.int64) for m in ranges}
        for values, w in _measured(pairs(batches), n_bits):
            for m, (lo, hi) in reached.items():
                if len(values[m]):
                    reached[m] = (np.fmin(lo, np.fmin.reduce(values[m])), np.fmax(hi, np.fmax.reduce(values[m])))
            for m, (lo, hi) in ranges.items():
                v, n = values[m], np.broadcast_to(w, values[m].shape)
                if m == "cosine":
                    v, n = v[~np.isnan(v)], n[~np.isnan(v)]
                number = np.clip((v - lo) / (hi - lo) * bins, 0, bins - 1).astype(np.int64)
                # one weight for all is cheaper; sums of weights stay below 2**53
                found = w * np.bincount(number, minlength=bins) if np.ndim(w) == 0 else np.bincount(number, n, bins)
                counts[m] += found.astype(np.int64)
        found = [(m, None, 0, float(lo), float(hi)) for m, (lo, hi) in reached.items() if lo == lo]
        found += [(m, k, int(n), None, None) for m, per_bin in counts.items() for k, n in enumerate(per_bin) if n]
        if found:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=["metric", "bin", "n", "lo", "hi"])

    return run


def _ranges(ends: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    return {m: (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi) for m, (lo, hi) in sorted(ends.items())}


def _found_ends(rows: DataFrame) -> dict[str, tuple[float, float]]:
    ends = rows.where("bin IS NULL").groupBy("metric").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return {r["metric"]: (r["lo"], r["hi"]) for r in ends.collect()}


def _whole_bins(blocks: PackedBlocks, bins: int) -> tuple[dict[str, tuple[float, float]], DataFrame]:
    """The ranges of the measures over all pairs of a table, and (metric, bin, n).

    The smallest and the largest sets, against all others, say what the ranges may be; the pass that bins all
    pairs finds what they are, and is made again where that is something else."""
    tiles = _written_tiles(blocks)
    first, last = tiles.agg(F.min("tile"), F.max("tile")).first()

    def look(ranges: dict[str, tuple[float, float]], ends: bool, pairs: Callable = _in_tiles, few: Column | None = None) -> DataFrame:
        found = _tile_pairs(tiles, few).mapInArrow(_bins(blocks.n_bits, bins, pairs, ranges, ends), _FOUND)
        return cut(found.groupBy("metric", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))

    if first is None:
        return {}, look({}, False).select("metric", "bin", "n")
    guess = _found_ends(look({}, True, _at_the_ends(first, last), F.col("tile_i").isin(first, last)))
    found = look(_ranges(guess), True)
    ends = _found_ends(found)
    wrong = {m: r for m, r in _ranges(ends).items() if guess.get(m) != ends[m]}
    counts = found.where(F.col("bin").isNotNull() & ~F.col("metric").isin(list(wrong)))
    if wrong:
        counts = counts.unionByName(look(wrong, False))
    return _ranges(ends), counts.select("metric", "bin", "n")


def pair_rows(blocks: PackedBlocks) -> DataFrame:
    """(size_a, size_b, common, w) per pair of a block; w counts both orders, self-pairs once.

    Each tile pair is one join key, so a block spreads over many tasks and one
    key holds at most tile x tile pairs.  Only i < j is joined.  The rows are
    meant to be aggregated by the caller in the same stage: it is cheaper to
    form the pairs again for a second pass than to store them."""
    packed = blocks.rows
    own = packed.select(
        F.col("s").alias("size_a"), F.col("s").alias("size_b"), F.col("s").alias("common"), F.lit(1).cast("long").alias("w")
    )
    if "bits" in packed.columns:
        return _listed_pairs(packed).unionByName(own)
    names = [c for c in packed.columns if c.startswith("w")]
    tiles = (blocks.block_size + blocks.tile - 1) // blocks.tile
    key = F.col("block_id") * (tiles * tiles) + F.col("i") * tiles + F.col("j")
    left = (
        packed.withColumn("i", F.col("t"))
        .withColumn("j", F.explode(F.sequence(F.col("t"), F.lit(tiles - 1))))
        .select(key.alias("ka"), F.col("position").alias("pa"), F.col("s").alias("sa"), *[F.col(n).alias(f"a_{n}") for n in names])
    )
    right = (
        packed.withColumn("j", F.col("t"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("t"))))
        .select(key.alias("kb"), F.col("position").alias("pb"), F.col("s").alias("sb"), *[F.col(n).alias(f"b_{n}") for n in names])
    )
    common = reduce(
        lambda x, y: x + y, [F.bit_count(F.col(f"a_{n}").bitwiseAND(F.col(f"b_{n}"))) for n in names]
    ).cast("long")
    # small rows, much work per row: shuffled by tile pair even where one side could be broadcast
    pairs = left.join(right.hint("merge"), (F.col("ka") == F.col("kb")) & (F.col("pa") < F.col("pb"))).select(
        F.col("sa").alias("size_a"), F.col("sb").alias("size_b"), common.alias("common"), F.lit(2).cast("long").alias("w")
    )
    return pairs.unionByName(own)


def _listed_pairs(rows: DataFrame) -> DataFrame:
    """(size_a, size_b, common, w) from the elements that rows of a block share.

    Pairs are joined through their elements, so the work follows what is shared and not the width of the space.
    A block bounds the list of an element.  Pairs without a shared element are not formed: their
    number by sizes is what is left of all pairs of the block, and they come as one row with that weight."""
    cells = rows.select("block_id", "position", "s", F.explode("bits").alias("e"))
    left = cells.select(F.col("block_id").alias("ka"), F.col("e").alias("ea"), F.col("position").alias("pa"), F.col("s").alias("sa"))
    right = cells.select(F.col("block_id").alias("kb"), F.col("e").alias("eb"), F.col("position").alias("pb"), F.col("s").alias("sb"))
    meet = (F.col("ka") == F.col("kb")) & (F.col("ea") == F.col("eb")) & (F.col("pa") < F.col("pb"))
    shared = cut(left.join(right.hint("merge"), meet).groupBy("pa", "pb", "sa", "sb").agg(F.count(F.lit(1)).alias("common")))
    found = shared.select(F.col("sa").alias("size_a"), F.col("sb").alias("size_b"), "common", F.lit(2).cast("long").alias("w"))
    sizes = rows.groupBy("block_id", "s").agg(F.count(F.lit(1)).alias("n"))
    other = sizes.select("block_id", F.col("s").alias("sb"), F.col("n").alias("nb"))
    pairs = F.when(F.col("s") < F.col("sb"), F.col("n") * F.col("nb")).otherwise(F.expr("n * (n - 1) div 2"))
    every = sizes.join(other, "block_id").where(F.col("s") <= F.col("sb"))
    every = every.select(F.col("s").alias("size_a"), F.col("sb").alias("size_b"), pairs.cast("long").alias("pairs"))
    taken = shared.select(F.least("sa", "sb").alias("size_a"), F.greatest("sa", "sb").alias("size_b"), F.lit(-1).cast("long").alias("pairs"))
    apart = every.unionByName(taken).groupBy("size_a", "size_b").agg((2 * F.sum("pairs")).alias("w")).where(F.col("w") > 0)
    return found.unionByName(apart.select("size_a", "size_b", F.lit(0).cast("long").alias("common"), "w"))


def pair_counts(blocks: PackedBlocks) -> DataFrame:
    """(size_a, size_b, common, n) with size_a <= size_b over all ordered pairs."""
    if "bits" in blocks.rows.columns:
        a, b = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
        return pair_rows(blocks).groupBy(a.alias("size_a"), b.alias("size_b"), "common").agg(F.sum("w").alias("n"))
    wide = F.lit(blocks.n_bits + 1).cast("long")
    sizes = F.call_function("div", F.col("key"), wide)
    return _counted(blocks, "sizes").select(
        F.call_function("div", sizes, wide).alias("size_a"), (sizes % wide).alias("size_b"), (F.col("key") % wide).alias("common"), "n"
    )


def pair_metrics(counts: DataFrame, n_bits: int = 2048) -> DataFrame:
    """The five measures beside the sizes, all in one projection."""
    a, b, c = F.col("size_a"), F.col("size_b"), F.col("common")
    return counts.select("*", *[from_counts(m, a, b, c, n_bits).alias(m) for m in SET_MEASURES])


def pair_histograms(blocks: PackedBlocks, bins: int = 50) -> DataFrame:
    """A histogram per measure over all pairs: rows (metric, bin, lo, hi, n).

    Two passes over the pairs of blocks, one for the ranges and one for the bins, and one over those of a whole
    table (`_whole_bins`); only per-task counts leave the tasks that form them."""
    listed = "bits" in blocks.rows.columns
    whole = blocks.block_size is None and not listed
    spark = blocks.rows.sparkSession
    if listed:
        pairs = pair_metrics(pair_rows(blocks), blocks.n_bits)
        ends = pairs.agg(*[f(m).alias(f"{p}_{m}") for m in SET_MEASURES for p, f in (("lo", F.min), ("hi", F.max))]).first()
        ranges = _ranges({m: (ends[f"lo_{m}"], ends[f"hi_{m}"]) for m in SET_MEASURES if ends[f"lo_{m}"] is not None})
    elif whole:
        ranges, binned = _whole_bins(blocks, bins)
    else:
        rows, formed = _dealt(blocks, 4 * spark.sparkContext.defaultParallelism), _in_blocks(BIN_ROWS)
        ranges = _ranges(_found_ends(rows.mapInArrow(_bins(blocks.n_bits, bins, formed, {}, True), _FOUND)))
    schema = "metric string, bin int, lo double, hi double"
    frame = [
        (m, k, lo + k * ((hi - lo) / bins), lo + (k + 1) * ((hi - lo) / bins))
        for m, (lo, hi) in ranges.items()
        for k in range(bins)
    ]
    empty = spark.createDataFrame(frame, schema)  # measures x bins rows
    if not ranges:
        return empty.withColumn("n", F.lit(0).cast("long"))
    if listed:
        cells = []
        for m, (lo, hi) in ranges.items():
            number = F.least(F.floor((F.col(m) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
            # least() skips NULLs, so an undefined measure is sorted out by name
            cells.append(F.struct(F.lit(m).alias("metric"), F.when(F.col(m).isNotNull(), number).alias("bin")))
        binned = pairs.select(F.explode(F.array(*cells)).alias("_c"), F.col("w").alias("n")).where(F.col("_c.bin").isNotNull())
        binned = binned.select("_c.metric", "_c.bin", "n")
    elif not whole:
        binned = rows.mapInArrow(_bins(blocks.n_bits, bins, formed, ranges, False), _FOUND)
    counts = binned.groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    return F.broadcast(empty).join(counts, ["metric", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pair_values(blocks: PackedBlocks) -> DataFrame:
    """(metric, value, n): how often each value of each measure occurs.

    Four measures depend on the pair only through |A| + |B| and the shared
    bits, and the cosine through |A| * |B|; the pairs are counted by these, so
    the tables stay bounded by the bit space, not by the number of pairs."""
    if "bits" in blocks.rows.columns:
        rows = pair_rows(blocks)
        by_sum = rows.groupBy((F.col("size_a") + F.col("size_b")).alias("_s"), "common").agg(F.sum("w").alias("n"))
        by_product = rows.groupBy((F.col("size_a") * F.col("size_b")).alias("_p"), "common").agg(F.sum("w").alias("n"))
    else:
        wide = F.lit(blocks.n_bits + 1).cast("long")
        counted = cut(_counted(blocks, "sum", "product"))
        sizes, common = F.call_function("div", F.col("key"), wide), (F.col("key") % wide).alias("common")
        by_sum = counted.where("kind = 'sum'").select(sizes.alias("_s"), common, "n")
        by_product = counted.where("kind = 'product'").select(sizes.alias("_p"), common, "n")
    zero = F.lit(0).cast("long")
    linear = [
        F.struct(F.lit(m).alias("metric"), from_counts(m, F.col("_s"), zero, F.col("common"), blocks.n_bits).alias("value"))
        for m in ("tanimoto", "dice", "hamming", "manhattan")
    ]
    cosine = from_counts("cosine", F.col("_p"), F.lit(1).cast("long"), F.col("common"))
    stacked = (
        by_sum.select(F.explode(F.array(*linear)).alias("_m"), "n")
        .select("_m.metric", "_m.value", "n")
        .unionByName(by_product.select(F.lit("cosine").alias("metric"), cosine.alias("value"), "n"))
    )
    return stacked.where(F.col("value").isNotNull()).groupBy("metric", "value").agg(F.sum("n").alias("n"))


def pair_violins(blocks: PackedBlocks, bins: int = 30) -> DataFrame:
    """Quartiles and binned density per measure; the two distances are rescaled to [0, 1] first."""
    values = cut(pair_values(blocks))
    ends = values.groupBy("metric").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))  # five rows
    spread = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    scaled = F.when(F.col("metric").isin("hamming", "manhattan"), spread).otherwise(F.col("value"))
    rescaled = values.join(F.broadcast(ends), "metric").select("metric", scaled.alias("value"), "n")
    return violin_summary(rescaled, "value", ["metric"], bins, "n")
