"""Exact similarity join of bit sets at a Tanimoto threshold.

Prefix filtering (Bayardo et al. 2007; Xiao et al. 2008): with the elements of
every set in one global order, rare elements first, two sets of sizes a and b
with Tanimoto >= t share an element among the first a - ceil(t*a) + 1 of the
one and the first b - ceil(t*b) + 1 of the other.  Joining on these elements
finds every pair; length and position bounds drop most of the rest.  So does a
bitmap bound (Sandes et al. 2020): folding sets to a few words by parity never
makes them differ more, so two words that differ too much rule a pair out.  The
remaining candidates are compared in full.

The number of candidates depends on how rare the rarest elements are.  A wide bit space (2**30) keeps the
elements of long texts apart and the candidates few.  Sets folded into few bits share most of them, and postings
would meet more often than there are pairs: such sets are packed and compared in tiles of like sizes (`join_index`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayspark.functions.measures import from_counts
from assayspark.functions.text import bind
from assayspark.operators import bitrows
from assayspark.operators.spread import attach_by_key
from assayspark.sources.stages import cut, release, tidy

EPS = 1e-9
POSTINGS_PER_TASK = 20_000
#: Widest space whose sets may be compared as they are, what a posting's match costs in such comparisons, rows of a tile.
PACKED_BITS = 16_384
MATCH_COST = 20
TILE_ROWS = (2_048, 32_768)
SIGNATURE = [f"x{k}" for k in range(8)]


def distinct_sets(df: DataFrame, id: str, bits: str = "bits") -> DataFrame:
    """One row per distinct set: ``rep`` (its least id), ``bits``, ``copies``.

    A group of equal rows becomes one row before anything is joined, combined
    ahead of the shuffle."""
    rows = df.where(F.col(bits).isNotNull())
    return rows.groupBy(F.col(bits).alias("bits")).agg(F.min(id).alias("rep"), F.count(F.lit(1)).alias("copies"))


def written_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct sets of written ``rows`` (id, bits) without moving or storing a set again.

    Gives the rows with their digest in place of the set (id, bits, _row), the digests with the least id, the number of rows and the
    place of one row of that id (bits, rep, copies, _row), and (rep, bits) of the rows at these places, read from ``rows`` as
    they are needed.  Sets meet as their SHA-256, and the tasks receive a bit per row."""
    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.withColumn("_row", F.monotonically_increasing_id())  # the place of a row in the written files
    named = cut(placed.mapInArrow(bitrows.digests, f"id {kind}, bits binary, _row long"))
    order = F.struct(F.col("id").isNull(), "id", "_row")
    best = F.min_by("_row", order).alias("_row")
    firsts = cut(named.groupBy("bits").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), best))
    places = firsts.groupBy(F.shiftright("_row", 33).cast("int").alias("part")).agg(
        F.collect_list(F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).alias("places")
    )
    marks = {r["part"]: bytes(r["marks"]) for r in tidy(places.mapInArrow(bitrows.row_marks, "part int, marks binary")).collect()}
    held = rows.sparkSession.sparkContext.broadcast(marks)
    return named, firsts, placed.mapInArrow(bitrows.marked_rows(held), f"rep {kind}, bits array<int>")


def set_digest(bits: str) -> Column:
    return F.xxhash64(bits)


def copy_groups(df: DataFrame, id: str, bits: str = "bits", sets: DataFrame | None = None) -> DataFrame:
    """(id, rep, copies): each row with the first row that has the same set."""
    sets = distinct_sets(df, id, bits) if sets is None else sets
    rows = df.where(F.col(bits).isNotNull()).select(F.col(id).alias("id"), F.col(bits).alias("bits"))
    digest = set_digest("bits").alias("_digest")
    # the sets themselves travel only where two of them share a digest
    named = cut(sets.select(digest, "rep", "copies"))
    clash = cut(named.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    if clash.isEmpty():
        return attach_by_key(rows.select("id", digest), named, "_digest", "copies").select("id", "rep", "copies")
    return attach_by_key(rows, sets.select("bits", "rep", "copies"), "bits", "copies").select("id", "rep", "copies")


@dataclass
class PrefixIndex:
    """``sets`` (rep, bits) that have postings, and the written ``prefix`` postings of one join; ``live`` is the stage behind the sets."""

    sets: DataFrame
    prefix: DataFrame
    threshold: float
    live: DataFrame | None = None


@dataclass
class PackedIndex:
    """Written rows (rep, size, words): the sets of a narrow space, which are compared as they are."""

    prefix: DataFrame
    threshold: float
    live: DataFrame | None = None


def parity_words(bits: str) -> list[Column]:
    """Eight 64-bit words; bit i is the parity of the elements that are i modulo 512."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(k: int) -> Column:
        inside = F.filter(F.col(bits), lambda b: F.shiftright(b, 6).bitwiseAND(F.lit(7)) == k)
        folded = F.aggregate(
            inside, zero, lambda acc, b: acc.bitwiseXOR(F.call_function("shiftleft", one, b.bitwiseAND(F.lit(63))))
        )
        return F.coalesce(folded, zero)

    return [word(k) for k in range(len(SIGNATURE))]


def _measured(sets: DataFrame) -> tuple[int, int, int, int]:
    """Number of sets and of elements, least and greatest element."""
    found = sets.agg(F.count(F.lit(1)), F.sum(F.size("bits")), F.min(F.array_min("bits")), F.max(F.array_max("bits"))).first()
    return found[0], found[1] or 0, found[2], found[3]


def join_index(sets: DataFrame, threshold: float) -> PrefixIndex | PackedIndex:
    """The index that suits the sets: packed rows where prefixes would meet about as often as there are pairs."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    n, elements, least, greatest = _measured(sets)
    if elements and 0 <= least and greatest < PACKED_BITS:
        prefix = (1.0 - threshold) * elements / n
        if prefix * prefix * MATCH_COST > greatest + 1:
            return _packed_index(sets, threshold, greatest + 1)
    return prefix_index(sets, threshold, elements)


def _packed_index(sets: DataFrame, threshold: float, n_bits: int) -> PackedIndex:
    words = 1 << max(0, math.ceil(math.log2(n_bits / 64)))
    kind = sets.schema["rep"].dataType.simpleString()
    return PackedIndex(cut(sets.select("rep", "bits").mapInArrow(bitrows.packed(words), f"rep {kind}, size int, words binary")), threshold)


def prefix_index(sets: DataFrame, threshold: float, elements: int | None = None) -> PrefixIndex:
    """Order each set by element frequency and list its prefix elements.

    ``sets`` is read several times and should be a written stage.  The elements are counted once, range by
    range; after that each set is ordered where it lies.  An element of
    one set only cannot join: such elements fill the first places of a set's
    order, so their number is enough, and only shared elements are carried on.
    Any common order finds every pair, so the marks of shared elements and the list of frequent ones may
    be bounded.  Empty sets have no elements; the one distinct empty set is equal only to its
    own copies."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    if elements is None:
        elements = _measured(sets)[1]
    context = sets.sparkSession.sparkContext
    rare = bitrows.rarity(sets, elements)
    held, again = context.broadcast(rare), None
    kind = sets.schema["rep"].dataType.simpleString()
    signature = ", ".join(f"{n} long" for n in SIGNATURE)
    schema = f"rep {kind}, bits array<int>, size int, _o array<bigint>, _p array<int>, {signature}"
    if rare.full():
        # a share of the elements is in the prefixes, and marks of these alone tell more of them apart
        met = sets.select("rep", "bits").mapInArrow(bitrows.prefixes(held, threshold), schema)
        again = context.broadcast(bitrows.rarity(met, elements, "_o", mix=False))
    live = cut(sets.select("rep", "bits").mapInArrow(bitrows.prefixes(held, threshold, again), schema))
    postings = live.select("rep", "size", "_p", *SIGNATURE, F.posexplode("_o").alias("_at", "element"))
    postings = postings.withColumn("pos", F.get("_p", F.col("_at"))).drop("_p", "_at")
    frequency = postings.groupBy("element").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") > 1)
    frequency = cut(frequency)
    prefix = cut(attach_by_key(postings, frequency, "element", "freq").select("element", "freq", "rep", "size", "pos", *SIGNATURE))
    release(frequency)
    return PrefixIndex(live.select("rep", "bits"), prefix, threshold, live)


def _candidates(left: DataFrame, right: DataFrame, t: float, postings_per_task: int, share: float = 1.0) -> DataFrame:
    """Distinct (a, b), a < b, that pass the prefix, length and position bounds.

    The postings of a frequent element are cut into pieces: the right side, which
    may be the longer one, is dealt out by row and the left side repeated per
    piece, so one element never makes one long task.  ``share`` is the part of
    all sets on the right side; it sets the number of pieces only."""
    pieces = F.greatest(F.ceil(F.col("freq") * F.lit(share) / F.lit(postings_per_task)), F.lit(1)).cast("int")
    a = left.select(
        F.col("element").alias("ea"),
        F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_a"),
        F.col("rep").alias("a"),
        F.col("size").alias("na"),
        F.col("pos").alias("pa"),
        *[F.col(n).alias(f"a_{n}") for n in SIGNATURE],
    )
    b = right.select(
        F.col("element").alias("eb"),
        F.pmod(F.xxhash64("rep"), pieces).cast("int").alias("piece_b"),
        F.col("rep").alias("b"),
        F.col("size").alias("nb"),
        F.col("pos").alias("pb"),
        *[F.col(n).alias(f"b_{n}") for n in SIGNATURE],
    )
    na, nb = F.col("na"), F.col("nb")
    needed = F.ceil((na + nb) * F.lit(t / (1.0 + t)) - F.lit(EPS))
    differing = reduce(
        lambda x, y: x + y, [F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in SIGNATURE]
    )
    reachable = F.least(na - F.col("pa"), nb - F.col("pb"))
    on = (
        (F.col("ea") == F.col("eb"))
        & (F.col("piece_a") == F.col("piece_b"))
        & (F.col("a") < F.col("b"))
        & (nb >= na * F.lit(t) - F.lit(EPS))
        & (na >= nb * F.lit(t) - F.lit(EPS))
        & (reachable >= needed)
        & (differing <= (na + nb) * F.lit((1.0 - t) / (1.0 + t)) + F.lit(EPS))
    )
    return a.join(b, on).select("a", "b").distinct()


def _verified(candidates: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(id_a, id_b, similarity) of the candidates that reach the threshold."""
    found = cut(candidates)
    n = found.count()

    def with_bits(rows: DataFrame, key: str) -> DataFrame:
        load = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_load"))
        side = sets.select(F.col("rep").alias(key), F.col("bits").alias(f"bits_{key}"))
        return attach_by_key(rows, load.join(side, key), key, "_load", left_rows=n).drop("_load")

    both = with_bits(with_bits(found, "a"), "b")
    score = bind(F.size(F.array_intersect("bits_a", "bits_b")), lambda c: from_counts("tanimoto", F.size("bits_a"), F.size("bits_b"), c))
    # generated and not filtered: a filter would have the sets compared once more
    reached = F.explode(F.filter(F.array(score), lambda x: x >= F.lit(t))).alias("similarity")
    return both.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), reached)


@dataclass
class _Tile:
    low: int
    high: int


def _tiles(rows: DataFrame, tile_rows: int | None = None) -> tuple[DataFrame, list[_Tile]]:
    """``rows`` with the number of their tile: neighbouring sizes, dealt out by row where one size has more rows than a tile."""
    counts = sorted(rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())  # a narrow space has few sizes
    total = sum(n for _, n in counts)
    limit = tile_rows or min(max(total // 64, TILE_ROWS[0]), TILE_ROWS[1])
    tiles: list[_Tile] = []
    places, held = [], limit
    for size, n in counts:
        pieces = -(-n // limit)
        if pieces == 1 and held + n <= limit:
            tiles[-1].high = size
            places.append((size, len(tiles) - 1, 1))
            held += n
            continue
        places.append((size, len(tiles), pieces))
        tiles += [_Tile(size, size) for _ in range(pieces)]
        held = n if pieces == 1 else limit
    place = F.broadcast(rows.sparkSession.createDataFrame(places, "size int, _first int, _pieces int"))
    tile = F.col("_first") + F.pmod(F.xxhash64("rep"), F.col("_pieces")).cast("int")
    return rows.join(place, "size").select("rep", "size", "words", tile.alias("tile")), tiles


def _packed_pairs(left: DataFrame, right: DataFrame, t: float, tile_rows: int | None = None) -> DataFrame:
    """All pairs a < b that reach the threshold, a of ``left`` and b of ``right``.

    Sets are dealt out in tiles of like sizes; tiles whose sizes cannot reach the threshold never meet.  A pair of
    tiles is one key and is compared in one task, on parity words first."""
    itself = left is right
    kind = left.schema["rep"].dataType.simpleString()
    out = f"id_a {kind}, id_b {kind}, similarity double"
    a, a_tiles = _tiles(left, tile_rows)
    b, b_tiles = (a, a_tiles) if itself else _tiles(right, tile_rows)
    deal = []
    for i, x in enumerate(a_tiles):
        for j, y in enumerate(b_tiles):
            if (not itself or i <= j) and x.high >= y.low * t - EPS and y.high >= x.low * t - EPS:
                deal.append((i, j, len(deal), itself and i == j))
    if not deal:
        return left.sparkSession.createDataFrame([], out)
    session, shape = left.sparkSession, "tile int, key int, itself boolean, side int"
    first = F.broadcast(session.createDataFrame([(i, k, own, 0) for i, _, k, own in deal], shape))
    second = F.broadcast(session.createDataFrame([(j, k, own, 1) for _, j, k, own in deal if not own], shape))
    columns = ["key", "itself", "side", "rep", "size", "words"]
    both = a.join(first, "tile").select(columns).unionByName(b.join(second, "tile").select(columns))
    tasks = min(len(deal), max(session.sparkContext.defaultParallelism * 4, len(deal) // 4))
    ordered = both.repartition(tasks, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(bitrows.near_pairs(t, not itself), out)


def join_postings(
    index: PrefixIndex | PackedIndex,
    left: DataFrame,
    right: DataFrame,
    postings_per_task: int = POSTINGS_PER_TASK,
    share: float = 1.0,
) -> DataFrame:
    """Verified pairs between two parts of the index's postings, the earlier id first."""
    if isinstance(index, PackedIndex):
        return _packed_pairs(left, right, index.threshold)
    found = _candidates(left, right, index.threshold, postings_per_task, share)
    return _verified(found, index.sets, index.threshold)


def similarity_join(
    df: DataFrame, id: str, bits: str = "bits", threshold: float = 0.8, postings_per_task: int = POSTINGS_PER_TASK
) -> DataFrame:
    """All pairs of *distinct* sets with Tanimoto >= threshold: (id_a, id_b, similarity), id_a < id_b.

    Each distinct set is named by its least id.  Rows with equal sets are listed
    once each by `copy_groups` instead of as all their pairs; joining both ends
    to that table gives the pairs of rows where they are wanted."""
    index = join_index(cut(distinct_sets(df, id, bits)), threshold)
    return join_postings(index, index.prefix, index.prefix, postings_per_task)
