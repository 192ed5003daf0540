"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each; the index of the cell on the Hilbert curve
through that grid is the sort key, so rows that are alike in all dimensions lie close together
and a file holds a narrow range of each.  The sorted rows are cut into runs with counts at most one apart.

No task sorts all rows and no cell has to fit in one: below the curve index the key goes on with a hash, ranges of
keys come from a sketch of their quantiles, positions are taken inside ranges and added up over range totals.

Rows with a null in a dimension lie in its cell 0.  A null text counts as empty.  Rows that are equal in doc_id and
text are dealt in any order among themselves; with fewer rows than shards, some shards are empty; an empty table
gives an empty result.  Further columns are kept by `hilbert_shards`.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayspark.operators.spread import running_totals

from .common import staged, text_column

#: Bits per dimension.
BITS = 6
#: Bits of the hash that continues the key inside a cell.
HASH_BITS = 20


def name_cell(name: Column, bits: int = BITS) -> Column:
    """A cell for a name: by its hash, the same in every table."""
    return F.when(name.isNull(), 0).otherwise(F.pmod(F.xxhash64(name), F.lit((1 << bits) - 1)) + 1).cast("int")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """A cell for a size: three to each doubling."""
    return F.coalesce(F.least(F.floor(F.log2(F.greatest(size, F.lit(0)) + 1.0) * 3), F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a grid cell, by reflecting and exchanging axes from the top bit down."""
    n = len(cells)
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    plan = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps])

    def turn(x: Column, step: Column) -> Column:
        low = step["q"] - 1
        own = F.get(x, step["i"])
        is_set = own.bitwiseAND(step["q"]) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, j: F.when(is_set & (j == 0), v.bitwiseXOR(low))
            .when(~is_set & ((j == 0) | (j == step["i"])), F.when(step["i"] == 0, v).otherwise(v.bitwiseXOR(swap)))
            .otherwise(v),
        )

    def finish(x: Column) -> Column:
        gray = F.transform(
            x, lambda _, i: F.aggregate(F.slice(x, F.lit(1), i + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v))
        )
        return _bound(gray, lambda g: _bound(_undone(g, bits), lambda h: _woven(h, n, bits)))

    return F.aggregate(plan, F.array(*cells), turn, finish)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas read it many times."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def _undone(gray: Column, bits: int) -> Column:
    flips = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    last = F.element_at(gray, -1)
    undo = F.aggregate(flips, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    return F.transform(gray, lambda v: v.bitwiseXOR(undo))


def _woven(cells: Column, n: int, bits: int) -> Column:
    """The bits of all cells, top bits first."""
    terms = [
        F.when(F.get(cells, F.lit(i)).bitwiseAND(F.lit(1 << b)) != 0, F.lit(1 << (b * n + n - 1 - i))).otherwise(F.lit(0))
        for b in range(bits)
        for i in range(n)
    ]
    return reduce(lambda a, b: a + b, (t.cast("long") for t in terms))


def document_cells(size: Column) -> Mapping[str, Column]:
    """The dimensions of a document: language, source, size in bytes."""
    return {
        "lang": name_cell(F.col("lang")),
        "source": name_cell(F.col("source")),
        "size": size_cell(size),
    }


def hilbert_shards(df: DataFrame, cells: Mapping[str, Column], shards: int, tie: list[str], rows_per_range: int = 100_000) -> DataFrame:
    """``df`` with curve (index), shard and slot; ``tie`` names the columns that settle the order inside a cell."""
    names = [f"cell_{c}" for c in cells]
    out = df.drop("curve", "shard", "slot").withColumns({f"cell_{c}": v for c, v in cells.items()})
    out = out.withColumn("curve", hilbert_index([F.col(c) for c in names]))
    fine = F.pmod(F.xxhash64(*tie), F.lit(1 << HASH_BITS))
    out = staged(out.withColumn("_key", F.col("curve") * (1 << HASH_BITS) + fine), "curve")
    total = out.count()
    ranked = running_totals(out, ["_key", *tie], {"_rank": F.lit(1)}, rows_per_bucket=rows_per_range)
    place = F.col("_rank").cast("long") - 1
    # shard s begins at ceil(s * total / shards)
    # whole-number division: shard s begins at ceil(s * total / shards)
    ranked = ranked.withColumn("shard", F.expr(f"(CAST(_rank AS long) - 1) * {shards} DIV {max(total, 1)}").cast("int"))
    start = F.expr(f"(CAST(shard AS long) * {total} + {shards - 1}) DIV {shards}")
    return ranked.withColumn("slot", place - start).drop("_key", "_rank", *names)


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32 and the place of every document; the text itself is read once and not moved."""
    text = text_column(docs)
    narrow = docs.select(
        "doc_id", "lang", "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return hilbert_shards(narrow, document_cells(F.col("size")), shards, ["doc_id", "text_crc32", "size"])


def shard_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard the rows and the least and greatest value of each column: what a reader skips files by."""
    cuts = [f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *cuts)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, sorted along the curve inside the files; large shards become several files."""
    order = ["shard", "slot"]
    sharded.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("shard").parquet(path)
