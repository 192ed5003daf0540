"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of words (A-Z lower-cased, ASCII punctuation is a blank).  A document is contaminated
by an item of n words if some part of it is within ``floor(MAX_RATIO * n)`` word edits of the item.

The CGK embedding walks over a sequence: at step j it writes the word under the pointer and moves on by one if a random
function of (j, word) says so.  Two walks with the same function over sequences at a small edit distance come together again
after an edit, so the written sequences are at a small Hamming distance.  Bit-sampling LSH picks a few
steps; a window and a piece of an item are candidates if they wrote the same words there.  The pieces, ``PIECE`` words each, begin
every ``STRIDE`` words and the last ends with the item, so edits that crowd at its start, middle or end leave others
whole; a walk has fewer steps than its piece has words, so a piece that is whole is always found.  Items of fewer than ``2 * PIECE`` words
have shorter pieces, one at each word: one edit leaves one of them whole.  ``REPETITIONS`` walks with own functions and
own samples bring the recall for edits that are spread over the item to the target (the tests measure it).
A walk starts at every word of every document, and its samples are looked up one by one: a window whose
words so far belong to no piece is given up, which changes nothing but the work.

Candidates are confirmed exactly: first bounds (the window's words that the item has, and the item's that the window has),
then the edit distance.

The benchmark is a stated query set.  It goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text; a
larger one means further passes over what the last one wrote, never a larger broadcast.  Documents are not shuffled.

Defined results: null or empty texts and items have no words; such items match nothing.  Items with equal texts are all
listed.  An item without id is listed as null.  Every row gets its own result, repeated or not; an empty table on either
side gives no hits; very long texts are searched whole.  Names of further columns do not matter and the columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, packs, staged, text_column, word_hashes

#: Edits that are allowed, as a share of the item's words.
MAX_RATIO = 0.2
REPETITIONS = 8
#: Words of a piece, at most; a walk over one has as many steps.
PIECE = 8
#: Words between the beginnings of pieces.
STRIDE = 3
#: Repetitions whose random bits share an integer.
PACKED = 64 // PIECE
#: Text of benchmark items that goes to the tasks at a time.
BLOCK_BYTES = 4 << 20
_TO_BLANKS = bytes(
    b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256)
)
_PAD = np.uint64(0x5851F42D4C957F2D)
#: Odd factor that takes a key on to the next sampled word.
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def words_in(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_BLANKS).split() if text else []


def edit_distances(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row of ``texts`` the least edits that turn ``item`` into some part of it."""
    at = np.arange(texts.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(texts), texts.shape[1] + 1), np.int32)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (texts != word), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - at, axis=1) + at
    return row.min(1)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def _seed(n: int) -> np.uint64:
    return np.uint64(n * 0xD6E8FEB86659FD93 % 2**64)


def _randoms(hashes: np.ndarray) -> list[np.ndarray]:
    """The random bits of each word for all steps, of PACKED repetitions to an integer."""
    return [mix(hashes ^ _seed(1000 + i)) for i in range(-(-REPETITIONS // PACKED))]


def _moves(randoms: list[np.ndarray], at, repetition: int, step: int) -> np.ndarray:
    """Whether the walk moves on from the words ``at``."""
    bits = randoms[repetition // PACKED].take(at) >> np.uint64(repetition % PACKED * PIECE + step)
    return (bits & np.uint64(1)).view(np.int64)


def piece_length(n: int) -> int:
    """Words of the pieces of an item of n words: one edit leaves half of a short item whole."""
    return min(PIECE, n if n < 5 else n // 2)


def piece_offsets(n: int) -> list[int]:
    """Where the pieces of an item of n words begin: from its first word to where the last piece ends with it."""
    if not n:
        return []
    last = n - piece_length(n)
    return sorted({*range(0, last + 1, STRIDE if piece_length(n) == PIECE else 1), last})


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """The top bits that occur."""
    out = np.zeros(1 << 16, bool)
    out[(hashes >> np.uint64(48)).astype(np.int32)] = True
    return out


class Items:
    """A block of benchmark items and its lookup tables."""

    def __init__(self, rows: list[tuple], ratio: float):
        self.ids = [i for i, _ in rows]
        self.words = [word_hashes(words_in(t)) for _, t in rows]
        self.known = [_bitmap(w) for w in self.words]
        self.edits = [int(ratio * len(w)) for w in self.words]
        self.pieces = [(i, offset) for i, words in enumerate(self.words) for offset in piece_offsets(len(words))]
        self.piece_items = np.array([i for i, _ in self.pieces], np.int64)
        self.piece_offsets = np.array([o for _, o in self.pieces], np.int64)
        self.allowed = np.array(self.edits, np.int64)
        # the words of all items in a row, for the walks
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.randoms = _randoms(self.flat)
        begins = np.cumsum([0, *(len(w) for w in self.words)])
        by_length: dict[int, list[int]] = {}
        for p, (i, _) in enumerate(self.pieces):
            by_length.setdefault(piece_length(len(self.words[i])), []).append(p)
        self.classes = [
            (length, np.array(members), np.array([begins[self.pieces[p][0]] + self.pieces[p][1] for p in members]))
            for length, members in sorted(by_length.items())
        ]
        self.tables = [self._table(r) for r in range(REPETITIONS)]

    @staticmethod
    def steps(length: int, repetition: int) -> list[int]:
        """The sampled steps of pieces of a length, ascending: the first one and two more, so that no walk leaves its piece before them."""
        return sorted({min(s, length - 1) for s in (0, 1 + repetition % 4, PIECE - 1 - repetition // 4 % 3)})

    def _table(self, repetition: int) -> list[tuple]:
        """For each length of pieces the steps, the bitmaps of the keys up to each, the whole keys and their pieces."""
        out = []
        for length, members, at in self.classes:
            steps = self.steps(length, repetition)
            key, bitmaps = self.flat[at], []
            for step in range(steps[-1] + 1):
                if step in steps:
                    key = key * _NEXT + self.flat[at] if step else key
                    bitmaps.append(_bitmap(key))
                if step < steps[-1]:
                    at = at + _moves(self.randoms, at, repetition, step)
            order = np.argsort(key, kind="stable")
            out.append((steps, bitmaps, key[order], members[order]))
        return out


def _candidates(items: Items, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window start, piece) arrays: windows that agree with a piece in all sampled steps of a repetition.

    ``hashes`` ends with PIECE pads, so that no walk runs out."""
    randoms = _randoms(hashes)
    top = (hashes[: len(hashes) - PIECE] >> np.uint64(48)).astype(np.int32)
    starts = [np.flatnonzero(bitmaps[0].take(top)) for _, bitmaps, _, _ in items.tables[0]]
    first = [hashes.take(s) for s in starts]
    for repetition, classes in enumerate(items.tables):
        for (steps, bitmaps, keys, members), start, key in zip(classes, starts, first):
            at = start
            for k in range(1, len(steps)):
                for step in range(steps[k - 1], steps[k]):
                    at = at + _moves(randoms, at, repetition, step)
                key = key * _NEXT + hashes.take(at)
                alive = np.flatnonzero(bitmaps[k].take((key >> np.uint64(48)).astype(np.int32)))
                start, at, key = start.take(alive), at.take(alive), key.take(alive)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for shift in range(int((hi - lo).max(initial=0))):
                more = lo + shift < hi
                yield start[more], members[lo[more] + shift]


def find_items(items: Items, texts: list[list[bytes]]) -> list[list[tuple[int, int]]]:
    """For each text the (item number, edits) that it contains."""
    sizes = np.array([len(t) for t in texts])
    hits: list[dict[int, int]] = [{} for _ in texts]
    if not sizes.sum() or not items.pieces:
        return [[] for _ in texts]
    hashes = np.append(word_hashes([w for t in texts for w in t]), np.full(PIECE, _PAD))
    ends = np.cumsum(sizes)
    seen: list[np.ndarray] = []
    for start, piece in _candidates(items, hashes):
        if len(start):
            seen.append(start * len(items.pieces) + piece)
    if not seen:
        return [[] for _ in texts]
    starts, pieces = np.divmod(_distinct(np.concatenate(seen)), len(items.pieces))
    owner = np.searchsorted(ends, starts, "right")
    # pieces of an item that lie alike ask for the same part of the text, which is looked at once
    numbers = items.piece_items[pieces]
    lo = np.maximum(ends[owner] - sizes[owner], starts - items.piece_offsets[pieces] - items.allowed[numbers])
    numbers, lo = np.divmod(_distinct(numbers * len(hashes) + lo), len(hashes))
    owner = np.searchsorted(ends, lo, "right")
    top = (hashes >> np.uint64(48)).astype(np.int32)
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    for first, after in zip(cuts, cuts[1:]):
        item = int(numbers[first])
        words, edits = items.words[item], items.edits[item]
        width = np.arange(len(words) + 2 * edits, dtype=np.int32)
        for block in range(first, after, 4096):
            part = slice(block, min(after, block + 4096))
            spot = lo[part, None] + width
            inside = spot < ends[owner[part], None]
            grid = np.minimum(spot, len(hashes) - 1)
            shared = (items.known[item].take(top.take(grid)) & inside).sum(1)
            rows = np.flatnonzero(shared >= len(words) - edits)
            for some in range(0, len(rows), 256):
                few = rows[some : some + 256]
                near = np.where(inside[few], hashes[grid[few]], _PAD)
                # of the item's own words, all but the edits must be there too
                there = (near[:, :, None] == words).any(axis=1).sum(axis=1)
                few, near = few[there >= len(words) - edits], near[there >= len(words) - edits]
                for row, distance in zip(few.tolist(), edit_distances(words, near).tolist() if len(few) else ()):
                    text = int(owner[block + row])
                    if distance <= min(edits, hits[text].get(item, edits)):
                        hits[text][item] = distance
    return [sorted(h.items()) for h in hits]


@lru_cache(maxsize=4)
def _built(rows: tuple, ratio: float) -> Items:
    return Items(list(rows), ratio)


def _search(rows: tuple, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(rows, ratio)
        for batch in packs(batches, "_text"):
            texts = [words_in(t) for t in batch.column("_text").to_pylist()]
            found = find_items(items, texts)
            old = batch.column("hits").to_pylist()
            hits = [
                (o or []) + [{"item_id": items.ids[i], "edits": e} for i, e in f] for o, f in zip(old, found)
            ]
            columns = [batch.column(n) for n in batch.schema.names]
            at = batch.schema.names.index("hits")
            columns[at] = pa.array(hits, batch.schema.field("hits").type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple]:
    """The items, in blocks of bounded size: one block at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long"), text_column(benchmark).cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    n = max(1, -(-size // (block_bytes // 2)))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield tuple(sorted(((r["item_id"], bytes(r["text"])) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def _searched(docs: DataFrame, benchmark: DataFrame, ratio: float, block_bytes: int) -> DataFrame:
    """(row, hits): each row of ``docs`` as a struct, so that no name of its columns can clash."""
    empty = F.array().cast("array<struct<item_id:long,edits:long>>")
    row = F.struct(*docs.columns).alias("row")
    out = docs.select(row, empty.alias("hits"), text_column(docs).cast("binary").alias("_text"))
    for number, rows in enumerate(_blocks(benchmark, block_bytes)):
        # what was found so far is written, so that the driver and the plan hold one block of items and no more
        out = staged(out, "hits") if number else out
        out = out.mapInArrow(_search(rows, ratio), out.schema)
    return out.select("row", F.array_sort("hits").alias("hits"))


def with_hits(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_RATIO, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``hits``: an array of (item_id, edits), empty for a clean document.  A column of that name is replaced."""
    kept = [f"row.{c}" for c in docs.columns if c != "hits"]
    return _searched(docs, benchmark, ratio, block_bytes).select(*kept, "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_RATIO) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, fewest_edits) of every row."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, ratio)
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.col("hits.item_id").alias("item_ids"),
        F.array_min("hits.edits").alias("fewest_edits"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_RATIO) -> DataFrame:
    """The clean rows of ``docs``, all their columns unchanged."""
    return _searched(docs, benchmark, ratio, BLOCK_BYTES).where(F.size("hits") == 0).select("row.*")
