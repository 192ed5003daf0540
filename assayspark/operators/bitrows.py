"""Steps of the similarity join that look at all elements of many sets, as Arrow batches inside tasks.

Elements are mixed to 32 bits (`mixed`), one to one for ``array<int>``, so that ranges of them are even and their order
is unrelated to the data.  `Rarity` says which elements occur in one set only and which are frequent; it is bounded
whatever the data, and any loss in it costs candidates and never a pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayspark.sources.stages import tidy

EPS = 1e-9
#: Elements that a task counts at once, ranges of elements, bits that mark shared elements, frequent elements kept per range.
FLUSH = 1 << 22
RANGES = 1_024
RANGES_PER_TASK = 16
MARKED_BITS = 28
HOT_PER_RANGE = 1_024
HOT_FROM = 32
WORDS = 8
#: Share of set marks above which too many elements are taken for shared ones.
FULL_MARKS = 1 / 16
#: Pairs that are handed on at once, rows of one batch that are unpacked at once.
EMIT = 100_000
UNPACK = 1_024


def mixed(values: np.ndarray) -> np.ndarray:
    """32-bit numbers, one to one."""
    x = values.astype(np.int64).astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat elements, and the number of elements of each row."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.flatten()), np.diff(offsets)


# --- one row of equal sets ----------------------------------------------------


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets replaced by their SHA-256, which stands for them wherever they are only told apart."""
    for batch in batches:
        flat, sizes = _lists(batch.column("bits"))
        raw, ends = memoryview(np.ascontiguousarray(flat, np.int32)).cast("B"), 4 * np.cumsum(sizes)
        named = [hashlib.sha256(raw[end - 4 * size : end]).digest() for end, size in zip(ends.tolist(), sizes.tolist())]
        yield batch.set_column(batch.schema.get_field_index("bits"), "bits", pa.array(named, pa.binary()))


def row_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, marks): a bit per row of a partition, set at the places listed."""
    for batch in batches:
        for row in batch.to_pylist():
            places = np.asarray(row["places"], np.int64)
            flags = np.zeros(places.max() + 1, np.uint8)
            flags[places] = 1
            yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "marks": [np.packbits(flags).tobytes()]})


def marked_rows(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(rep, bits) of the rows whose number `_row` is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flags = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.asarray(batch.column("_row"))
            if part != numbers[0] >> 33:  # the rows of a task are of one partition
                part = numbers[0] >> 33
                flags = np.unpackbits(np.frombuffer(held.value.get(int(part), b""), np.uint8))
            places = numbers & ((1 << 33) - 1)
            places = np.flatnonzero((places < len(flags)) & (flags[np.minimum(places, len(flags) - 1)] > 0)) if len(flags) else []
            chosen = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_pydict({"rep": chosen.column("id"), "bits": chosen.column("bits")})

    return run


# --- elements and how many sets they are in -----------------------------------


@dataclass
class Rarity:
    """A bit per value of the leading bits of a mixed element, set where a shared element falls; frequent elements with their magnitude."""

    shift: int
    marks: np.ndarray
    hot: np.ndarray
    level: np.ndarray

    def shared(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint32(self.shift)
        return (self.marks[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1 > 0

    def full(self) -> bool:
        """True when so many marks are set that elements of one set are often taken for shared ones."""
        return int(np.bitwise_count(self.marks).sum(dtype=np.int64)) > 8 * len(self.marks) * FULL_MARKS

    def levels(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(h), np.uint8)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return np.where(self.hot[at] == h, self.level[at], 0).astype(np.uint8)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, their first bytes first and so on: where they are small, most of it is zeros, which shrink to nothing on the way."""
    return np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _counted(range_bits: int, mix: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Elements range by range: the steps from one to the next, and their numbers."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        counts = counts.astype(np.int32)
        ranges = values.astype(np.int64) >> (32 - range_bits)
        names, starts = np.unique(ranges, return_index=True)
        ends = [*starts[1:], len(values)]
        return pa.RecordBatch.from_pydict({
            "range": pa.array(names.astype(np.int32)),
            "e": pa.array([_planes(np.diff(values[a:b], prepend=np.uint32(0))) for a, b in zip(starts, ends)], pa.binary()),
            "n": pa.array([_planes(counts[a:b]) for a, b in zip(starts, ends)], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            h = _lists(batch.column("bits"))[0]
            h = mixed(h) if mix else h.astype(np.uint32)
            parts.append(h)
            held += len(h)
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _marked(range_bits: int, mark_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The marks and the frequent elements of each range; rows come sorted by range."""

    def marks(name: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        e, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(e)
        e, n = e[order], n[order]
        starts = np.flatnonzero(np.diff(e.astype(np.int64), prepend=-1))
        e, n = e[starts], np.add.reduceat(n.astype(np.int64), starts)
        width = 1 << (mark_bits - range_bits)
        flags = np.zeros(width, np.uint8)
        flags[(e[n > 1] >> np.uint32(32 - mark_bits)).astype(np.int64) & (width - 1)] = 1
        top = np.flatnonzero(n >= HOT_FROM)
        if len(top) > HOT_PER_RANGE:
            top = np.sort(top[np.argsort(-n[top], kind="stable")[:HOT_PER_RANGE]])
        level = np.floor(np.log2(n[top])).astype(np.uint8)
        return pa.RecordBatch.from_pydict({
            "range": pa.array([name], pa.int32()), "marks": [np.packbits(flags, bitorder="little").tobytes()],
            "hot": [e[top].tobytes()], "level": [level.tobytes()],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts = None, []
        for batch in batches:
            for at, e, n in zip(*(batch.column(c) for c in ("range", "e", "n"))):
                if at.as_py() != name:
                    if parts:
                        yield marks(name, parts)
                    name, parts = at.as_py(), []
                parts.append((np.cumsum(_numbers(e.as_py()), dtype=np.uint32), _numbers(n.as_py())))
        if parts:
            yield marks(name, parts)

    return run


def rarity(sets: DataFrame, elements: int, bits: str = "bits", mix: bool = True) -> Rarity:
    """Count the elements of all sets, range by range; the driver receives marks of at most 32 MB and a bounded list.

    ``mix`` is off for elements that are mixed already."""
    range_bits = min(int(math.log2(RANGES)), max(1, math.ceil(math.log2(max(elements, 2) / 2**16))))
    mark_bits = min(MARKED_BITS, max(range_bits + 3, math.ceil(math.log2(max(elements, 2))) + 3))
    counted = sets.select(F.col(bits).alias("bits")).mapInArrow(_counted(range_bits, mix), "range int, e binary, n binary")
    met = counted.repartition(max(1, (1 << range_bits) // RANGES_PER_TASK), "range").sortWithinPartitions("range")
    found = tidy(met.mapInArrow(_marked(range_bits, mark_bits), "range int, marks binary, hot binary, level binary")).collect()
    share = (1 << (mark_bits - range_bits)) // 8
    marks = np.zeros(share << range_bits, np.uint8)
    found.sort(key=lambda r: r["range"])
    for r in found:
        marks[r["range"] * share : (r["range"] + 1) * share] = np.frombuffer(r["marks"], np.uint8)
    hot = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(r["hot"], np.uint32) for r in found]])
    level = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(r["level"], np.uint8) for r in found]])
    return Rarity(32 - mark_bits, marks, hot, level)


def prefixes(held, threshold: float, again=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets with shared elements in their prefix: these elements, the number of elements before each, parity words.

    Elements of one set only come first in a set's order, so their number is enough.  ``again`` marks what is shared
    among the prefixes themselves; other elements are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = held.value
        for batch in batches:
            flat, sizes = _lists(batch.column("bits"))
            h = mixed(flat)
            row = np.repeat(np.arange(len(sizes)), sizes)
            shared = rare.shared(h)
            single = sizes - np.bincount(row[shared], minlength=len(sizes))
            take = sizes - np.ceil(sizes * threshold - EPS).astype(np.int64) + 1 - single
            live = (take > 0) & (sizes > single)
            if not live.any():
                continue
            of = np.flatnonzero(live)
            inside = live[row]
            h, row, shared = h[inside], row[inside], shared[inside]
            # parity of the elements of a set that fall on each of 512 places
            cells = np.bincount((np.searchsorted(of, row) << 9) | (flat[inside] & 511).astype(np.int64), minlength=len(of) << 9)
            words = np.packbits((cells & 1).astype(np.uint8).reshape(len(of), -1), axis=1, bitorder="little").view(np.int64)
            h, row = h[shared], row[shared]
            order = np.lexsort((h, rare.levels(h), row))
            h, row = h[order], row[order]
            first = np.searchsorted(row, of)
            rank = np.arange(len(row)) - first[np.searchsorted(of, row)]
            keep = rank < take[row]
            if again is not None:
                keep &= again.value.shared(h)
            listed = np.bincount(row[keep], minlength=len(sizes))[of]
            words, of, listed = words[listed > 0], of[listed > 0], listed[listed > 0]
            ends = np.concatenate([[0], np.cumsum(listed)]).astype(np.int32)
            part = batch.take(pa.array(of))
            columns = {"rep": part.column("rep"), "bits": part.column("bits"), "size": pa.array(sizes[of].astype(np.int32))}
            columns |= {"_o": pa.ListArray.from_arrays(ends, pa.array(h[keep].astype(np.int64)))}
            columns |= {"_p": pa.ListArray.from_arrays(ends, pa.array((single[row] + rank)[keep].astype(np.int32)))}
            columns |= {f"x{k}": pa.array(np.ascontiguousarray(words[:, k])) for k in range(WORDS)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


# --- sets in a narrow space, compared as they are -----------------------------


def packed(n_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bit sets as ``n_words`` 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, UNPACK):
                part = batch.slice(lo, UNPACK)
                flat, sizes = _lists(part.column("bits"))
                cells = np.zeros((len(sizes), 64 * n_words), np.uint8)
                cells[np.repeat(np.arange(len(sizes)), sizes), flat] = 1
                words = np.packbits(cells, axis=1, bitorder="little")
                yield pa.RecordBatch.from_pydict({
                    "rep": part.column("rep"), "size": pa.array(sizes.astype(np.int32)),
                    "words": pa.array([w.tobytes() for w in words], pa.binary()),
                })

    return run


@dataclass
class _Side:
    reps: np.ndarray
    sizes: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> _Side:
        sizes = np.asarray(rows.column("size").combine_chunks(), np.int64)
        words = np.frombuffer(b"".join(rows.column("words").to_pylist()), np.uint64).reshape(len(sizes), -1)
        order = np.argsort(sizes, kind="stable")
        return cls(rows.column("rep").to_numpy()[order], sizes[order], words[order])


def _folds(size: int, n_words: int, c: float) -> int:
    """Words to fold a set to, so that sets that meet by chance still differ in more places than a pair may."""
    k = 1
    while k < n_words:
        places = 64.0 * k
        odd = (1 - (1 - 2 / places) ** min(size, 64 * n_words)) / 2
        differ = 2 * odd * (1 - odd)
        if places * differ - 4 * math.sqrt(places * differ * (1 - differ)) > 2 * c * size:
            return k
        k *= 2
    return n_words


def _near(left: _Side, right: _Side, t: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, similarity) of the pairs that reach the threshold."""
    c = (1.0 - t) / (1.0 + t)
    n_words = left.words.shape[1]
    allowed = (right.sizes * c).astype(np.float32)
    folded: dict[int, np.ndarray] = {}

    def fold(words: np.ndarray, k: int) -> np.ndarray:
        return np.bitwise_xor.reduce(words.reshape(len(words), -1, k), axis=1)

    low = np.searchsorted(right.sizes, np.ceil(left.sizes * t - EPS))
    high = np.searchsorted(right.sizes, np.floor(left.sizes / t + EPS), side="right")
    k_of = {int(s): _folds(int(s), n_words, c) for s in np.unique(left.sizes)}
    own: dict[int, np.ndarray] = {k: fold(left.words, k) for k in set(k_of.values())}
    for i, size in enumerate(left.sizes.tolist()):
        lo, hi = int(max(low[i], i + 1) if same else low[i]), int(high[i])
        if size == 0 or lo >= hi:
            continue
        k = k_of[size]
        if k not in folded:
            folded[k] = np.ascontiguousarray(fold(right.words, k).T)
        other, mine = folded[k], own[k][i]
        differing = np.bitwise_count(other[0, lo:hi] ^ mine[0]).astype(np.uint16)
        for w in range(1, k):
            differing += np.bitwise_count(other[w, lo:hi] ^ mine[w])
        at = lo + np.flatnonzero(differing - allowed[lo:hi] <= np.float32(size * c + 0.01))
        if not len(at):
            continue
        apart = np.bitwise_count(right.words[at] ^ left.words[i]).sum(axis=1, dtype=np.int64)
        common = (size + right.sizes[at] - apart) // 2
        score = common / (size + right.sizes[at] - common)
        good = score >= t
        if good.any():
            at, score = at[good], score[good]
            yield np.repeat(left.reps[i : i + 1], len(at)), right.reps[at], score


def near_pairs(t: float, ordered: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the two sides of each key, or one with itself; rows come sorted by key.  With ``ordered`` the earlier id is on the left."""

    def batch(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        a, b, score = (np.concatenate(x) for x in zip(*found))
        first = a < b
        return pa.RecordBatch.from_pydict({
            "id_a": pa.array(np.where(first, a, b), kind), "id_b": pa.array(np.where(first, b, a), kind), "similarity": pa.array(score),
        })

    def compare(rows: list[pa.RecordBatch], itself: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        side = np.asarray(table.column("side").combine_chunks())
        if not itself and not (0 < side.sum() < len(side)):
            return
        left = _Side.of(table.filter(pa.array(side == 0)))
        right = left if itself else _Side.of(table.filter(pa.array(side == 1)))
        kind = table.schema.field("rep").type
        found, held = [], 0
        for a, b, score in _near(left, right, t, itself):
            if ordered:
                a, b, score = (x[a < b] for x in (a, b, score))
            found.append((a, b, score))
            held += len(a)
            if held >= EMIT:
                yield batch(found, kind)
                found, held = [], 0
        if held:
            yield batch(found, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, itself = None, [], False
        for b in batches:
            keys = np.asarray(b.column("key"))
            starts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(starts, starts[1:]):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    if rows:
                        yield from compare(rows, itself)
                    key, rows, itself = keys[lo], [], bool(b.column("itself")[lo].as_py())
                rows.append(b.slice(lo, hi - lo))
        if rows:
            yield from compare(rows, itself)

    return run
