"""Substring deduplication by seed and extend.

Removed is each word that lies in a window of ``WINDOW`` consecutive words whose sequence also starts
somewhere else in the corpus.

Seeds are winnowed anchors: of the ``WINDOW - ANCHOR + 1`` word runs of length ``ANCHOR`` in a window, the one with the
least hash (the first of equal ones).  The choice depends on the window's words only, so two equal windows have equal
anchors at equal places, and windows can only be equal if their anchors are.  Consecutive windows with one anchor form a span.

Documents meet on anchors that occur twice or more.  A match is then extended both ways around its anchor, as
far as the span reaches: spans with equal words are equal over all their windows; where spans with one anchor
differ, their windows are compared one by one, and the equal ones are the part that extends alike.  What touches or
overlaps is merged into maximal repeats, all of at least ``WINDOW`` words.

No pairs of documents are formed: spans and windows are counted by hash (128 bits: anchor and content), so
a passage that a third of the documents share costs one row each.  Texts are recognised by a digest; equal texts have equal results.

Defined results: null and empty texts have no words and keep an empty sequence; texts shorter than a window keep all words;
repeated rows count as occurrences elsewhere, so they lose all their windows.  doc_id is only carried along and may be
null or repeated; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix, packs, run_hashes, staged, text_column, word_hashes, words_of

WINDOW = 35
ANCHOR = 8
#: Windows of a text that are handled at once; positions of ties need 24 bits.
SEGMENT = 4_000_000
_PLACE = np.uint64((1 << 24) - 1)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of ``size`` values, by doubling."""
    n, width = len(values) - size + 1, 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:n], values[size - width : size - width + n]) if width < size else values[:n]


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    return run_hashes(hashes, window, seed=7)


def spans(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """Spans of windows with one anchor: (start, length, anchor hash, content hash) arrays.

    ``owner`` numbers the text of each word; windows do not cross texts."""
    if len(hashes) < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    seeds = run_hashes(hashes, anchor, seed=5)
    place = np.arange(len(seeds), dtype=np.uint64)
    least = _least((seeds & ~_PLACE) | place, window - anchor + 1) & _PLACE
    starts = np.flatnonzero(owner[: len(owner) - window + 1] == owner[window - 1 :])
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    at = least[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(starts)))
    whole = window_hashes(hashes, window)
    begin = starts[first]
    end = begin + length - 1
    content = mix(whole[begin] * np.uint64(0x9E3779B97F4A7C15) + mix(whole[end]) + length.astype(np.uint64))
    return begin, length, seeds[at[first]].view(np.int64), content.view(np.int64)


def _segments(words: list[list[bytes]], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word hashes, text numbers and positions of the packed texts, in pieces of bounded size."""
    sizes = np.array([len(w) for w in words])
    if not sizes.sum():
        return
    flat = word_hashes([w for one in words for w in one])
    owner = np.repeat(np.arange(len(words)), sizes)
    position = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for lo in range(0, len(flat), SEGMENT):
        hi = min(len(flat), lo + SEGMENT + window - 1)
        yield flat[lo:hi], owner[lo:hi], position[lo:hi]


def _key(text: Column) -> list[Column]:
    """120 bits of the text's digest as two longs."""
    digest = F.md5(text)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for name, at in (("k1", 1), ("k2", 16))]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_column(docs).cast("binary").alias("text")).select("doc_id", "text", *_key(F.col("text")))


def _find_spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packs(batches):
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            for hashes, owner, position in _segments(words_of(batch), window):
                begin, length, anchor, content = spans(hashes, owner, window)
                who = owner[begin]
                columns = [k1[who], k2[who], position[begin], length, anchor, content]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "start", "n", "anchor", "content"])

    return run


def _open_windows(window: int):
    """The windows of the listed spans, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packs(batches):
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            lists = batch.column("spans").to_pylist()
            for i, words in enumerate(words_of(batch)):
                whole = window_hashes(word_hashes(words), window)
                at = [np.arange(s["start"], s["start"] + s["n"]) for s in lists[i]]
                sizes = [len(a) for a in at]
                starts = np.concatenate(at)
                repeat = lambda name: np.repeat([s[name] for s in lists[i]], sizes)  # noqa: E731, B023
                columns = [np.repeat(k1[i], len(starts)), np.repeat(k2[i], len(starts)), starts, repeat("anchor"), whole[starts].view(np.int64), repeat("times")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "start", "anchor", "window", "times"]
                )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packs(batches):
            out: list[list] = [[], [], [], []]
            for words, found in zip(words_of(batch), batch.column("spans").to_pylist()):
                steps = np.zeros(len(words) + 1, np.int64)
                if found:
                    begin = np.array([s["start"] for s in found])
                    np.add.at(steps, begin, 1)
                    np.add.at(steps, begin + np.array([s["n"] for s in found]) + window - 1, -1)
                covered = np.cumsum(steps[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).reshape(-1, 2)
                kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c]) if len(edges) else b" ".join(words)
                for column, value in zip(out, (len(words), int(covered.sum()), kept, edges.tolist())):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "repeats"],
            )

    return run


def repeated_spans(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, spans): for each text the spans (start, n) of windows that occur elsewhere too."""
    schema = "k1 long, k2 long, start long, n long, anchor long, content long"
    found = staged(keyed.select("k1", "k2", "text").mapInArrow(_find_spans(window), schema), "spans")
    # written first: a join of two plain shuffles can be split where an anchor is hot
    twice = staged(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    found = staged(found.join(twice, "anchor", "left_semi"), "seeds")
    some = {c: F.first(c).alias(c) for c in ("k1", "k2", "start", "n")}
    kinds = staged(found.groupBy("anchor", "content").agg(F.count("*").alias("times"), *some.values()), "kinds")
    # equal spans: repeated over all their windows
    whole = found.join(kinds.where("times > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    # different spans around one anchor: compared window by window, one of each kind
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    listed = kinds.join(several, "anchor", "left_semi").groupBy("k1", "k2")
    listed = listed.agg(F.collect_list(F.struct("start", "n", "anchor", "times")).alias("spans"))
    texts = keyed.select("k1", "k2", "text").join(listed, ["k1", "k2"])
    # a text that comes several times is opened once
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("spans").alias("spans"))
    opened = "k1 long, k2 long, start long, anchor long, window long, times long"
    windows = staged(texts.mapInArrow(_open_windows(window), opened), "windows")
    equal = windows.groupBy("anchor", "window").agg(F.count("*").alias("seen")).where("seen > 1").select("anchor", "window")
    single = windows.where("times = 1").join(equal, ["anchor", "window"], "left_semi")
    both = whole.select("k1", "k2", "start", "n").unionByName(single.select("k1", "k2", "start", F.lit(1).cast("long").alias("n")))
    return both.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, repeats) of every row; ``repeats`` are the maximal [begin, end) word ranges."""
    keyed = _keyed(docs)
    spans_of = staged(repeated_spans(keyed, window), "repeats")
    out = keyed.join(spans_of, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, n_words long, n_removed long, kept_text binary, repeats array<array<long>>"
    return out.mapInArrow(_cut(window), schema)
