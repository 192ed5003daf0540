"""Byte-level BPE encoding and decoding as a reduction over a tree of text parts.

A text is halved until its parts are short.  Parts are encoded on their own and neighbours
are joined: only a window around the seam is encoded again.  The window grows, doubling on each side,
until it ends at places where the token pattern must break in any context: before a blank
that follows a non-blank, since no alternative of the pattern takes a blank after
a non-blank, nor looks past the first blank.  Tokens outside such places are therefore the
tokens of the joined text.  Where a side has no such place, its whole part is in the window.
The join is associative, so the tree may have any shape, and its value is
the plain encoding of the text.  Decoding joins the bytes of the tokens up a tree.

Encoding and decoding read one row at a time; nothing is shuffled.  Null and empty texts have no
tokens; repeated rows are encoded each; further columns are kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import packs

#: Characters of a part that is encoded as a whole.
LEAF_CHARS = 2048
#: Tokens of a part that is decoded as a whole.
LEAF_TOKENS = 4096
#: Characters on each side of a seam in the first window.
FIRST_WINDOW = 32

_BREAK = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def tokenizer(ranks_path: str, pattern: str):
    """The public tokenizer of a rank file, without special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _last_break(text: str) -> int:
    """A break near the end of ``text``; 0 if there is none."""
    window = FIRST_WINDOW
    while True:
        start = max(0, len(text) - window)
        found = [m.start() for m in _BREAK.finditer(text, max(0, start - 1)) if m.start() >= start]
        if found:
            return found[-1]
        if start == 0:
            return 0
        window *= 2


def _first_break(text: str) -> int:
    """The first break of ``text``; its length if there is none."""
    window = FIRST_WINDOW
    while True:
        found = _BREAK.search(text, 0, min(len(text), window))
        if found and found.start() > 0:
            return found.start()
        if window >= len(text):
            return len(text)
        window *= 2


def join_parts(encode, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """The encoding of two neighbouring encoded parts as one part."""
    (text, ids), (more, more_ids) = left, right
    if not text or not more:
        return (text + more, ids + more_ids)
    start, end = _last_break(text), _first_break(more)
    drop, skip = len(encode(text[start:])), len(encode(more[:end]))
    seam = encode(text[start:] + more[:end])
    return text + more, ids[: len(ids) - drop] + seam + more_ids[skip:]


def encode_tree(encode, text: str, leaf: int = LEAF_CHARS) -> list[int]:
    """Token ids of ``text`` by halving and joining."""

    def reduce(lo: int, hi: int) -> tuple[str, list[int]]:
        if hi - lo <= leaf:
            part = text[lo:hi]
            return part, encode(part)
        middle = (lo + hi) // 2
        return join_parts(encode, reduce(lo, middle), reduce(middle, hi))

    return reduce(0, len(text))[1]


def decode_tree(decode, ids: list[int], leaf: int = LEAF_TOKENS) -> bytes:
    """The bytes of the tokens, joined up a tree."""
    if len(ids) <= leaf:
        return decode(ids)
    middle = len(ids) // 2
    return decode_tree(decode, ids[:middle], leaf) + decode_tree(decode, ids[middle:], leaf)


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in batch.schema.names}
    columns[name] = values
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the token ids as little-endian unsigned 32-bit integers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks_path, pattern).encode_ordinary
        for batch in packs(batches, text):
            texts = batch.column(text).to_pylist()
            ids = [np.asarray(encode_tree(encode, t), dtype="<u4").tobytes() if t else b"" for t in texts]
            yield _replaced(batch, out, pa.array(ids, pa.binary()))

    plain = df.drop(out)
    return plain.mapInArrow(run, plain.withColumn(out, F.lit(b"")).schema)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes of the tokens in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer(ranks_path, pattern).decode_bytes
        for batch in packs(batches, ids):
            values = [decode_tree(decode, np.frombuffer(v or b"", "<u4").tolist()) for v in batch.column(ids).to_pylist()]
            yield _replaced(batch, out, pa.array(values, pa.binary()))

    plain = df.drop(out)
    return plain.mapInArrow(run, plain.withColumn(out, F.lit(b"")).schema)


def id_count(ids: Column) -> Column:
    """The number of ids in a binary value."""
    return (F.octet_length(ids) / 4).cast("long")
