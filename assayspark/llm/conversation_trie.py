"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 16 bytes of digest over role and text, a conversation's key the ids of its turns in order.
The keys are sorted over all tasks.  Each task puts runs of at most ``RUN_KEYS`` distinct keys
into an adaptive radix tree: nodes of 4, 16, 48 and 256 children that grow as they fill, with compressed paths.
Only byte depths that are whole turns are nodes of the result.  Inside a run all is counted but the
nodes on the paths of its first and last key, which neighbours may share.  These few (two
paths a run) become entries of a further tree, over the runs of 64 neighbouring tasks at a time, until one tree
holds the rest.  So a first turn or a whole conversation that very many share is counted in many tasks,
and the list of the conversations that end at such a node arrives as one row per ``CHUNK_IDS`` ids, hashed as a stream.

Defined results: rows without conversation id take no part.  Turns go by number (null first), equal numbers
by role and then by id; repeated rows are turns of their own.  A null role or text is empty.  Long texts
are read whole.  An empty table has no nodes, not even a root.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from assayspark.operators.spread import attach_by_key, checked_broadcast

from .common import BLANKS, staged, tasks

#: Bytes of a turn id.
WIDTH = 16
#: Distinct keys in one tree, ids of one key in one row, bits of the tasks whose runs meet in one further tree.
RUN_KEYS = 100_000
CHUNK_IDS = 4_096
FAN_BITS = 6
_NODE, _ENTRY, _ENDS = 0, 1, 2
_NONE = hashlib.sha256(b"").hexdigest()

# -- adaptive radix tree ---------------------------------------------------------------------------------------------


class Few:
    """Up to 4, then up to 16 children: their bytes and the children side by side."""

    __slots__ = ("prefix", "value", "room", "bytes", "children")

    def __init__(self, prefix: bytes, value: list | None = None):
        self.prefix, self.value, self.room = prefix, value, 4
        self.bytes, self.children = bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.children[at]

    def put(self, byte: int, child) -> Few | Indexed:
        """Add or replace a child; the node that now holds it."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.children[at] = child
            return self
        if len(self.bytes) == self.room:
            if self.room == 16:
                return Indexed(self).put(byte, child)
            self.room = 16
        self.bytes.append(byte)
        self.children.append(child)
        return self

    def each(self) -> Iterator:
        return zip(self.bytes, self.children)


class Indexed:
    """Up to 48 children: 256 places that point into them."""

    __slots__ = ("prefix", "value", "places", "children")

    def __init__(self, few: Few):
        self.prefix, self.value = few.prefix, few.value
        self.places, self.children = bytearray(256), few.children
        for i, byte in enumerate(few.bytes):
            self.places[byte] = i + 1

    def get(self, byte: int):
        at = self.places[byte]
        return self.children[at - 1] if at else None

    def put(self, byte: int, child) -> Indexed | Full:
        at = self.places[byte]
        if at:
            self.children[at - 1] = child
        elif len(self.children) == 48:
            return Full(self).put(byte, child)
        else:
            self.children.append(child)
            self.places[byte] = len(self.children)
        return self

    def each(self) -> Iterator:
        return ((byte, self.children[at - 1]) for byte, at in enumerate(self.places) if at)


class Full:
    """256 children by their byte."""

    __slots__ = ("prefix", "value", "children")

    def __init__(self, indexed: Indexed):
        self.prefix, self.value = indexed.prefix, indexed.value
        self.children = [indexed.get(byte) for byte in range(256)]

    def get(self, byte: int):
        return self.children[byte]

    def put(self, byte: int, child) -> Full:
        self.children[byte] = child
        return self

    def each(self) -> Iterator:
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` equal ``b`` from ``at`` on."""
    if b.startswith(a, at):
        return len(a)
    n = 0
    for x, y in zip(a, memoryview(b)[at:]):
        if x != y:
            break
        n += 1
    return n


class Tree:
    """Keys with values; values of an equal key are merged."""

    def __init__(self, merge: Callable[[list, list], list]):
        self.root, self.merge = Few(b""), merge

    def insert(self, key: bytes, value: list) -> None:
        above, turn, node, at = None, 0, self.root, 0
        while True:
            n = _shared(node.prefix, key, at)
            if n < len(node.prefix):  # cut the compressed path
                new = Few(node.prefix[:n])
                new.put(node.prefix[n], node)
                node.prefix = node.prefix[n + 1 :]
                if at + n == len(key):
                    new.value = value
                else:
                    new.put(key[at + n], Few(key[at + n + 1 :], value))
                break
            at += n
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            child = node.get(key[at])
            if child is None:
                new = node.put(key[at], Few(key[at + 1 :], value))
                if new is node:
                    return
                break
            above, turn, node, at = node, key[at], child, at + 1
        if above is None:
            self.root = new
        else:
            above.put(turn, new)


# -- counting --------------------------------------------------------------------------------------------------------

# A value or sum is [conversations, smallest id, children, leaves, saved words, words of the turns, digest of the ends].
_N, _LEAST, _CHILDREN, _LEAVES, _SAVED, _WORDS, _ENDS_SHA = range(7)


def _merge(a: list, b: list) -> list:
    return [a[_N] + b[_N], min(a[_LEAST], b[_LEAST]), *(a[i] + b[i] for i in (_CHILDREN, _LEAVES, _SAVED)), a[_WORDS], a[_ENDS_SHA]]


def digest(prefix: bytes) -> bytes:
    return hashlib.blake2b(prefix, digest_size=16).digest()


class Rows:
    """Rows of the three kinds, column by column."""

    TYPES = {
        "kind": pa.int32(), "digest": pa.binary(), "parent_digest": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(),
        "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
        "saved_tokens": pa.int64(), "ends": pa.string(), "key": pa.binary(), "words": pa.binary(), "run": pa.int64(), "place": pa.int64(),
    }
    SCHEMA = (
        "kind int, digest binary, parent_digest binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends string, key binary, words binary, run long, place long"
    )

    def __init__(self):
        self.columns = {name: [] for name in self.TYPES}

    def add(self, **values) -> int:
        for name, column in self.columns.items():
            column.append(values.get(name))
        return len(self.columns["kind"]) - 1

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.columns[n], t) for n, t in self.TYPES.items()], names=list(self.TYPES))


def count_nodes(tree: Tree, low: bytes, high: bytes, run: int, out: Rows, last: bool, marked: bool) -> None:
    """Rows of the nodes that no other run shares, and entries for the others, those on the paths to ``low`` and ``high``.

    In the ``last`` tree nothing is shared.  ``marked`` rows carry their digest in place of the hash of their ends."""
    stack = [(tree.root, 0, b"", not last, not last, None)]
    sums: list[list | None] = [None]  # of the nodes on the stack; the first stands above the root
    tops: list[list[int]] = [[]]
    while stack:
        node, start, path, on_low, on_high, shared = stack.pop()
        end = start + len(node.prefix)
        path = path + node.prefix if marked and shared is None else path
        if shared is None:
            to_low = start + _shared(node.prefix, low, start) if on_low else -1
            to_high = start + _shared(node.prefix, high, start) if on_high else -1
            stack.append((node, start, path, on_low, on_high, (to_low, to_high)))
            sums.append(None if node.value is None else node.value)
            tops.append([])
            for byte, child in node.each():
                step = bytes((byte,))
                go_low = to_low == end and low[end : end + 1] == step
                go_high = to_high == end and high[end : end + 1] == step
                stack.append((child, end + 1, path + step if marked else b"", go_low, go_high, None))
            continue
        total, top = sums.pop(), tops.pop()
        ends = node.value[_ENDS_SHA] if node.value is not None and end % WIDTH == 0 else None
        for at in range(end - end % WIDTH, start - 1, -WIDTH):
            if at <= max(shared):
                prefix = low[:at] if at <= shared[0] else high[:at]
                for row in top:
                    out.columns["parent_digest"][row] = digest(prefix)
                if total is not None:
                    out.add(kind=_ENTRY, key=prefix, words=total[_WORDS][: at // WIDTH * 8], run=run, place=(prefix == low) + 2 * (prefix == high),
                            conv_id=total[_LEAST], n_convs=total[_N], n_children=total[_CHILDREN], n_leaves=total[_LEAVES],
                            saved_tokens=total[_SAVED])
                total, top = None, []
            else:
                n, least, children, leaves, saved, words, _ = total
                depth = at // WIDTH
                leaves = leaves if children else 1
                saved += (n - 1) * int.from_bytes(words[depth * 8 - 8 : depth * 8], "big") if depth else 0
                row = out.add(kind=_NODE, conv_id=least, depth=depth, n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved,
                              ends=None if marked else ends or _NONE, digest=digest(path[:at]) if marked else None)
                for below in top:
                    out.columns["parent_conv_id"][below] = least
                total, top = [n, least, 1, leaves, saved, words, None], [row]
            ends = None
        if total is not None:
            sums[-1] = total if sums[-1] is None else _merge(sums[-1], total)
        tops[-1] += top


# -- tasks -----------------------------------------------------------------------------------------------------------


class _Run:
    """Distinct keys in ascending order, each with its ids in ascending order, as they come."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.words: list[bytes] = []
        self.ids: list[list[int]] = []

    def rows(self, run: int) -> pa.RecordBatch:
        out, tree = Rows(), Tree(_merge)
        low, high = self.keys[0], self.keys[-1]
        for key, words, ids in zip(self.keys, self.words, self.ids):
            text = ",".join(map(str, ids))
            sha = hashlib.sha256(text.encode()).hexdigest()
            if low.startswith(key) or high.startswith(key):
                out.add(kind=_ENDS, digest=digest(key), ends=text, conv_id=ids[0], run=run)
            tree.insert(key, [len(ids), ids[0], 0, 0, 0, words, sha])
        count_nodes(tree, low, high, run, out, False, False)
        return out.batch()


def _build(run_keys: int, chunk_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs, now = TaskContext.get().partitionId(), 0, _Run()
        for batch in batches:
            lists = batch.column("words")
            offsets = np.asarray(lists.offsets)
            flat = np.asarray(lists.values).astype(">i8")
            for i, (key, conv_id) in enumerate(zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist())):
                again = bool(now.keys) and now.keys[-1] == key
                if (len(now.ids[-1]) == chunk_ids) if again else len(now.keys) == run_keys:
                    yield now.rows(part << 32 | runs)
                    now, runs, again = _Run(), runs + 1, False
                if again:
                    now.ids[-1].append(conv_id)
                else:
                    now.keys.append(key)
                    now.words.append(flat[offsets[i] : offsets[i + 1]].tobytes())
                    now.ids.append([conv_id])
        if now.keys:
            yield now.rows(part << 32 | runs)

    return build


def _join_runs(last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, entries: pa.Table) -> pa.Table:
        entries = entries.sort_by([("run", "ascending"), ("key", "ascending")])
        out, tree, low, high = Rows(), Tree(_merge), None, b""
        names = ("key", "words", "place", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        for prefix, words, place, least, n, children, leaves, saved in zip(*(entries.column(c).to_pylist() for c in names)):
            low = prefix if low is None and place & 1 else low
            high = prefix if place & 2 else high
            tree.insert(prefix, [n, least, children, leaves, saved, words, None])
        count_nodes(tree, low, high, key[0].as_py(), out, last, True)
        return pa.Table.from_batches([out.batch()])

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([mark], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])

    for batch in batches:
        for found, ids in zip(batch.column("digest").to_pylist(), batch.column("ends").to_pylist()):
            if found != mark:
                if state is not None:
                    yield row()
                mark, state = found, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield row()


# -- jobs ------------------------------------------------------------------------------------------------------------


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words): hexadecimal ids and word counts of the turns of each conversation, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != ""))
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), words.cast("long").alias("words"),
    )
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    return own.select("conv_id", F.col("own.id").alias("ids"), F.col("own.words").alias("words"))


def rebuild(conversations: DataFrame, base: Column, head: Column) -> DataFrame:
    """Each conversation with its first ``head`` turns taken from conversation ``base``; ``head`` is 3 at most."""
    conversations = staged(conversations, "conversations")
    heads = conversations.select(F.col("conv_id").alias("_base"), *(F.slice(c, 1, 3).alias(f"_{c}") for c in ("ids", "words")))
    kinds = {"ids": "array<string>", "words": "array<bigint>"}
    joined = conversations.withColumns({"_of": base, "_head": head}).join(heads, F.col("_of") == F.col("_base"), "left")
    turns = {
        c: F.concat(
            F.slice(F.coalesce(F.col(f"_{c}"), F.array().cast(kind)), F.lit(1), F.col("_head")),
            F.slice(F.col(c), F.col("_head") + 1, F.size(c)),
        )
        for c, kind in kinds.items()
    }
    return joined.select("conv_id", *(column.alias(c) for c, column in turns.items()))


def prefix_trie(conversations: DataFrame, run_keys: int = RUN_KEYS, chunk_ids: int = CHUNK_IDS, fan_bits: int = FAN_BITS) -> DataFrame:
    """The nodes of the trie over (conv_id, ids, words): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = tasks(conversations.sparkSession)
    keys = staged(conversations.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"), "words"), "keys")
    runs = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_build(run_keys, chunk_ids), Rows.SCHEMA)
    made = [staged(runs, "runs")]
    top, shift = made[0].agg(F.max("run")).first()[0], 32 + fan_bits
    while top is not None:
        last = top >> shift == 0
        entries = made[-1].where(F.col("kind") == _ENTRY).groupBy(F.shiftright("run", shift).alias("up"))
        made.append(staged(entries.applyInArrow(_join_runs(last), Rows.SCHEMA), "runs"))
        top, shift = None if last else top >> shift, fan_bits
    ends = (
        made[0].where(F.col("kind") == _ENDS)
        .select("digest", "run", "ends")
        .repartition(parts, "digest")
        .sortWithinPartitions("digest", "run")
        .mapInArrow(_hash_ends, "digest binary, ends_sha256 string")
    )
    nodes = [df.where(F.col("kind") == _NODE).drop("kind", "key", "words", "run", "place") for df in made]
    shared = reduce(DataFrame.unionByName, nodes[1:], nodes[0].limit(0))
    hashed = F.coalesce("ends_sha256", F.lit(_NONE))
    shared = staged(shared.join(ends, "digest", "left").withColumn("ends", hashed).drop("ends_sha256"), "shared")
    every = nodes[0].unionByName(shared)
    above = shared.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("below"))
    waiting = every.where("parent_digest IS NOT NULL").drop("parent_conv_id")
    small = checked_broadcast(above)
    named = attach_by_key(waiting, above, "parent_digest", "below") if small is above else waiting.join(small, "parent_digest")
    whole = every.where("parent_digest IS NULL").unionByName(named.drop("below"))
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")
    )


#: The check SQL; 3988292384 is the polynomial of CRC-32.
SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i))
), own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM own, crc_table
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), members AS (
  SELECT conv_id, len(turns) AS n, depth, turns[1:depth] AS prefix FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, prefix
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.prefix[n.depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM counted WHERE depth > 0 GROUP BY ALL
), facts AS (
  SELECT c.*, coalesce(n_children, 0) AS n_children FROM counted c LEFT JOIN children USING (conv_id, depth)
), below AS (
  SELECT a.conv_id, a.depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM facts) f JOIN nodes a ON a.depth = f.up AND a.prefix = f.prefix[1:f.up]
  GROUP BY a.conv_id, a.depth
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM facts JOIN below USING (conv_id, depth)
"""
