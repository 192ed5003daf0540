"""The prefix trie against brute force: shared heads, copies, nulls, ties, long conversations, tiny trees."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from assayspark.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, ids string, words string, key int, own int"


def rebuilt(rows):
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv_id].append(((turn is not None, turn or 0), role, mark, text))
    own = {c: [(t[1], t[3]) for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(rows):
    members = collections.defaultdict(list)
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = collections.defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    saved = {n: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n, m in members.items()}
    children = collections.Counter(n[:-1] for n in members if n)
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n))
        out.append((
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], sum(not children[x] for x in below[n]),
            sum(saved[x] for x in below[n]), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie(spark, rows, **small):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    convs = ct.rebuild(ct.conversations_of(df), F.col("conv_id") - F.col("conv_id") % 20, head)
    return sorted((tuple(r) for r in ct.prefix_trie(convs, **small).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in range(0, 160):
        if c == 40:
            continue  # a base that is absent
        n = rng.randint(1, 6)
        out += [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("a b", "a  b\tc", "", None, "q", "a b c d"))) for t in range(n)]
    for c in range(200, 300):  # one conversation that many share, whole
        out += [(c, t, "user", f"same {t}") for t in range(5)]
    out += [(301, None, "user", "first"), (301, 3, "user", "x"), (301, 3, "user", "x"), (301, 3, None, "x"), (301, -1, "z", "y")]
    out += [(310, t, "user", f"long {t}") for t in range(300)] + [(311, t, "user", f"long {t}") for t in range(290)]
    out += [(320, 0, "user", "word " * 20_000), (None, 0, "user", "no id"), (None, 1, "user", "no id")]
    return out


def test_nodes_grow_and_paths_are_compressed():
    rng = random.Random(2)
    tree = ct.Tree(lambda a, b: [a[0] + b[0]])
    keys = [rng.randbytes(1) * rng.randint(0, 3) + bytes(rng.randrange(256) for _ in range(rng.randint(0, 5))) for _ in range(5000)]
    keys += [b"", b"abcdefgh", b"abcdefgh", b"abcd", b"abcdxy"] + [b"qqqqqqqqq" + bytes((i,)) for i in range(40)]
    for key in keys:
        tree.insert(key, [1])
    found, kinds, stack = {}, set(), [(b"", tree.root)]
    while stack:
        path, node = stack.pop()
        kinds.add((type(node).__name__, getattr(node, "room", None)))
        path += node.prefix
        if node.value is not None:
            found[path] = node.value[0]
        children = list(node.each())
        assert node.value is not None or len(children) > 1 or node is tree.root  # no path of single children
        for byte, child in children:
            assert node.get(byte) is child
            stack.append((path + bytes((byte,)), child))
    assert found == collections.Counter(keys)
    assert kinds == {("Few", 4), ("Few", 16), ("Indexed", None), ("Full", None)}


@pytest.mark.parametrize("small", [{}, {"run_keys": 3, "chunk_ids": 2, "fan_bits": 1}])
def test_against_brute_force(spark, rows, small):
    got, want = trie(spark, rows, **small), brute(rows)
    assert len(got) == len(want) and got == want


def test_empty_and_turnless(spark):
    assert trie(spark, []) == []
    # conversations that lose all their turns to an absent base
    few = [(c, 0, "user", "x") for c in range(1, 20)]
    assert trie(spark, few) == brute(few)
