"""Hard negatives against brute force: nulls, ties, repeated rows, odd lengths, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score long, planes string, block int, part int"


def brute(rows, anchor, positives=5, negatives=5, low=80, high=100):
    valid = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if any(abs(256 * x) >= 2**25 for x in vector):
            continue
        valid.append((vec_id, tuple(math.floor(256 * x) for x in vector), label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a_id, a, a_label in sorted({v for v in valid if anchor(v[0])}):
        scored = sorted((-dot(a, v), i, lab) for i, v, lab in valid)
        for neg_p, p_id, _ in [s for s in scored if s[2] == a_label and s[1] != a_id][:positives]:
            found = [s for s in scored if s[2] != a_label and low * -neg_p <= 100 * -s[0] <= high * -neg_p]
            out += [(a_id, p_id, r, s[1], -neg_p, -s[0]) for r, s in enumerate(found[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)
    numbers = hn.whole_numbers(df, F.col("vec_id"), F.col("embedding"), F.col("label"))
    return sorted(tuple(r) for r in hn.mine(numbers, F.col("vec_id") % 10 == 0).collect())


def test_planes_and_tables_give_exact_products():
    rng = np.random.default_rng(1)
    for bits, dims in ((2, 1), (10, 64), (17, 13), (26, 40)):
        a = rng.integers(-(2 ** (bits - 1)), 2 ** (bits - 1), (70, dims))
        c = rng.integers(-(2 ** (bits - 1)), 2 ** (bits - 1), (5000, dims))
        packed = hn.pack_planes(c, bits)
        wide = hn.unpack_planes(packed)
        assert (wide[:, :dims] == c).all() and not wide[:, dims:].any()
        padded = hn.unpack_planes(hn.pack_planes(a, bits))
        assert (hn.scores(padded, packed) == a.astype(object).dot(c.T.astype(object))).all()


@pytest.mark.parametrize("cells", [(16_384, 131_072), (2, 7)])
def test_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(hn, "CELL_ANCHORS", cells[0])
    monkeypatch.setattr(hn, "CELL_CANDIDATES", cells[1])
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.25, 0.3, 1.0, 0.0)) for _ in range(5)], rng.choice((0, 0, 0, 1, -3, 2**31 - 1))) for i in range(90)]
    rows += [(i, [0.25, 0.3, 1.0, 0.25, 0.3], i % 2) for i in range(100, 140)]  # equal vectors
    rows += [rows[20], rows[20], rows[50], (30, [0.5] * 5, 1)]  # repeated rows, one id twice
    rows += [(200, None, 1), (210, [1.0, None], 1), (220, [math.nan], 1), (230, [math.inf], 1), (None, [1.0], 1), (240, [1.0], None)]
    rows += [(250, [], 0), (260, [0.5], 1), (270, [0.5] * 700, 0), (280, [2.0**17], 0), (290, [-700.25, 900.75], 1)]
    got = mined(spark, rows)
    want = brute(rows, lambda i: i % 10 == 0)
    assert got == want and len(got) > 100


def test_empty_tables_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.25], 2)]) == []
    assert mined(spark, [(10, [], 1), (20, [], 1), (30, [], 2)]) == brute([(10, [], 1), (20, [], 1), (30, [], 2)], lambda i: True)
