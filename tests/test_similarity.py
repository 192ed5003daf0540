import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayspark.functions import measures
from assayspark.functions.text import hash_bit, shingles
from assayspark.operators import bitrows, cluster, pairs, simjoin
from assayspark.operators.fingerprints import fingerprint
from assayspark.sources.stages import cut


def random_sets(seed, n, universe, families=6, empty=2, copies=8):
    """Random sets, families of near copies, exact copies and empty sets, shuffled."""
    rng = random.Random(seed)
    sets = [set(rng.sample(range(universe), rng.randint(1, 25))) for _ in range(n)]
    for _ in range(families):
        base = set(rng.sample(range(universe), 20))
        for _ in range(6):
            near = set(base)
            for _ in range(rng.randint(0, 3)):
                near.discard(rng.choice(sorted(base)))
                near.add(rng.randrange(universe))
            sets.append(near)
    sets += [set(sets[0]) for _ in range(copies)] + [set() for _ in range(empty)]
    rng.shuffle(sets)
    return [sorted(s) for s in sets]


def frame(spark, sets):
    return spark.createDataFrame([(i * 3, s) for i, s in enumerate(sets)], "id long, bits array<int>").repartition(4)


def tanimoto(a, b):
    union = len(set(a) | set(b))
    return 1.0 if union == 0 else len(set(a) & set(b)) / union


def sequential_leaders(sets, t):
    leader = {}
    for i in range(len(sets)):
        if i in leader:
            continue
        leader[i] = i
        for j in range(i + 1, len(sets)):
            if j not in leader and tanimoto(sets[i], sets[j]) >= t:
                leader[j] = i
    return leader


def brute_pairs(sets, t):
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    reps = sorted(first.values())
    return {
        (i * 3, j * 3): tanimoto(sets[i], sets[j])
        for x, i in enumerate(reps)
        for j in reps[x + 1 :]
        if tanimoto(sets[i], sets[j]) >= t
    }


@pytest.mark.parametrize("seed, universe, t, per_task", [(1, 60, 0.5, 20_000), (2, 2000, 0.8, 20_000), (3, 40, 0.8, 3), (4, 200, 0.9, 5), (5, 30, 0.3, 7)])
def test_similarity_join_equals_brute_force(spark, seed, universe, t, per_task):
    sets = random_sets(seed, 60, max(universe, 30))
    got = simjoin.similarity_join(frame(spark, sets), "id", threshold=t, postings_per_task=per_task).collect()
    want = brute_pairs(sets, t)
    assert {(r["id_a"], r["id_b"]) for r in got} == set(want)
    assert len(got) == len(want)
    assert all(abs(r["similarity"] - want[(r["id_a"], r["id_b"])]) < 1e-12 for r in got)


@pytest.mark.parametrize("t, universe, tile_rows", [(0.8, 100, 7), (0.5, 300, 20), (0.3, 64, 1000), (1.0, 90, 5)])
def test_sets_of_a_narrow_space_are_compared_in_tiles(spark, t, universe, tile_rows):
    rng = random.Random(universe)
    sets = [*random_sets(31, 50, universe), [], [0], [universe - 1], *[sorted(rng.sample(range(universe), universe - k)) for k in (0, 1, 2, 3)]]
    distinct = simjoin.distinct_sets(frame(spark, sets), "id")
    index = simjoin.join_index(distinct, t)
    if t < 1.0:  # a prefix of several elements, and few elements: postings would meet as often as there are pairs
        assert isinstance(index, simjoin.PackedIndex)
    rows = simjoin._packed_index(distinct, t, universe).prefix
    want = brute_pairs(sets, t)
    got = simjoin._packed_pairs(rows, rows, t, tile_rows).collect()
    assert len(got) == len(want) and {(r["id_a"], r["id_b"]): r["similarity"] for r in got} == pytest.approx(want)
    early, late = rows.where("rep < 60"), rows.where("rep >= 60")
    between = simjoin._packed_pairs(early, late, t, tile_rows).collect()
    assert {(r["id_a"], r["id_b"]) for r in between} == {(a, b) for a, b in want if a < 60 <= b}
    assert simjoin._packed_pairs(late, early, t, tile_rows).isEmpty()
    again = simjoin._packed_pairs(rows.where("rep >= 0"), rows, t, tile_rows).collect()
    assert len(again) == len(want) and {(r["id_a"], r["id_b"]) for r in again} == set(want)


@pytest.mark.parametrize("t, mark_bits, hot", [(0.8, 28, 1024), (0.5, 4, 0), (0.7, 6, 3)])
def test_bounded_marks_lose_no_pair(spark, monkeypatch, t, mark_bits, hot):
    """Elements are counted range by range and sets ordered where they lie; loss in the marks adds candidates only."""
    monkeypatch.setattr(bitrows, "MARKED_BITS", mark_bits)
    monkeypatch.setattr(bitrows, "HOT_PER_RANGE", hot)
    monkeypatch.setattr(bitrows, "HOT_FROM", 2)
    monkeypatch.setattr(bitrows, "FLUSH", 50)
    sets = [[2**30 - 1 - 7919 * b for b in reversed(x)] for x in random_sets(32, 60, 4000)] + [[]]
    got = simjoin.similarity_join(frame(spark, sets), "id", threshold=t).collect()
    want = brute_pairs(sets, t)
    assert len(got) == len(want) and {(r["id_a"], r["id_b"]): r["similarity"] for r in got} == pytest.approx(want)


def test_parity_bound_never_drops_a_pair(spark):
    """Parity folding can only shrink the number of differing positions."""
    rng = random.Random(9)
    sets = [sorted(rng.sample(range(5000), 300)) for _ in range(6)]
    words = [w.alias(n) for n, w in zip(simjoin.SIGNATURE, simjoin.parity_words("bits"))]
    rows = frame(spark, sets).select("id", *words).orderBy("id").collect()
    for i in range(6):
        for j in range(6):
            folded = sum(bin((rows[i][n] ^ rows[j][n]) & (2**64 - 1)).count("1") for n in simjoin.SIGNATURE)
            assert folded <= len(set(sets[i]) ^ set(sets[j]))


def test_copy_groups(spark):
    got = {r["id"]: (r["rep"], r["copies"]) for r in simjoin.copy_groups(frame(spark, [[1, 2], [3], [1, 2], [], [], [1, 2]]), "id").collect()}
    assert got == {0: (0, 3), 3: (3, 1), 6: (0, 3), 9: (9, 2), 12: (9, 2), 15: (0, 3)}


def test_copy_groups_carry_digests_and_tell_clashes_apart(spark, monkeypatch):
    sets = [[1, 2], [3], [1, 2], [], [], [1, 2]]
    want = {0: (0, 3), 3: (3, 1), 6: (0, 3), 9: (9, 2), 12: (9, 2), 15: (0, 3)}
    for digest in (simjoin.set_digest, lambda bits: F.lit(0).cast("long")):
        monkeypatch.setattr(simjoin, "set_digest", digest)
        out = simjoin.copy_groups(frame(spark, sets), "id")
        assert {r["id"]: (r["rep"], r["copies"]) for r in out.collect()} == want


@pytest.mark.parametrize("seed, universe, t, chunk, growth", [(11, 60, 0.5, 4096, 8), (12, 50, 0.3, 10, 2), (13, 400, 0.8, 15, 3), (14, 35, 0.4, 5, 4)])
def test_leader_cluster_equals_sequential_rule(spark, seed, universe, t, chunk, growth):
    sets = random_sets(seed, 45, max(universe, 30))
    got = cluster.leader_cluster(frame(spark, sets), "id", threshold=t, first_chunk=chunk, growth=growth, one_chunk_matches=0).collect()
    want = sequential_leaders(sets, t)
    assert {r["id"]: r["leader_id"] for r in got} == {3 * i: 3 * x for i, x in want.items()}
    number = {x: k for k, x in enumerate(sorted(set(want.values())))}
    assert {r["id"]: r["cluster_id"] for r in got} == {3 * i: number[x] for i, x in want.items()}


def test_leader_cluster_on_a_chain(spark):
    """Each set is near its neighbours only: the worst case for the rounds."""
    sets = [list(range(i, i + 10)) for i in range(14)]
    got = cluster.leader_cluster(frame(spark, sets), "id", threshold=0.8).collect()
    assert {r["id"]: r["leader_id"] for r in got} == {3 * i: 3 * x for i, x in sequential_leaders(sets, 0.8).items()}


def test_leader_cluster_without_pairs_and_with_null(spark):
    df = spark.createDataFrame([(1, [1]), (2, [2]), (3, None), (4, [2])], "id long, bits array<int>")
    got = {r["id"]: (r["leader_id"], r["cluster_id"]) for r in cluster.leader_cluster(df, "id").collect()}
    assert got == {1: (1, 0), 2: (2, 1), 4: (2, 1)}


def test_cluster_tables(spark):
    rows = [(i, c, w) for i, (c, w) in enumerate([(0, 5.0), (0, 3.0), (0, 3.0), (1, 1.0), (1, 2.0), (2, None), (2, 9.0), (2, 8.0), (2, 7.0)])]
    df = spark.createDataFrame(rows, "id long, cluster_id long, w double")
    assert sorted((r["cluster_id"], r["id"]) for r in cluster.cluster_hits(df, "cluster_id", "w", "id", 3).collect()) == [(0, 1), (2, 8)]
    assert sorted((r["size"], r["n"]) for r in cluster.cluster_size_histogram(df, 2).collect()) == [(2, 1), (3, 2)]
    assert sorted(r["id"] for r in cluster.cluster_members(df.select("id", "w"), df.select("id", "cluster_id"), "id", 4).collect()) == [5, 6, 7, 8]


def test_set_measures(spark):
    cases = [([1, 2, 3], [2, 3, 4, 5]), ([1], [1]), ([], []), ([], [7]), ([1, 2], [3])]
    df = spark.createDataFrame(cases, "a array<int>, b array<int>")
    got = df.select(*[measures.similarity(F.col("a"), F.col("b"), m, 16).alias(m) for m in measures.SET_MEASURES]).collect()
    for (a, b), r in zip(cases, got):
        x, y = np.zeros(16), np.zeros(16)
        x[a], y[b] = 1, 1
        assert r["hamming"] == np.mean(x != y)
        assert r["manhattan"] == np.abs(x - y).sum() == 16 * r["hamming"]
        assert r["tanimoto"] <= r["dice"] or (not a and not b)
        assert 0 <= r["tanimoto"] <= 1
        if a and b:
            assert np.isclose(r["cosine"], x @ y / np.sqrt((x @ x) * (y @ y)))
        else:
            assert r["cosine"] is None
    assert got[2]["tanimoto"] == got[2]["dice"] == 1.0
    with pytest.raises(ValueError):
        measures.from_counts("other", F.lit(1), F.lit(1), F.lit(1))


def all_pair_values(sets, block, n_bits):
    values = {m: [] for m in measures.SET_MEASURES}
    for s in range(0, len(sets), block):
        part = sets[s : s + block]
        for a in part:
            for b in part:
                c = len(set(a) & set(b))
                values["tanimoto"].append(tanimoto(a, b))
                values["dice"].append(2 * c / (len(a) + len(b)) if a or b else 1.0)
                if a and b:
                    values["cosine"].append(c / np.sqrt(float(len(a) * len(b))))
                values["hamming"].append((len(a) + len(b) - 2 * c) / n_bits)
                values["manhattan"].append(float(len(a) + len(b) - 2 * c))
    return values


@pytest.mark.parametrize("block, tile, per_bucket", [(16, 4, 10**6), (10, 4, 20), (1024, 128, 10**6)])
def test_pair_distributions(spark, block, tile, per_bucket):
    sets = random_sets(21, 20, 300, families=2)
    blocks = pairs.pack_blocks(frame(spark, sets), "id", n_bits=300, block_size=block, tile=tile, rows_per_bucket=per_bucket)
    want = all_pair_values(sets, block, 300)
    hist = pairs.pair_histograms(blocks, 50).collect()
    for m in measures.SET_MEASURES:
        mine = sorted((r["bin"], r["n"]) for r in hist if r["metric"] == m)
        counts, _ = np.histogram(want[m], 50)
        assert sum(n for _, n in mine) == len(want[m])
        lo, hi = min(want[m]), max(want[m])
        by_rule = np.bincount([min(int((v - lo) / (hi - lo) * 50), 49) for v in want[m]], minlength=50)
        assert [n for _, n in mine] == list(by_rule)
        assert np.abs(by_rule - counts).sum() <= 0.02 * len(want[m])  # edges may fall either side
    violin = pairs.pair_violins(blocks, 10).collect()
    for m in measures.SET_MEASURES:
        v = np.array(want[m])
        if m in ("hamming", "manhattan"):
            v = (v - v.min()) / (v.max() - v.min())
        r = next(r for r in violin if r["metric"] == m)
        assert np.allclose([r["q1"], r["median"], r["q3"]], np.quantile(v, [0.25, 0.5, 0.75]))
    total = pairs.pair_counts(blocks).agg(F.sum("n")).first()[0]
    assert total == len(want["tanimoto"])


def test_pairs_leave_out_rows_without_bits(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [2, 70])], "id long, bits array<int>")
    counts = pairs.pair_counts(pairs.pack_blocks(df, "id", n_bits=128, block_size=2)).collect()
    assert sorted((r["size_a"], r["size_b"], r["common"], r["n"]) for r in counts) == [(2, 2, 1, 2), (2, 2, 2, 2)]
    wide = pairs.pair_counts(pairs.pack_blocks(df, "id", n_bits=2**30, block_size=2)).collect()
    assert sorted((r["size_a"], r["size_b"], r["common"], r["n"]) for r in wide) == [(2, 2, 1, 2), (2, 2, 2, 2)]


def test_wide_sets_give_the_packed_counts(spark, monkeypatch):
    sets = [*random_sets(22, 30, 300), [299], [298], []]
    packed = pairs.pack_blocks(frame(spark, sets), "id", n_bits=300, block_size=16, tile=4)
    monkeypatch.setattr(pairs, "PACKED_BITS", 64)
    listed = pairs.pack_blocks(frame(spark, sets), "id", n_bits=300, block_size=16, tile=4)
    assert "bits" in listed.rows.columns and "w0" in packed.rows.columns
    for of in (pairs.pair_counts, pairs.pair_histograms, pairs.pair_values):
        assert sorted(of(listed).collect(), key=str) == sorted(of(packed).collect(), key=str)


def test_histograms_form_no_pair_rows(spark, monkeypatch):
    sets = [*random_sets(23, 30, 300), [], []]
    blocks = pairs.pack_blocks(frame(spark, sets), "id", n_bits=300, block_size=16, tile=4)
    monkeypatch.setattr(pairs, "pair_rows", None)
    found = pairs.pair_histograms(blocks, 10).collect()
    want = all_pair_values(sets, 16, 300)
    assert {m: sum(r["n"] for r in found if r["metric"] == m) for m in measures.SET_MEASURES} == {m: len(v) for m, v in want.items()}
    one = pairs.pack_blocks(frame(spark, [[], []]), "id", n_bits=300)  # no cosine, and ranges of one value
    assert sorted({(r["metric"], r["n"]) for r in pairs.pair_histograms(one, 10).collect() if r["n"]}) == [
        (m, 4) for m in ("dice", "hamming", "manhattan", "tanimoto")
    ]
    none = pairs.pack_blocks(frame(spark, [[1]]).where("id < 0"), "id", n_bits=300)
    assert pairs.pair_histograms(none, 10).collect() == []


def test_fingerprint(spark):
    texts = ["The quick  brown fox\njumps", "one two", "", None, "THE QUICK BROWN FOX JUMPS"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["bits"] for r in fingerprint(df, "t", 3, 64).collect()}
    assert len(got[0]) == 3 and got[0] == sorted(set(got[0])) == got[4]
    assert len(got[1]) == 1 and got[2] == [] and got[3] == []
    assert df.select(shingles("t", 3, "word").alias("s")).first()["s"] == ["the quick brown", "quick brown fox", "brown fox jumps"]
    assert df.where("id = 1").select(shingles("t", 5, "char").alias("s")).first()["s"] == ["one t", "ne tw", "e two"]
    fast = fingerprint(df, "t", 3, 64, method="xxhash64").where("id = 0").first()["bits"]
    assert 1 <= len(fast) <= 3 and all(0 <= b < 64 for b in fast)
    assert spark.range(1).select(hash_bit(F.lit("abc"), 2**31 - 1).alias("h")).first()["h"] == 0x90015098 % (2**31 - 1)
    for bad in ({"unit": "line"}, {"method": "crc"}, {"n_bits": 0}):
        with pytest.raises(ValueError):
            fingerprint(df, "t", **bad)


def test_project2d(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.1 * (i % 3)]) for i in range(20)], "id int, v array<double>")
    out = cluster.project2d(df, "v").collect()
    assert len(out) == 20
    assert np.var([r["x"] for r in out]) > np.var([r["y"] for r in out])


def test_counts_by_key_stay_bounded_in_a_task(spark, monkeypatch):
    """Pairs are counted in the task that forms them, handed on in parts, and add up to all ordered pairs."""
    monkeypatch.setattr(pairs, "HELD_KEYS", 40)
    monkeypatch.setattr(pairs, "EMIT", 7)
    monkeypatch.setattr(pairs, "TILE_ROWS", 3)
    sets = [*random_sets(23, 25, 200), list(range(200))]
    blocks = pairs.pack_blocks(frame(spark, sets), "id", n_bits=200, block_size=16, tile=4)
    joined = pairs.pair_rows(blocks).groupBy(F.least("size_a", "size_b").alias("size_a"), F.greatest("size_a", "size_b").alias("size_b"), "common")
    want = sorted(map(tuple, joined.agg(F.sum("w").alias("n")).collect()))
    assert sorted(map(tuple, pairs.pair_counts(blocks).collect())) == want
    assert pairs.pair_values(blocks).where("metric = 'cosine'").agg(F.sum("n")).first()[0] == sum(n for a, _, _, n in want if a)
    assert pairs._counted(blocks, "sum").agg(F.sum("n")).first()[0] == sum(r[-1] for r in want)


def test_one_row_of_equal_sets_without_moving_sets(spark):
    """Ids that repeat or are missing, copies in several partitions: one row per distinct set, named by its least id."""
    rows = [(5, [1, 2]), (3, [1, 2]), (3, [4]), (3, [4]), (None, [7]), (None, [1, 2]), (8, []), (9, []), (9, [2**30 - 1])]
    written = cut(spark.createDataFrame(rows, "id long, bits array<int>").repartition(5))
    named, firsts, sets = simjoin.written_sets(written)
    want = sorted([(3, [1, 2]), (3, [4]), (None, [7]), (8, []), (9, [2**30 - 1])], key=str)
    assert sorted(((r["rep"], r["bits"]) for r in sets.collect()), key=str) == want
    assert sorted(((r["rep"], r["copies"]) for r in firsts.collect()), key=str) == sorted([(3, 3), (3, 2), (None, 1), (8, 2), (9, 1)], key=str)
    assert named.count() == len(rows) and named.select("bits").distinct().count() == 5
    none = simjoin.written_sets(cut(written.where("id < 0")))
    assert none[2].collect() == [] and cluster.leader_cluster(written.where("id < 0"), "id").collect() == []


def _size(top, part=""):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if part in f)


def test_clusters_leave_no_set_on_disk(spark):
    """What is left beside the result are ids and digests, and shuffle files go with the stage they were for."""
    rng = random.Random(40)
    sets = [sorted(rng.sample(range(2**30), 400)) for _ in range(300)]
    sets += [sorted({*s[:390], *rng.sample(range(2**30), 10)}) for s in sets[:100]] + sets[:50]
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    local = [str(d) for d in env.blockManager().diskBlockManager().localDirs()]
    kept, shuffled = _size(shared), sum(_size(d, "shuffle_") for d in local)
    for chunks in ({}, {"first_chunk": 50, "growth": 3, "one_chunk_matches": 0}):
        out = cluster.leader_cluster(frame(spark, sets), "id", **chunks)
        assert _size(shared) - kept < 4 * 400 * len(sets) / 4
        assert out.select("leader_id").distinct().count() == 300
        del out
    for _ in range(50):
        if sum(_size(d, "shuffle_") for d in local) - shuffled < 4 * 400 * len(sets) / 4:
            break
        time.sleep(0.2)
    else:
        raise AssertionError("shuffle files stay")


@pytest.mark.parametrize("n, rows, square, narrow", [(60, 10, 4, False), (60, 25, 1024, False), (600, 200, 64, True)])
def test_histograms_over_all_pairs(spark, monkeypatch, n, rows, square, narrow):
    """No block keeps two rows apart; rows without an id or with the same id are rows as any other."""
    monkeypatch.setattr(pairs, "WHOLE_ROWS", (rows, rows))
    monkeypatch.setattr(pairs, "SQUARE_ROWS", square)
    rng = random.Random(n)
    sets = [sorted(rng.sample(range(200), rng.choice([20, 21]))) for _ in range(n)] if narrow else [*random_sets(24, n, 300), *[sorted(rng.sample(range(300), 290))] * 3]
    want = all_pair_values(sets, len(sets), 300)
    df = frame(spark, sets).withColumn("id", F.when(F.col("id") > 9, F.col("id") % 7))
    blocks = pairs.pack_blocks(df, "id", n_bits=300, block_size=None)
    hist = pairs.pair_histograms(blocks, 50).collect()
    for m in measures.SET_MEASURES:
        lo, hi = min(want[m]), max(want[m])
        by_rule = np.bincount([min(int((v - lo) / (hi - lo) * 50), 49) for v in want[m]], minlength=50)
        assert [x for _, x in sorted((r["bin"], r["n"]) for r in hist if r["metric"] == m)] == list(by_rule)
    total = pairs.pair_counts(blocks).agg(F.sum("n")).first()[0]
    assert total == len(sets) ** 2


def test_ranges_that_the_first_look_misses(spark, monkeypatch):
    """The extremes lie between sets of middle size: the bins are counted again over the true ranges."""
    monkeypatch.setattr(pairs, "WHOLE_ROWS", (2, 2))
    sets = [[0, 1], [0, 1], [0, 1, 2, *range(10, 30)], [0, 1, 2, *range(40, 60)], [3, *range(60, 84)], [0, 3, *range(100, 125)], [*range(0, 250, 1)], [*range(0, 251)]]
    blocks = pairs.pack_blocks(frame(spark, sets), "id", n_bits=256, block_size=None)
    want = all_pair_values(sets, len(sets), 256)
    for kept in (pairs._found_ends, lambda rows, calls=[]: calls.append(1) or ({m: (0.25, 0.5) for m in want} if len(calls) == 1 else found(rows))):
        found = pairs._found_ends
        monkeypatch.setattr(pairs, "_found_ends", kept)
        hist = pairs.pair_histograms(blocks, 20).collect()
        monkeypatch.setattr(pairs, "_found_ends", found)
        for m, values in want.items():
            lo, hi = min(values), max(values)
            by_rule = np.bincount([min(int((v - lo) / (hi - lo) * 20), 19) for v in values], minlength=20)
            assert [x for _, x in sorted((r["bin"], r["n"]) for r in hist if r["metric"] == m)] == list(by_rule)


def test_all_documents_meet_in_pair_histograms(spark, tmp_path):
    from catalog import registry, similar  # noqa: F401

    rows = [(i, f"w{i % 7} x{i % 11} y{i % 3} z{i % 5}") for i in range(1030)]  # more than a block of 1,024
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["pair_histograms"](spark, str(tmp_path)).groupBy("metric").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in found} == {1030**2}
