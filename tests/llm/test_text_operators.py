"""Dealt operators against brute force, on small tables with nulls, empty, repeated and very long rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayspark.llm import (
    byte_bpe,
    decontamination,
    near_dedup,
    personal_data,
    quality_rules,
    sharding,
    substring_dedup,
    token_counts,
    url_filters,
)
from assayspark.llm import common, queries
from assayspark.sources.stages import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, hits int, kept int, curve int"


def rows_of(texts, ids=None):
    return [
        (i if ids is None else ids[i], t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "x", 1, 2, 3)
        for i, t in enumerate(texts)
    ]


def table(spark, texts, ids=None):
    return spark.createDataFrame(rows_of(texts, ids), SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = sentence(rng, 60)
    out = [None, "", " \n\t ", "one", "a b c d", "A B C D"]
    out += [sentence(rng, rng.randint(5, 120)) for _ in range(60)]
    out += [out[10], out[10], sentence(rng, 20) + " " + passage + " " + sentence(rng, 9), passage + "\n" + sentence(rng, 50)]
    for _ in range(12):  # near copies
        words = out[20].split() + out[21].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += ["x " * 300, "x y z " * 90, sentence(rng, 6000)]
    return out


# -- words -----------------------------------------------------------------------------------------------------------


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(40, 60)] + [(3, 3)]
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 131))
    assert all(found[i] == 7 for i in [7, *range(40, 60)])
    none = spark.createDataFrame([], "a long, b long")
    assert common.components(none).count() == 0


# -- substring dedup ------------------------------------------------------------------------------------------------


def brute_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        covered = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                covered[i : i + window] = [True] * window
        out.append((len(w), sum(covered), b" ".join(x for x, c in zip(w, covered) if not c)))
    return out


def test_repeats_match_brute_force(spark, texts):
    got = substring_dedup.remove_repeats(table(spark, texts)).orderBy("doc_id").collect()
    want = brute_repeats(texts, 35)
    assert [(r["n_words"], r["n_removed"], bytes(r["kept_text"])) for r in got] == want
    assert sum(w[1] for w in want) > 300


def test_repeats_with_small_segments_and_null_ids(spark, texts, monkeypatch):
    words = [t.encode().split() for t in texts if t]
    flat = common.word_hashes([w for one in words for w in one])
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    whole = substring_dedup.spans(flat, owner)
    assert len(whole[0]) and (whole[1] > 0).all()
    got = substring_dedup.remove_repeats(table(spark, ["a b " * 40, "a b " * 40], ids=[None, None])).collect()
    assert [r["n_removed"] for r in got] == [80, 80]
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


# -- near duplicates ------------------------------------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(near_dedup._LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i), root(i) == i) for i, s in enumerate(sets)]


def test_near_duplicates_match_brute_force(spark, texts, monkeypatch):
    want = brute_components(texts)
    got = [tuple(r) for r in near_dedup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == want
    assert sum(not w[3] for w in want) >= 12
    kept = {r["doc_id"] for r in near_dedup.keep_one(table(spark, texts)).collect()}
    assert kept == {w[0] for w in want if w[3]}


def test_large_groups_are_dealt_out_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    rng = random.Random(2)
    base = sentence(rng, 80).split()
    copies = []
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = sentence(rng, 1) + "q"
        copies.append(" ".join(words))
    got = [tuple(r) for r in near_dedup.near_duplicates(table(spark, copies)).orderBy("doc_id").collect()]
    assert got == brute_components(copies)


def test_chains_across_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 3)
    rng = random.Random(12)
    chains = []
    for _ in range(2):  # each text is linked with its neighbours in the chain only
        words = sentence(rng, 400).split()
        chains += [" ".join(words[i : i + 100]) for i in range(0, 240, 6)]
    rng.shuffle(chains)
    got = [tuple(r) for r in near_dedup.near_duplicates(table(spark, chains)).orderBy("doc_id").collect()]
    assert got == brute_components(chains) and len({r[2] for r in got}) == 2


def test_near_duplicates_of_repeated_and_null_ids(spark):
    long = sentence(random.Random(1), 30)
    got = near_dedup.near_duplicates(table(spark, [long, long, long, "a"], ids=[4, 4, None, 9])).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(4, 26, 4, True), (4, 26, 4, True), (None, 26, None, True), (9, 1, 9, True)], key=str)
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_bands_and_sketch_limit_follow_the_threshold():
    rng = np.random.default_rng(4)
    for threshold, common_part in ((85, 850), (80, 800)):
        bands, rows = near_dedup.banding(threshold)
        assert (1 - (threshold / 100) ** rows) ** bands < 2e-7
        limit = near_dedup.sketch_limit(threshold)
        for _ in range(150):
            # common_part of 1000 hashes are shared: the similarity of the threshold
            pool = rng.integers(1, 2**63, 1000, dtype=np.uint64)
            half = (1000 - common_part) // 2
            a, b = (near_dedup.samples(np.delete(pool, slice(k * half, (k + 1) * half)), bands * rows) for k in (0, 1))
            assert (near_dedup.band_keys(a, rows) == near_dedup.band_keys(b, rows)).any()
            x, y = (np.frombuffer(near_dedup.odd_sketch(v), np.uint64) for v in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= limit


def test_odd_sketch_limit_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    limit, worst = near_dedup.sketch_limit(), 0
    for _ in range(200):
        n = int(rng.integers(40, 400))
        common_part = rng.integers(1, 2**63, n, dtype=np.uint64)
        extra = max(0, int(n * 15 / 85) // 2)
        sides = [np.unique(np.concatenate([common_part, rng.integers(1, 2**63, extra, dtype=np.uint64)])) for _ in range(2)]
        a, b = (np.frombuffer(near_dedup.odd_sketch(near_dedup.samples(s)), np.uint64) for s in sides)
        worst = max(worst, int(np.bitwise_count(a ^ b).sum()))
    assert worst <= limit
    far = [rng.integers(1, 2**63, 300, dtype=np.uint64) for _ in range(2)]
    a, b = (np.frombuffer(near_dedup.odd_sketch(near_dedup.samples(np.unique(s))), np.uint64) for s in far)
    assert int(np.bitwise_count(a ^ b).sum()) > limit


# -- sharding -------------------------------------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours(spark):
    grid = spark.createDataFrame([(a, b, c) for a in range(8) for b in range(8) for c in range(8)], "a int, b int, c int")
    cells = [F.col("a"), F.col("b"), F.col("c")]
    rows = grid.select("a", "b", "c", sharding.hilbert_index(cells, 3).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    steps = [sum(abs(x - y) for x, y in zip(p[:3], q[:3])) for p, q in zip(rows, rows[1:])]
    assert set(steps) == {1}


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_whole_and_even(spark, texts, shards):
    got = sharding.shard_documents(table(spark, texts), shards).collect()
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(texts) and set(slots) == set(range(shards))
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in got)


def test_shards_in_several_ranges_and_empty(spark, texts):
    small = table(spark, texts).select("doc_id", "lang", "source", F.col("n_chars").alias("size"))
    got = sharding.hilbert_shards(small, sharding.document_cells(F.col("size")), 4, ["doc_id"], rows_per_range=9).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted(
        (p * 4 // len(got), p - -(-(p * 4 // len(got)) * len(got) // 4)) for p in range(len(got))
    )
    assert sharding.shard_documents(table(spark, []), 8).count() == 0
    assert sharding.shard_documents(table(spark, ["a", "a"]), 8).count() == 2


def test_written_shards_and_their_ranges(spark, texts):
    path = fresh_path(spark, "shards")
    placed = sharding.shard_documents(table(spark, texts), 4)
    sharding.write_shards(placed, path)
    assert spark.read.parquet(path).count() == len(texts)
    ranges = sharding.shard_ranges(placed, ["size"]).collect()
    assert sum(r["rows"] for r in ranges) == len(texts)


# -- personal data --------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {
            "email": True,
            "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits),
            "phone": 9 <= len(digits) <= 15,
        }[kind]

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


ODD = [
    None, "", "a@b.c%x@d.e f@g..h i@j.k-l.m @x.y", "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255 0001.000.0256.1 256.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111  4111 1111--1111 1111 41111111111111112222 5500005555555559",
    "+1 (234) 567-8901 +12 +123456789012345678 ++44 20 7946 0958.", "é😀 a@b.cd 10.0.0.1  x@y.zz",
    "1" * 3000 + "." + "a" * 3000 + "@" + "b." * 3000, "aa 4111\n1111 +1\n234567890 x@y.z.@w.v", "1 " * 20000, "a." * 20000,
]


def test_base_spans_match_python_patterns(spark):
    rng = random.Random(8)
    parts = ["a", "b.c", "@", ".", " ", "-", "+", "1", "23", "456", "(", ")", "\n", "é", "4111111111111111", "10.0.0.1", "%", "_"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    got = {r["doc_id"]: r for r in personal_data.digest(personal_data.find_personal_data(table(spark, texts))).collect()}
    for i, text in enumerate(texts):
        want = brute_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (text, listed, got[i]["spans"])
        counts = collections.Counter(k for k, _, _ in want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [counts[k] for k in PATTERNS]


def test_contexts_discover_unseen_identifiers(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005"]
    texts = [f"please note customer: {c} in the file" for c in cards]
    texts += ["then customer: AB-10293 came back", "the year 1234567 and the rest", "plain words only " * 30]
    found = {r["doc_id"]: r for r in personal_data.find_personal_data(table(spark, texts)).collect()}
    assert [s["value"] for s in found[4]["id"]] == ["AB-10293"]
    assert found[5]["id"] == [] and found[6]["id"] == []
    masked = {r["doc_id"]: r for r in personal_data.mask_personal_data(table(spark, texts + [None, ""])).collect()}
    assert masked[0]["text"] == "please note customer: [CARD] in the file"
    assert masked[4]["text"] == "then customer: [ID] came back" and masked[4]["n_chars"] == len(masked[4]["text"])
    assert masked[6]["text"] == texts[6] and masked[7]["text"] is None and masked[8]["text"] == ""
    assert personal_data.mask_personal_data(table(spark, [])).count() == 0


def test_secrets_induce_assignment_patterns(spark):
    rng = random.Random(6)
    secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(4)]
    texts = [f'some words token = "{s}" and more' for s in secrets]
    texts += ['then  Token="zq-77120-x" came', "a token 9912345x of another kind", 'width = "abc123def" here', "x" * 50 + ": 1234567"]
    found = {r["doc_id"]: [s["value"] for s in r["id"]] for r in personal_data.find_personal_data(table(spark, texts)).collect()}
    assert [found[i] for i in range(4)] == [[s] for s in secrets]
    assert found[4] == ["zq-77120-x"] and found[5] == found[6] == found[7] == []


def test_scoring_rounds_against_plain_loops(spark):
    rng = random.Random(12)
    seen = [(rng.choice(("card", "id", "id", "id")), f"v{rng.randrange(30)}", f"w{rng.randrange(9)}") for _ in range(150)]
    totals = {f"w{i}": 10 + 5 * i for i in range(9)}
    got = personal_data.bootstrap(spark.createDataFrame(seen, "kind string, value string, word string"), spark.createDataFrame(list(totals.items()), "word string, n long"))
    seeds = {v for k, v, _ in seen if k != "id"}
    known, trusted = set(seeds), {}
    for _ in range(personal_data.ROUNDS):
        trusted = {}
        for w, n in totals.items():
            hits = [v for _, v, x in seen if x == w and v in known]
            if len(set(hits)) >= personal_data.MIN_INSTANCES and min(1.0, len(hits) / n) >= personal_data.MIN_PRECISION:
                trusted[w] = min(1.0, len(hits) / n)
        known = seeds | {v for _, v, w in seen if w in trusted}
    assert trusted and {r["word"]: r["precision"] for r in got.collect()} == pytest.approx(trusted)


def test_masking_keeps_columns_of_any_name(spark):
    rows = [(1, "mail a@b.co", 11, "x", 5, "y"), (2, None, None, "z", 6, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _hash string, _spans int, _h string")
    got = sorted(tuple(r) for r in personal_data.mask_personal_data(docs).collect())
    assert got == [(1, "mail [EMAIL]", 12, "x", 5, "y"), (2, None, None, "z", 6, "w")]


def test_overlapping_spans_are_masked_once(spark):
    text = "call +4111111111111111 or a@b.co"
    got = personal_data.mask_personal_data(table(spark, [text, text])).collect()
    assert {r["text"] for r in got} == {"call +[CARD] or [EMAIL]"} and len(got) == 2


# -- tokens ---------------------------------------------------------------------------------------------------------


def test_tree_encoding_is_the_plain_encoding():
    tok = byte_bpe.tokenizer(*queries._vocabulary())
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "l", "'ll", "'s", "1", "23", "é", "ñ", "。", "😀", " ", "\t", "!?", "xxxx", " "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        ids = byte_bpe.encode_tree(tok.encode_ordinary, text, rng.choice([1, 2, 3, 5, 8, 13]))
        assert ids == tok.encode_ordinary(text)
        assert byte_bpe.decode_tree(tok.decode_bytes, ids, 3) == text.encode()
    for text in ("a" * 50000, " " * 50000, "ab1 " * 9000):
        assert byte_bpe.encode_tree(tok.encode_ordinary, text) == tok.encode_ordinary(text)


def test_joining_is_associative():
    encode = byte_bpe.tokenizer(*queries._vocabulary()).encode_ordinary
    rng = random.Random(4)
    for _ in range(300):
        a, b, c = ((t, encode(t)) for t in ("".join(rng.choice("ab '\n1é") for _ in range(9)) for _ in range(3)))
        left = byte_bpe.join_parts(encode, byte_bpe.join_parts(encode, a, b), c)
        assert left == byte_bpe.join_parts(encode, a, byte_bpe.join_parts(encode, b, c))


def test_encode_and_decode_tables(spark, texts):
    ranks, pattern = queries._vocabulary()
    tok = byte_bpe.tokenizer(ranks, pattern)
    encoded = byte_bpe.encode_texts(table(spark, texts), ranks, pattern)
    got = byte_bpe.decode_ids(encoded, ranks, pattern).collect()
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == tok.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    assert len(got) == len(texts) and byte_bpe.encode_texts(table(spark, []), ranks, pattern).count() == 0


# -- quality --------------------------------------------------------------------------------------------------------


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    repeated = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(repeated),
    )


def test_text_statistics_match_brute_force(spark, texts):
    rng = random.Random(6)
    more = texts + ["a\nb\na\n\na", "#*$%&|<> x\r\ny", "é ñ 😀"] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(100)]
    got = quality_rules.quality_verdicts(table(spark, more)).collect()
    for r in got:
        n_words, letters, symbols, lines, repeats = brute_statistics(more[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n_words, letters, symbols, lines, repeats)
        failed = n_words < 10 or 100 * repeats > 20 * n_words
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(7)
    clean = [sentence(rng, int(rng.lognormvariate(5, 0.8)) + 12) for _ in range(400)]
    junk = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in sentence(rng, 150).split()) for _ in range(8)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(table(spark, clean + junk)).collect()}
    assert all(got[i] for i in range(400)) and not any(got[400 + i] for i in range(8))
    kept = quality_rules.quality_filter(table(spark, clean + junk))
    assert kept.columns == table(spark, []).columns and kept.count() == 400
    assert quality_rules.quality_filter(table(spark, [])).count() == 0


def test_estimates_of_equal_documents_reject_nothing(spark):
    text = "one two three four five six seven eight nine ten eleven"
    assert quality_rules.quality_filter(table(spark, [text] * 30)).count() == 30


# -- benchmark ------------------------------------------------------------------------------------------------------


def test_edit_distance_inside_a_text():
    rng = random.Random(1)

    def brute(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item):
            new = [i + 1]
            for j, b in enumerate(text):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(100):
        item = np.array([rng.randrange(4) for _ in range(rng.randint(1, 9))], np.uint64)
        texts = np.array([[rng.randrange(4) for _ in range(12)] for _ in range(5)], np.uint64)
        assert decontamination.edit_distances(item, texts).tolist() == [brute(item, t) for t in texts]


def test_recall_of_edited_items():
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randint(8, 120)).encode()) for i in range(60)]
    block = decontamination.Items(items, decontamination.MAX_RATIO)
    for ratio, least in ((0.0, 1.0), (0.1, 0.97), (decontamination.MAX_RATIO, 0.9)):
        texts, want = [], []
        for i, raw in items * 4:
            words = raw.split()
            for _ in range(int(ratio * len(words))):
                at, kind = rng.randrange(len(words)), rng.random()
                if kind < 0.5:
                    words[at] = b"other"
                elif kind < 0.75:
                    del words[at]
                else:
                    words.insert(at, b"more")
            texts.append(sentence(rng, rng.randrange(80)).encode().split() + words + sentence(rng, rng.randrange(80)).encode().split())
            want.append(i)
        found = decontamination.find_items(block, texts)
        assert sum(any(x == i for x, _ in f) for f, i in zip(found, want)) >= least * len(want)
    clean = [sentence(rng, 300).encode().split() for _ in range(40)]
    assert not any(decontamination.find_items(block, clean))


def test_recall_of_edits_at_the_start_the_middle_and_the_end():
    rng = random.Random(10)
    items = [(i, sentence(rng, n).encode()) for i, n in enumerate([*range(1, 60), *range(60, 150, 9)])]
    block = decontamination.Items(items, decontamination.MAX_RATIO)
    for place in (0.0, 0.5, 1.0):
        for kind in ("other", "missing"):
            texts = []
            for _, raw in items:
                words = raw.split()
                edits = int(decontamination.MAX_RATIO * len(words))
                at = int(place * (len(words) - edits))
                words[at : at + edits] = [b"other"] * edits if kind == "other" else []
                texts.append(sentence(rng, 30).encode().split() + words + sentence(rng, 30).encode().split())
            found = decontamination.find_items(block, texts)
            assert [i for i, _ in items if not any(x == i for x, _ in found[i])] == []


def test_contamination_of_tables(spark, texts):
    items = [(1, texts[10]), (2, texts[10]), (None, texts[12]), (3, None), (4, ""), (5, "not anywhere in any of these texts at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = " ".join([texts[9], texts[11]] * 40) + " " + texts[10].upper() + ". " + texts[9]
    docs = table(spark, [*texts, long])
    whole = {r["doc_id"]: r for r in decontamination.contamination(docs, bench).collect()}
    assert whole[10]["item_ids"] == [1, 2] and whole[len(texts)]["item_ids"] == [1, 2] and whole[12]["item_ids"] == [None]
    assert not whole[0]["contaminated"] and not whole[1]["contaminated"]
    small = decontamination.with_hits(docs, bench, block_bytes=300).select("doc_id", F.size("hits").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in small} == {i: r["n_items"] for i, r in whole.items()}
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r["contaminated"] for r in whole.values())
    assert decontamination.contamination(table(spark, []), bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_contamination_equals_a_sliding_search(spark):
    rng = random.Random(31)
    items = [(i, sentence(rng, rng.choice((1, 3, 4, 9, 15, 16, 30, 50)))) for i in range(16)] + [(-1, sentence(rng, 20)), (None, sentence(rng, 20))]
    rows = []
    for n in range(120):
        _, item = items[n % len(items)]
        words = item.split()
        for _ in range(rng.randint(0, max(1, len(words) // 4))):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randint(0, 1)] = [sentence(rng, 1)] * rng.randint(0, 1)
        rows.append(" ".join([sentence(rng, rng.randint(0, 40)), *words, sentence(rng, rng.randint(0, 40))]))
    found = decontamination.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()

    def least(item, words):  # Sellers: the item against any part of the text
        row = [0] * (len(words) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(words, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    split = [decontamination.words_in(t.encode()) for _, t in items]
    for r in found:
        words = decontamination.words_in(rows[r["doc_id"]].encode())
        want = {items[i][0] for i, item in enumerate(split) if least(item, words) <= int(decontamination.MAX_RATIO * len(item))}
        assert set(r["item_ids"]) == want


# -- URLs -----------------------------------------------------------------------------------------------------------


def brute_rule(url, rules):
    at = -1 if url is None else url.find("://")
    rest = "" if at < 0 else url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_rules_match_brute_force(spark):
    rng = random.Random(11)
    hosts = ["a.org", "www.example.org", "EXAMPLE.org", "x.example.com", "com", "deep.a.b.c.example.org", "notexample.org", "", "org:80", "É.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123", "/en/2", "/fr/x", "/de/y", "/de", "/es/é"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=://x/', '#/es/'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "://", "http://com/fr/://x"]
    extra = [("c.example.org", "/e", "allow"), ("example.org", "/es/deep", "allow"), ("b.c.example.org", "", "block")]
    for rules in (url_filters.RULES, url_filters.RULES + extra):
        pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
        table_ = spark.createDataFrame([*rules, (None, "/", "block"), ("net", "/", None)], "host string, path string, verdict string")
        got = url_filters.judge_urls(pages, table_).collect()
        assert len(got) == len(urls) * 2
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_rule(r["url"], rules), r
    assert url_filters.judge_urls(pages.limit(0), table_).count() == 0
    assert url_filters.judge_urls(pages, table_.limit(0)).where("rule IS NOT NULL").count() == 0


# -- token counts ---------------------------------------------------------------------------------------------------


def test_rollups_follow_changes_and_ignore_repeats(spark, texts):
    path = fresh_path(spark, "rollup")
    old = token_counts.word_counts(table(spark, texts), "words")
    new_texts = list(texts)
    new_texts[10], new_texts[12] = "only three words", None
    new = token_counts.word_counts(table(spark, new_texts).where("doc_id <> 11"), "words")

    def summed(rows):
        out = collections.Counter()
        for r in rows:
            out[(r["source"], r["lang"], r["tokenizer"], "docs")] += 1
            out[(r["source"], r["lang"], r["tokenizer"], "tokens")] += r["n_tokens"]
        return +out

    def held(batches):
        out = collections.Counter()
        for r in token_counts.totals(spark, path, batches).collect():
            out[(r["source"], r["lang"], r["tokenizer"], "docs")] += r["n_docs"]
            out[(r["source"], r["lang"], r["tokenizer"], "tokens")] += r["n_tokens"]
        return +out

    assert token_counts.commit_batch(spark, path, "a", token_counts.signed(old, 1))
    assert not token_counts.commit_batch(spark, path, "a", token_counts.signed(old, 1))
    assert held(["a"]) == summed(old.collect())
    assert token_counts.commit_batch(spark, path, "b", token_counts.changes(old, new))
    assert held(["b", "a"]) == summed(new.collect())
    assert token_counts.compact(spark, path, ["a", "b"], "all") and held(["all"]) == summed(new.collect())
    token_counts.commit_batch(spark, path, "c", token_counts.signed(new, -1))
    assert held(["all", "c"]) == {} and held(["missing"]) == {}


def test_bpe_counts(spark, texts):
    ranks, pattern = queries._vocabulary()
    tok = byte_bpe.tokenizer(ranks, pattern)
    got = token_counts.bpe_counts(table(spark, texts), {"v": ranks}, pattern).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(tok.encode_ordinary(t or "")) for i, t in enumerate(texts)}
