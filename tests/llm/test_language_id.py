"""Language identification: subwords and scores against a plain version, held-out accuracy, rejection, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayspark.llm import language_id as li
from assayspark.llm import queries

SCHEMA = "doc_id long, text string, lang string, score string, accepted int, held_out int"


def plain_subwords(text):
    data, out = li.words_only(text), []
    for size in li.SIZES:
        for i in range(len(data) - size + 1):
            part = data[i : i + size]
            if b" " not in part[1:-1] and part != b"  ":
                code = 0
                for byte in part:
                    code = code * 257 + byte
                out.append(((code * 8 + size) * int(li._FACTOR) % 2**64) >> (64 - li.BUCKET_BITS))
    return out


def made(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    alphabets = {"aa": "abcdeio", "bb": "rstuvwé", "cc": "жзиклмн", "dd": "日本語中文"}
    return [(lang, made(rng, letters, rng.randint(3, 80))) for _ in range(60) for lang, letters in alphabets.items()]


def test_scores_are_the_mean_over_subwords():
    rng = np.random.default_rng(0)
    texts = ["One two, three!", "x", "Ünïcode 12 日本語 words", "a " * 50, "b" * 3000]
    for languages in (3, 20):
        model = li.Model([str(i) for i in range(languages)], rng.normal(size=(li.BUCKETS, languages)).astype(np.float32), 0.7)
        got = model.probabilities([li.words_only(t) for t in texts])
        for row, text in zip(got, texts):
            logits = np.mean([model.scores[b] for b in plain_subwords(text)], axis=0, dtype=np.float64) / 0.7
            want = np.exp(logits - logits.max())
            assert np.allclose(row, want / want.sum(), atol=1e-5)


def test_training_separates_and_rejects(corpus):
    model = li.train([t for _, t in corpus], [g for g, _ in corpus], [i % 5 == 4 for i in range(len(corpus))])
    rng = random.Random(9)
    fresh = [("aa", made(rng, "abcdeio", 12)), ("bb", made(rng, "rstuvwé", 12)), ("cc", made(rng, "жзиклмн", 12)), ("dd", made(rng, "日本語中文", 12))]
    p = model.probabilities([li.words_only(t) for _, t in fresh])
    assert [model.languages[i] for i in p.argmax(axis=1)] == [g for g, _ in fresh]
    assert (p.max(axis=1) >= model.threshold).all()
    unknown = model.probabilities([li.words_only(made(rng, "ԱԲԳԴԵԶ", 30))])
    assert unknown.max() < model.threshold
    assert li.train([], [], []) is None


def test_table_with_odd_rows(spark, corpus):
    rows = [(i, t, g, "x", 1, 2) for i, (g, t) in enumerate(corpus)]
    odd = [None, "", "12 34 !?", "²½ __", "é", "word " * 30_000]
    rows += [(1000 + i, t, None if i % 2 else "aa", "x", 1, 2) for i, t in enumerate(odd)]
    rows += [(None, "abc deio", "zz", "x", 1, 2), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = li.fit_languages(docs, F.col("doc_id").isNotNull(), F.col("doc_id"))
    assert model.languages == ["aa", "bb", "cc", "dd"]
    out = li.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score", "accepted"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert letters or r["score"] == 0 and not r["accepted"]
    same = [(r["lang_pred"], r["score"]) for r in found if r["doc_id"] == 0]
    assert len(same) == 3 and len(set(same)) == 1
    assert li.fit_languages(docs.limit(0), F.lit(True), F.col("doc_id")) is None
    assert {r["lang_pred"] for r in li.predict(docs, None).collect()} == {"und"}
    assert li.predict(docs.limit(0), model).count() == 0


def test_sample_is_bounded(spark, monkeypatch, corpus):
    monkeypatch.setattr(li, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(li, "LANGUAGES", 3)
    rows = [(i, t, g, "x", 1, 2) for i, (g, t) in enumerate(corpus)]
    model = li.fit_languages(spark.createDataFrame(rows, SCHEMA), F.lit(True), F.col("doc_id"))
    assert model.languages == ["aa", "bb", "cc"]


def test_held_out_accuracy(spark, sf):
    found = queries.op11_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND text IS NOT NULL").collect()
    assert len(rows) >= 20 and math.fsum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert found.count() == docs.count()
