"""Licence classifier on held-out wording, and the pipeline stage by stage against brute force."""

import importlib

import pytest

import corpus_pipeline
from assayspark.llm import license_scan, queries
from assayspark.llm.common import staged

HELD_OUT = [
    ("Licensed under the Apache License, Version 2.0, see the file.", "apache-2.0"),
    ("This code is released under the MIT License.", "mit"),
    ("licensed under the gnu general public license, version 3", "gpl"),
    ("This work is licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("The teacher has a license and was released from work today.", None),
    ("The general public may use the library under these conditions.", None),
]


@pytest.fixture(scope="module")
def model(spark, sf):
    return license_scan.fit_licenses(spark.read.parquet(f"{sf}/documents.parquet"))


def test_held_out_wording(spark, model):
    docs = spark.createDataFrame(
        [(i, f"some words first\n\n{t}\nand more") for i, (t, _) in enumerate(HELD_OUT)] + [(90, None), (91, ""), (92, "word " * 30000)],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r for r in license_scan.document_licenses(docs, model).collect()}
    assert [got[i]["families"] for i in range(len(HELD_OUT))] == [f for _, f in HELD_OUT]
    assert all(got[i]["n_license"] == (f is not None) for i, (_, f) in enumerate(HELD_OUT))
    assert [got[i]["n_paragraphs"] for i in (90, 91, 92)] == [0, 0, 1]
    assert [(r["position"], r["family"]) for r in license_scan.scan_licenses(docs, model).where("doc_id = 0").collect()] == [(1, "apache-2.0")]


def test_empty_table_and_repeated_rows(spark, model):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")] * 2 + [(None, "x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["families"]) for r in license_scan.document_licenses(docs, model).collect())
    assert got == [("1", "mit"), ("1", "mit"), ("None", None)]
    assert license_scan.document_licenses(docs.limit(0), model).count() == 0


def test_notices_in_documents(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"] for r in license_scan.document_licenses(docs, model).where("n_license > 0").collect()}
    want = {r["doc_id"] for r in docs.where("text RLIKE '(?i)licensed under (the|cc)|under the mit license'").collect()}
    assert got == want and want


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = staged(corpus_pipeline.quality(spark, docs, sf), "stage")
    verdict = {r["doc_id"]: r["kept"] for r in queries.op7_quality_rules(spark, sf).collect()}
    assert kept.columns == names and {r["doc_id"] for r in kept.collect()} == {i for i, k in verdict.items() if k}
    single = staged(corpus_pipeline.near_duplicates(spark, kept, sf), "stage")
    assert single.columns == names and len({r["text"] for r in single.collect()}) == single.count()
    clean = staged(corpus_pipeline.decontaminate(spark, single, sf), "stage")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert clean.columns == names
    assert not [r for r in clean.collect() if any(t in r["text"] for t in items)]
    masked = staged(corpus_pipeline.mask(spark, clean, sf), "stage")
    assert masked.columns == names and masked.count() == clean.count()
    changed = [r for r in masked.collect() if r["text"] != start[r["doc_id"]]]
    assert all("[" in r["text"] for r in changed)
    last = corpus_pipeline.tokens(spark, masked, sf)
    assert last.count() == masked.count() and last.where("NOT exact").count() == 0


def test_near_duplicates_of_the_pipeline_share_four_fifths(spark, sf):
    def text(name, edits=0):
        words = [f"{name}{i}" for i in range(200)]
        for k in range(edits):
            words[20 + 30 * k] = f"edit{k}"
        return " ".join(words)

    # 4 edits: 176 of 216 shingles (0.81); 5 edits: 171 of 221 (0.77)
    rows = [(1, text("a")), (2, text("a", 4)), (3, text("b")), (4, text("b", 5)), (5, text("a")), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert got == {1, 3, 4, 6, 7}


def test_entry_lists_all_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len(queries.QUERIES) == 13
