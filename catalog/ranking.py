"""Positions, splits, folds, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayspark.operators import ranking
from assayspark.operators.evaluate import multiclass_metrics
from assayspark.sources.tables import load_table
from catalog.registry import query, rounded

_BLOCKS = """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position,
  (row_number() OVER (ORDER BY o_orderkey) - 1) // 1024 AS block_id FROM orders"""


@query("with_block_id", _BLOCKS)
def _(spark, sf):
    return ranking.with_block_id(load_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("with_block_id_two_levels", _BLOCKS)
def _(spark, sf):
    """The same with small buckets, as for a table too large for one sort."""
    rows = load_table(spark, sf, "orders").select("o_orderkey")
    return ranking.with_block_id(rows, "o_orderkey", rows_per_bucket=2_000)


_RANKED = """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) AS rk,
  count(*) OVER (PARTITION BY lang) AS n FROM documents"""
_SPLIT = f"SELECT doc_id, lang, CASE WHEN rk <= floor(n * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM ({_RANKED})"


def _docs(spark, sf):
    return load_table(spark, sf, "documents").select("doc_id", "lang")


@query("stratified_split", _SPLIT)
def _(spark, sf):
    return ranking.stratified_split(_docs(spark, sf), "lang", "doc_id")


@query("stratified_split_two_levels", _SPLIT)
def _(spark, sf):
    return ranking.stratified_split(_docs(spark, sf), "lang", "doc_id", rows_per_bucket=100)


_HASH = """SELECT doc_id, CASE WHEN ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.8
  THEN 'train' ELSE 'test' END AS split FROM documents"""


@query("hash_split", _HASH)
def _(spark, sf):
    return ranking.hash_split(_docs(spark, sf).select("doc_id"), "doc_id")


@query("stratified_folds", f"SELECT doc_id, lang, ((rk - 1) % 5)::INT AS fold FROM ({_RANKED})")
def _(spark, sf):
    return ranking.stratified_folds(_docs(spark, sf), "lang", "doc_id")


@query("split_distribution", f"SELECT split, lang, count(*)::BIGINT AS n FROM ({_SPLIT}) GROUP BY ALL")
def _(spark, sf):
    return ranking.split_distribution(ranking.stratified_split(_docs(spark, sf), "lang", "doc_id"), "lang")


@query(
    "split_distribution_map",
    f"""SELECT split, string_agg(lang || '=' || n, ',' ORDER BY lang) AS distribution
FROM (SELECT split, lang, count(*) AS n FROM ({_SPLIT}) GROUP BY ALL) GROUP BY split""",
)
def _(spark, sf):
    out = ranking.split_distribution_map(ranking.stratified_split(_docs(spark, sf), "lang", "doc_id"), "lang")
    shown = F.transform(F.map_entries("distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("split", F.array_join(shown, ",").alias("distribution"))


@query(
    "top_k_models",
    """WITH p AS (SELECT 'guess ' || k AS model, label, CASE WHEN vec_id % k = 0 THEN (label + 1) % 10 ELSE label END AS p
  FROM embeddings, (SELECT unnest([2, 3, 5, 7, 11]) AS k))
SELECT model, round(avg((label = p)::INT), 6) AS test_accuracy FROM p GROUP BY model ORDER BY test_accuracy DESC, model LIMIT 3""",
)
def _(spark, sf):
    e = load_table(spark, sf, "embeddings").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (2, 3, 5, 7, 11)])))
    pred = e.select(
        F.concat(F.lit("guess "), F.col("k")).alias("model"),
        "label",
        F.expr("CASE WHEN vec_id % k = 0 THEN (label + 1) % 10 ELSE label END").alias("prediction"),
    )
    results = multiclass_metrics(pred, ["model"]).select("model", F.col("accuracy").alias("test_accuracy"))
    return rounded(ranking.top_k(results, 3))
