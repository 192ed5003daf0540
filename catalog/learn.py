"""Feature preparation, model training and scoring on the test tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayspark.operators import evaluate, ranking
from assayspark.operators.spread import checked_broadcast
from assayspark.plans import models, prepare
from assayspark.plans.fixed import SWEEP_WIDTHS
from assayspark.sources.stages import fresh_path, load_model
from assayspark.sources.tables import load_table, spread_scan
from catalog.ranking import _RANKED
from catalog.registry import query, r6, rounded
from catalog.similar import bits_sql


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, features, label, split, target): embeddings scaled to [0, 1] on the training rows, labels indexed."""
    e = load_table(spark, sf, "embeddings")
    rows = e.select(
        "vec_id", prepare.vector_from_array("embedding").alias("raw_features"), F.col("label").cast("string").alias("target")
    )
    rows = ranking.stratified_split(rows, "target", "vec_id")
    train = rows.where(F.col("split") == "train")
    stages = [prepare.label_indexer(), prepare.minmax_scaler()]
    out = Pipeline(stages=stages).fit(train).transform(prepare.require_target(rows))
    return prepare.clip_unit(out.select("vec_id", "features", "label", "split", "target"))


def shown(results: DataFrame) -> DataFrame:
    """Results without the fit time, which differs from run to run."""
    return rounded(results.drop("fit_seconds"))


@query("train_and_evaluate")
def _(spark, sf):
    """Four classifiers, their grids and five folds; one row per model, best first."""
    chosen = {n: m for n, m in models.models().items() if n != "One-vs-Rest"}
    return shown(models.train_and_evaluate(labelled_vectors(spark, sf), "vec_id", chosen, parallelism=8).ranked())


@query("train_one_vs_rest")
def _(spark, sf):
    """The fifth classifier with the same grid and folds: one binary fit per class, fold and point."""
    chosen = {n: m for n, m in models.models().items() if n == "One-vs-Rest"}
    return shown(models.train_and_evaluate(labelled_vectors(spark, sf), "vec_id", chosen, parallelism=8).ranked())


@query("save_best_models")
def _(spark, sf):
    """Fit all five models, save the three best, list their confusion counts."""
    done = models.train_and_evaluate(labelled_vectors(spark, sf), "vec_id", models.models(), parallelism=8)
    saved = done.save_best(fresh_path(spark, "models"))
    return done.confusions().where(F.col("model").isin(saved))


@query("more_models")
def _(spark, sf):
    data = labelled_vectors(spark, sf)
    return shown(models.train_and_evaluate(data, "vec_id", models.more_models(64, 10), parallelism=8).ranked())


@query("random_search")
def _(spark, sf):
    """Seeded random points, chosen by cross-validated accuracy."""
    data = labelled_vectors(spark, sf)
    lr = LogisticRegression(family="multinomial")
    grid = models.random_search(lr, {"regParam": ("log", 1e-5, 3e-5), "maxIter": ("int", 3, 6)}, n=3)
    train = models.training_rows(ranking.stratified_folds(data.where(F.col("split") == "train"), "label", "vec_id"))
    cv = models.cross_validate(train, lr, grid, parallelism=8)
    rows = [(i, p[lr.regParam], p[lr.maxIter], float(a)) for i, (p, a) in enumerate(zip(grid, cv.avgMetrics))]
    return rounded(spark.createDataFrame(rows, "point int, reg_param double, max_iter int, accuracy double"), 8)


@query("lr_deep_grid")
def _(spark, sf):
    """All seven axes of the deep grid: 288 points with five folds each."""
    data = labelled_vectors(spark, sf)
    train = ranking.stratified_folds(data.where(F.col("split") == "train"), "label", "vec_id")
    n_classes = data.agg(F.max("label")).first()[0]
    return rounded(models.deep_grid(train, int(n_classes) + 1).table(spark))


@query("fit_multilabel")
def _(spark, sf):
    """Quality and toxicity of documents from the hashed tokens of their texts: all metrics per split."""
    marked = F.array_join(
        F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull()), ","
    )
    labels = load_table(spark, sf, "labels").select("doc_id", marked.alias("target"))
    rows = load_table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")
    rows = prepare.binarize_labels(rows, "target", classes=["quality", "toxic"])
    rows = ranking.hash_split(prepare.hash_tokens(rows, "text", 256), "doc_id")
    pred = models.fit_multilabel(rows, "doc_id", ["quality", "toxic"])
    out = evaluate.fold_metrics(pred.withColumn("fold", F.lit(0)))
    return rounded(out, 5)


def _sweep_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_scan(load_table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("target")))
    rows = ranking.stratified_split(docs, "target", "doc_id")
    return prepare.label_indexer().fit(rows).transform(rows)


@query("width_sweep")
def _(spark, sf):
    """Accuracy of all five models for all 18 fingerprint widths: language from character shingles."""
    return rounded(models.width_sweep(_sweep_rows(spark, sf), "doc_id", "text", candidates=list(models.models()), k=2, unit="char"))


_SWEEP_BAYES = """WITH ranked AS (SELECT doc_id, lang, lower(text) AS t,
  row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) <= floor(count(*) OVER (PARTITION BY lang) * 0.8 + 0.5) AS train
  FROM documents),
classes AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) AS class FROM documents WHERE lang IS NOT NULL GROUP BY lang),
grams AS (SELECT DISTINCT doc_id, substr(t, i, 2) AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 1, 1) + 1)) AS i FROM ranked WHERE t <> '')),
numbers AS (SELECT g, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT g FROM grams)),
cells AS (SELECT DISTINCT doc_id, w, h % w AS bit FROM grams JOIN numbers USING (g), (SELECT unnest([{widths}]) AS w)),
rows AS (SELECT doc_id, train, class FROM ranked JOIN classes USING (lang)),
n AS (SELECT class, count(*) AS n FROM rows WHERE train GROUP BY class),
prior AS (SELECT class, ln(n + 1) - ln(sum(n) OVER () + count(*) OVER ()) AS p FROM n),
c AS (SELECT w, class, bit, count(*) AS c FROM cells JOIN rows USING (doc_id) WHERE train GROUP BY ALL),
size AS (SELECT w, class, sum(c) AS total FROM c GROUP BY ALL),
weight AS (SELECT k.w, k.bit, s.class, ln(coalesce(c, 0) + 1) - ln(total + k.w) AS x
  FROM (SELECT DISTINCT w, bit FROM cells) k JOIN size s USING (w) LEFT JOIN c ON c.w = k.w AND c.bit = k.bit AND c.class = s.class),
score AS (SELECT doc_id, w, class, sum(x) AS s FROM cells JOIN weight USING (w, bit) GROUP BY ALL),
full_score AS (SELECT r.doc_id, r.train, r.class AS own, k.w, p.class, coalesce(s, 0) + p AS s
  FROM rows r CROSS JOIN (SELECT unnest([{widths}]) AS w) k CROSS JOIN prior p LEFT JOIN score ON score.doc_id = r.doc_id AND score.w = k.w AND score.class = p.class),
best AS (SELECT doc_id, w, any_value(train) AS train, any_value(own) AS own, arg_max(class, s) AS class FROM full_score GROUP BY doc_id, w)
SELECT w::INTEGER AS n_bits, round(avg(CASE WHEN train THEN (own = class)::INT END), 6) AS train_accuracy,
  round(avg(CASE WHEN NOT train THEN (own = class)::INT END), 6) AS test_accuracy FROM best GROUP BY w"""


@query("width_sweep_bayes", _SWEEP_BAYES.format(widths=", ".join(map(str, SWEEP_WIDTHS))))
def _(spark, sf):
    """Train and test accuracy of naive Bayes for all 18 widths, from one aggregate of bit counts."""
    found = models.width_sweep(_sweep_rows(spark, sf), "doc_id", "text", candidates=["Naive Bayes"], k=2, unit="char")
    return rounded(found.select("n_bits", "train_accuracy", "test_accuracy"))


@query("standard_pca")
def _(spark, sf):
    rows = load_table(spark, sf, "embeddings").select("vec_id", prepare.vector_from_array("embedding").alias("raw_features"))
    out = prepare.standard_pca(4).fit(rows).transform(rows)
    parts = vector_to_array("features")
    return out.select("vec_id", *[r6(parts[i]).alias(f"pc{i}") for i in range(4)])


_SCALED = """WITH e AS (SELECT vec_id, label, list_transform(embedding::FLOAT[], lambda x: x::DOUBLE) AS v FROM embeddings),
t AS (SELECT vec_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id))
  <= floor(count(*) OVER (PARTITION BY label) * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM e),
u AS (SELECT vec_id, split, unnest(range(64)) AS i, unnest(v) AS x FROM e JOIN t USING (vec_id)),
r AS (SELECT i, min(x) AS a, max(x) AS b FROM u WHERE split = 'train' GROUP BY i),
f AS (SELECT vec_id, split, i, least(greatest((x - a) / (b - a), 0), 1) AS x FROM u JOIN r USING (i))"""
_MINMAX = _SCALED + " SELECT vec_id, split, round(sum(x), 6) AS feature_sum FROM f GROUP BY ALL"


@query("scaled_features", _MINMAX)
def _(spark, sf):
    """Min-max scaling fitted on the training rows, clipped to [0, 1], summed per row."""
    rows = labelled_vectors(spark, sf)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", "split", r6(total).alias("feature_sum"))


@query(
    "naive_bayes_predictions",
    _SCALED
    + """, c AS (SELECT label, i, sum(x) AS s FROM f JOIN e USING (vec_id) WHERE split = 'train' GROUP BY ALL),
n AS (SELECT label, count(*) AS n FROM t JOIN e USING (vec_id) WHERE split = 'train' GROUP BY label),
p AS (SELECT label, ln(n + 1) - ln(sum(n) OVER () + count(*) OVER ()) AS prior FROM n),
w AS (SELECT label, i, ln(s + 1) - ln(sum(s) OVER (PARTITION BY label) + 64) AS weight FROM c),
g AS (SELECT vec_id, split, w.label, any_value(prior) + sum(x * weight) AS score FROM f JOIN w USING (i) JOIN p ON p.label = w.label GROUP BY ALL)
SELECT vec_id, split, arg_max(label, score)::VARCHAR AS predicted, round(max(score), 4) AS log_likelihood FROM g GROUP BY ALL""",
)
def _(spark, sf):
    """The class that naive Bayes gives each row, and the joint log likelihood of row and class."""
    data = labelled_vectors(spark, sf).persist()
    bayes, _ = models.models()["Naive Bayes"]
    scored = bayes.fit(data.where(F.col("split") == "train")).transform(data)
    names = data.select(F.col("label").alias("prediction"), F.col("target").alias("predicted")).distinct()
    best = F.round(F.array_max(vector_to_array("rawPrediction")), 4)
    out = scored.select("vec_id", "split", "prediction", best.alias("log_likelihood"))
    return out.join(checked_broadcast(names), "prediction").drop("prediction")


@query(
    "reloaded_models",
    """SELECT model, split, count(*) AS n_rows, 0::BIGINT AS n_different
FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id)) AS rk, count(*) OVER (PARTITION BY label) AS n
  FROM embeddings), (VALUES ('Naive Bayes'), ('Decision Tree')) AS m(model),
LATERAL (SELECT CASE WHEN rk <= floor(n * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split) GROUP BY ALL""",
)
def _(spark, sf):
    """Two models are fitted, saved and loaded: rows that the loaded ones judge, and rows that they judge differently."""
    data = labelled_vectors(spark, sf).persist()
    chosen = {n: m for n, m in models.models().items() if n in ("Naive Bayes", "Decision Tree")}
    done = models.train_and_evaluate(data, "vec_id", chosen)
    path = fresh_path(spark, "models")
    out = None
    for name in done.save_best(path, 2):
        loaded = load_model(spark, f"{path}/model_{name.replace(' ', '_').lower()}").transform(data)
        one = loaded.select(F.lit(name).alias("model"), "vec_id", F.col("prediction").alias("again"))
        out = one if out is None else out.unionByName(one)
    both = done.predictions.join(out, ["model", "vec_id"])
    return both.groupBy("model", "split").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("prediction").eqNullSafe(F.col("again"))).alias("n_different")
    )


@query(
    "pca_norms",
    """WITH e AS (SELECT vec_id, list_transform(embedding::FLOAT[], lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM e),
m AS (SELECT i, avg(x) AS a, stddev_samp(x) AS d FROM u GROUP BY i)
SELECT vec_id, round(sum(((x - a) / d) ** 2), 4) AS squared_norm FROM u JOIN m USING (i) GROUP BY vec_id""",
)
def _(spark, sf):
    """The projection on all 64 principal directions keeps the length of every standardised row."""
    rows = load_table(spark, sf, "embeddings").select("vec_id", prepare.vector_from_array("embedding").alias("raw_features"))
    out = prepare.standard_pca(64).fit(rows).transform(rows)
    norm = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x)
    return out.select("vec_id", F.round(norm, 4).alias("squared_norm"))


@query(
    "assemble_features",
    "SELECT p_partkey, round(p_size + p_retailprice + p_partkey, 6) AS total FROM part",
)
def _(spark, sf):
    wide = load_table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_size").alias("feature_0"),
        F.col("p_retailprice").alias("feature_1"),
        F.col("p_partkey").cast("double").alias("feature_2"),
    )
    out = prepare.assembler(3).transform(wide)
    return out.select("p_partkey", r6(F.aggregate(vector_to_array("raw_features"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


_DOCS = """(SELECT doc_id, text, nullif(lang, 'es') AS lang,
  CASE WHEN doc_id % 17 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE n_chars::DOUBLE END AS value FROM documents)"""


def _docs(spark, sf):
    return spread_scan(load_table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")).select(
        "doc_id",
        "text",
        F.nullif("lang", F.lit("es")).alias("lang"),
        F.expr("CASE WHEN doc_id % 17 = 0 THEN double('Infinity') ELSE double(n_chars) END").alias("value"),
    )


@query(
    "format_features",
    f"""WITH b AS ({bits_sql(f"(SELECT * FROM {_DOCS} WHERE lang IS NOT NULL)", 'doc_id', 'text', 2048)}),
t AS (SELECT doc_id, lang, CASE WHEN ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.8
  THEN 'train' ELSE 'test' END AS split FROM {_DOCS} WHERE lang IS NOT NULL),
u AS (SELECT doc_id, split, unnest(bits) AS bit FROM b JOIN t USING (doc_id)),
always AS (SELECT bit FROM u WHERE split = 'train' GROUP BY bit HAVING count(*) = (SELECT count(*) FROM t WHERE split = 'train')),
k AS (SELECT doc_id, count(*) AS n, sum(bit) AS s FROM u WHERE bit NOT IN (SELECT bit FROM always) GROUP BY doc_id)
SELECT t.doc_id, lang AS target, split, coalesce(n, 0)::BIGINT AS bits_set, coalesce(s, 0)::BIGINT AS bit_sum
FROM t LEFT JOIN k USING (doc_id)""",
)
def _(spark, sf):
    """Clean, fingerprint, scale, split; the sparse vectors are summed up for the check."""
    path = fresh_path(spark, "features")
    prepare.format_features(_docs(spark, sf), "doc_id", "text", "lang", "value", path=path)
    stored = spark.read.parquet(path)
    cells = stored.select("doc_id", "target", "split", F.posexplode(vector_to_array("features")).alias("i", "x"))
    on = F.col("x") > 0
    return cells.groupBy("doc_id", "target", "split").agg(
        F.count(F.when(on, 1)).alias("bits_set"), F.coalesce(F.sum(F.when(on, F.col("i"))), F.lit(0)).alias("bit_sum")
    )


_TEXT = _RANKED.replace("FROM documents", f"FROM {_DOCS} WHERE lang IS NOT NULL")


@query(
    "format_text",
    f"""SELECT doc_id, lang AS target, CASE WHEN rk <= floor(n * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM ({_TEXT})""",
)
def _(spark, sf):
    path = fresh_path(spark, "text")
    prepare.format_text(_docs(spark, sf), "doc_id", "text", "lang", "value", path=path)
    return spark.read.parquet(path).select("doc_id", "target", "split")


@query(
    "hash_tokens",
    """SELECT doc_id, count(w)::BIGINT AS n_tokens FROM
(SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY doc_id""",
)
def _(spark, sf):
    rows = prepare.hash_tokens(load_table(spark, sf, "documents"), "text", 512)
    counts = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", counts.cast("long").alias("n_tokens"))
