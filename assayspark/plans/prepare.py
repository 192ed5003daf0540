"""Feature preparation for Spark ML and for text/target models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA,
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    MinMaxScaler,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayspark.functions.columns import col, split_labels
from assayspark.operators.filters import drop_nulls, require_columns
from assayspark.operators.fingerprints import fingerprint
from assayspark.operators.quantiles import impute_median
from assayspark.operators.ranking import hash_split, split_distribution, stratified_split
from assayspark.operators.spread import attach_by_key, number_rows
from assayspark.sources.files import write_splits
from assayspark.sources.stages import cut

#: Labels that may stand in the plan itself; more of them are joined as a table.
LISTED_LABELS = 10_000


# --- stages ----------------------------------------------------------------


def label_indexer(target: str = "target", label: str = "label") -> StringIndexer:
    """String labels to numbers, the most frequent first."""
    return StringIndexer(inputCol=target, outputCol=label, stringOrderType="frequencyDesc")


def assembler(n: int, prefix: str = "feature_", out: str = "raw_features") -> VectorAssembler:
    """Wide numeric columns ``feature_0..n-1`` to one vector."""
    return VectorAssembler(inputCols=[f"{prefix}{i}" for i in range(n)], outputCol=out)


def minmax_scaler(inp: str = "raw_features", out: str = "features") -> MinMaxScaler:
    return MinMaxScaler(inputCol=inp, outputCol=out)


def standard_pca(k: int, inp: str = "raw_features", out: str = "features") -> Pipeline:
    """Standard scaling followed by a k-dimensional projection."""
    scaler = StandardScaler(inputCol=inp, outputCol="_scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, PCA(k=k, inputCol="_scaled", outputCol=out)])


def fit_minmax(train: DataFrame, inp: str = "raw_features", out: str = "features", constant: str = "half") -> PipelineModel:
    """Min-max scaling fitted on the training rows only.

    A constant column becomes 0.5, or 0 with ``constant='zero'``."""
    model = minmax_scaler(inp, "_minmax" if constant == "zero" else out).fit(train)
    if constant != "zero":
        return PipelineModel([model])
    low, high = model.originalMin.toArray(), model.originalMax.toArray()
    keep = Vectors.dense([1.0 if b > a else 0.0 for a, b in zip(low, high)])
    return PipelineModel([model, ElementwiseProduct(scalingVec=keep, inputCol="_minmax", outputCol=out)])


def clip_unit(df: DataFrame, c: str = "features") -> DataFrame:
    """Cut scaled features to [0, 1]: rows outside the training range stay valid for naive Bayes."""
    unit = F.transform(vector_to_array(c), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return df.withColumn(c, array_to_vector(unit))


def bits_to_vector(df: DataFrame, bits: str, n_bits: int, out: str = "features") -> DataFrame:
    """Bit positions to one sparse 0/1 vector, never to ``n_bits`` columns."""
    encoder = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_bits)], "_words", out, binary=True)
    encoder.setMinTF(0.0)
    words = F.transform(F.col(bits), lambda b: b.cast("string"))
    return encoder.transform(df.withColumn("_words", words)).drop("_words")


def drop_constant_bits(df: DataFrame, bits: str, fit_on: DataFrame) -> DataFrame:
    """Clear the bits that are set in every row of ``fit_on``.

    For 0/1 columns this is min-max scaling with constant columns at zero, and
    it keeps the sets sparse.  The list is at most one row's bits long."""
    n = fit_on.count()
    counts = fit_on.select(F.explode(bits).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    constant = [r["b"] for r in counts.where(F.col("n") == n).collect()]
    if not constant:
        return df
    return df.withColumn(bits, F.array_except(F.col(bits), F.array(*[F.lit(b) for b in constant])))


def vector_from_array(c: str) -> F.Column:
    return array_to_vector(col(c).cast("array<double>"))


def require_target(df: DataFrame, target: str = "target") -> DataFrame:
    return require_columns(df, {target: T.StringType()})


# --- jobs ------------------------------------------------------------------


def clean_activity(df: DataFrame, value: str) -> DataFrame:
    """Drop rows with any missing cell; infinite values become the median."""
    return impute_median(drop_nulls(df), value)


def format_features(
    df: DataFrame,
    key: str,
    text: str,
    target: str,
    value: str,
    n_bits: int = 2048,
    k: int = 3,
    unit: str = "word",
    fraction: float = 0.8,
    path: str | None = None,
) -> DataFrame:
    """Clean, fingerprint, scale, split and optionally store: (key, features, target, split)."""
    clean = clean_activity(df, value)
    rows = fingerprint(clean, text, k, n_bits, unit)
    # the texts are hashed once; counting, clearing and encoding read the written bits
    rows = cut(hash_split(rows.select(key, "bits", F.col(target).alias("target")), key, fraction))
    rows = drop_constant_bits(rows, "bits", rows.where(F.col("split") == "train"))
    out = bits_to_vector(rows, "bits", n_bits).select(key, "features", "target", "split")
    if path:
        write_splits(out, path)
    return out


def format_text(
    df: DataFrame, key: str, text: str, target: str, value: str, fraction: float = 0.8, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Clean, project, stratified split and optionally store; also the class counts per split."""
    clean = clean_activity(df, value).select(key, F.col(text).alias("text"), F.col(target).alias("target"))
    out = stratified_split(clean, "target", key, fraction)
    if path:
        write_splits(out, path)
    return out, split_distribution(out, "target")


def label_vocabulary(df: DataFrame, target: str, sep: str = ",") -> DataFrame:
    """Distinct labels of a separator-joined target column."""
    return df.select(F.explode(split_labels(target, sep)).alias("label")).distinct()


def label_count(df: DataFrame, target: str, sep: str = ",") -> DataFrame:
    return label_vocabulary(df, target, sep).agg(F.count(F.lit(1)).alias("n_labels"))


def binarize_labels(
    df: DataFrame, target: str, sep: str = ",", out: str = "labels", classes: Sequence[str] | None = None
) -> DataFrame:
    """0/1 array over the sorted label vocabulary."""
    present = split_labels(target, sep)
    if classes is None:
        rows = label_vocabulary(df, target, sep).limit(LISTED_LABELS + 1).collect()
        if len(rows) > LISTED_LABELS:
            return _binarize_by_table(df, present, target, sep, out)
        classes = sorted(r["label"] for r in rows)
    vocabulary = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, F.transform(vocabulary, lambda c: F.array_contains(present, c).cast("int")))


def _binarize_by_table(df: DataFrame, present: Column, target: str, sep: str, out: str) -> DataFrame:
    """`binarize_labels` for a vocabulary that is a table of numbered labels and never on the driver."""
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    numbered = cut(number_rows(label_vocabulary(rows, target, sep), "label", "_number"))
    n = numbered.count()
    pairs = rows.select("_row", F.explode(F.array_distinct(present)).alias("label"))
    counts = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    found = attach_by_key(pairs, cut(numbered.join(counts, "label")), "label", "_n")
    found = found.groupBy("_row").agg(F.collect_list("_number").alias("_numbers"))
    numbers = F.coalesce("_numbers", F.array().cast("array<bigint>"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    flags = F.transform(every, lambda i: F.when(present.isNotNull(), F.array_contains(numbers, i).cast("int")))
    return rows.join(found, "_row", "left").withColumn(out, flags).drop("_row", "_numbers")


def label_rows(df: DataFrame, key: str, target: str, sep: str = ",") -> DataFrame:
    """Long form (key, label), one row per label that is set."""
    return df.select(key, F.explode(split_labels(target, sep)).alias("label")).distinct()


def hash_tokens(
    df: DataFrame, c: str, n_features: int = 2048, pattern: str = r"\S+", out: str = "features"
) -> DataFrame:
    """Hashed token counts of the whole text."""
    tokens = F.regexp_extract_all(F.lower(F.col(c)), F.lit(pattern), F.lit(0))
    tf = HashingTF(inputCol="_tokens", outputCol=out, numFeatures=n_features)
    return tf.transform(df.withColumn("_tokens", F.coalesce(tokens, F.array().cast("array<string>")))).drop("_tokens")
