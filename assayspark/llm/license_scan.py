"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line with a word.  Its features are hashed word n-grams (one to three words), a sparse
vector.  Multinomial logistic regression with one class per licence family and a class ``unknown`` is fitted on
notices and on a bounded sample of the corpus (``SAMPLE_DOCS`` documents, chosen by a hash of their ids), whose paragraphs
are unknown unless they share a notice's wording.  A held-out half of those calibrates the unknown class: a
family is taken only above the highest probability that any held-out unknown paragraph reached.  A prediction stands
if the paragraph and a notice of that family share enough three-word runs.

Every paragraph of every document is scored, with Spark ML and SQL expressions only.

Null and empty texts have no paragraphs and no family; repeated rows get equal results; further columns are ignored.  A
paragraph with equal probabilities gets the first family by name.  With an empty table the model is fitted on the notices and plain filler alone.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BLANKS, staged, text_column

#: Documents whose paragraphs are used as examples of unknown text.
SAMPLE_DOCS = 200
#: Size of the hashed feature space.
FEATURES = 1 << 14
#: Least probability of a family, whatever the calibration says.
MIN_PROBABILITY = 0.5
#: Share of a paragraph's three-word runs, or of a notice's, that must agree.
MIN_SHARED = 0.5
UNKNOWN = "unknown"

#: Customary notices of public licences, by family.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
}
#: Plain sentences that share words with notices but are none.
FILLER = [
    "The driver has a license and the car is free to use today.",
    "We released the second version of the work under public pressure.",
    "The general public was free to use the library in the city.",
    "All conditions of the agreement were met in writing by the company.",
    "A copy of the software was sent to the person in charge.",
]


def paragraphs(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, size: int) -> Column:
    """Runs of ``size`` words; ``words`` must be a column that is computed already."""
    starts = F.sequence(F.lit(0), F.size(words) - size)
    run = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])
    return F.when(F.size(words) >= size, F.transform(starts, run)).otherwise(F.array().cast("array<string>"))


def with_features(rows: DataFrame, text: str = "paragraph") -> DataFrame:
    """``rows`` with ``words`` and ``features``."""
    out = rows.withColumn("words", _terms(F.col(text)))
    words = F.col("words")
    out = out.withColumn("_grams", F.concat(words, _runs(words, 2), _runs(words, 3)))
    return HashingTF(numFeatures=FEATURES, inputCol="_grams", outputCol="features", binary=True).transform(out).drop("_grams")


def notice_table(spark: SparkSession, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """(family, paragraph) of the notices: a table of fixed size."""
    rows = [(family, text) for family, texts in (notices or NOTICES).items() for text in texts]
    return spark.createDataFrame(rows, "family string, paragraph string")


def _variants(table: DataFrame) -> DataFrame:
    """Each notice as it is, without its first, last or every fifth word, and inside other words."""
    words = F.split("paragraph", " ")

    def thinned(k: int) -> Column:
        return F.array_join(F.filter(words, lambda w, i: i % 5 != k), " ")

    shapes = [
        F.col("paragraph"), F.upper("paragraph"), F.concat(F.lit("* "), F.col("paragraph")),
        F.concat(F.lit("Note: "), F.col("paragraph"), F.lit(" All rights reserved.")),
        F.when(F.size(words) > 6, F.array_join(F.slice(words, 2, F.size(words)), " ")),
        F.when(F.size(words) > 6, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")),
        *[F.when(F.size(words) > 6, thinned(k)) for k in range(5)],
    ]
    return table.select("family", F.explode(F.array(*shapes)).alias("paragraph")).where("paragraph IS NOT NULL")


def _templates(table: DataFrame) -> DataFrame:
    """(family, templates): the three-word runs of each notice, one row per family."""
    rows = table.withColumn("words", _terms(F.col("paragraph"))).withColumn("runs", _runs(F.col("words"), 3))
    return rows.groupBy("family").agg(F.collect_list("runs").alias("templates"))


def _shared(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """``rows`` (family, words) with the best agreement with a notice of the family."""
    runs = rows.withColumn("_runs", _runs(F.col("words"), 3)).join(F.broadcast(templates), "family", "left")
    both = lambda t: F.size(F.array_intersect(F.col("_runs"), t))
    own = F.greatest(F.size("_runs"), F.lit(1))
    best = F.array_max(F.transform("templates", lambda t: F.greatest(both(t) / own, both(t) / F.greatest(F.size(t), F.lit(1)))))
    return runs.withColumn("shared", F.coalesce(best, F.lit(0.0))).drop("_runs", "templates")


class LicenseModel:
    """A fitted classifier with its threshold and templates."""

    def __init__(self, model: LogisticRegressionModel, families: list[str], threshold: float, templates: DataFrame):
        self.model, self.families, self.threshold, self.templates = model, families, threshold, templates

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (paragraph) with words, family and probability."""
        scored = self.model.transform(with_features(rows))
        kept = [c for c in scored.columns if c not in ("features", "rawPrediction", "probability", "prediction")]
        # a generated column: later filters are not pushed into the model, which would run it once per use
        out = scored.select(*kept, F.explode(F.array(vector_to_array("probability"))).alias("_p"))
        best = F.array_max("_p")
        names = F.array(*[F.lit(f) for f in self.families])
        out = out.withColumns({"probability": best, "family": F.element_at(names, F.array_position("_p", best).cast("int"))})
        return out.drop("_p")

    def predict(self, rows: DataFrame) -> DataFrame:
        """The rows that are of a licence family: confident and confirmed."""
        found = self.probabilities(rows).where((F.col("family") != UNKNOWN) & (F.col("probability") >= self.threshold))
        return _shared(found, self.templates).where(F.col("shared") >= MIN_SHARED).drop("words")


def fit_licenses(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, notices: dict[str, list[str]] | None = None) -> LicenseModel:
    """Fit and calibrate on the notices and on at most ``sample_docs`` documents."""
    spark = docs.sparkSession
    table = notice_table(spark, notices)
    templates = staged(_templates(table), "templates")
    families = sorted([UNKNOWN, *(notices or NOTICES)])
    chosen = docs.select("doc_id", text_column(docs).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs)
    unknown = chosen.select(F.explode(paragraphs(F.col("text"))).alias("paragraph"))
    unknown = unknown.unionByName(spark.createDataFrame([(t,) for t in FILLER], "paragraph string"))
    # a paragraph that agrees with any notice is no example of unknown text
    words = unknown.withColumn("words", _terms(F.col("paragraph"))).withColumn("_runs", _runs(F.col("words"), 3))
    # the notices are a fixed list, so their runs are one
    known = sorted({run for r in templates.collect() for notice in r["templates"] for run in notice})
    clean = words.where(~F.arrays_overlap("_runs", F.array(*[F.lit(run) for run in known]))).select("paragraph")
    held = F.pmod(F.xxhash64("paragraph"), F.lit(2)) == 1
    unknown = staged(clean.withColumn("held", held).coalesce(1), "unknown")
    rows = _variants(table).unionByName(unknown.where("NOT held").select(F.lit(UNKNOWN).alias("family"), "paragraph"))
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    rows = with_features(rows).withColumn("label", label.cast("double")).select("family", "label", "features")
    counts = {r["family"]: r["n"] for r in rows.groupBy("family").agg(F.count("*").alias("n")).collect()}
    weights = F.create_map(*[x for f, n in counts.items() for x in (F.lit(f), F.lit((3.0 if f == UNKNOWN else 1.0) / n))])
    # one small partition, so the sums of the fit come in one order
    rows = rows.withColumn("weight", F.element_at(weights, F.col("family"))).coalesce(1)
    fit = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        family="multinomial", regParam=1e-3, elasticNetParam=0.0, maxIter=30, weightCol="weight", standardization=False
    ).fit(rows)
    model = LicenseModel(fit, families[: fit.numClasses], 0.0, templates)
    taken = model.probabilities(unknown.where("held").select("paragraph")).where(F.col("family") != UNKNOWN)
    highest = taken.agg(F.max("probability")).first()[0] or 0.0
    model.threshold = min(max(MIN_PROBABILITY, highest), 0.99)
    return model


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, shared): every paragraph of a licence family, with its number."""
    model = model or fit_licenses(docs)
    rows = docs.select("doc_id", F.posexplode(paragraphs(text_column(docs))).alias("position", "paragraph"))
    return model.predict(rows)


def document_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row per document: its paragraphs, those with a licence, the families by name."""
    keyed = docs.select("doc_id", text_column(docs).alias("text")).withColumn("_hash", F.xxhash64("text"))
    model = model or fit_licenses(docs)
    rows = keyed.select("doc_id", "_hash", F.posexplode(paragraphs(F.col("text"))).alias("position", "paragraph"))
    found = model.predict(rows).groupBy(F.col("doc_id").alias("_doc"), F.col("_hash").alias("_h"))
    found = found.agg(
        F.count_distinct("position").alias("n_license"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.array_join(F.array_sort(F.collect_set("position")), ",").alias("positions"),
    )
    counted = keyed.select("doc_id", "_hash", F.size(paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_h"))
    out = counted.join(found, same, "left").drop("_doc", "_h", "_hash")
    return out.withColumn("n_license", F.coalesce("n_license", F.lit(0)).cast("long"))
