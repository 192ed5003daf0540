"""Quality rules: robust multivariate outliers on text statistics.

A document becomes a vector of transformed statistics.  For each language and source a centre and a
covariance are estimated from the half of the documents that lie closest (minimum
covariance determinant, reached by concentration steps: take the closest share, estimate anew).
A document whose squared Mahalanobis distance is beyond a cutoff is rejected.

Everything is built from DataFrame expressions: the statistics are computed within the
row, the estimates are grouped aggregates of a few sums, so no group is gathered in a task, and the
distance is a forward substitution with the Cholesky factor, written as columns.

Defined results: null and empty texts have no words and all counts 0; they fail the base rules.  Null language or
source is a group of its own.  A group with fewer than ``MIN_GROUP`` documents uses the
estimate of its language, or of all documents.  A statistic that hardly varies has a floor under its
variance (``FLOORS``), so equal documents do not make everything else an outlier.  Repeated rows count each.
Only finite vectors exist: every denominator is at least 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayspark.operators.spread import checked_broadcast

from .common import BLANKS, staged, text_column

SYMBOLS = "#*$%&|<>"
#: Names of the vector's parts.
VECTOR = ("v_length", "v_word", "v_symbols", "v_lines", "v_repeats")
#: Standard deviations that an estimate does not go below.
FLOORS = (0.5, 0.5, 0.15, 0.15, 0.15)
#: Share of the documents that an estimate is made from.
SHARE = 0.75
#: Concentration steps.
STEPS = 3
#: Documents that a group needs for its own estimate.
MIN_GROUP = 200
#: Squared distance beyond which a document is rejected.  Lengths and rates of clean text have tails
#: heavier than a normal distribution's, so this is far beyond its quantile at 0.999 (20.5).
CUTOFF = 60.0
#: Groups whose estimates are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 20_000


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    value = text_column(df, text)
    words = F.filter(F.split(value, f"[{BLANKS}]+"), lambda w: w != "")
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))
    out = df.withColumns({"_words": words, "_lines": lines})
    at = F.sequence(F.lit(0), F.size("_words") - 5)
    word = F.col("_words")
    windows = F.when(
        F.size("_words") > 5, F.transform(at, lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(5)]))
    )
    out = out.withColumn("_windows", windows)
    ranked = F.array_sort(
        F.transform(F.col("_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    out = out.withColumn("_ranked", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ranked))
    hit = F.col("_ranked")
    last = F.size(hit) - 1
    starts = F.filter(
        F.transform(
            hit,
            lambda x, i: F.when(
                ((i > 0) & (F.get(hit, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(hit, i + 1)["h"] == x["h"])),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    out = out.withColumn("_starts", F.array_sort(starts))
    covered = F.aggregate(
        F.col("_starts"),
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")),
    )["n"]
    symbols = F.length(value) - F.length(F.translate(value, SYMBOLS, ""))
    letters = F.length(F.translate(value, " \t\n\x0b\f\r", ""))
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": letters.cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_words", "_lines", "_windows", "_ranked", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector(df: DataFrame) -> DataFrame:
    """Transformed statistics; rates are scaled by the root of the length, since short texts scatter more."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    weight = F.sqrt(F.least(words, F.lit(400.0)) / 400.0)
    return df.withColumns(
        {
            "v_length": F.log(words),
            "v_word": F.col("word_chars") / words * weight + (1 - weight) * 5.0,
            "v_symbols": F.sqrt(F.col("n_symbols") / words) * 4,
            "v_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) * 2,
            "v_repeats": F.sqrt(F.col("n_repeat_words") / words) * 2,
        }
    )


def _estimates(rows: DataFrame) -> DataFrame:
    """Centre and Cholesky factor per group, from sums."""
    p = len(VECTOR)
    sums = [F.avg(v).alias(f"m{i}") for i, v in enumerate(VECTOR)]
    sums += [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy("level", "g_lang", "g_source").agg(*sums)
    for j in range(p):
        squares = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - squares, F.lit(FLOORS[j] ** 2))))
        for i in range(j + 1, p):
            cross = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - cross) / F.col(f"l{j}{j}"))
    return out.drop(*[f"c{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance(df: DataFrame) -> DataFrame:
    p = len(VECTOR)
    for i, name in enumerate(VECTOR):
        known = sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z{i}", (F.col(name) - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    df = df.withColumn("distance", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0)))
    drop = [f"z{i}" for i in range(p)] + [f"m{i}" for i in range(p)]
    return df.drop(*drop, *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _first_estimates(rows: DataFrame) -> DataFrame:
    """Medians and robust scales: the start of the concentration steps."""
    p = len(VECTOR)
    cuts = [F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, v in enumerate(VECTOR)]
    out = rows.groupBy("level", "g_lang", "g_source").agg(*cuts)
    columns = {f"m{i}": F.get(f"q{i}", F.lit(1)) for i in range(p)}
    columns |= {
        f"l{i}{i}": F.greatest((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, F.lit(FLOORS[i]))
        for i in range(p)
    }
    columns |= {f"l{i}{j}": F.lit(0.0) for i in range(p) for j in range(i)}
    return out.withColumns(columns).drop(*[f"q{i}" for i in range(p)])


def _levels(df: DataFrame) -> DataFrame:
    """Each row once for its language and source, once for its language, once for all."""
    lang, source = F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))
    rows = F.array(
        F.struct(F.lit("own").alias("level"), lang.alias("g_lang"), source.alias("g_source")),
        F.struct(F.lit("lang").alias("level"), lang.alias("g_lang"), F.lit("").alias("g_source")),
        F.struct(F.lit("all").alias("level"), F.lit("").alias("g_lang"), F.lit("").alias("g_source")),
    )
    return df.withColumn("_g", F.explode(rows)).select("*", "_g.*").drop("_g")


def robust_estimates(statistics: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """One estimate per level and group, with the number of its documents (n)."""
    keys = ["level", "g_lang", "g_source"]
    rows = _levels(_vector(statistics).select("lang", "source", *VECTOR)).select(*keys, *VECTOR)
    sizes = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    found = _first_estimates(rows)
    for step in range(steps):
        far = _distance(rows.join(checked_broadcast(staged(found, "estimate"), BROADCAST_GROUPS), keys))
        limit = far.groupBy(*keys).agg(F.percentile_approx("distance", share, 1000).alias("limit"))
        limit = checked_broadcast(staged(limit, "limit"), BROADCAST_GROUPS)
        found = _estimates(far.join(limit, keys).where(F.col("distance") <= F.col("limit")))
    return staged(found.join(sizes, keys), "estimate")


def _scored(stats: DataFrame, found: DataFrame, cutoff: float) -> DataFrame:
    """Distance to the finest estimate that has enough documents, and the verdict."""
    p = len(VECTOR)
    parts = ["n", *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)]]
    keyed = _vector(stats).withColumns(
        {"g_lang": F.coalesce("lang", F.lit("\0")), "g_source": F.coalesce("source", F.lit("\0"))}
    )
    estimate = F.struct(*parts)
    own = found.where(f"level = 'own' AND n >= {MIN_GROUP}").select("g_lang", "g_source", estimate.alias("e_own"))
    by_lang = found.where(f"level = 'lang' AND n >= {MIN_GROUP}").select("g_lang", estimate.alias("e_lang"))
    # a single row of numbers
    overall = found.where("level = 'all'").select(*parts).first()
    overall = F.struct(*[F.lit(overall[x] if overall else None).cast("double").alias(x) for x in parts])
    keyed = keyed.join(checked_broadcast(own, BROADCAST_GROUPS), ["g_lang", "g_source"], "left")
    keyed = keyed.join(checked_broadcast(by_lang, BROADCAST_GROUPS), ["g_lang"], "left")
    keyed = keyed.withColumn("_e", F.coalesce("e_own", "e_lang", overall)).select("*", "_e.*")
    keyed = keyed.drop("_e", "e_own", "e_lang", "g_lang", "g_source", "n")
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return _distance(keyed).drop(*VECTOR).withColumn("kept", kept)


def _plain(docs: DataFrame) -> DataFrame:
    """The columns that are read, whatever else the table holds."""
    have = docs.columns
    names = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("lang", "source", "text")]
    return docs.select(*([F.col("doc_id")] if "doc_id" in have else []), *names)


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, lang, source) with the statistics, ``base_failed``, ``distance`` and ``kept``."""
    stats = text_statistics(_plain(docs)).withColumn("base_failed", base_failed()).drop("text")
    stats = staged(stats, "statistics")
    return _scored(stats, robust_estimates(stats.where("NOT base_failed")), cutoff)


def quality_filter(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.

    The estimates come from a first pass; a second one scores each row where its text is, so no
    text is shuffled."""
    stats = text_statistics(_plain(docs)).withColumn("base_failed", base_failed()).drop("text")
    found = robust_estimates(staged(stats, "statistics").where("NOT base_failed"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = text_statistics(_plain(docs.withColumn("doc_id", row))).withColumn("base_failed", base_failed())
    # a generated column: the filter stays above the scoring, which it would repeat once per use if pushed into it
    scored = _scored(again, found, cutoff).select("doc_id", F.explode(F.array("kept")).alias("_kept"))
    return scored.where("_kept").select("doc_id.*")
