"""Filters, clean-up, scalar functions, token profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayspark.functions import columns as X
from assayspark.operators import filters, fingerprints, quantiles
from assayspark.plans.prepare import clean_activity
from assayspark.sources.tables import load_table
from catalog.registry import query, r6, rounded

# events with gaps: a NULL group, NaN values, infinite values, text that is no number
GAPS = """SELECT event_id, user_id, nullif(event_type, 'view') AS grp,
  CASE WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS val,
  CASE WHEN event_id % 17 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS val_inf,
  CASE WHEN event_id % 13 = 0 THEN 'abc' ELSE CAST(event_id AS VARCHAR) || '.5' END AS txt
FROM events"""


def gaps(spark, sf):
    e = load_table(spark, sf, "events")
    return e.select(
        "event_id",
        "user_id",
        F.nullif("event_type", F.lit("view")).alias("grp"),
        F.expr("CASE WHEN event_id % 13 = 0 THEN double('NaN') ELSE value END").alias("val"),
        F.expr("CASE WHEN event_id % 17 = 0 THEN double('Infinity') ELSE value END").alias("val_inf"),
        F.expr("CASE WHEN event_id % 13 = 0 THEN 'abc' ELSE concat(event_id, '.5') END").alias("txt"),
    )


@query("drop_nulls_any", f"SELECT event_id, grp FROM ({GAPS}) WHERE grp IS NOT NULL AND NOT isnan(val)")
def _(spark, sf):
    return filters.drop_nulls(gaps(spark, sf)).select("event_id", "grp")


@query("drop_nulls_column", f"SELECT event_id, grp FROM ({GAPS}) WHERE grp IS NOT NULL")
def _(spark, sf):
    return filters.drop_nulls(gaps(spark, sf), "grp").select("event_id", "grp")


@query(
    "split_by_cutoff",
    f"""SELECT event_id, val, CASE WHEN val <= 100 THEN 'positive' ELSE 'negative' END AS side
FROM ({GAPS}) WHERE NOT isnan(val)""",
)
def _(spark, sf):
    pos, neg = filters.split_by_cutoff(gaps(spark, sf).select("event_id", "val"), "val", 100.0)
    return filters.union_labelled({"positive": pos, "negative": neg}, "side")


@query("keep_groups", f"SELECT event_id, grp FROM ({GAPS}) WHERE grp IN ('click', 'error')")
def _(spark, sf):
    return filters.keep_groups(gaps(spark, sf).select("event_id", "grp"), "grp", ["click", "error"])


@query("drop_groups", f"SELECT event_id, grp FROM ({GAPS}) WHERE grp IS NULL OR grp NOT IN ('click', 'error')")
def _(spark, sf):
    return filters.drop_groups(gaps(spark, sf).select("event_id", "grp"), "grp", ["click", "error"])


@query(
    "label_activity",
    f"""SELECT event_id, CASE WHEN NOT isnan(val) AND val < 50 THEN 'active' ELSE 'inactive' END AS label
FROM ({GAPS})""",
)
def _(spark, sf):
    return filters.label_activity(gaps(spark, sf), "val", 50).select("event_id", "label")


@query(
    "impute_median",
    f"""WITH g AS ({GAPS}), f AS (SELECT *, CASE WHEN isfinite(val_inf) THEN val_inf END AS v FROM g)
SELECT event_id, round(coalesce(v, (SELECT median(v) FROM f)), 6) AS val_inf FROM f""",
)
def _(spark, sf):
    return rounded(quantiles.impute_median(gaps(spark, sf), "val_inf").select("event_id", "val_inf"))


@query(
    "clean_activity",
    f"""WITH g AS (SELECT event_id, grp, val_inf FROM ({GAPS}) WHERE grp IS NOT NULL),
f AS (SELECT *, CASE WHEN isfinite(val_inf) THEN val_inf END AS v FROM g)
SELECT event_id, grp, round(coalesce(v, (SELECT median(v) FROM f)), 6) AS val_inf FROM f""",
)
def _(spark, sf):
    return rounded(clean_activity(gaps(spark, sf).select("event_id", "grp", "val_inf"), "val_inf"))


@query("to_number", f"SELECT event_id, try_cast(txt AS DOUBLE) AS num FROM ({GAPS})")
def _(spark, sf):
    return gaps(spark, sf).select("event_id", X.to_number("txt").alias("num"))


_BAND = " UNION ALL ".join(
    f"""SELECT '{c}' AS series, {c}::DOUBLE AS value FROM part,
 (SELECT quantile_cont({c}, 0.01) AS a, quantile_cont({c}, 0.99) AS b FROM part) q
WHERE {c} >= a - (b - a) * 0.10 * {f} AND {c} <= b + (b - a) * 0.10 * {f}"""
    for c, f in (("p_size", 1.0), ("p_retailprice", 1.5))
)


@query("trim_band", _BAND)
def _(spark, sf):
    return quantiles.trim_band(load_table(spark, sf, "part"), ["p_size", "p_retailprice"], {"p_retailprice": 1.5})


@query("trim_band_narrow", """
SELECT 'l_extendedprice' AS series, l_extendedprice AS value FROM lineitem,
 (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) q
WHERE l_extendedprice >= a - (b - a) * 0.05 AND l_extendedprice <= b + (b - a) * 0.05""")
def _(spark, sf):
    return quantiles.trim_band(load_table(spark, sf, "lineitem"), ["l_extendedprice"], None, 0.25, 0.75, 0.05)


@query(
    "having_min_size",
    """SELECT c_custkey, c_nationkey FROM customer
WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 60)""",
)
def _(spark, sf):
    return filters.having_min_size(load_table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 60)


@query(
    "require_columns",
    "SELECT p_partkey, p_name AS target FROM part",
)
def _(spark, sf):
    from pyspark.sql import types as T

    df = load_table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("target"))
    return filters.require_columns(df, {"target": T.StringType()})


_SALTS = "SELECT DISTINCT split_part(p_name, ' ', 1) AS salt FROM part WHERE split_part(p_name, ' ', 1) < 'h'"


@query(
    "strip_parts",
    f"""WITH s AS (SELECT list(salt) AS salts FROM ({_SALTS})),
p AS (SELECT p_partkey, replace(p_name, ' ', '.') || '.ring' AS code FROM part),
k AS (SELECT p.*, list_filter(string_split(code, '.'), lambda x: NOT list_contains(salts, x)) AS kept FROM p, s)
SELECT p_partkey, CASE WHEN len(kept) > 0 THEN array_to_string(kept, '.') ELSE code END AS code,
       CASE WHEN len(kept) > 0 THEN array_to_string(kept, '.') ELSE code END <> code AS contains_salt FROM k""",
)
def _(spark, sf):
    part = load_table(spark, sf, "part")
    first = F.element_at(F.split("p_name", " "), 1)
    salts = part.select(first.alias("salt")).where(F.col("salt") < "h")
    rows = part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".ring")).alias("code"))
    return filters.strip_parts(rows, "code", salts)


@query(
    "deduplicate",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice, p_partkey) AS rn FROM part),
t AS (SELECT p_name, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS targets FROM part GROUP BY p_name)
SELECT p_name, p_partkey, p_retailprice, targets FROM r JOIN t USING (p_name) WHERE rn = 1""",
)
def _(spark, sf):
    out = filters.deduplicate(load_table(spark, sf, "part"), "p_name", "p_retailprice", "p_partkey", "p_brand")
    return out.select("p_name", "p_partkey", "p_retailprice", F.array_join("targets", ",").alias("targets"))


@query("distinct_values", "SELECT DISTINCT p_name, p_type FROM part")
def _(spark, sf):
    return filters.distinct_values(load_table(spark, sf, "part"), "p_name", "p_type")


@query(
    "union_labelled",
    """SELECT c_custkey AS id, c_acctbal AS balance, 'customer' AS series FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""",
)
def _(spark, sf):
    c = load_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = load_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return filters.union_labelled({"customer": c, "supplier": s})


CLASSES = {"n_vowels": "[aeiou]", "n_consonants": "[b-df-hj-np-tv-z]", "n_double": "(ll|dd)"}
WEIGHTS = {"a": 1.0, "e": 2.0, "i": 3.0, "o": 4.0, "ring": 50.0}


_PROFILE = """SELECT p_name, length(p_name) AS n_chars,
  len(regexp_extract_all(p_name, '[aeiou]')) AS n_vowels,
  len(regexp_extract_all(p_name, '[b-df-hj-np-tv-z]')) AS n_consonants,
  len(regexp_extract_all(p_name, '(ll|dd)')) AS n_double,
  coalesce(list_sum(list_transform(regexp_extract_all(p_name, '(ring|a|e|i|o)'), lambda t:
    CASE t WHEN 'a' THEN 1.0 WHEN 'e' THEN 2.0 WHEN 'i' THEN 3.0 WHEN 'o' THEN 4.0 ELSE 50.0 END)), 0)::DOUBLE AS mass
FROM (SELECT DISTINCT p_name FROM part)"""


@query("token_profile", _PROFILE + " WHERE regexp_matches(p_name, 'r')")
def _(spark, sf):
    return fingerprints.token_profile(load_table(spark, sf, "part"), "p_name", CLASSES, WEIGHTS, valid="r")


@query(
    "token_profile_null",
    f"""SELECT p_name, CASE WHEN regexp_matches(p_name, 'r') THEN n_vowels END AS n_vowels,
CASE WHEN regexp_matches(p_name, 'r') THEN mass END AS mass FROM ({_PROFILE})""",
)
def _(spark, sf):
    out = fingerprints.token_profile(load_table(spark, sf, "part"), "p_name", CLASSES, WEIGHTS, "r", "null")
    return out.select("p_name", "n_vowels", "mass")


@query(
    "attach_features",
    f"SELECT f.*, p_type FROM ({_PROFILE}) f LEFT JOIN (SELECT DISTINCT p_name, p_type FROM part) USING (p_name)",
)
def _(spark, sf):
    part = load_table(spark, sf, "part")
    features = fingerprints.token_profile(part, "p_name", CLASSES, WEIGHTS)
    return fingerprints.attach_features(features, part, "p_name", ["p_type"])


@query("describe_rows", f"SELECT p_partkey, n_vowels, mass FROM part JOIN ({_PROFILE}) USING (p_name)")
def _(spark, sf):
    rows = load_table(spark, sf, "part").select("p_partkey", "p_name")
    return fingerprints.describe_rows(rows, "p_name", CLASSES, WEIGHTS).select("p_partkey", "n_vowels", "mass")


@query(
    "scalar_functions",
    """SELECT page_id, string_split(url, '/')[-1] AS last_part, lower(replace(replace(url, ' ', '_'), '/', '_')) AS slug,
  upper(substr(url, 1, 1)) || lower(substr(url, 2)) AS capitalised,
  regexp_extract('x/metrics_' || page_id || '_m.json', 'metrics_(.*?)\\.json', 1) AS run,
  round(1 / (1 + exp(-(page_id - 20) / 10.0)), 6) AS sigmoid,
  CASE WHEN 1 / (1 + exp(-(page_id - 20) / 10.0)) > 0.5 THEN 1 ELSE 0 END AS predicted
FROM pages""",
)
def _(spark, sf):
    x = (F.col("page_id") - 20) / 10.0
    return load_table(spark, sf, "pages").select(
        "page_id",
        X.last_part("url").alias("last_part"),
        X.slug("url").alias("slug"),
        X.capitalise("url").alias("capitalised"),
        X.run_name(F.concat(F.lit("x/metrics_"), F.col("page_id"), F.lit("_m.json"))).alias("run"),
        r6(X.sigmoid(x)).alias("sigmoid"),
        X.predicted(X.sigmoid(x)).alias("predicted"),
    )


@query(
    "array_functions",
    """WITH e AS (SELECT vec_id, list_transform(embedding::FLOAT[], lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, list_position(v, list_max(v)) - 1 AS argmax,
  round(list_sum(list_transform(v, lambda x: x + CASE WHEN list_min(v) < 0 THEN abs(list_min(v)) ELSE 0 END)), 6) AS shifted_sum
FROM e""",
)
def _(spark, sf):
    v = F.col("embedding").cast("array<double>")
    shifted = F.aggregate(X.shift_non_negative(v), F.lit(0.0), lambda a, x: a + x)
    return load_table(spark, sf, "embeddings").select(
        "vec_id", X.argmax_index(v).alias("argmax"), r6(shifted).alias("shifted_sum")
    )


@query("with_constant", "SELECT event_id, value, 'nM' AS unit FROM events")
def _(spark, sf):
    return filters.with_constant(load_table(spark, sf, "events").select("event_id", "value"), "unit", "nM")


@query("with_computed", "SELECT p_partkey, length(p_name)::INT AS n_chars, upper(p_name) AS upper_name FROM part")
def _(spark, sf):
    rows = load_table(spark, sf, "part").select("p_partkey", "p_name")
    return filters.with_computed(rows, {"n_chars": F.length("p_name"), "upper_name": F.upper("p_name")}).drop("p_name")


@query("zip_to_map", "SELECT s_suppkey, s_name AS by_name, s_nationkey::VARCHAR AS by_nation FROM supplier")
def _(spark, sf):
    rows = load_table(spark, sf, "supplier")
    pairs = X.zip_to_map(F.array(F.lit("name"), F.lit("nation")), F.array("s_name", F.col("s_nationkey").cast("string")))
    found = rows.select("s_suppkey", pairs.alias("m"))
    return found.select("s_suppkey", F.col("m")["name"].alias("by_name"), F.col("m")["nation"].alias("by_nation"))
