"""The compound jobs from end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayspark.operators import filters
from assayspark.plans import compounds
from assayspark.sources.tables import load_table, spread_scan
from catalog.clean import gaps
from catalog.registry import query, rounded
from catalog.similar import _HITS, WIDE
from catalog.stats import _CUT, _CV, _RATIO, CUTOFFS

_CODES = "SELECT p_partkey, replace(p_name, ' ', '.') AS code, p_retailprice FROM part"
_CLEAN = f"""WITH s AS (SELECT list(DISTINCT split_part(p_name, ' ', 1)) AS salts FROM part WHERE split_part(p_name, ' ', 1) < 'h'),
c AS (SELECT c.*, list_filter(string_split(code, '.'), lambda x: NOT list_contains(salts, x)) AS kept FROM ({_CODES}) c, s),
f AS (SELECT p_partkey, code AS original, array_to_string(kept, '.') AS code, p_retailprice FROM c)"""


@query(
    "clean_compounds",
    f"""{_CLEAN}
SELECT p_partkey, code, p_retailprice, original <> code AS contains_salt, 'with_salt' AS part FROM f
UNION ALL SELECT p_partkey, code, p_retailprice, original <> code, 'salt_free' FROM f
UNION ALL SELECT p_partkey, code, p_retailprice, original <> code, 'positive' FROM f WHERE p_retailprice <= 950
UNION ALL SELECT p_partkey, code, p_retailprice, original <> code, 'negative' FROM f WHERE p_retailprice > 950""",
)
def _(spark, sf):
    part = load_table(spark, sf, "part")
    first = F.element_at(F.split("p_name", " "), 1)
    salts = part.select(first.alias("salt")).where(F.col("salt") < "h")
    rows = part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("code"), "p_retailprice")
    return filters.union_labelled(compounds.clean_compounds(rows, salts, "code", "p_retailprice", 950.0), "part")


@query("cluster_compounds", _HITS)
def _(spark, sf):
    docs = spread_scan(load_table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars"))
    out = compounds.cluster_compounds(docs, "doc_id", "text", "n_chars", n_bits=WIDE, unit="word")
    return out["hits"].select("cluster_id", "doc_id", "source", "n_chars")


@query(
    "check_balance",
    f"""{_CUT}, c AS (SELECT threshold, label, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT threshold, {_RATIO} AS r, {_CV} AS v, -sum(n / t * log2(n / t)) AS e
      FROM c JOIN (SELECT threshold, sum(n) AS t FROM c GROUP BY 1) USING (threshold) GROUP BY threshold)
SELECT threshold, 'Class Ratio' AS "Metric", round(r, 6) AS "Value" FROM s
UNION ALL SELECT threshold, 'Entropy of Distribution', round(e, 6) FROM s
UNION ALL SELECT threshold, 'Coefficient of Variation', round(v, 6) FROM s""",
)
def _(spark, sf):
    return rounded(compounds.check_balance(gaps(spark, sf), "val", "grp", drop=["error"], cutoffs=CUTOFFS)["metrics"])


@query(
    "check_balance_overall",
    f"{_CUT} SELECT threshold, label, count(*)::BIGINT AS n FROM l GROUP BY ALL",
)
def _(spark, sf):
    return compounds.check_balance(gaps(spark, sf), "val", "grp", drop=["error"], cutoffs=CUTOFFS)["overall"]
