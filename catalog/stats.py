"""Counts, balance, quantiles, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayspark.operators import balance, filters, quantiles
from assayspark.sources.tables import load_table
from catalog.clean import GAPS, gaps
from catalog.registry import query, rounded

CUTOFFS = {"50": 50.0, "150": 150.0}


def labelled(spark, sf):
    return filters.label_activity(gaps(spark, sf), "val", 50)


LABELLED = f"SELECT *, CASE WHEN NOT isnan(val) AND val < 50 THEN 'active' ELSE 'inactive' END AS label FROM ({GAPS})"
_COUNTS = f"WITH c AS (SELECT label, count(*) AS n FROM ({LABELLED}) GROUP BY label)"
_RATIO = "max(n) FILTER (label = 'active') / max(n) FILTER (label = 'inactive')"
_ENTROPY = "-sum(n / t * log2(n / t))"
_CV = "stddev_pop(n) / avg(n)"


@query("value_counts", f"SELECT grp, count(*)::BIGINT AS n FROM ({GAPS}) WHERE grp IS NOT NULL GROUP BY grp")
def _(spark, sf):
    return balance.value_counts(gaps(spark, sf), "grp")


@query(
    "crosstab",
    f"""SELECT grp, count(*) FILTER (label = 'active') AS active, count(*) FILTER (label = 'inactive') AS inactive
FROM ({LABELLED}) WHERE grp IS NOT NULL GROUP BY grp""",
)
def _(spark, sf):
    return balance.crosstab(labelled(spark, sf), "grp", "label")


@query("class_ratio", f"{_COUNTS} SELECT round({_RATIO}, 6) AS class_ratio FROM c")
def _(spark, sf):
    return rounded(balance.class_ratio(labelled(spark, sf)))


@query("class_entropy", f"{_COUNTS} SELECT round({_ENTROPY}, 6) AS class_entropy FROM c, (SELECT sum(n) AS t FROM c)")
def _(spark, sf):
    return rounded(balance.class_entropy(labelled(spark, sf)))


@query("class_cv", f"{_COUNTS} SELECT round({_CV}, 6) AS class_cv FROM c")
def _(spark, sf):
    return rounded(balance.class_cv(labelled(spark, sf)))


@query(
    "balance_metrics",
    f"""{_COUNTS}
SELECT 'Class Ratio' AS "Metric", round({_RATIO}, 6) AS "Value" FROM c
UNION ALL SELECT 'Entropy of Distribution', round({_ENTROPY}, 6) FROM c, (SELECT sum(n) AS t FROM c)
UNION ALL SELECT 'Coefficient of Variation', round({_CV}, 6) FROM c""",
)
def _(spark, sf):
    return rounded(balance.balance_metrics(labelled(spark, sf)))


_CUT = f"""WITH g AS (SELECT * FROM ({GAPS}) WHERE grp IS NULL OR grp <> 'error'),
k AS (SELECT * FROM (VALUES ('50', 50.0), ('150', 150.0)) t(threshold, cut)),
l AS (SELECT threshold, grp, val, CASE WHEN NOT isnan(val) AND val < cut THEN 'active' ELSE 'inactive' END AS label FROM g, k)"""


def _kept(spark, sf):
    return filters.drop_groups(gaps(spark, sf), "grp", ["error"])


@query("label_counts", f"{_CUT} SELECT threshold, grp, label, count(*)::BIGINT AS n FROM l GROUP BY ALL")
def _(spark, sf):
    return balance.label_counts(_kept(spark, sf), "val", "grp", CUTOFFS)


@query(
    "balance_report",
    f"""{_CUT}, c AS (SELECT threshold, label, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT threshold, {_RATIO} AS r, {_CV} AS v, -sum(n / t * log2(n / t)) AS e
      FROM c JOIN (SELECT threshold, sum(n) AS t FROM c GROUP BY 1) USING (threshold) GROUP BY threshold)
SELECT threshold, 'Class Ratio' AS "Metric", round(r, 6) AS "Value" FROM s
UNION ALL SELECT threshold, 'Entropy of Distribution', round(e, 6) FROM s
UNION ALL SELECT threshold, 'Coefficient of Variation', round(v, 6) FROM s""",
)
def _(spark, sf):
    return rounded(balance.balance_report(_kept(spark, sf), "val", "grp", CUTOFFS))


@query("count_by", "SELECT event_type, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return balance.count_by(load_table(spark, sf, "events"), ["event_type", "user_id"])


@query(
    "exact_quantiles",
    """SELECT event_type, prob, round(CASE prob WHEN 0.01 THEN a WHEN 0.25 THEN b WHEN 0.5 THEN c ELSE d END, 6) AS value
FROM (SELECT event_type, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.5) AS c,
      quantile_cont(value, 0.99) AS d FROM events GROUP BY event_type),
     (SELECT unnest([0.01, 0.25, 0.5, 0.99])::DOUBLE AS prob)""",
)
def _(spark, sf):
    out = quantiles.exact_quantiles(load_table(spark, sf, "events"), "value", [0.01, 0.25, 0.5, 0.99], ["event_type"])
    return rounded(out)


_RANKED = """SELECT prob, round(CASE prob WHEN 0.1 THEN a WHEN 0.5 THEN b ELSE c END, 6) AS value
FROM (SELECT quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.5) AS b,
      quantile_cont(l_extendedprice, 0.999) AS c FROM lineitem), (SELECT unnest([0.1, 0.5, 0.999])::DOUBLE AS prob)"""


@query("exact_quantiles_ranked", _RANKED)
def _(spark, sf):
    """The way taken by large groups: distinct values ranked in two levels."""
    rows = load_table(spark, sf, "lineitem")
    out = quantiles.exact_quantiles(
        rows, "l_extendedprice", [0.1, 0.5, 0.999], direct_rows=1000, rows_per_bucket=10_000
    )
    return rounded(out)


def _hist_sql(source: str, value: str, k: int) -> str:
    return f"""WITH v AS (SELECT {value} AS v FROM {source} WHERE {value} IS NOT NULL),
r AS (SELECT min(v) AS a, max(v) AS b FROM v),
c AS (SELECT least(floor((v - a) / (b - a) * {k}), {k - 1})::INT AS bin, count(*) AS n FROM v, r GROUP BY 1)
SELECT bin, round(a + bin * (b - a) / {k}, 6) AS lo, round(a + (bin + 1) * (b - a) / {k}, 6) AS hi,
       coalesce(n, 0)::BIGINT AS n
FROM (SELECT unnest(range({k}))::INT AS bin) LEFT JOIN c USING (bin), r"""


@query("histogram", _hist_sql("lineitem", "l_extendedprice", 50))
def _(spark, sf):
    return rounded(quantiles.histogram(load_table(spark, sf, "lineitem"), "l_extendedprice", 50))


@query("histogram_20", _hist_sql("customer", "c_acctbal", 20))
def _(spark, sf):
    return rounded(quantiles.histogram(load_table(spark, sf, "customer"), "c_acctbal", 20))


_SERIES = """SELECT 'customer' AS series, c_acctbal AS value FROM customer
UNION ALL SELECT 'supplier', s_acctbal FROM supplier"""


def _series(spark, sf):
    c = load_table(spark, sf, "customer").select(F.col("c_acctbal").alias("value"))
    s = load_table(spark, sf, "supplier").select(F.col("s_acctbal").alias("value"))
    return filters.union_labelled({"customer": c, "supplier": s})


def _density_sql(extra: str = "", joined: str = "") -> str:
    return f"""WITH v AS ({_SERIES}),
r AS (SELECT series, min(value) AS a, max(value) AS b, count(*) AS t,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1),
c AS (SELECT series, least(floor((value - a) / (b - a) * 30), 29)::INT AS bin, count(*) AS n FROM v JOIN r USING (series) GROUP BY ALL)
SELECT r.series, k.bin, round(a + k.bin * (b - a) / 30, 6) AS lo, round(a + (k.bin + 1) * (b - a) / 30, 6) AS hi,
  coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (t * (b - a) / 30), 8) AS density {extra}
FROM r CROSS JOIN (SELECT unnest(range(30))::INT AS bin) k LEFT JOIN c ON c.series = r.series AND c.bin = k.bin"""


def _shown(df):
    return rounded(df.withColumn("density", F.round("density", 8).cast("decimal(20,8)"))).withColumn(
        "density", F.col("density").cast("double")
    )


@query("density_histogram", _density_sql())
def _(spark, sf):
    return _shown(quantiles.density_histogram(_series(spark, sf)))


@query("violin_summary", _density_sql(", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3"))
def _(spark, sf):
    return _shown(quantiles.violin_summary(_series(spark, sf), "value", ["series"]))


@query(
    "box_summary",
    f"""{_CUT}, v AS (SELECT threshold, label, val FROM l WHERE NOT isnan(val)),
q AS (SELECT threshold, label, quantile_cont(val, 0.25) AS q1, quantile_cont(val, 0.5) AS m, quantile_cont(val, 0.75) AS q3
      FROM v GROUP BY ALL)
SELECT threshold, label, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3,
  round(min(val) FILTER (val BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_lo,
  round(max(val) FILTER (val BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  count(*) FILTER (NOT val BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
FROM v JOIN q USING (threshold, label) GROUP BY threshold, label, q1, m, q3""",
)
def _(spark, sf):
    rows = _kept(spark, sf)
    both = filters.union_labelled({t: filters.label_activity(rows, "val", c) for t, c in CUTOFFS.items()}, "threshold")
    return rounded(quantiles.box_summary(both, "val", ["threshold", "label"]))


@query(
    "minmax_rescale",
    "SELECT event_id, round((value - a) / (b - a), 6) AS scaled FROM events, (SELECT min(value) AS a, max(value) AS b FROM events)",
)
def _(spark, sf):
    out = quantiles.minmax_rescale(load_table(spark, sf, "events"), "value", "scaled")
    return rounded(out.select("event_id", "scaled"))
