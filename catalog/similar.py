"""Fingerprints, pair measures, similarity join, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayspark.functions.measures import SET_MEASURES, similarity, vector_measure
from assayspark.operators import cluster, fingerprints, pairs, simjoin
from assayspark.sources.stages import cut
from assayspark.sources.tables import load_table, spread_scan
from catalog.registry import query, r6, rounded

WIDE = 2**30
EXACT = ("hamming", "manhattan")  # multiples of 1/2048: compared without rounding


def _units(text: str, unit: str) -> tuple[str, str]:
    if unit == "word":
        return f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> '')", " "
    return f"string_split(lower({text}), '')", ""


def bits_sql(table: str, key: str, text: str, n_bits: int, k: int = 3, unit: str = "word") -> str:
    units, glue = _units(text, unit)
    return f"""SELECT {key}, list_sort(list_distinct(list_transform(sh,
    lambda s: (('0x' || substr(md5(s), 1, 8))::BIGINT % {n_bits})::INT))) AS bits
  FROM (SELECT {key}, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
    list_transform(range(1, greatest(len(w) - {k - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {k - 1}], '{glue}')) END AS sh
    FROM (SELECT {key}, {units} AS w FROM {table}))"""


def doc_bits(spark: SparkSession, sf: str, n_bits: int = 2048) -> DataFrame:
    docs = spread_scan(load_table(spark, sf, "documents").select("doc_id", "text"))
    return fingerprints.fingerprint(docs, "text", 3, n_bits).select("doc_id", "bits")


DOC_BITS = bits_sql("documents", "doc_id", "text", 2048)
DOC_BITS_WIDE = bits_sql("documents", "doc_id", "text", WIDE)


@query("fingerprint_words", f"SELECT doc_id, array_to_string(bits, ',') AS bits FROM ({DOC_BITS})")
def _(spark, sf):
    return doc_bits(spark, sf).select("doc_id", F.array_join("bits", ",").alias("bits"))


@query(
    "fingerprint_chars",
    f"SELECT p_partkey, array_to_string(bits, ',') AS bits FROM ({bits_sql('part', 'p_partkey', 'p_name', 512, 3, 'char')})",
)
def _(spark, sf):
    out = fingerprints.fingerprint(load_table(spark, sf, "part"), "p_name", 3, 512, "char")
    return out.select("p_partkey", F.array_join("bits", ",").alias("bits"))


@query(
    "set_measures",
    f"""WITH b AS ({DOC_BITS}),
p AS (SELECT x.doc_id, len(x.bits) AS a, len(y.bits) AS b, len(list_intersect(x.bits, y.bits)) AS c
      FROM b x JOIN b y ON y.doc_id = x.doc_id + 1)
SELECT doc_id, round(c / (a + b - c), 6) AS tanimoto, round(2.0 * c / (a + b), 6) AS dice,
  round(c / sqrt(a::DOUBLE * b), 6) AS cosine, ((a + b - 2 * c) / 2048.0)::DOUBLE AS hamming,
  (a + b - 2 * c)::DOUBLE AS manhattan FROM p""",
)
def _(spark, sf):
    """The five set measures on neighbouring documents."""
    bits = doc_bits(spark, sf)
    after = bits.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bits").alias("next_bits"))
    out = bits.join(after, "doc_id")
    out = out.select("doc_id", *[similarity(F.col("bits"), F.col("next_bits"), m).alias(m) for m in SET_MEASURES])
    return rounded(out, skip=EXACT)


@query(
    "vector_measures",
    """WITH e AS (SELECT vec_id, list_transform(embedding::FLOAT[], lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT x.vec_id, x.v AS a, y.v AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine,
  round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS manhattan,
  round(list_sum(list_transform(list_zip(a, b), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1.0 ELSE 0.0 END))::DOUBLE / 64, 6) AS hamming
FROM p""",
)
def _(spark, sf):
    e = load_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")

    def sign(v):
        return F.transform(v, lambda x: (x > 0).cast("double"))

    return e.join(after, "vec_id").select(
        "vec_id",
        r6(vector_measure(a, b, "cosine")).alias("cosine"),
        r6(vector_measure(a, b, "manhattan")).alias("manhattan"),
        r6(vector_measure(sign(a), sign(b), "hamming")).alias("hamming"),
    )


def _pairs_sql(block: str) -> str:
    return f"""WITH b AS ({DOC_BITS}),
p AS (SELECT doc_id, bits, len(bits) AS s, {block} AS block FROM b),
u AS (SELECT doc_id, block, unnest(bits) AS bit FROM p),
k AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS c FROM u x JOIN u y USING (block, bit) GROUP BY ALL),
m AS (SELECT x.s AS a, y.s AS b, coalesce(c, 0) AS c FROM p x JOIN p y USING (block)
      LEFT JOIN k ON k.i = x.doc_id AND k.j = y.doc_id),
v AS (SELECT least(a, b) AS size_a, greatest(a, b) AS size_b, c AS common, count(*) AS n,
  CASE WHEN a + b - c = 0 THEN 1.0 ELSE c / (a + b - c) END AS tanimoto,
  CASE WHEN a + b = 0 THEN 1.0 ELSE 2.0::DOUBLE * c / (a + b) END AS dice,
  CASE WHEN a * b > 0 THEN c / sqrt(a::DOUBLE * b) END AS cosine,
  (a + b - 2 * c) / 2048.0::DOUBLE AS hamming, (a + b - 2 * c)::DOUBLE AS manhattan FROM m GROUP BY ALL)"""


_PAIRS = _pairs_sql("(row_number() OVER (ORDER BY doc_id) - 1) // 1024")
_ALL_PAIRS = _pairs_sql("0")
_LONG = "l AS (SELECT metric, value, sum(n) AS n FROM (UNPIVOT (SELECT tanimoto, dice, cosine, hamming, manhattan, n FROM v) ON tanimoto, dice, cosine, hamming, manhattan INTO NAME metric VALUE value) GROUP BY ALL)"


def _blocks(spark, sf, block_size=1024):
    return pairs.pack_blocks(doc_bits(spark, sf), "doc_id", block_size=block_size)


@query(
    "pair_metrics",
    f"""{_PAIRS} SELECT size_a, size_b, common, sum(n)::BIGINT AS n, any_value(tanimoto) AS tanimoto,
  any_value(dice) AS dice, any_value(cosine) AS cosine, any_value(hamming) AS hamming,
  any_value(manhattan) AS manhattan FROM v GROUP BY ALL""",
)
def _(spark, sf):
    out = pairs.pair_metrics(pairs.pair_counts(_blocks(spark, sf)))
    return out


@query(
    "pair_histograms",
    f"""{_ALL_PAIRS}, {_LONG}, r AS (SELECT metric, min(value) AS a, max(value) AS b FROM l GROUP BY metric),
h AS (SELECT metric, least(floor((value - a) / (b - a) * 50), 49)::INT AS bin, sum(n) AS n FROM l JOIN r USING (metric) GROUP BY ALL)
SELECT r.metric, g.bin, round(a + g.bin * ((b - a) / 50), 6) AS lo, round(a + (g.bin + 1) * ((b - a) / 50), 6) AS hi,
  coalesce(n, 0)::BIGINT AS n
FROM r CROSS JOIN (SELECT unnest(range(50))::INT AS bin) g LEFT JOIN h ON h.metric = r.metric AND h.bin = g.bin""",
)
def _(spark, sf):
    """All documents against all, in both orders and each with itself."""
    return rounded(pairs.pair_histograms(_blocks(spark, sf, None)))


@query(
    "pair_violins",
    f"""{_PAIRS}, {_LONG}, z AS (SELECT metric, CASE WHEN metric IN ('hamming', 'manhattan')
   THEN (value - min(value) OVER (PARTITION BY metric)) / (max(value) OVER (PARTITION BY metric) - min(value) OVER (PARTITION BY metric))
   ELSE value END AS value, n FROM l),
w AS (SELECT metric, value, sum(n) AS n FROM z GROUP BY ALL),
x AS (SELECT metric, value, sum(n) OVER (PARTITION BY metric ORDER BY value) AS upto, n, sum(n) OVER (PARTITION BY metric) AS t FROM w),
q AS (SELECT metric,
  min(value) FILTER (upto > floor(0.25 * (t - 1))) * (1 - (any_value(0.25 * (t - 1)) - floor(any_value(0.25 * (t - 1)))))
   + min(value) FILTER (upto > ceil(0.25 * (t - 1))) * (any_value(0.25 * (t - 1)) - floor(any_value(0.25 * (t - 1)))) AS q1,
  min(value) FILTER (upto > floor(0.5 * (t - 1))) * (1 - (any_value(0.5 * (t - 1)) - floor(any_value(0.5 * (t - 1)))))
   + min(value) FILTER (upto > ceil(0.5 * (t - 1))) * (any_value(0.5 * (t - 1)) - floor(any_value(0.5 * (t - 1)))) AS median,
  min(value) FILTER (upto > floor(0.75 * (t - 1))) * (1 - (any_value(0.75 * (t - 1)) - floor(any_value(0.75 * (t - 1)))))
   + min(value) FILTER (upto > ceil(0.75 * (t - 1))) * (any_value(0.75 * (t - 1)) - floor(any_value(0.75 * (t - 1)))) AS q3
  FROM x GROUP BY metric),
r AS (SELECT metric, min(value) AS a, max(value) AS b, sum(n) AS t FROM w GROUP BY metric),
h AS (SELECT metric, least(floor((value - a) / (b - a) * 30), 29)::INT AS bin, sum(n) AS n FROM w JOIN r USING (metric) GROUP BY ALL)
SELECT r.metric, g.bin, round(a + g.bin * ((b - a) / 30), 6) AS lo, round(a + (g.bin + 1) * ((b - a) / 30), 6) AS hi,
  coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (t * ((b - a) / 30)), 6) AS density,
  round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3
FROM r JOIN q USING (metric) CROSS JOIN (SELECT unnest(range(30))::INT AS bin) g
LEFT JOIN h ON h.metric = r.metric AND h.bin = g.bin""",
)
def _(spark, sf):
    return rounded(pairs.pair_violins(_blocks(spark, sf)))


def _sim_sql(bits: str) -> str:
    return f"""b AS ({bits}),
s AS (SELECT min(doc_id) AS doc_id, bits, len(bits) AS n FROM b GROUP BY bits),
u AS (SELECT doc_id, n, unnest(bits) AS bit FROM s),
k AS (SELECT x.doc_id AS id_a, y.doc_id AS id_b, x.n AS na, y.n AS nb, count(*) AS c
      FROM u x JOIN u y ON x.bit = y.bit AND x.doc_id < y.doc_id GROUP BY ALL),
sim AS (SELECT id_a, id_b, c / (na + nb - c) AS similarity FROM k WHERE c / (na + nb - c) >= 0.8)"""


@query("similarity_join", f"WITH {_sim_sql(DOC_BITS)} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM sim")
def _(spark, sf):
    return rounded(simjoin.similarity_join(cut(doc_bits(spark, sf)), "doc_id"))


@query(
    "similarity_join_wide",
    f"WITH {_sim_sql(DOC_BITS_WIDE)} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM sim",
)
def _(spark, sf):
    """A bit space wide enough to keep long texts apart."""
    return rounded(simjoin.similarity_join(cut(doc_bits(spark, sf, WIDE)), "doc_id"))


@query(
    "copy_groups",
    f"""WITH b AS ({DOC_BITS_WIDE})
SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY bits) AS rep, count(*) OVER (PARTITION BY bits) AS copies FROM b""",
)
def _(spark, sf):
    return simjoin.copy_groups(cut(doc_bits(spark, sf, WIDE)), "doc_id")


def _cluster_sql(bits: str) -> str:
    """The sequential rule as a recursive walk over the distinct sets."""
    return f"""WITH RECURSIVE {_sim_sql(bits)},
nodes AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r,
  coalesce((SELECT list(id_a) FROM sim WHERE id_b = doc_id), []::BIGINT[]) AS prev FROM s),
walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS leaders
  UNION ALL SELECT n.r, CASE WHEN list_has_any(leaders, prev) THEN leaders ELSE list_append(leaders, doc_id) END
  FROM walk JOIN nodes n ON n.r = walk.r + 1),
lead AS (SELECT unnest(leaders) AS leader_id FROM (SELECT leaders FROM walk ORDER BY r DESC LIMIT 1)),
numbered AS (SELECT leader_id, row_number() OVER (ORDER BY leader_id) - 1 AS cluster_id FROM lead),
sets AS (SELECT s.doc_id, s.bits, CASE WHEN s.doc_id IN (SELECT leader_id FROM lead) THEN s.doc_id
  ELSE (SELECT min(id_a) FROM sim WHERE id_b = s.doc_id AND id_a IN (SELECT leader_id FROM lead)) END AS leader_id FROM s),
clustered AS (SELECT b.doc_id, leader_id, cluster_id FROM b JOIN sets ON b.bits = sets.bits JOIN numbered USING (leader_id))"""


_CLUSTER, _CLUSTER_WIDE = _cluster_sql(DOC_BITS), _cluster_sql(DOC_BITS_WIDE)


def _clustered(spark, sf, n_bits=WIDE, **more):
    return cluster.leader_cluster(doc_bits(spark, sf, n_bits), "doc_id", **more)


@query("leader_cluster", f"{_CLUSTER} SELECT * FROM clustered")
def _(spark, sf):
    return _clustered(spark, sf, 2048)


@query("leader_cluster_wide", f"{_CLUSTER_WIDE} SELECT * FROM clustered")
def _(spark, sf):
    return _clustered(spark, sf)


@query("leader_cluster_chunks", f"{_CLUSTER_WIDE} SELECT * FROM clustered")
def _(spark, sf):
    """In chunks, as where postings are long."""
    return _clustered(spark, sf, first_chunk=50, growth=8, one_chunk_matches=0)


@query("cluster_report", f"{_CLUSTER_WIDE} SELECT cluster_id, leader_id, count(*)::BIGINT AS size FROM clustered GROUP BY ALL")
def _(spark, sf):
    return cluster.cluster_report(_clustered(spark, sf))


@query(
    "cluster_size_histogram",
    f"""{_CLUSTER_WIDE}, z AS (SELECT count(*) AS size FROM clustered GROUP BY cluster_id HAVING count(*) >= 2)
SELECT least(size, greatest((SELECT max(size) FROM z) - 1, 2))::BIGINT AS size, count(*)::BIGINT AS n FROM z GROUP BY 1""",
)
def _(spark, sf):
    return cluster.cluster_size_histogram(_clustered(spark, sf), 2)


_MEMBERS = f"""{_CLUSTER_WIDE},
members AS (SELECT d.doc_id, source, n_chars, cluster_id FROM documents d JOIN clustered USING (doc_id)
  WHERE cluster_id IN (SELECT cluster_id FROM clustered GROUP BY 1 HAVING count(*) >= 3))"""


def _members(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    clustered = cut(_clustered(spark, sf).select("doc_id", "cluster_id"))
    return cluster.cluster_members(docs, clustered, "doc_id", 3)


@query("cluster_members", f"{_MEMBERS} SELECT * FROM members")
def _(spark, sf):
    return _members(spark, sf)


_HITS = f"""{_MEMBERS} SELECT cluster_id, doc_id, source, n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n_chars, doc_id) AS rn FROM members) WHERE rn = 1"""


@query("cluster_hits", _HITS)
def _(spark, sf):
    return cluster.cluster_hits(_members(spark, sf), "cluster_id", "n_chars", "doc_id", 3)


@query("filter_hits", f"SELECT * FROM ({_HITS}) WHERE source NOT IN ('src1', 'src2', 'src3')")
def _(spark, sf):
    hits = cluster.cluster_hits(_members(spark, sf), "cluster_id", "n_chars", "doc_id", 3)
    return cluster.filter_hits(hits, "source", ["src1", "src2", "src3"])


@query("project2d")
def _(spark, sf):
    out = cluster.project2d(load_table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return rounded(out.select("vec_id", "x", "y"))
