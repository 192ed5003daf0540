"""Leader clustering and the tables made from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from assayspark.operators.filters import drop_groups, having_min_size
from assayspark.operators.ranking import with_position
from assayspark.operators.simjoin import PackedIndex, copy_groups, join_index, join_postings, written_sets
from assayspark.operators.spread import attach_by_key
from assayspark.sources.stages import cut, release

FIRST_CHUNK = 256
GROWTH = 16
ONE_CHUNK_MATCHES = 50_000_000
MATCHES_PER_POSTING = 20


def _members(edges: DataFrame) -> DataFrame | None:
    """Nodes that are not leaders, for written edges (id_a < id_b) among undecided nodes.

    A node with no earlier neighbour left leads; its later neighbours are
    members and leave the graph.  Each round decides at least the first node of
    every component, and few rounds are needed when the order is unrelated to
    the similarity."""
    members, stage = None, None
    edges = edges.select("id_a", "id_b")
    n = edges.count()
    while n:
        degree = edges.groupBy("id_a").agg(F.count(F.lit(1)).alias("_deg"))
        later = edges.select(F.col("id_b").alias("id_a")).distinct()
        leaders = degree.join(later, "id_a", "left_anti")
        new = attach_by_key(edges, leaders, "id_a", "_deg", left_rows=n).select(F.col("id_b").alias("id"))
        new = cut(new.distinct())
        members = new if members is None else members.unionByName(new)
        for side in ("id_a", "id_b"):
            load = edges.groupBy(side).agg(F.count(F.lit(1)).alias("_load"))
            alive = load.join(new.withColumnRenamed("id", side), side, "left_anti")
            edges = attach_by_key(edges, alive, side, "_load", left_rows=n).select("id_a", "id_b")
        edges = cut(edges)
        if stage is not None:
            release(stage)
        stage = edges
        n = edges.count()
    return members


def _short_postings(postings: DataFrame, one_chunk_matches: int) -> bool:
    """True when joining all postings at once stays near their own number."""
    per_element = postings.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    sums = per_element.agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("matches")).first()
    if not sums["n"]:
        return True
    return sums["matches"] <= one_chunk_matches or (
        one_chunk_matches > 0 and sums["matches"] <= MATCHES_PER_POSTING * sums["n"]
    )


def _few_pairs(rows: DataFrame, one_chunk_matches: int) -> bool:
    """True when the pairs of all rows are no more than the matches of postings that are joined at once."""
    return rows.count() ** 2 / 2 <= one_chunk_matches


def leader_assignments(
    sets: DataFrame,
    threshold: float = 0.8,
    first_chunk: int = FIRST_CHUNK,
    growth: int = GROWTH,
    one_chunk_matches: int = ONE_CHUNK_MATCHES,
    behind: Sequence[DataFrame] = (),
) -> DataFrame:
    """(rep, leader) for the members among distinct sets; a set that is not listed leads.

    Same result as the sequential rule: in id order, each unvisited row leads
    and takes every later unvisited row with Tanimoto >= threshold.

    Where the postings are short, all ids are joined at once.  Otherwise they
    are handled in chunks of growing size.  A chunk is first freed of the
    rows near an earlier leader, so a large family of near copies disappears
    with its first member and its pairs are never formed.  The first chunk is
    small, since it alone meets such a family whole.  After a prefix of k
    rows in random order, the rows left have few neighbours among the next
    chunk (Blelloch, Fineman, Shun 2012), so each chunk joins a sparse graph.

    ``behind`` names written stages that only ``sets`` is read from; they go when the index is
    written, and each stage of the way when the next one is.
    """
    index = join_index(sets, threshold)
    release(*behind)
    rest = stage = index.prefix
    bounds, shares = [], []
    short = _few_pairs if isinstance(index, PackedIndex) else _short_postings
    if not short(rest, one_chunk_matches):
        ids = rest.select(F.col("rep").cast("double").alias("r")).distinct()
        total, reach = ids.count(), first_chunk
        while reach < total:
            shares.append(reach / total)
            reach *= growth
        if shares:
            # bounds only choose the chunk sizes; any bounds give the same clusters
            bounds = sorted(ids.approxQuantile("r", shares, max(min(0.25 * shares[0], 0.01), 1e-5)))
    out = None
    done = 0.0
    for bound, reached in zip([*bounds, None], [*shares, 1.0]):
        chunk = rest if bound is None else rest.where(F.col("rep") < F.lit(bound))
        pairs = cut(join_postings(index, chunk, chunk, share=reached - done))
        done = reached
        members = _members(pairs)
        found = []
        if members is not None:
            by_leader = pairs.groupBy("id_a").agg(F.count(F.lit(1)).alias("_deg")).join(
                members.withColumnRenamed("id", "id_a"), "id_a", "left_anti"
            )
            taken = attach_by_key(pairs, by_leader, "id_a", "_deg")
            found.append(cut(taken.groupBy(F.col("id_b").alias("rep")).agg(F.min("id_a").alias("leader"))))
        if bound is not None:
            later = rest.where(F.col("rep") >= F.lit(bound))
            leading = chunk
            if members is not None:
                leading = chunk.join(members.withColumnRenamed("id", "rep"), "rep", "left_anti")
            near = join_postings(index, leading, later, share=1.0 - reached)
            near = cut(near.groupBy(F.col("id_b").alias("rep")).agg(F.min("id_a").alias("leader")))
            found.append(near)
            rest = cut(later.join(near, "rep", "left_anti"))
            release(stage)
            stage = rest
        release(pairs)
        for part in found:
            out = part if out is None else out.unionByName(part)
    release(stage)
    if index.live is not None:
        release(index.live)
    if out is None:
        rep = sets.schema["rep"].dataType.simpleString()
        return sets.sparkSession.createDataFrame([], f"rep {rep}, leader {rep}")
    return out


def leader_cluster(
    df: DataFrame,
    id: str,
    bits: str = "bits",
    threshold: float = 0.8,
    first_chunk: int = FIRST_CHUNK,
    growth: int = GROWTH,
    one_chunk_matches: int = ONE_CHUNK_MATCHES,
) -> DataFrame:
    """(id, leader_id, cluster_id) for every row with a fingerprint.

    ``id`` is a unique number and gives the row order; ``cluster_id`` counts the
    leaders from 0 in that order.  Rows are matched by key, so rows without a
    fingerprint shift nothing.  ``df`` is read once, and its sets are written once."""
    written = cut(df.where(F.col(bits).isNotNull()).select(F.col(id).alias("id"), F.col(bits).alias("bits")))
    named, firsts, sets = written_sets(written)
    assigned = leader_assignments(sets, threshold, first_chunk, growth, one_chunk_matches, [written])
    leaders = firsts.select("rep", "copies").join(assigned, "rep", "left")
    leaders = cut(leaders.select("rep", "copies", F.coalesce("leader", "rep").alias("leader_id")))
    numbered = with_position(leaders.where(F.col("rep") == F.col("leader_id")).select("leader_id"), "leader_id", "cluster_id")
    sizes = leaders.groupBy("leader_id").agg(F.count(F.lit(1)).alias("_n"))
    labelled = attach_by_key(leaders, sizes.join(numbered, "leader_id"), "leader_id", "_n")
    rows = copy_groups(named, "id", "bits", firsts).select("id", "rep")
    out = attach_by_key(rows, labelled.select("rep", "copies", "leader_id", "cluster_id"), "rep", "copies")
    return out.select(F.col("id").alias(id), "leader_id", "cluster_id")


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def cluster_size_histogram(clustered: DataFrame, min_size: int = 3) -> DataFrame:
    """(size, n) over unit bins from ``min_size`` to the largest size.

    The last bin is closed: sizes max-1 and max share it."""
    sizes = cluster_sizes(clustered).where(F.col("size") >= min_size)
    counts = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("size").alias("m")).scalar()
    last = F.greatest(largest - 1, F.lit(min_size).cast("long"))
    return counts.groupBy(F.least(F.col("size"), last).alias("size")).agg(F.sum("n").alias("n"))


def cluster_members(df: DataFrame, clustered: DataFrame, id: str, min_size: int = 3) -> DataFrame:
    """The rows of all clusters with at least ``min_size`` rows, with their cluster."""
    return df.join(having_min_size(clustered, "cluster_id", min_size), id)


def cluster_hits(df: DataFrame, cluster: str, weight: str, id: str, min_size: int = 3) -> DataFrame:
    """Lightest row (then least id) of each cluster with at least ``min_size`` rows."""
    rest = [c for c in df.columns if c != cluster]
    # a missing weight sorts last
    order = F.struct(F.col(weight).isNull().cast("int"), F.col(weight), F.col(id))
    best = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.min_by(F.struct(*rest), order).alias("_hit"), F.count(F.lit(1)).alias("_size")
    )
    return best.where(F.col("_size") >= min_size).select(cluster, *[F.col(f"_hit.{c}").alias(c) for c in rest])


def cluster_report(clustered: DataFrame, min_size: int = 1) -> DataFrame:
    """(cluster_id, leader_id, size) per cluster."""
    return (
        clustered.groupBy("cluster_id", "leader_id")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") >= min_size)
    )


def filter_hits(hits: DataFrame, group: str, dropped: Sequence[str]) -> DataFrame:
    """Hits outside the listed groups; hits without a group stay."""
    return drop_groups(hits, group, dropped)


def project2d(df: DataFrame, vector: str, as_array: bool = True) -> DataFrame:
    """Linear projection of numeric vectors to two columns ``x`` and ``y``."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))) if as_array else df.withColumn("_v", F.col(vector))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    out = model.transform(rows).withColumn("_p", vector_to_array("_p"))
    return out.withColumn("x", F.col("_p")[0]).withColumn("y", F.col("_p")[1]).drop("_v", "_p")
