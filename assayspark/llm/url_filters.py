"""URL filters: rules and URLs meet in a sort-merge range join.

A rule is a host, which also holds for its subdomains, and a path prefix.  With
the labels of the host reversed, rule and URL become keys such as ``com.example//en/1``
and a rule covers one interval of keys, those that begin with its own.
A URL gives one key per host suffix as long as some rule's host, so subdomains need no
second dimension.  Keys and rules are cut into the same ranges; in each range one sorted
sweep keeps the stack of the rules that are open, which are always nested, and its
top is the longest rule for the key.

Defined results: a null URL or one without ``://`` has empty host and path and fits
only rules with an empty host, of which there are none, so it gets the default.  Rules without host or verdict
are left out, a null path is an empty one, and of equal rules with both verdicts ``block`` holds.
If rules fit, the longest (host and path together) wins; at equal length, the one
with the longer host.  Repeated URLs each get their row; an empty table gives no rows;
further columns of the input are not used.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import tasks

#: Keys sampled for the range bounds; they balance the ranges and do not touch the result.
SAMPLED_KEYS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def _assign(bounds: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, salts = batch.column("key").to_pylist(), batch.column("salt").to_pylist()
            parts = [bisect_right(bounds, pair) for pair in zip(keys, salts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), *(batch.column(c) for c in ("key", "host", "path"))],
                names=["part", "key", "host", "path"],
            )

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, open_rules = None, []
    for batch in batches:
        found: list[list] = [[], [], [], [], [], []]
        names = ("part", "key", "kind", "host", "path", "verdict")
        for at, key, kind, host, path, verdict in zip(*(batch.column(n).to_pylist() for n in names)):
            if at != part:
                part, open_rules = at, []
            while open_rules and not key.startswith(open_rules[-1][0]):
                open_rules.pop()
            if kind == 0:
                open_rules.append((key, host, path, verdict))
            elif open_rules:
                _, rule_host, rule_path, rule_verdict = open_rules[-1]
                row = (host, path, rule_host + rule_path, rule_verdict, len(rule_host) + len(rule_path), len(rule_host))
                for column, value in zip(found, row):
                    column.append(value)
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(found, types)],
            names=["host", "path", "rule", "verdict", "total", "host_length"],
        )


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of each distinct (host, path) that a rule fits."""
    spark = urls.sparkSession
    rules = (
        rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", F.split("host", r"\."))
        .withColumn("key", _key(F.reverse("labels"), F.col("path")))
    )
    longest = rules.agg(F.max(F.size("labels"))).first()[0] or 0
    labels = F.reverse(F.split("host", r"\."))
    keys = (
        urls.select("host", "path")
        .where("host <> ''")
        .distinct()
        .withColumn("labels", labels)
        .withColumn("level", F.explode(F.expr(f"sequence(1, least(size(labels), {longest}))") if longest else F.array()))
        .select("host", "path", _key(F.slice("labels", 1, F.col("level")), F.col("path")).alias("key"))
        .withColumn("salt", F.xxhash64("host", "path"))
    )
    ranges = 4 * tasks(spark)
    sample = sorted(tuple(r) for r in keys.orderBy(F.xxhash64("salt", "key")).limit(SAMPLED_KEYS).select("key", "salt").collect())
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    bounds = sorted(set(bounds))
    dealt = keys.mapInArrow(_assign(bounds), "part int, key string, host string, path string")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a rule goes to every range that its interval meets
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                lo = bisect_right(bounds, (row["key"], -(2**63)))
                hi = bisect_right(bounds, (row["key"] + _LAST, 2**63))
                rows += [row | {"part": p} for p in range(lo, hi + 1)]
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema([("part", pa.int32()), ("key", pa.string()), ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())]),
            )

    opened = rules.select("key", "host", "path", "verdict").mapInArrow(
        spread, "part int, key string, host string, path string, verdict string"
    )
    events = opened.withColumn("kind", F.lit(0)).unionByName(
        dealt.withColumns({"verdict": F.lit(None).cast("string"), "kind": F.lit(1)})
    )
    swept = (
        events.repartition(tasks(spark), "part")
        .sortWithinPartitions("part", "key", "kind")
        .mapInArrow(_sweep, "host string, path string, rule string, verdict string, total int, host_length int")
    )
    best = F.array_max(F.collect_list(F.struct("total", "host_length", "rule", "verdict")))
    return swept.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules`` has host, path and verdict (allow or block).  The URLs meet the rules as distinct
    (host, path) pairs, so a page that is listed many times is swept once."""
    host, path = url_parts(F.col(url))
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    best = longest_rules(out, rules)
    return out.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), urls AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) AS rule,
         arg_max(v, length(rule_host) + length(rule_path)) AS v
  FROM (SELECT DISTINCT host, path FROM urls) u
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, urls.host, urls.path, rule, coalesce(v, 'allow') AS verdict
FROM urls LEFT JOIN best ON urls.host = best.host AND urls.path = best.path
"""
