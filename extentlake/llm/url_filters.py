"""Allow and block rules on URLs by a sort-merge range join on reversed-host keys (DataFrame functions only).

A host ``www.example.com`` has the key ``com.example.www.``; a rule's host with all of its subdomains is then the
interval ``[key, key with the last "." replaced by "/")``, since "/" is the byte after "." and occurs in no host.
Such intervals nest or are disjoint. A sorted sweep over their end points with a stack of the open rules gives the
rules in force after every end point; the distinct hosts are merged with the end points by a range sort, and each takes
the stack of the last end point at or before it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ._common import Scratch, table

STACK = "array<struct<len:int,rule:string,path:string,verdict:string>>"

#: (verdict, host, path prefix)
PRODUCTION_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url):
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep_rules(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, list[tuple[int, str, str, str]]]]:
    """End points in byte order, each with the stack in force from there on: the open rules, longest first.

    ``rules`` is configuration held by the caller; its end points are swept once here and only then distributed.
    """
    by_host: dict[str, list[tuple[int, str, str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((len(host) + len(path), host + path, path, verdict))
    events = []
    for host in by_host:
        key = ".".join(reversed(host.split("."))) + "."
        events += [(key.encode(), 1, key, host), ((key[:-1] + "/").encode(), 0, key[:-1] + "/", host)]
    stack: list[str] = []
    after: dict[str, list[tuple[int, str, str, str]]] = {}
    for _, opens, key, host in sorted(events):
        stack.append(host) if opens else stack.pop()
        after[key] = sorted((r for h in stack for r in by_host[h]), key=lambda r: (-r[0], r[1], r[3]))
    return list(after.items())


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = PRODUCTION_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row's URL; returns id, host, path, rule, verdict.

    A rule fits its host and all subdomains when the path starts with the rule's path; the longest (host and path
    characters together; ties by rule text) wins, ``default`` holds where none fits. Null URLs and URLs without
    ``://`` have empty host and path and get ``default``. Null ids and repeated rows are kept as they are; other
    columns are not read, so their names can't clash. An empty table or rule list gives a result of the same schema.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    points = rows.where("host <> ''").select("host").distinct().select(host_key(F.col("host")).alias("key"), "host", F.lit(None).cast(STACK).alias("stack"))
    # A literal that the JVM parses: no Python rows on the way.
    swept = json.dumps([{"key": key, "stack": [dict(zip(("len", "rule", "path", "verdict"), r)) for r in stack]} for key, stack in sweep_rules(rules)])
    ends = spark.range(1).select(F.inline(F.from_json(F.lit(swept), f"array<struct<key:string,stack:{STACK}>>"))).select("key", F.lit(None).cast("string").alias("host"), "stack")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    is_point = F.col("host").isNotNull()
    # The ranges are written, so that the sweep inside them and what they hand on see the same cuts.
    ranges = points.unionByName(ends).repartitionByRange(n, "key").withColumn("pid", F.spark_partition_id())
    ranges = Scratch(spark, "urls").save(ranges, "ranges")
    order = W.partitionBy("pid").orderBy("key", is_point)
    inside = ranges.withColumn("open", F.last("stack", ignorenulls=True).over(order)).where(is_point).select("host", "pid", "open")
    # One row per range: the stack that is still in force when the range begins.
    handed = ranges.groupBy("pid").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("last"))
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    handed = handed.select("pid", F.last("last", ignorenulls=True).over(before).alias("carried"))
    active = inside.join(handed, "pid").select("host", F.coalesce("open", "carried").alias("active"))
    hit = F.get(F.filter("active", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    judged = rows.join(active, "host", "left").withColumn("hit", hit)
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, h, pre, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
m AS (SELECT page_id, host, path, (SELECT arg_max({'rule': rule, 'verdict': verdict}, length(rule)) FROM r
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) AS hit FROM p)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM m
"""
