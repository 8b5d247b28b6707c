"""URL filters as a sort-merge range join, with DataFrame functions only.

A rule (host, path) fits a URL if the host is the rule's or a subdomain of it and the path starts with the rule's path. The host with
its labels reversed and each closed by a dot is the canonical key (`www.example.com` -> `com.example.www.`), so a rule's hosts
are one interval of keys that begin with its prefix, and intervals are nested or disjoint. Rules and URLs are sorted together by key; the
sweep keeps one stack slot per nesting depth (number of labels) with the last rule opened there. A slot is active while the key
still begins with its prefix. The longest rule among the active slots whose path fits wins.

The URLs are salted over tasks by page id and the rules are copied to each salt, so no host, however frequent, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, partitions_for, table

#: The rules of the registered query: action, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a dot; an empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """Judges every URL: page_id, host, path, rule (host + path of the winner, else null), verdict (its action, else default).

    pages: page_id, url; other columns are ignored, repeated rows and null ids are kept as they are. rules: action, host, path. The
    longest rule text wins; of equally long ones the longer host, then the smaller text, then `block` before `allow`, so repeated
    rules do no harm. Rules with a null field or an empty host fit nothing. An empty rules table gives every URL the default verdict.
    salts: tasks over which the URLs are dealt, by default 8 for each shuffle partition or 64 MB of pages, if these are more; each salt gets a copy of the rules.
    """
    spark = pages.sparkSession
    salts = salts or 8 * partitions_for(pages, 64 << 20)
    host, path = split_url(F.col("url"))
    keyed = only(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    rule = F.struct(F.length("rule").alias("n"), F.length("host").alias("h"), F.col("rule").alias("rule"), F.col("path").alias("path"), F.col("action").alias("action"))
    nodes = (
        only(rules, "action", "host", "path").dropna().where("host <> ''").withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        .withColumn("rule", F.concat("host", "path")).withColumn("key", host_key(F.col("host")))
        .groupBy("key").agg(F.array_sort(F.collect_set(rule)).alias("rules")).withColumn("depth", F.size(F.split("key", r"\.", -1)) - 1)
    )
    depths = [r[0] for r in nodes.select("depth").distinct().collect()]  # as many as hosts have labels
    opened = nodes.select("key", "rules", "depth", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    sweep = Window.partitionBy("salt").orderBy("key", "is_page").rowsBetween(Window.unboundedPreceding, 0)
    node = F.struct(F.col("key").alias("prefix"), "rules")
    rows = opened.select("salt", "key", "depth", node.alias("node"), F.lit(0).alias("is_page")).unionByName(
        keyed.select(F.pmod(F.xxhash64("page_id", "key", "path"), F.lit(salts)).cast("int").alias("salt"), "key", F.lit(1).alias("is_page"), "page_id", "host", "path"), allowMissingColumns=True
    )
    slots = [F.last(F.when(F.col("depth") == d, F.col("node")), ignorenulls=True).over(sweep).alias(f"slot{d}") for d in sorted(depths)]
    swept = rows.select("*", *slots).where("is_page = 1")
    active = [F.when(F.startswith("key", F.col(f"slot{d}.prefix")), F.col(f"slot{d}.rules")) for d in sorted(depths)]
    if not active:
        return keyed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    stack = F.filter(F.flatten(F.filter(F.array(*active), lambda x: x.isNotNull())), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_sort(stack, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["h"] != b["h"], b["h"] - a["h"]).when(a["rule"] != b["rule"], F.when(a["rule"] < b["rule"], -1).otherwise(1)).when(a["action"] == b["action"], 0).when(a["action"] > b["action"], -1).otherwise(1))
    won = swept.select("page_id", "host", "path", F.get(best, F.lit(0)).alias("won"))
    return won.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of RULES on every page. Nulls, ties, repeats and empty tables as in filter_urls()."""
    return filter_urls(table(spark, sf_dir, "pages"), rule_frame(spark, RULES))


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM p
), s AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h
), j AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
