"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is a verdict for a host, with all of its subdomains, and a path prefix. A url is expanded into every pair of a host
suffix and a path prefix whose shape (labels in the host, length of the path) some rule has; the expressions meet the
rules by an equi-join on the first 8 hex digits of their SHA-256, and the full digest confirms. The longest rule wins; of
equal ones that block, block. Distinct urls are judged once.

Nulls: a null url, or one without "://", has an empty host and path, and no rule. Rules with a null host or path are left
out. Repeated rows and urls keep their rows. Urls of any length: the expressions are as many as the rules have shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import checked_broadcast, own_prefix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8
DEFAULT = "allow"
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) for the urls (distinct) that some rule (verdict, host, path) fits."""
    of = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    of = of.groupBy("host", "path").agg(F.max_by("verdict", F.col("verdict") == "block").alias("verdict"))
    of = of.withColumn("rule", F.concat("host", "path")).withColumn("labels", F.size(F.split("host", r"\."))).withColumn("deep", F.length("path"))
    # One row a shape: at most the labels of a host (127) times the characters of the longest rule path.
    shapes = of.select("labels", "deep").distinct().collect()
    digest = F.sha2(F.col("rule").cast("binary"), 256)
    of = of.select(F.substring(digest, 1, SHORT).alias("short"), digest.alias("rule_digest"), "rule", "verdict")
    parts, path = F.col("parts"), F.col("path")
    pairs = [F.when((F.size(parts) >= r.labels) & (F.length(path) >= r.deep), F.concat(F.array_join(F.slice(parts, -r.labels, r.labels), "."), F.substring(path, 1, r.deep))) for r in shapes]
    if not pairs:
        return urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    every = urls.filter("url IS NOT NULL").select("url", F.split(host_of(F.col("url")), r"\.").alias("parts"), path_of(F.col("url")).alias("path"))
    every = every.select("url", F.explode(F.array_compact(F.array(*pairs))).alias("expression")).withColumn("digest", F.sha2(F.col("expression").cast("binary"), 256))
    met = every.join(checked_broadcast(of), F.substring("digest", 1, SHORT) == F.col("short")).filter("digest = rule_digest")
    return met.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")).select("url", "best.rule", "best.verdict")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("verdict", "host", "path"), r, strict=True))) for r in RULES))))


def judged(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced."""
    rules = rules if rules is not None else default_rules(pages.sparkSession)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    p = own_prefix(pages)
    found = matches(pages.select("url").distinct(), rules).select(F.col("url").alias(p + "url"), F.col("rule").alias(p + "rule"), F.col("verdict").alias(p + "verdict"))
    # Nulls meet nothing, and other keys spread them.
    key = F.coalesce(F.col("url"), F.concat(F.lit("\0"), F.xxhash64(*own).cast("string")))
    joined = pages.select(*own).join(found, key == F.col(p + "url"), "left")
    return joined.select(*own, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col(p + "rule").alias("rule"), F.coalesce(p + "verdict", F.lit(default)).alias("verdict"))
