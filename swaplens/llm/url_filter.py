"""URL filtering by host-suffix and path-prefix expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize
from .simhash import LOWER, UPPER

#: Rule rows up to which the rule table is broadcast; beyond, it is joined by shuffling.
BROADCAST_RULES = 500_000
#: Hexadecimal digits of a digest that the equi-join compares; the full digest confirms.
PREFIX = 8

#: (verdict, host, path) of the query's rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """One row per input row: page_id, host, path, rule (host and path, or null), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. Of the rules that
    fit, the one with the longest host and path wins; of equally long ones that with the longer
    host, then block before allow. Without a fit the verdict is ``otherwise``. A url is expanded
    only into suffixes with as many labels, and prefixes with as many characters, as some rule
    has, so a url's expressions are bounded by the rules, not by its length; urls of one host and path are
    judged once. Null urls and urls
    without ``://`` have empty host and path, which no rule fits; repeated rows stay.
    """
    ruled = rules.select(
        F.lower("verdict").alias("verdict"), F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).where("host <> ''").withColumn("digest", _digest(F.col("host"), F.col("path")))
    ruled = ruled.select(
        F.substring("digest", 1, PREFIX).alias("short"), "digest", "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length")
    )
    shape = rules.where("host <> ''").agg(  # a few numbers: how many labels and characters rules have
        F.array_sort(F.collect_set(F.size(F.split("host", "\\.")))).alias("labels"),
        F.array_sort(F.collect_set(F.length(F.coalesce("path", F.lit(""))))).alias("lengths"),
    ).first()
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract("rest", "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), rest.alias("rest"))
    base = base.select("page_id", host.alias("host"), F.regexp_extract("rest", "(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    labels = F.size(F.split("host", "\\."))
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")
    suffixes = F.transform(F.filter(ints(shape["labels"]), lambda k: k <= labels), lambda k: F.array_join(F.slice(F.split("host", "\\."), labels - k + 1, k), "."))
    prefixes = F.transform(F.filter(ints(shape["lengths"]), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    places = base.where("host <> ''").select("host", "path").distinct()
    expressions = places.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps")).select("host", "path", "h", F.explode("ps").alias("p"))
    asked = expressions.withColumn("full", _digest(F.col("h"), F.col("p"))).select("host", "path", "full", F.substring("full", 1, PREFIX).alias("short"))
    small = ruled.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    fits = asked.join(F.broadcast(ruled) if small else ruled, "short").where(F.col("full") == F.col("digest"))
    order = F.struct(-F.length("rule"), -F.col("host_length"), F.when(F.col("verdict") == "block", 0).otherwise(1), F.col("rule"), F.col("verdict"))
    won = fits.groupBy("host", "path").agg(F.min(order).alias("b")).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    # written out, so that what joins it is dealt anew: a place that very many pages share is split
    return base.join(materialize(won, "won"), ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")
    )
