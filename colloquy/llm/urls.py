"""URL filters: host suffixes and path prefixes, found by short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Bytes of the digest that the join takes.
PREFIX = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// to /, ?, # or the end, A-Z lower-cased. Path: from there to ?, # or the end.

    A null url or one without :// has neither: both are empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(rule_verdict, rule, rule_len, digest, short); equal rules count once, block before allow."""
    least: dict[str, str] = {}
    for verdict, host, path in rules:
        least[host + "\t" + path] = max(verdict, least.get(host + "\t" + path, ""))
    rows = [(verdict, *k.split("\t")) for k, verdict in sorted(least.items())]
    made = spark.createDataFrame(rows, "rule_verdict string, rule_host string, rule_path string")
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    return made.select("rule_verdict", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_path").alias("rule_len"), digest.alias("rule_digest"), F.left(digest, F.lit(2 * PREFIX)).alias("short"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict (the rule's, else ``otherwise``).

    Of the rules that fit, the longest (host and path together) wins; of equally long ones, the one with the longer
    path, then block. Each distinct host and path is judged once and what was found is written, so that Spark can
    split the join on a url that fills a third of the table; expressions are made only for path lengths that some rule has. Null urls have an empty host and path.
    Columns of pages named like the results are replaced.
    """
    spark = pages.sparkSession
    mine = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("url"))
    mine = mine.withColumn("host", host).withColumn("path", path)
    lengths = sorted({len(p) for _, _, p in rules})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in lengths]), lambda x: x.isNotNull())
    seen = mine.select("host", "path").distinct()
    made = seen.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    made = made.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)).withColumn("short", F.left("digest", F.lit(2 * PREFIX)))
    hit = made.join(rule_table(spark, rules), "short").where(F.col("digest") == F.col("rule_digest"))
    won = F.max(F.struct(F.length("rule").alias("n"), F.col("rule_len"), F.col("rule_verdict"), F.col("rule"))).alias("won")
    best = hit.groupBy("host", "path").agg(won).select("host", "path", F.col("won.rule").alias("rule"), F.col("won.rule_verdict").alias("verdict"))
    return mine.join(durable(best), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))
