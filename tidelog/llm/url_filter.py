"""Allow and block rules for URLs, matched through hashed host-suffix and path-prefix expressions.

A URL is expanded into every expression (host suffix at a label boundary, path prefix) whose shape occurs
among the rules, the expressions meet the rules through an equi-join on a short prefix of their SHA-256, the
full digest confirms, and the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, repeated, small

#: Hexadecimal digits of a digest that the join compares; the rest confirms.
PREFIX_DIGITS = 8

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of `pages`.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule (host and path
    together) wins; of two as long the one with the longer host; of one rule given with both verdicts, block.
    Without a rule the verdict is `default`. A null URL, or one without `://`, has empty host and path. Repeated
    rows give repeated results, null ids are kept, other columns of either table are not read, an empty rule
    table decides nothing.

    The number of expressions per URL is the number of shapes (labels of the host, length of the path) among the
    rules, however long the URL is. Only one row per URL is shuffled, after partial aggregation.
    """
    known = (
        rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max(F.col("verdict") == "block").alias("blocks"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    )
    # Few by nature: label counts times path lengths that rules have.
    shapes = known.select(_labels(F.col("r_host")), F.length("r_path")).distinct().collect()
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    fits = [
        F.when(
            (_labels(F.col("host")) >= n) & (F.length("path") >= m),
            _digest(F.substring_index("host", ".", -n), F.substring("path", 1, m)),
        )
        for n, m in sorted(shapes)
    ]
    expressions = F.filter(F.array(*fits), lambda d: d.isNotNull()) if fits else F.lit(None).cast("array<string>")
    expanded = urls.select("*", F.posexplode_outer(expressions).alias("pos", "digest"))
    expanded = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    same = (F.col("e.prefix") == F.col("r.prefix")) & (F.col("e.digest") == F.col("r.r_digest"))
    met = expanded.alias("e").join(small(known).alias("r"), same, "left")
    rule = F.concat("r_host", "r_path")
    best = F.max(
        F.when(
            F.col("r_host").isNotNull(),
            F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), "blocks", rule.alias("rule")),
        )
    )
    judged = met.groupBy("page_id", "url").agg(
        F.any_value("host").alias("host"),
        F.any_value("path").alias("path"),
        best.alias("best"),
        F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("copies"),
    )
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.blocks"), "block").otherwise("allow")
    out = judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "copies")
    return repeated(out, "copies")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
    ('org', '/fr/', 'allow')) t(h, p, verdict)
)
SELECT page_id, host, path,
  (SELECT arg_max(h || r.p, length(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)) AS rule,
  coalesce((SELECT arg_max(verdict, length(h || r.p)) FROM r
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)), 'allow') AS verdict
FROM p
"""
