"""URL filters: host-suffix and path-prefix expressions, joined with rules on hash prefixes.

A URL is expanded into the expressions that some rule could equal: its last k host labels with the
first n characters of its path, for each (k, n) that occurs among the rules, a table joined on k. Each expression's SHA-256
is joined with the rules' on its first `prefix_bytes` bytes alone; among these candidates the full digest then confirms, and
the longest rule wins. Only DataFrame functions run on this path.

Nulls, URLs without `://` and empty URLs have an empty host and path and get the default verdict; a row without an id is judged like others. URLs of any length are read whole.
Repeated rows give repeated results, a table without rows gives none, other columns are kept, but for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the rules of op3.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules up to this many are broadcast (under 200 bytes each); more are joined by shuffle.
MAX_BROADCAST_RULES = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a DataFrame (verdict, host, path, rule)."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("verdict", "host", "path", "rule")])
    return spark.range(1).select(F.inline(F.array(*rows))).withColumn("rule", F.concat("host", "path"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", prefix_bytes: int = 4, default: str = "allow") -> DataFrame:
    """pages' columns with host, path, rule and verdict. Of rules of equal length the one with the longer host wins, then the smaller."""
    host, path = host_and_path(F.col(f"`{url}`"))
    pages = pages.withColumns({"__host": host, "__path": path})
    labels = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "rule")
    shapes = rules.select(labels(F.col("r_host")).alias("k"), F.length("r_path").alias("n")).distinct()
    n_rules, deepest = rules.agg(F.count(F.lit(1)), F.max(labels(F.col("r_host")))).first()
    if not n_rules:
        return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("__host", "__path", "host", "path", "rule", "verdict")], F.col("__host").alias("host"), F.col("__path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    small = F.broadcast if n_rules <= MAX_BROADCAST_RULES else lambda df: df  # there are no more shapes than rules
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\u0000"), p), 256)
    rules = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("r_prefix", F.substring("r_digest", 1, 2 * prefix_bytes))
    urls = pages.select("__host", "__path").distinct()
    suffixes = urls.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(labels(F.col("__host")), F.lit(deepest)))))
    expressions = suffixes.join(small(shapes), "k").filter(F.length("__path") >= F.col("n"))
    expressions = expressions.select("__host", "__path", digest(F.expr("substring_index(__host, '.', -k)"), F.substring("__path", F.lit(1), F.col("n"))).alias("digest")).withColumn("prefix", F.substring("digest", 1, 2 * prefix_bytes))
    candidates = expressions.join(small(rules), F.col("prefix") == F.col("r_prefix"))
    found = candidates.filter(F.col("digest") == F.col("r_digest"))
    best = found.groupBy(F.col("__host").alias("m_host"), F.col("__path").alias("m_path")).agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "verdict")).alias("m")
    )
    joined = pages.join(best, (F.col("__host") == F.col("m_host")) & (F.col("__path") == F.col("m_path")), "left")
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("__host", "__path", "host", "path", "rule", "verdict")]
    return joined.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)
), r(verdict, r_host, r_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), b AS (
  SELECT host, path, arg_max(struct_pack(rule := r_host || r_path, verdict := verdict), length(r_host) + length(r_path)) AS m
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""
