"""Judge addresses by host and path rules, found by hash prefixes of their expansions.

An address expands into its host's suffixes times its path's prefixes. Each expression's SHA-256
meets the rules' in an equi-join on a short prefix; the full digest confirms, and the longest
fitting rule decides. Only distinct (host, directory) pairs are expanded; a pair's pages get its rule in
salted parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandflow.llm.common import lower_ascii

#: Host, path and verdict of each rule.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8
#: Parts that a pair's pages are dealt to when they get their rule, so that a host with a third of all pages is no one task's.
SALTS = 32


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (lower-case A-Z, after the first `://`) and path (up to `?`, `#`); both empty without `://`."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(lower_ascii(host), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def checked_rules(rules: DataFrame) -> DataFrame:
    """Rules with their expression and digest, one a (host, path); `allow` wins over a repeated `block`.

    A rule's path must begin and end with a slash, so that directory prefixes meet every rule.
    """
    r = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    bad = r.where(~F.col("rule_path").rlike(r"(?s)^/(.*/)?$") | (F.col("rule_host") == "") | ~F.coalesce(F.col("rule_verdict").isin("allow", "block"), F.lit(False)))
    if bad.take(1):
        raise ValueError("a rule needs a host, a path that begins and ends with '/', and the verdict allow or block")
    r = r.groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict"))
    r = r.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2("rule", 256))
    return r.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per page: page_id, host, path, rule (null without one), verdict.

    A rule fits its host and subdomains where the path starts with the rule's; of several the longest
    wins, then the longer host. A null address or one without `://` has no rule. Repeated pages give
    repeated rows, an empty table none; other columns are not looked at.
    """
    rules = checked_rules(rules)
    # Deeper expressions than the deepest rule cannot meet one; two numbers come to the driver.
    labels, slashes = rules.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.length(F.regexp_replace("rule_path", "[^/]", "")))).first()
    labels, slashes = int(labels or 1), int(slashes or 1)
    p = with_host_and_path(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))).drop("url")
    directory = F.regexp_extract("path", rf"^/(?:[^/]*/){{0,{slashes - 1}}}", 0)
    suffix = F.substring_index("host", ".", -labels)
    p = p.withColumn("suffix", suffix).withColumn("directory", directory)
    keys = p.where("host <> '' and directory <> ''").select("suffix", "directory").distinct()
    names = F.split("suffix", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, -i, i), "."))
    parts = F.split("directory", "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    e = keys.withColumn("e_host", F.explode(hosts)).withColumn("e_path", F.explode(paths))
    e = e.withColumn("e_digest", F.sha2(F.concat("e_host", "e_path"), 256)).withColumn("prefix", F.substring("e_digest", 1, PREFIX_HEX))
    met = e.join(rules, "prefix").where("e_digest = digest and e_host = rule_host and e_path = rule_path")
    order = F.struct(F.length("rule"), F.length("rule_host"), "rule")
    best = met.groupBy("suffix", "directory").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int"))
    judged = p.join(best, ["suffix", "directory", "salt"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_rules(spark))


SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM a),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

QUERIES = {"op8_url_filter": (query, SQL)}
