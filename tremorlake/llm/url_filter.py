"""URL filters: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

A url becomes the expressions host-suffix + path-prefix that a rule could be (suffixes at the dots, prefixes
at the lengths that rules' paths have).  Expressions and rules meet in an equi-join on the first 32 bits of
their SHA-256, for which the rules that share those bits are put in one list; then the full digest and the
text confirm, and the longest rule wins.  Distinct (host, path) pairs are judged once and joined back to the
rows; rows without a host take no part in that.

Defined cases: a null url or one without "://" has empty host and path and takes no rule; no rules: the
default verdict for all; repeated rules: one; a rule listed with both actions blocks; repeated page rows all
stay; other columns of pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import ascii_lower, table

#: (host, path, action) of the contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
RULE_SCHEMA = "rule_host string, rule_path string, action string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    rest = F.expr("substring(url, locate('://', url) + 3)")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(found, ascii_lower(host)).otherwise(""), F.when(found, path).otherwise("")


def short(full: str) -> Column:
    return F.substring(F.col(full), 1, 8)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    # at most as many lengths as a path has characters, however many rules there are
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect() if r[0] is not None)
    named = rows.where("host <> ''")
    urls = named.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    told = urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    told = told.select("host", "path", F.explode(F.transform("prefixes", lambda p: F.concat("suffix", p))).alias("expression"))
    told = told.withColumn("full", F.sha2("expression", 256)).withColumn("short", short("full"))
    listed = rules.groupBy(F.concat("rule_host", "rule_path").alias("rule")).agg(F.max(F.col("action")).alias("action")).where("rule is not null")
    listed = listed.withColumn("rule_full", F.sha2("rule", 256)).withColumn("short", short("rule_full"))
    # as many rules in a list as share 32 bits of their digests
    listed = listed.groupBy("short").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "action", "rule_full")).alias("candidates"))
    sure = lambda r: (r["rule_full"] == F.col("full")) & (r["rule"] == F.col("expression"))
    met = told.join(listed, "short").select("host", "path", F.explode(F.filter("candidates", sure)).alias("r"))
    best = met.groupBy("host", "path").agg(F.max(F.struct("r.n", "r.rule", "r.action")).alias("best"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.xxhash64("host", "path").alias("j"), "best")
    # the derived key makes both sides plain exchanges, whose hot keys AQE can split
    same = (F.col("i") == F.col("j")) & (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))
    out = named.withColumn("i", F.xxhash64("host", "path")).join(best, same, "left")
    out = out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    none = rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return out.unionByName(none)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as literals of the plan."""
    names = ("rule_host", "rule_path", "action")
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_table(spark, RULES))


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
rules(h, r, a) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT DISTINCT q.host, q.path, h || r AS rule, a FROM q JOIN rules ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, r)),
b AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(a, length(rule)) AS a FROM m GROUP BY ALL)
SELECT q.page_id, q.host, q.path, b.rule, coalesce(b.a, 'allow') AS verdict FROM q LEFT JOIN b USING (host, path)
"""
