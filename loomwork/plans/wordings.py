"""Queries over texts, names and scopes that are made of the tables' own values, broken and odd ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wording
from ..operators import classify, scoped
from ..sources import tables

read = tables.read


def _cat(*cs):
    return F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in cs])


def scrubbed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parts that say who asked for them, without that."""
    p = read(spark, sf_dir, "part")
    form = F.col("p_size") % 8
    label = (
        F.when(form == 0, _cat("v", F.col("p_name"), "（用户许可", F.col("p_type"), "）；；done"))
        .when(form == 1, _cat("按用户确认，", F.col("p_name"), "(同意 x)；"))
        .when(form == 2, _cat(F.col("p_name"), "——bump ", F.col("p_brand"), "（用户要看）——"))
        .when(form == 3, _cat(" ", F.col("p_type"), "（用户", F.col("p_brand"), "）()"))
        .when(form == 4, F.lit(None))
        .otherwise(F.col("p_name"))
    )
    return p.select("p_partkey", wording.scrubbed(label).alias("label"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner and name that the first two segments of pages' paths make, where they do."""
    p = read(spark, sf_dir, "pages")
    given = F.concat(F.lit(" "), F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#]*)", 1))
    return p.select("page_id", wording.slug(given).alias("s")).select("page_id", "s.ok", "s.owner", "s.name")


def own_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What texts say to a trigger of one's own, and to the one that stands in for a broken pattern."""
    c = read(spark, sf_dir, "conversations")
    good, broken = wording.usable_trigger(r"  (?i)\bthe[a-z]+ed\b "), wording.usable_trigger("(the", default="und")
    block = r"(?i)\bnicht\b|nda"
    return c.select("conv_id", "turn", classify.completion(F.col("text"), good, block).alias("own"), classify.completion(F.col("text"), broken, block).alias("fallback"))


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on the failures of events, by the status that their value stands for."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase"))
    status = F.floor(F.col("value") * 6).cast("int")
    failure = classify.push_failure(F.concat("props", F.lit(" "), F.col("event_type")), status)
    steps = F.when(F.col("user_id") % 3 != 0, F.array(F.col("event_type"), F.lit("x"))).when(F.col("user_id") % 2 == 0, F.array().cast("array<string>"))
    rows = e.select("event_id", failure.alias("f"), F.col("props").alias("meaning"), steps.alias("steps"))
    return rows.select("event_id", wording.diagnosis(F.col("f.code"), F.col("f.confidence"), F.col("meaning"), F.col("steps")).alias("line"))


def workspace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of paths in files that are in order, broken, or of another form."""
    c = read(spark, sf_dir, "customer")
    text = (
        F.when(F.col("c_acctbal") < 0, _cat('{"paths": ["', F.col("c_name")))
        .when(F.col("c_mktsegment").startswith("M"), _cat('{"paths": "', F.col("c_name"), '"}'))
        .when(F.col("c_mktsegment").startswith("B"), _cat('[1, "', F.col("c_name"), '"]'))
        .otherwise(_cat('{"paths": [" /w/', F.col("c_name"), ' ", "", "  ", null, "', F.lower("c_mktsegment"), '"], "updatedAt": "', F.col("c_nationkey").cast("string"), '"}'))
    )
    return c.select("c_custkey", wording.listed_paths(text).alias("p")).select("c_custkey", F.array_join("p.paths", "|").alias("paths"), "p.updated_at", "p.updated_by")


def scoped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of an order's lines, as files by status and part, its run looks at: those in the folders that the order names, or all."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    changed = li.select(F.col("l_orderkey").alias("run"), F.concat_ws("/", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("path"))
    named = F.when(F.col("o_orderstatus") == "F", "./R/").when(F.col("o_orderstatus") == "O", "N/O").when(F.col("o_orderpriority").startswith("1"), "A").otherwise("")
    scopes = o.select(F.col("o_orderkey").alias("run"), named.alias("path"))
    out = scoped.scoped_run(o.select(F.col("o_orderkey").alias("run")), scopes, changed)
    return out.groupBy("run", "scoped").agg(F.count("path").alias("files"), F.min("path").alias("first"))


QUERIES = {f.__name__: f for f in (scrubbed_labels, slugs, own_triggers, diagnoses, workspace_paths, scoped_runs)}

ORACLES = {
    "scrubbed_labels": """
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'v' || p_name || '；done' WHEN 1 THEN p_name WHEN 2 THEN p_name || '——bump ' || p_brand WHEN 3 THEN p_type WHEN 4 THEN '' ELSE p_name END AS label FROM part
""",
    "slugs": r"""
WITH p AS (SELECT page_id, trim(regexp_extract(url, '^[^:]*://([^/?#]*)', 1) || regexp_extract(url, '^[^:]*://[^/?#]*([^#]*)', 1), ' ') AS s FROM pages),
q AS (SELECT *, regexp_full_match(s, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') AS ok FROM p)
SELECT page_id, ok, CASE WHEN ok THEN split_part(s, '/', 1) END AS owner, CASE WHEN ok THEN split_part(s, '/', 2) END AS name FROM q
""",
    "own_triggers": r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\bnicht\b|nda') THEN 'blocked' WHEN regexp_matches(text, '(?i)\bthe[a-z]+ed\b') THEN 'triggered' ELSE 'none' END AS own,
  CASE WHEN regexp_matches(text, '(?i)\bnicht\b|nda') THEN 'blocked' WHEN contains(text, 'und') THEN 'triggered' ELSE 'none' END AS fallback FROM conversations
""",
    "diagnoses": """
WITH e AS (SELECT *, floor(value * 6)::INT AS s FROM events WHERE event_type IN ('error', 'purchase')),
c AS (SELECT *, CASE WHEN s = 401 THEN 'auth-denied' WHEN s = 403 THEN 'protected' WHEN s = 404 THEN 'repo-not-found-or-no-access' WHEN s = 429 THEN 'rate-limited' WHEN s >= 500 THEN 'server-error' ELSE 'unknown' END AS code FROM e)
SELECT event_id, '分类 ' || code || CASE WHEN code IN ('unknown', 'repo-not-found-or-no-access') THEN '（推断，置信度低）' ELSE '（依据充分）' END || '：' || props || CASE WHEN user_id % 3 <> 0 THEN '｜下一步：' || event_type ELSE '' END AS line FROM c
""",
    "workspace_paths": """
SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment[1] IN ('M', 'B') THEN '' ELSE '/w/' || c_name || '|' || lower(c_mktsegment) END AS paths, CASE WHEN c_acctbal < 0 OR c_mktsegment[1] IN ('M', 'B') THEN '' ELSE c_nationkey::VARCHAR END AS updated_at, '' AS updated_by FROM customer
""",
    "scoped_runs": """
WITH o AS (SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'R' WHEN o_orderstatus = 'O' THEN 'N/O' WHEN o_orderpriority LIKE '1%' THEN 'A' ELSE '' END AS scope FROM orders),
l AS (SELECT DISTINCT l_orderkey AS run, l_returnflag || '/' || l_linestatus || '/' || l_partkey AS path FROM lineitem)
SELECT o.run, count(path) > 0 AS scoped, count(path) AS files, min(path) AS first FROM o LEFT JOIN l ON l.run = o.run AND scope <> '' AND starts_with(path, scope || '/') GROUP BY o.run
""",
}
