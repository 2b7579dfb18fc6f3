"""Queries on classification and aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import aggregate, classify
from ..sources import tables

read = tables.read


def scored_match_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 3 == 0, "ssh443").when(F.col("s_suppkey") % 3 == 1, "scp").otherwise("https").alias("form"), F.when(F.col("s_suppkey") % 5 == 0, "origin").otherwise(F.concat(F.lit("r"), F.col("s_suppkey").cast("string"))).alias("name"), (F.col("s_suppkey") % 2).alias("mine"))
    points = classify.remote_points(F.col("mine").cast("string"), F.lit("x"), F.col("form"), F.col("name"), F.lit("1"), F.lit("X"))
    best = classify.scored_best(s, ["nation"], points, F.desc(F.col("name") == "origin"), F.col("s_suppkey"))
    return best.select("nation", "s_suppkey", "score", F.array_join("reasons", " ").alias("reasons"))


def failure_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    said = (
        F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 4 == 0, "ERROR: Repository not found.").when(F.col("user_id") % 4 == 1, "git@x: Permission denied (publickey).").when(F.col("user_id") % 4 == 2, "Updates were rejected because fetch first").otherwise("odd"))
        .when(F.col("event_type") == "click", "Could not resolve host: x")
        .otherwise("")
    )
    status = F.when(F.col("event_type") == "view", F.lit(400) + F.col("event_id") % 120)
    found = classify.push_failure(said, status.cast("int"))
    return e.select("event_id", found.alias("f")).select("event_id", "f.code", "f.confidence")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    conclusion = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderpriority").startswith("1"), "failure").otherwise("neutral")
    out = classify.run_summary(o.withColumn("run", F.col("o_orderkey").cast("string")), ["o_custkey"], status, conclusion, "run")
    return out.select("o_custkey", "total", "pending", "failing", "ok", "conclusion", F.array_join("failing_runs", ",").alias("failing_runs"))


def failure_cause_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase", "signup"))
    causes = [("401", (F.col("event_type") == "error") & (F.col("value") > 90)), ("403", (F.col("event_type") == "purchase") & (F.col("value") > 95)), ("5xx", F.col("event_type") == "error")]
    return classify.any_of_priority(e, ["user_id"], causes)


def ownership_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    owner = F.when(F.col("c_custkey") % 6 == 0, F.lit("")).when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("c_mktsegment"))
    joined = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
    return joined.select("c_custkey", classify.ownership(F.col("n_name"), owner).alias("ownership"))


def nested_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line totals are summed by order first, so that the join meets one row for each order."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("qty"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    joined = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.round(F.coalesce(F.sum("qty"), F.lit(0.0)), 2).alias("qty"), F.count_if(F.col("returned") > 0).alias("with_returns"))


def size_partition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.size_split(read(spark, sf_dir, "documents"), F.col("n_chars"), 2000)


def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.occurrences(read(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("html")), "page_id", "html", "href", r"https?://|href=.?/")


def distinct_across_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.distinct_across(read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey", "l_suppkey"])


def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("reason", F.concat("event_type", F.lit(" ("), F.col("user_id").cast("string"), F.lit(")")))
    return aggregate.histogram(e, F.regexp_replace("reason", r" \(.*$", ""), "reason")


def highest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("tag", F.concat(F.lit("release v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 17).cast("string"), F.lit("."), (F.col("p_partkey") % 101).cast("string")))
    return aggregate.highest_version(p, strings.version(F.col("tag")), ["p_brand"]).select("p_brand", "highest.major", "highest.minor", "highest.patch")


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00"))
    return aggregate.staleness(read(spark, sf_dir, "events"), ["user_id"], "ts", now, "2 DAYS")


def bottom_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 6).alias("mean"))
    return aggregate.bottom(means, 3, "mean", "l_suppkey")


def top_segment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*/([^/?#]*)", 1)
    groups = read(spark, sf_dir, "pages").groupBy(path.alias("segment")).agg(F.count(F.lit(1)).alias("pages"))
    return aggregate.known_first(groups, "segment", ["en", "de"])


def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter(F.col("value") >= 50)
    return aggregate.histogram(e, F.col("event_type"), "rule").orderBy(F.desc("n"), "rule").limit(20)


def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count(F.lit(1)).alias("all"))
    joined = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", aggregate.percent(F.coalesce("done", F.lit(0)), F.col("all")).alias("percent"))


QUERIES = {f.__name__: f for f in (scored_match_top1, failure_classifier, run_summary, failure_cause_priority, ownership_class, nested_totals, size_partition_totals, occurrence_counts, distinct_across_columns, reason_histogram, highest_version, staleness, bottom_three, top_segment_groups, findings_by_rule, progress_percent)}

ORACLES = {
    "scored_match_top1": """
WITH s AS (SELECT s_suppkey, s_nationkey AS nation, CASE s_suppkey % 3 WHEN 0 THEN 'ssh443' WHEN 1 THEN 'scp' ELSE 'https' END AS form, CASE WHEN s_suppkey % 5 = 0 THEN 'origin' ELSE 'r' || s_suppkey::VARCHAR END AS name, s_suppkey % 2 = 1 AS mine FROM supplier),
p AS (SELECT *, (CASE WHEN mine THEN 100 ELSE -100 END + CASE form WHEN 'ssh443' THEN 30 WHEN 'scp' THEN -20 ELSE 5 END + CASE WHEN name = 'origin' THEN 10 ELSE 0 END)::INT AS score,
  concat_ws(' ', CASE WHEN mine THEN 'belongs(+100)' ELSE 'foreign(-100)' END, CASE form WHEN 'ssh443' THEN 'ssh443(+30)' WHEN 'scp' THEN 'scp(-20)' ELSE 'form(+5)' END, CASE WHEN name = 'origin' THEN 'origin(+10)' END) AS reasons FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, (name = 'origin') DESC, s_suppkey) AS n FROM p)
SELECT nation, s_suppkey, score, reasons FROM r WHERE n = 1
""",
    "failure_classifier": """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN CASE user_id % 4 WHEN 0 THEN 'repo-not-found-or-no-access' WHEN 1 THEN 'auth-denied' WHEN 2 THEN 'diverged' END WHEN event_type = 'click' THEN 'dns' END AS t,
  CASE WHEN event_type = 'view' THEN 400 + event_id % 120 END AS s FROM events),
c AS (SELECT event_id, coalesce(t, CASE WHEN s = 401 THEN 'auth-denied' WHEN s = 403 THEN 'protected' WHEN s = 404 THEN 'repo-not-found-or-no-access' WHEN s = 429 THEN 'rate-limited' WHEN s >= 500 THEN 'server-error' END, 'unknown') AS code FROM e)
SELECT event_id, code, CASE WHEN code IN ('unknown', 'repo-not-found-or-no-access') THEN 'low' ELSE 'high' END AS confidence FROM c
""",
    "run_summary": """
WITH r AS (SELECT o_custkey, o_orderkey::VARCHAR AS run, o_orderstatus = 'P' AS p, o_orderstatus NOT IN ('P', 'O') AND o_orderpriority LIKE '1%' AS f FROM orders)
SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE p) AS pending, count(*) FILTER (WHERE f) AS failing, count(*) FILTER (WHERE NOT p AND NOT f) AS ok,
  CASE WHEN bool_or(p) THEN 'pending' WHEN bool_or(f) THEN 'failure' ELSE 'success' END AS conclusion, coalesce(string_agg(run, ',' ORDER BY run) FILTER (WHERE f), '') AS failing_runs FROM r GROUP BY 1
""",
    "failure_cause_priority": """
SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 90) THEN '401' WHEN bool_or(event_type = 'purchase' AND value > 95) THEN '403' WHEN bool_or(event_type = 'error') THEN '5xx' ELSE 'unknown' END AS cause
FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1
""",
    "ownership_class": """
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'unknown' WHEN c_custkey % 2 = 0 OR lower(c_mktsegment) = lower(n_name) THEN 'own' ELSE 'foreign' END AS ownership FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    "nested_totals": """
WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS qty, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS orders, coalesce(sum(lines), 0)::BIGINT AS lines, round(coalesce(sum(qty), 0), 2) AS qty, count(*) FILTER (WHERE returned > 0) AS with_returns FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1
""",
    "size_partition_totals": """
SELECT count(*) FILTER (WHERE n_chars <= 2000) AS kept, coalesce(sum(n_chars) FILTER (WHERE n_chars <= 2000), 0)::BIGINT AS kept_size, count(*) FILTER (WHERE n_chars > 2000) AS skipped, coalesce(sum(n_chars) FILTER (WHERE n_chars > 2000), 0)::BIGINT AS skipped_size, count(*) FILTER (WHERE n_chars <= 2000) = 0 AS empty FROM documents
""",
    "occurrence_counts": r"""
WITH l AS (SELECT page_id, unnest(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10))) AS line FROM pages)
SELECT page_id, count(*) AS hits, count(*) FILTER (WHERE regexp_matches(line, 'https?://|href=.?/')) AS url_hits FROM l WHERE contains(line, 'href') GROUP BY 1
""",
    "distinct_across_columns": """
WITH u AS (SELECT l_orderkey, l_partkey::VARCHAR AS v FROM lineitem UNION SELECT l_orderkey, l_suppkey::VARCHAR FROM lineitem)
SELECT l_orderkey, count(*) AS n_distinct, min(v) AS smallest FROM u GROUP BY 1
""",
    "reason_histogram": "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1",
    "highest_version": """
WITH r AS (SELECT p_brand, p_size AS major, (p_partkey % 17)::INT AS minor, (p_partkey % 101)::INT AS patch, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey % 17 DESC, p_partkey % 101 DESC) AS n FROM part)
SELECT p_brand, major, minor, patch FROM r WHERE n = 1
""",
    "staleness": "SELECT user_id, max(ts) AS newest, count(*) FILTER (WHERE ts IS NULL) AS unknown, coalesce(max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 2 DAY, true) AS stale FROM events GROUP BY 1",
    "bottom_three": "SELECT l_suppkey, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1 ORDER BY mean, l_suppkey LIMIT 3",
    "top_segment_groups": """
WITH g AS (SELECT regexp_extract(url, '^[^:]*://[^/?#]*/([^/?#]*)', 1) AS segment, count(*) AS pages FROM pages GROUP BY 1)
SELECT segment, pages, (CASE segment WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END)::INT AS rank FROM g
""",
    "findings_by_rule": "SELECT event_type AS rule, count(*) AS n FROM events WHERE value >= 50 GROUP BY 1 ORDER BY n DESC, rule LIMIT 20",
    "progress_percent": """
WITH l AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS d, count(*) AS a FROM lineitem GROUP BY 1)
SELECT o_orderkey, (CASE WHEN coalesce(a, 0) > 0 THEN least(99, floor(d * 100 / a)) ELSE 0 END)::INT AS percent FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""",
}
