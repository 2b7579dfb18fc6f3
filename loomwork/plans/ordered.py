"""Queries that follow an order or a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import classify, graph, windows
from ..sources import tables

read = tables.read


def last_assistant_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return windows.latest_with_text(said, "conv_id", "turn", "text")


def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.failure_runs(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error", "ts")


def last_n_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n(read(spark, sf_dir, "events"), "event_type", 200, F.desc("ts"), F.desc("event_id")).select("event_type", "event_id", "place")


def progress_stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_progress(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", "ts")


def turn_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("minute", F.date_trunc("MINUTE", "ts"))
    return windows.first_per_key(e, ["user_id", "minute"], "ts", "event_id").select("user_id", "event_id")


def _word(names: str) -> str:
    return rf"(?i)(^|[^a-zA-Z0-9_])({names})($|[^a-zA-Z0-9_])"


def completion_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", classify.completion(F.col("text"), _word("the|der|la"), _word("that|und")).alias("state"))


def commit_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halving chains as a commit graph: every part's parent is half its number; a third has a second parent."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    edges = p.select("src", F.floor(F.col("src") / 2).alias("dst")).filter("dst > 0").unionByName(p.filter(F.col("src") % 3 == 0).select("src", F.floor(F.col("src") / 3).alias("dst")).filter("dst > 0"))
    start = p.filter(F.col("src") % 97 == 0).select(F.col("src").alias("node"))
    return graph.reach(edges, start, 6)


def commit_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = p.select("node", F.floor(F.col("node") / 2).alias("parent")).unionByName(p.filter(F.col("node") % 3 == 0).select("node", F.floor(F.col("node") / 3).alias("parent")))
    return graph.layers(p, edges.filter("parent < node"))


def replay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"))
    sha = lambda c: F.concat(F.lit("c"), c.cast("string"))
    parents = F.when(F.col("seq") % 3 == 0, F.array(sha(F.floor(F.col("seq") / 2)), sha(F.floor(F.col("seq") / 3)))).otherwise(F.array(sha(F.floor(F.col("seq") / 2))))
    plan = graph.replay_plan(p.select("seq", sha(F.col("seq")).alias("sha"), parents.alias("parents")))
    return plan.select("seq", "sha", F.array_join(F.transform("parent_seq", lambda x: x.cast("string")), ",").alias("parents"), "is_merge")


def ancestor_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1)
    dirs = read(spark, sf_dir, "pages").select(F.explode(paths.ancestors(path)).alias("dir"))
    return dirs.groupBy("dir").agg(F.count(F.lit(1)).alias("pages"))


def path_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", paths.in_scope(path, ["/en", "/de/1", "/fr/"]).alias("in_scope"))


QUERIES = {f.__name__: f for f in (last_assistant_message, consecutive_failures, last_n_ring, progress_stall, turn_dedupe, completion_trigger, commit_reach, commit_layers, replay_plan, ancestor_directories, path_scope_filter)}

ORACLES = {
    "last_assistant_message": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND trim(coalesce(text, '')) <> '' GROUP BY 1",
    "consecutive_failures": """
WITH i AS (SELECT user_id, ts, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM events),
m AS (SELECT user_id, max(k) AS k FROM i GROUP BY 1)
SELECT i.user_id, count(*) FILTER (WHERE NOT ok AND i.k = m.k) AS failures, max(ts) FILTER (WHERE ok) AS last_ok_at, max(ts) FILTER (WHERE NOT ok) AS last_fail_at, count(*) FILTER (WHERE NOT ok AND i.k = m.k) >= 3 AS disabled
FROM i JOIN m ON i.user_id = m.user_id GROUP BY 1
""",
    "last_n_ring": """
WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS place FROM events) SELECT * FROM r WHERE place <= 200
""",
    "progress_stall": """
WITH w AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, max(ts) FILTER (WHERE b IS NULL OR value > b) AS last_progress_at, count(*) FILTER (WHERE b IS NULL OR value > b) AS steps FROM w GROUP BY 1
""",
    "turn_dedupe": """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n = 1
""",
    "completion_trigger": r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)(^|[^a-zA-Z0-9_])(that|und)($|[^a-zA-Z0-9_])') THEN 'blocked' WHEN regexp_matches(coalesce(text, ''), '(?i)(^|[^a-zA-Z0-9_])(the|der|la)($|[^a-zA-Z0-9_])') THEN 'triggered' ELSE 'none' END AS state FROM conversations
""",
    "commit_reach": """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey // 2 > 0 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 3 = 0 AND p_partkey // 3 > 0),
r(node, distance) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 97 = 0 UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node WHERE r.distance < 6)
SELECT node, min(distance)::INT AS distance FROM r GROUP BY 1
""",
    "commit_layers": """
WITH RECURSIVE n AS (SELECT p_partkey AS node FROM part),
e AS (SELECT node, node // 2 AS parent FROM n UNION SELECT node, node // 3 FROM n WHERE node % 3 = 0),
i AS (SELECT e.node, e.parent FROM e JOIN n ON n.node = e.parent WHERE e.parent < e.node),
r(node, layer) AS (SELECT node, 0 FROM n UNION SELECT i.node, r.layer + 1 FROM r JOIN i ON i.parent = r.node)
SELECT node, max(layer)::INT AS layer FROM r GROUP BY 1
""",
    "replay_plan": """
WITH e AS (SELECT p_partkey AS seq, 0 AS i, p_partkey // 2 AS p FROM part UNION ALL SELECT p_partkey, 1, p_partkey // 3 FROM part WHERE p_partkey % 3 = 0)
SELECT e.seq, 'c' || e.seq::VARCHAR AS sha, coalesce(string_agg(k.p_partkey::VARCHAR, ',' ORDER BY i), '') AS parents, e.seq % 3 = 0 AS is_merge FROM e LEFT JOIN part k ON k.p_partkey = e.p GROUP BY e.seq
""",
    "ancestor_directories": r"""
WITH s AS (SELECT list_filter(string_split(regexp_extract(url, '^[^:]*://([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages)
SELECT array_to_string(s[1:i], '/') AS dir, count(*) AS pages FROM s, unnest(range(1, len(s))) AS t(i) GROUP BY 1
""",
    "path_scope_filter": r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS p FROM pages)
SELECT page_id, p = '/en' OR starts_with(p, '/en/') OR p = '/de/1' OR starts_with(p, '/de/1/') OR p = '/fr' OR starts_with(p, '/fr/') AS in_scope FROM p
""",
}
