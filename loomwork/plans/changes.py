"""Queries on merges, differences and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, merge, sets
from ..sources import tables

read = tables.read


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("visibility"), F.col("c_acctbal").alias("score"), F.col("c_nationkey").alias("nation"))


def index_merge_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir).drop("nation")
    existing = c.filter(F.col("key") % 3 != 0)
    blank = F.when(F.col("key") % 4 == 0, F.lit("")).otherwise(F.lower("visibility"))
    fresh = c.filter(F.col("key") % 2 == 0).select("key", "name", blank.alias("visibility"), (F.col("score") + 1).alias("score"))
    return merge.overlay(existing, fresh, "key", keep_left_if_blank=("visibility",)).select("key", "name", "visibility", F.round("score", 2).alias("score"), "origin")


def index_merge_update_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir).drop("nation")
    fresh = c.filter(F.col("key") % 5 < 2).select((F.col("key") + F.when(F.col("key") % 5 == 1, 10_000_000).otherwise(0)).alias("key"), F.when(F.col("key") % 2 == 0, F.col("visibility")).otherwise(F.lit("private")).alias("visibility"))
    return merge.update_only(c, fresh, "key", ["visibility"]).select("key", "name", "visibility", "changed")


def index_point_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.point_update(_customers(spark, sf_dir), "key", 7, {"visibility": F.lit("private"), "score": F.lit(0.0)})
    return out.select("key", "visibility", F.round("score", 2).alias("score"), "touched")


def index_prune_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return merge.prune_scoped(_customers(spark, sf_dir), scanned, "key", "nation", 3).select("key", "nation", "stays")


def seed_state_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    state = read(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 0).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("failures"), F.max("c_name").alias("last_error")).filter(F.col("nation") % 2 == 0)
    return merge.with_state(seed, state, "nation", {"failures": 0, "last_error": ""}).withColumn("disabled", F.col("failures") >= 3)


def first_per_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    parts = [o.filter(F.col("o_orderstatus") == "P"), o.filter(F.col("o_orderstatus") == "F")]
    return merge.first_of_unions(parts, "o_custkey", F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus", "part")


def _tree(spark: SparkSession, sf_dir: str, skip: int, salt: int) -> DataFrame:
    p = read(spark, sf_dir, "part").filter(F.col("p_partkey") % 10 != skip)
    path = F.concat(F.lower("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))
    body = F.when(F.col("p_partkey") % salt == 0, F.concat("p_name", F.lit("'"))).otherwise(F.col("p_name"))
    mode = F.when((F.col("p_partkey") % 13 == 0) & (F.lit(salt) == 7), "100755").otherwise("100644")
    return p.select(path.alias("path"), F.sha2(body, 256).alias("sha"), mode.alias("mode"))


def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.tree_diff(_tree(spark, sf_dir, 1, 1_000_000_007), _tree(spark, sf_dir, 2, 7))


def snapshot_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(16)).alias("sig"), "doc_id")
    before = d.filter(F.col("doc_id") % 7 != 0).select("path", "sig")
    after = d.filter(F.col("doc_id") % 5 != 0).select("path", F.when(F.col("doc_id") % 3 == 0, F.concat("sig", F.lit("x"))).otherwise(F.col("sig")).alias("sig"))
    return diff.change_counts(diff.snapshot_changes(before, after))


def drift_missing_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    documented = read(spark, sf_dir, "part").filter(F.col("p_size") <= 25).select(F.col("p_partkey").alias("key"))
    actual = read(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 45).select(F.col("l_partkey").alias("key"))
    return diff.drift(documented, actual, "key")


def blob_reuse_or_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    local = d.select("doc_id", F.sha2("text", 256).alias("sha"))
    remote = d.filter(F.col("doc_id") % 4 == 0).select(F.sha2("text", 256).alias("sha"))
    return diff.reuse_or_send(local, remote, "sha").select("doc_id", "plan")


def lag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return diff.changed_from_last(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority").select("o_custkey", "o_orderkey", "last", "moved")


def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("nation"))
    s = read(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 5000).select(F.col("s_nationkey").alias("nation"))
    return sets.membership(c, s, "nation")


def set_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("have"))
    given = F.array(F.lit(2), F.lit(9))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return lists.select("l_orderkey", *[text(sets.edited(F.col("have"), given, m)).alias(f"after_{m}") for m in ("set", "add", "remove", "clear")])


def identity_hit_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose queue's or whose customer's address is one of those to be replaced, which are given in another case."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    address = F.concat(F.replace("c_name", F.lit("Customer#"), F.lit("Mail")), F.lit("@"), F.initcap("c_mktsegment"), F.lit(".test"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", address.alias("author"), F.concat("o_orderpriority", F.lit("@Desk.test")).alias("committer"))
    wrong = c.filter(F.col("c_mktsegment").startswith("B")).select(F.upper(address).alias("wrong"))
    wrong = wrong.unionByName(o.filter(F.col("o_totalprice") > 200_000).filter(~F.col("o_orderpriority").startswith("5")).select(F.concat(F.lower("o_orderpriority"), F.lit("@desk.TEST")).alias("wrong")))
    return sets.hit_sides(rows, "author", "committer", wrong, "wrong").select("o_orderkey", "side")


QUERIES = {f.__name__: f for f in (index_merge_full_outer, index_merge_update_only, index_point_update, index_prune_scoped, seed_state_overlay, first_per_key_union, tree_diff, snapshot_diff_counts, drift_missing_stale, blob_reuse_or_send, lag_diff, set_membership, set_edits, identity_hit_sides)}

_TREE = """SELECT lower(p_brand) || '/' || p_partkey::VARCHAR AS path, sha256(CASE WHEN p_partkey % {salt} = 0 THEN p_name || '''' ELSE p_name END) AS sha,
  CASE WHEN p_partkey % 13 = 0 AND {salt} = 7 THEN '100755' ELSE '100644' END AS mode FROM part WHERE p_partkey % 10 <> {skip}"""

ORACLES = {
    "index_merge_full_outer": """
WITH c AS (SELECT c_custkey AS key, c_name AS name, c_mktsegment AS visibility, c_acctbal AS score FROM customer),
l AS (SELECT * FROM c WHERE key % 3 <> 0),
r AS (SELECT key, name, CASE WHEN key % 4 = 0 THEN '' ELSE lower(visibility) END AS visibility, score + 1 AS score FROM c WHERE key % 2 = 0)
SELECT coalesce(r.key, l.key) AS key, coalesce(r.name, l.name) AS name, coalesce(nullif(r.visibility, ''), l.visibility, r.visibility) AS visibility,
  round(coalesce(r.score, l.score), 2) AS score, CASE WHEN l.key IS NULL THEN 'added' WHEN r.key IS NULL THEN 'kept' ELSE 'updated' END AS origin
FROM l FULL JOIN r ON l.key = r.key
""",
    "index_merge_update_only": """
WITH c AS (SELECT c_custkey AS key, c_name AS name, c_mktsegment AS visibility FROM customer),
r AS (SELECT key + CASE WHEN key % 5 = 1 THEN 10000000 ELSE 0 END AS key, CASE WHEN key % 2 = 0 THEN visibility ELSE 'private' END AS visibility FROM c WHERE key % 5 < 2)
SELECT c.key, c.name, coalesce(r.visibility, c.visibility) AS visibility, r.key IS NOT NULL AND coalesce(r.visibility, c.visibility) IS DISTINCT FROM c.visibility AS changed FROM c LEFT JOIN r ON c.key = r.key
""",
    "index_point_update": "SELECT c_custkey AS key, CASE WHEN c_custkey = 7 THEN 'private' ELSE c_mktsegment END AS visibility, round(CASE WHEN c_custkey = 7 THEN 0.0::DOUBLE ELSE c_acctbal END, 2) AS score, c_custkey = 7 AS touched FROM customer",
    "index_prune_scoped": "SELECT c_custkey AS key, c_nationkey AS nation, c_custkey IN (SELECT o_custkey FROM orders) OR c_nationkey <> 3 AS stays FROM customer",
    "seed_state_overlay": """
WITH s AS (SELECT c_nationkey, count(*) AS f, max(c_name) AS e FROM customer WHERE c_acctbal < 0 AND c_nationkey % 2 = 0 GROUP BY 1)
SELECT n_nationkey AS nation, n_name AS name, coalesce(f, 0)::BIGINT AS failures, coalesce(e, '') AS last_error, coalesce(f, 0) >= 3 AS disabled FROM nation LEFT JOIN s ON c_nationkey = n_nationkey
""",
    "first_per_key_union": """
WITH u AS (SELECT *, CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS part FROM orders WHERE o_orderstatus IN ('P', 'F')),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY part, o_orderdate DESC, o_orderkey) AS n FROM u)
SELECT o_custkey, o_orderkey, o_orderstatus, part FROM r WHERE n = 1
""",
    "tree_diff": f"""
WITH p AS ({_TREE.format(salt=1_000_000_007, skip=1)}), c AS ({_TREE.format(salt=7, skip=2)}),
j AS (SELECT coalesce(c.path, p.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN p.path IS NULL THEN 'added' WHEN p.sha <> c.sha THEN 'content' WHEN p.mode <> c.mode THEN 'mode' ELSE 'same' END AS reason FROM p FULL JOIN c ON p.path = c.path)
SELECT path, CASE reason WHEN 'deleted' THEN 'remove' WHEN 'same' THEN 'keep' ELSE 'download' END AS action, reason FROM j
""",
    "snapshot_diff_counts": """
WITH d AS (SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS sig FROM documents),
b AS (SELECT * FROM d WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sig || 'x' ELSE sig END AS sig FROM d WHERE doc_id % 5 <> 0),
j AS (SELECT CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.sig <> b.sig THEN 'modified' END AS c FROM b FULL JOIN a ON a.doc_id = b.doc_id)
SELECT count(*) FILTER (WHERE c = 'added') AS added, count(*) FILTER (WHERE c = 'modified') AS modified, count(*) FILTER (WHERE c = 'deleted') AS deleted, count(c) AS total FROM j
""",
    "drift_missing_stale": """
WITH d AS (SELECT DISTINCT p_partkey AS key FROM part WHERE p_size <= 25), a AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity >= 45)
SELECT key, 'stale' AS drift FROM (SELECT key FROM d EXCEPT SELECT key FROM a) UNION ALL SELECT key, 'missing' FROM (SELECT key FROM a EXCEPT SELECT key FROM d)
""",
    "blob_reuse_or_send": "SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL) THEN 'reuse' ELSE 'send' END AS plan FROM documents",
    "lag_diff": """
WITH w AS (SELECT o_custkey, o_orderkey, o_orderpriority, lag(o_orderpriority) OVER w AS last, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, last, CASE WHEN n = 1 THEN 'first' WHEN last IS NOT DISTINCT FROM o_orderpriority THEN 'same' ELSE 'changed' END AS moved FROM w
""",
    "set_membership": """
WITH c AS (SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000)
SELECT coalesce(c.nation, s.nation) AS nation, CASE WHEN s.nation IS NULL THEN 'left' WHEN c.nation IS NULL THEN 'right' ELSE 'both' END AS side FROM c FULL JOIN s ON c.nation = s.nation
""",
    "set_edits": """
WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS have FROM lineitem GROUP BY 1)
SELECT l_orderkey, '2,9' AS after_set, array_to_string(list_concat(have, list_filter([2, 9], lambda x: NOT list_contains(have, x))), ',') AS after_add, coalesce(array_to_string(list_filter(have, lambda x: x NOT IN (2, 9)), ','), '') AS after_remove, '' AS after_clear FROM l
""",
    "identity_hit_sides": """
WITH w AS (SELECT DISTINCT o_orderpriority AS k FROM orders WHERE o_totalprice > 200000 AND o_orderpriority NOT LIKE '5%'), r AS (SELECT o_orderkey, c_mktsegment LIKE 'B%' AS a, o_orderpriority IN (SELECT k FROM w) AS b FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' ELSE 'right' END AS side FROM r WHERE a OR b
""",
}
