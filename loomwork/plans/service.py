"""Queries on service records, settings and policies: projections, filters, ordered decisions over single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, records, reports, strings
from ..sources import tables
from .parsing import _cat

read = tables.read


def _pick(key: Column, *of) -> Column:
    """One of the given values, in turn by key."""
    return F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in of]), (key % len(of)).cast("int"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues and pull requests."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    user, labels = F.struct(_cat("=u", "o_custkey").alias("login")), F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.col("o_orderstatus").alias("name")))
    return o.select(
        k.alias("number"), _cat("=t", k).alias("title"), _pick(k, "open", "closed").alias("state"), user.alias("user"), labels.alias("labels"), (k % 3).alias("comments"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        F.when(k % 5 == 0, "link").alias("pull_request"), (k % 2 == 0).alias("draft"), F.when(k % 7 == 0, F.col("o_orderdate")).alias("merged_at"), F.struct(_cat("=h", k).alias("ref")).alias("head"), F.struct(F.lit("main").alias("ref")).alias("base"),
    )


def issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.issues(_items(spark, sf_dir)).select("number", "title", "state", "user", F.array_join("labels", ",").alias("labels"), "comments")


def pull_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.pulls(_items(spark, sf_dir).filter("pull_request IS NOT NULL"))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    author = F.struct(_cat("=A", "o_custkey").alias("name"), _cat("=a", "o_custkey", "=@x.test").alias("email"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    committer = F.struct(F.when(k % 3 == 0, "Bot").otherwise(" ").alias("name"), F.when(k % 3 == 0, "bot@x.test").alias("email"), F.lit(None).cast("string").alias("date"))
    return o.select(F.when(k % 10 != 0, F.md5(k.cast("string"))).otherwise("").alias("sha"), _cat("=fix ", k, "=\n\nbody").alias("message"), F.col("o_orderdate").alias("date"), author.alias("author"), committer.alias("committer"))


def commit_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.short_commits(_commits(spark, sf_dir).filter("sha <> ''"))


def branch_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.branch_heads(_commits(spark, sf_dir))


def commit_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.commit_people(_commits(spark, sf_dir).filter("sha <> ''"))


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    runs = e.select(k.alias("id"), _pick(k, "build", " ", None).alias("name"), _pick(k, "x", "title", "").alias("display_title"), _pick(k, "completed", "queued").alias("status"), F.col("event_type").alias("conclusion"), _cat("=u", k).alias("html_url"), F.lit("push").alias("event"), _pick(k, "s1", "s2").alias("head_sha"))
    return records.run_names(runs.filter("head_sha = 's1'")).select("id", "name", "status", "conclusion")


def cloud_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    repos = c.select(F.col("c_name").alias("name"), _cat("=o/", "c_name").alias("full_name"), (k % 2 == 0).alias("private"), F.lit("main").alias("default_branch"), F.lit("2024-01-01").alias("pushed_at"), F.when(k % 3 == 0, F.repeat(F.lit("d"), (k % 200).cast("int"))).alias("description"))
    return records.cloud_repositories(repos).select("name", "full_name", "visibility", F.length("description").alias("chars"))


def package_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages of a search answer, and the clamp of a page's size."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    answer = _cat('={"objects":[{"package":{"name":"', "n_name", '=","version":"1.0.', k, '="},"score":', k, '=},{"package":{"name":"p', k, '="}}]}')
    found = n.select("n_nationkey", F.explode(F.from_json(answer, "objects array<struct<package:struct<name:string,version:string>,score:long>>")["objects"]).alias("o"))
    return found.select("n_nationkey", "o.package.name", F.coalesce("o.package.version", F.lit("")).alias("version"), records.page_size(k * 10 - 5, 50, 20).cast("int").alias("page"))


def version_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package versions of an answer; a missing package has none."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    answer = F.when(k % 4 != 0, _cat('={"versions":{"1.0.', k, '=":{},"2.0.0":{}}}'))
    names = F.map_keys(F.from_json(answer, "versions map<string, struct<x:string>>")["versions"])
    return n.select("n_nationkey", F.array_join(F.array_sort(F.coalesce(names, F.array().cast("array<string>"))), ",").alias("versions"))


def quota_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select(F.col("c_name").alias("resource"), (k * 10).alias("limit"), (k % 10).alias("used"), (k * 10 - k % 10).alias("remaining"), (k * 3600 + 1_700_000_000).alias("reset"))
    return records.quota(rows).select("resource", "limit", "used", "remaining", F.unix_seconds("reset_at").alias("reset"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    status = _pick(k, 200, 204, 301, 404, 500, 429)
    made = records.normalised(status, F.col("props"), F.when(k % 2 == 0, "why"))
    length = records.total_length(_pick(k, _cat("=bytes 0-1/", k), "bytes */*", None), _pick(k, "7", _cat(k), "x", None))
    return e.select("event_id", made.alias("r"), length.alias("length"), policy.visibility_of(status, k % 4 == 0).alias("visibility")).select("event_id", "r.ok", "r.error", "length", "visibility", policy.access_plan(F.col("visibility"))["transport"].alias("transport"))


def hidden_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("token"), "c_mktsegment")
    return records.without_secrets(c, ["token"])


def severity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        "event_id", policy.blocks(_pick(k, "blocker", "error", "warning", None)).alias("blocks"), policy.is_privacy_rule(_pick(k, "secret-key", "no-secret-x", "credref-a", None, "credfile-b")).alias("private"),
        policy.over_budget(_pick(k, F.lit(5), F.lit(None).cast("int"), F.lit(50)), k % 20).alias("late"), policy.is_diverged(_pick(k, "UPDATES were rejected", "fetch first!", "fine", "更新被拒绝，因为远程仓库", "远程仓库包含您本地尚不存在的提交。", None)).alias("diverged"),
        reports.bad_credentials(_pick(k, "Bad credentials", "HTTP 401", "no 4010", "")).alias("bad"), reports.client_id(_pick(k, " abc.def-123 ", "short", "has space in it", None)).alias("client"),
        reports.browser_entry(_pick(k, "./client", "./lib/client.js", "./clientele", "./Browser/x", ".")).alias("browser"), reports.module_target(_pick(k, "./a.js", "./b.css", "./c/", "./d.MJS", None)).alias("module"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    login = F.when(k % 3 != 0, _cat("=u", k)).otherwise("")
    who = policy.identity(_pick(k, "N", " ", None, "M"), _pick(k, "n@x.test", "m@x.test", ""), login, strings.noreply(F.when(k % 2 == 0, k).otherwise(0), login, "mail.test"), ("Nobody", "nobody@mail.test"))
    out = c.select("c_custkey", who.alias("w")).select("c_custkey", "w.*")
    return out.withColumn("label", policy.identity_label(F.col("name"), F.col("email")))


def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = _pick(k, _cat("=pkg", k), "@s/a.b@^1", "-rf", "a/../b", " ", "UPPER ok?", "@s", None)
    whole, version = k % 2 == 0, _pick(k, "1.2.3", "1.2", "", "1.0.0-rc.1+b")
    return p.select("p_partkey", policy.package_name_error(name).alias("install"), policy.unpublish_target_error(name, version, whole).alias("unpublish"))


def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        "p_partkey", policy.posix_mode(_pick(k, "100755", "100644")).alias("mode"), policy.megabytes(k * 100_000, 2).alias("mb"), policy.positive_ms(_pick(k, F.lit(1.5), F.lit(-1.0), F.lit(None).cast("double")), 9).alias("ms"),
        policy.poll_interval_ms(k % 5, F.lit(1000)).alias("poll"), policy.backoff_ms(k % 8, 500, 20_000).alias("backoff"), policy.mirrored(_pick(k, "https://a.test/x", "https://b.test/y"), ["https://a.test/"], "https://m.test").alias("url"),
    )


def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate to use of each nation's suppliers: the first healthy one, else the first that has cooled down."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    now, failed = F.timestamp_seconds(F.lit(1_700_000_000)), F.timestamp_seconds(F.lit(1_700_000_000) - (k % 10) * 60)
    order = policy.usable_order(F.when(F.col("s_nationkey") % 2 == 0, 5).otherwise((k % 5).cast("int")), failed, now)
    ranked = s.select("s_nationkey", "s_suppkey", order.alias("o")).filter("o IS NOT NULL")
    return ranked.groupBy("s_nationkey").agg(F.min(F.struct("o", "s_suppkey")).alias("m")).select("s_nationkey", F.col("m.s_suppkey").alias("chosen"), (F.col("m.o") == 1).alias("again"))


def command_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    params = F.create_map(F.lit("only"), F.array(F.col("n_name"), F.lit(" "), _cat("=x", k)), F.lit("name"), F.array(F.when(k % 2 == 0, "n").otherwise(" ")), F.lit("other"), F.array(F.lit("z")))
    return n.select("n_nationkey", F.array_join(policy.flag_arguments(params, F.create_map(F.lit("only"), F.lit("--only"), F.lit("name"), F.lit("--name"))), " ").alias("args"))


def option_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    local, whole = F.when(k % 3 == 0, F.lit(False)), F.when(k % 2 == 0, F.lit(True))
    given = policy.first_given(("local", local), ("global", whole), ("default", F.lit(True)))
    return e.select("event_id", given.alias("g"), policy.changed((local, whole), (k % 2, k % 2)).alias("changed")).select("event_id", "g.value", "g.source", "changed")


def package_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    bins = F.when(k % 3 == 0, F.array(F.lit("run")))
    exports = F.when(k % 2 == 0, F.create_map(F.lit("."), F.lit("a"), F.lit("./sub"), F.lit("b"), F.lit("./package.json"), F.lit("c"))).otherwise(F.create_map(F.lit("x"), F.lit("a")))
    return n.select("n_nationkey", policy.package_form(k % 2 == 0, bins).alias("form"), F.array_join(policy.entry_specs(F.lower("n_name"), exports), ",").alias("specs"))


def error_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    said = _pick(k, _cat("=Warning: Permanently added x\n fatal:  no ", k, "=\nhint: try\n提示：再试\nremote: z"), "hint: only", _cat("=a\n\n b ", k))
    return s.select("s_suppkey", policy.error_tail(said).alias("tail"), strings.tail(policy.error_tail(said), 4).alias("end"))


def unpublish_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", policy.within_hours(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")), F.lit("1996-01-01 00:00:00").cast("timestamp"), 24 * 365).alias("within"))


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    given = strings.owner_repo(_pick(k, _cat("=https://x.test/o/r", k), _cat("=git@x.test:o/r", k, "=.git"), "none"))
    built = s.select("s_suppkey", given.alias("g"), strings.is_loopback(_pick(k, "localhost", "::ffff:127.0.0.1", "127.0.0.1.x", "10.0.0.1")).alias("loopback"), strings.is_ipv4(_pick(k, "1.2.3.4", "256.1.1.1", "1.2.3", "0255.1.1.1")).alias("ipv4"))
    url = strings.built_urls(F.col("g.owner"), F.col("g.repo"), "x.test")
    return built.select("s_suppkey", "loopback", "ipv4", url["ssh443"].alias("ssh443"), url["https"].alias("https"), url["raw"].alias("raw"), strings.clone_command(F.col("g.owner"), F.col("g.repo"), k % 2 == 0).alias("clone"))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of contents, and a key over a nation's files in the order of their paths."""
    n = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_name").alias("path"), _cat("=body ", "s_suppkey").alias("text"))
    return n.groupBy("n").agg(reports.closure_key("path", "text", "format:1\nnode:v1\n").alias("key"))


QUERIES = {
    f.__name__: f
    for f in (
        issue_list, pull_list, commit_titles, branch_heads, commit_people, run_names, cloud_list, package_search, version_lists, quota_rows, answers, hidden_settings, severity_flags, identities, package_names,
        unit_values, candidate_order, command_flags, option_sources, package_forms, error_tails, unpublish_window, repo_urls, digests,
    )
}

_COMMITS = """c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 0 THEN md5(o_orderkey::VARCHAR) ELSE '' END AS sha, 'fix ' || o_orderkey AS title, o_orderdate AS date, o_custkey AS u FROM orders)"""

ORACLES = {
    "issue_list": "SELECT o_orderkey AS number, 't' || o_orderkey AS title, ['open', 'closed'][o_orderkey % 2 + 1] AS state, 'u' || o_custkey AS user, o_orderpriority || ',' || o_orderstatus AS labels, o_orderkey % 3 AS comments FROM orders WHERE o_orderkey % 5 <> 0",
    "pull_list": "SELECT o_orderkey AS number, 't' || o_orderkey AS title, ['open', 'closed'][o_orderkey % 2 + 1] AS state, o_orderkey % 2 = 0 AS draft, o_orderkey % 7 = 0 AS merged, 'u' || o_custkey AS user, 'h' || o_orderkey AS head, 'main' AS base FROM orders WHERE o_orderkey % 5 = 0",
    "commit_titles": f"WITH {_COMMITS} SELECT left(sha, 8) AS sha, title FROM c WHERE sha <> ''",
    "branch_heads": f"WITH {_COMMITS} SELECT left(sha, 7) AS sha, title, date FROM c WHERE sha <> '' ORDER BY c.date DESC, c.sha LIMIT 3",
    "commit_people": f"""
WITH {_COMMITS} SELECT sha, 'A' || u AS author_name, 'a' || u || '@x.test' AS author_email, strftime(date, '%Y-%m-%d') AS author_date, CASE WHEN k % 3 = 0 THEN 'Bot' ELSE 'A' || u END AS committer_name,
  CASE WHEN k % 3 = 0 THEN 'bot@x.test' ELSE 'a' || u || '@x.test' END AS committer_email, strftime(date, '%Y-%m-%d') AS committer_date FROM c WHERE sha <> ''
""",
    "run_names": "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'title' ELSE 'run ' || event_id END AS name, 'completed' AS status, event_type AS conclusion FROM events WHERE event_id % 2 = 0",
    "cloud_list": "SELECT c_name AS name, 'o/' || c_name AS full_name, CASE WHEN c_custkey % 2 = 0 THEN 'private' ELSE 'public' END AS visibility, CASE WHEN c_custkey % 3 = 0 THEN least(c_custkey % 200, 120) ELSE 0 END::INT AS chars FROM customer",
    "package_search": """
WITH p AS (SELECT n_nationkey, greatest(1, least(50, n_nationkey * 10 - 5))::INT AS page FROM nation)
SELECT n.n_nationkey, n_name AS name, '1.0.' || n.n_nationkey AS version, page FROM nation n JOIN p USING (n_nationkey) UNION ALL SELECT n_nationkey, 'p' || n_nationkey, '', page FROM p
""",
    "version_lists": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN '1.0.' || n_nationkey || ',2.0.0' ELSE '' END AS versions FROM nation",
    "quota_rows": "SELECT c_name AS resource, c_custkey * 10 AS limit, c_custkey % 10 AS used, c_custkey * 10 - c_custkey % 10 AS remaining, c_custkey * 3600 + 1700000000 AS reset FROM customer",
    "answers": """
WITH s AS (SELECT event_id AS k, [200, 204, 301, 404, 500, 429][event_id % 6 + 1] AS s FROM events), v AS (SELECT *, CASE WHEN s = 200 THEN CASE WHEN k % 4 = 0 THEN 'private' ELSE 'public' END WHEN s = 404 THEN 'private' ELSE 'unknown' END AS v FROM s)
SELECT k AS event_id, s BETWEEN 200 AND 299 AS ok, CASE WHEN s NOT BETWEEN 200 AND 299 THEN CASE WHEN k % 2 = 0 THEN 'why' ELSE 'HTTP ' || s END END AS error,
  CASE WHEN k % 3 = 0 THEN k WHEN k % 4 = 0 THEN 7 WHEN k % 4 = 1 THEN k END::BIGINT AS length, v AS visibility, CASE WHEN v = 'public' THEN 'https' ELSE 'ssh' END AS transport FROM v
""",
    "hidden_settings": "SELECT c_custkey, c_custkey % 2 = 0 AS has_token, c_mktsegment FROM customer",
    "severity_flags": """
SELECT event_id, event_id % 4 IN (0, 1) AS blocks, event_id % 5 IN (0, 2, 4) AS private, CASE event_id % 3 WHEN 0 THEN event_id % 20 > 5 ELSE false END AS late, event_id % 6 IN (0, 1, 3, 4) AS diverged,
  event_id % 4 IN (0, 1) AS bad, event_id % 4 = 0 AS client, event_id % 5 IN (0, 1, 3) AS browser, event_id % 5 IN (0, 2, 3, 4) AS module FROM events
""",
    "identities": """
WITH c AS (SELECT c_custkey AS k, ['N', ' ', NULL, 'M'][c_custkey % 4 + 1] AS n, ['n@x.test', 'm@x.test', ''][c_custkey % 3 + 1] AS e, CASE WHEN c_custkey % 3 <> 0 THEN 'u' || c_custkey END AS l FROM customer),
i AS (SELECT k, CASE WHEN trim(coalesce(n, '')) <> '' THEN n WHEN l IS NOT NULL THEN l ELSE 'Nobody' END AS name,
  CASE WHEN e <> '' THEN e WHEN l IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN k || '+' ELSE '' END || l || '@mail.test' ELSE 'nobody@mail.test' END AS email,
  CASE WHEN trim(coalesce(n, '')) <> '' AND e <> '' THEN 'repo-config' WHEN l IS NOT NULL THEN 'account' ELSE 'fallback' END AS source, trim(coalesce(n, '')) = '' AS missing_name, e = '' AS missing_email FROM c)
SELECT k AS c_custkey, name, email, source, missing_name, missing_email, name || ' <' || email || '>' AS label FROM i
""",
    "package_names": """
SELECT p_partkey, CASE p_partkey % 8 WHEN 2 THEN 'option' WHEN 3 THEN 'traversal' WHEN 4 THEN 'missing' WHEN 5 THEN 'malformed' WHEN 6 THEN 'malformed' WHEN 7 THEN 'missing' END AS install,
  CASE WHEN p_partkey % 8 IN (4, 7) THEN 'no name' WHEN p_partkey % 8 IN (1, 2, 3, 5, 6) THEN 'bad name' WHEN p_partkey % 2 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'bad version' END AS unpublish FROM part
""",
    "unit_values": """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 493 ELSE 420 END AS mode, round(p_partkey * 100000 / 1048576, 2) AS mb, CASE WHEN p_partkey % 3 = 0 THEN 1500 ELSE 9 END::BIGINT AS ms, 1000 + (p_partkey % 5) * 5000 AS poll,
  least(20000, 500 * 2 ** (p_partkey % 8))::BIGINT AS backoff, CASE WHEN p_partkey % 2 = 0 THEN 'https://m.test/https://a.test/x' ELSE 'https://b.test/y' END AS url FROM part
""",
    "candidate_order": """
WITH s AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 5 ELSE s_suppkey % 5 END AS f, s_suppkey % 10 AS m FROM supplier),
o AS (SELECT *, CASE WHEN f < 3 THEN 0 WHEN m >= 5 THEN 1 END AS o FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY o, s_suppkey) AS n FROM o WHERE o IS NOT NULL)
SELECT s_nationkey, s_suppkey AS chosen, o = 1 AS again FROM r WHERE n = 1
""",
    "command_flags": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '--name n ' ELSE '' END || '--only ' || n_name || ',x' || n_nationkey AS args FROM nation",
    "option_sources": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN false ELSE true END AS value, CASE WHEN event_id % 3 = 0 THEN 'local' WHEN event_id % 2 = 0 THEN 'global' ELSE 'default' END AS source, event_id % 3 = 0 OR event_id % 2 = 0 AS changed FROM events
""",
    "package_forms": """
SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 'both' WHEN n_nationkey % 2 = 0 THEN 'library' WHEN n_nationkey % 3 = 0 THEN 'cli' ELSE 'none' END AS form,
  lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN ',' || lower(n_name) || '/sub' ELSE '' END AS specs FROM nation
""",
    "error_tails": """
WITH t AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'fatal: no ' || s_suppkey WHEN 1 THEN 'hint: only' ELSE 'a b ' || s_suppkey END AS tail FROM supplier) SELECT *, right(tail, 4) AS end FROM t
""",
    "unpublish_window": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN floor(epoch(TIMESTAMP '1996-01-01')) - floor(epoch(o_orderdate)) <= 365 * 86400 END AS within FROM orders",
    "repo_urls": """
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 < 2 THEN 'o/r' || s_suppkey END AS r FROM supplier)
SELECT k AS s_suppkey, k % 4 IN (0, 1) AS loopback, k % 4 = 0 AS ipv4, 'ssh://git@ssh.x.test:443/' || r || '.git' AS ssh443, 'https://x.test/' || r || '.git' AS https, 'https://raw.x.test/' || r AS raw,
  'clone ' || r || CASE WHEN k % 2 = 0 THEN ' (private)' ELSE '' END AS clone FROM s
""",
    "digests": "SELECT s_nationkey AS n, sha256('format:1' || chr(10) || 'node:v1' || chr(10) || string_agg(s_name || chr(10) || 'body ' || s_suppkey || chr(10), '' ORDER BY s_name)) AS key FROM supplier GROUP BY 1",
}
