"""Queries that look rows up in registries, caches and plans, and roll their outcomes up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, paths, reports, strings
from ..operators import aggregate, classify, merge, timed, windows
from ..sources import tables
from .parsing import _cat
from .service import _pick

read = tables.read


def provider_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first provider that declares each event's type as an action, by the order of providers."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    declared = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.get(F.array(*[F.lit(x) for x in ("click", "view", "error", "other")]), F.col("n_nationkey") % 4).alias("event_type"))
    first = windows.first_per_key(declared, ["event_type"], "n_nationkey").select("event_type", F.col("n_name").alias("provider"))
    return e.join(F.broadcast(first), "event_type", "left").select("event_id", "provider")  # one row for each of four actions


def endpoint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to declared endpoints: the method counts where it is given, whatever its case; paths lose their leading slashes."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    asked = o.select("o_orderkey", F.regexp_replace(_cat(_pick(k, "/", "//", ""), "=r", k % 6), "^/+", "").alias("path"), _pick(k, "get", "POST", None).alias("method"))
    declared = spark.createDataFrame([(0, "r0", "GET", "a"), (1, "r1", "POST", "b"), (2, "r1", "GET", "c"), (3, "r2", None, "d"), (4, "r0", "POST", "e")], "ord int, path string, declared string, provider string")
    fits = F.col("method").isNull() | (F.upper(F.coalesce("declared", F.lit("GET"))) == F.upper("method"))
    hits = asked.join(F.broadcast(declared), "path", "left")
    return hits.groupBy("o_orderkey").agg(F.min_by("provider", F.when(fits, F.col("ord"))).alias("provider"))


def repo_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a repository's origin belongs to the account, and why not."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    url = F.when(k % 4 == 0, "").otherwise(_cat("=https://x.test/", _pick(k, "Me", "other"), "=/r", k))
    owner = strings.owner_repo(url)["owner"]
    mine = classify.ownership(F.lit("me"), owner) == "own"
    return s.select("s_suppkey", mine.alias("mine"), F.when(~mine, F.when(url == "", "no origin").otherwise("foreign origin")).alias("reason"))


def registry_by_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands by the name they have on a command line: their own, or the registered one with dashes."""
    registry = read(spark, sf_dir, "nation").select("n_nationkey", _cat("=git_", F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).alias("name"), F.when(F.col("n_nationkey") % 5 == 0, _cat("=cmd", "n_nationkey")).alias("cli"))
    registry = registry.select("name", F.coalesce("cli", F.replace("name", F.lit("_"), F.lit("-"))).alias("cli"))
    asked = read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, _cat("=cmd", "n_nationkey")).otherwise(_cat("=git-", F.lower(F.translate("n_name", " _", "--")))).alias("cli"))
    return asked.join(registry, "cli", "left").select("n_nationkey", "name")


def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a replay can go on: the marker's branch must be the same and its commit on the chain."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    markers = o.select("o_orderkey", _pick(k, "main", "dev", None).alias("branch"), (k % 40).alias("sha"))
    chain = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("sha")).distinct().withColumn("there", F.lit(True))
    joined = markers.join(F.broadcast(chain), "sha", "left")  # 25 rows
    reason = F.when(F.col("branch").isNull(), "no marker").when(F.col("branch") != "main", "other branch").when(F.col("there").isNull(), "not on the chain")
    return joined.select("o_orderkey", reason.isNull().alias("resume"), F.when(reason.isNull(), F.col("sha")).alias("from_sha"), reason.alias("reason"))


def replay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay's steps in order after the resume point, each with what it adds to the one before."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("sha"), F.col("o_totalprice").alias("size"))
    return timed.steps_after(o, "chain", "sha", "size", resume=F.col("chain") * 2)


def index_by_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    asked = p.select("p_partkey", _cat("=/w/x/Supplier#", F.lpad((k % 300).cast("string"), 9, "0"), F.when(k % 2 == 0, "/").otherwise("")).alias("path"))
    index = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_nationkey")
    return asked.withColumn("name", paths.basename(F.col("path"))).join(index, "name", "left").select("p_partkey", "s_nationkey")


def test_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files run and why: what may not be cached, what has no entry, what changed itself, what changed behind it."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    files = p.select("p_partkey", (k % 11 == 0).alias("always"), F.md5(_cat("=k", k % 50)).alias("key"), F.md5(_cat("=s", k % 40)).alias("self"))
    cache = p.filter(k % 3 != 0).select("p_partkey", F.md5(_cat("=k", F.when(k % 5 == 0, -1).otherwise(k % 50))).alias("was"), F.md5(_cat("=s", F.when(k % 10 == 0, -1).otherwise(k % 40))).alias("was_self"), (k % 7 != 0).alias("passed"))
    joined = files.join(cache, "p_partkey", "left")
    reason = F.when(F.col("always"), "always").when((F.col("key") == F.col("was")) & F.col("passed"), "hit").when(F.col("was").isNull(), "first").when(F.col("self") != F.col("was_self"), "changed").otherwise("dependency")
    return joined.select("p_partkey", (reason != "hit").alias("run"), reason.alias("reason"))


def cacheable_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose statements call the network, outside comments and strings."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    text = _pick(k, "const r = await fetch('x');", "// await fetch(x)\nlet a = 'server.listen(1)';", "app.listen (80)\nx.listen(1)", "/* net.connect( */ f()")
    return p.select("p_partkey", timed.calls_network(text).alias("network"))


def file_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular, skipped and archived files of each side."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(paths.side(_cat(_pick(k, "git/", "npm/", ""), "=t", k, "=.js")).alias("side"), (k % 9 == 0).alias("archived"), (k % 4 == 0).alias("hit"))
    return rows.groupBy("side").agg(F.count_if(~F.col("archived")).alias("regular"), F.count_if(~F.col("archived") & F.col("hit")).alias("skipped"), F.count_if("archived").alias("archived"))


def blocked_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking findings of each nation: how many, in how many files, and the first three files and findings."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select("c_nationkey", _cat("=f", k % 12, "=.js").alias("file"), (k % 90).alias("line"), _pick(k, "blocker", "error", "warning", "notice").alias("severity"), F.repeat(F.lit("m"), (k % 100).cast("int")).alias("message"))
    return timed.severity_report(rows, "c_nationkey", files=3, samples=3)


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories as lines of a report, and how many of each nation are dirty."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    w = s.select("s_suppkey", "s_nationkey", reports.scan_line(F.col("s_name"), _pick(k, "main", ""), k % 3, F.when(k % 2 == 0, k % 5)).alias("line"), (k % 3 > 0).alias("dirty"))
    n = w.groupBy("s_nationkey").agg(F.count_if("dirty").alias("dirty_repos"))
    return w.join(n, "s_nationkey").select("s_suppkey", "line", "dirty_repos")


def rewrite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    branches = F.array(F.struct(F.lit("main").alias("branch"), (k % 3).alias("hits"), (k % 2 == 0).alias("pushed")), F.struct(F.lit("dev").alias("branch"), F.lit(0).alias("hits"), F.lit(False).alias("pushed")))
    return n.select("n_nationkey", reports.rewrite_line(F.col("n_name"), k % 5 == 0, F.lit("no origin"), branches).alias("line"), reports.preview(F.sequence(F.lit(1), k + 1).cast("array<string>"), 10).alias("shown"))


def visibility_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service says before what was noted by hand; other notes don't count."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    noted = s.select(F.col("s_suppkey").alias("k"), F.from_json(_cat('={"visibility":"', _pick(k, "public", "private", "maybe"), '="}'), "visibility string")["visibility"].alias("v")).filter("v IN ('public', 'private')")
    said = s.filter(k % 4 == 0).select(F.col("s_suppkey").alias("k"), F.lit("private").alias("v"))
    both = merge.first_of_unions([said, noted], "k").withColumnRenamed("k", "s_suppkey")
    return s.select("s_suppkey").join(both, "s_suppkey", "left").select("s_suppkey", F.coalesce("v", F.lit("unknown")).alias("visibility"))


def version_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all sources of a project state one version."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    stated = s.select("s_nationkey", _cat("=1.0.", F.when(F.col("s_nationkey") % 2 == 0, k % 2).otherwise(0)).alias("version"))
    return stated.groupBy("s_nationkey").agg((F.min("version") == F.max("version")).alias("ok"), F.countDistinct("version").alias("versions"))


def dependency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of a project as rows; development ones override ordinary ones of the same name."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    m = "map<string, string>"
    own = F.from_json(_cat('={"a":"1.', k, '=","b":"2"}'), m)
    dev = F.when(k % 2 == 0, F.from_json(_cat('={"b":"3.', k, '="}'), m)).otherwise(F.create_map().cast(m))
    both = F.map_zip_with(own, dev, lambda _, a, b: F.struct(F.coalesce(b, a).alias("version"), b.isNotNull().alias("dev")))
    return n.select("n_nationkey", F.explode(both).alias("name", "d")).select("n_nationkey", "name", "d.version", "d.dev")


def seed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of seed lists with the state kept of them; failures are never below zero, and odd addresses are no candidates."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    seeds = n.select("n_nationkey", F.explode(F.from_json(_cat('={"candidates":["10.0.0.', k, '=","300.1.1.', k, '="]}'), "candidates array<string>")["candidates"]).alias("ip")).filter(strings.is_ipv4(F.col("ip")))
    state = n.select(F.explode(F.from_json(_cat('={"10.0.0.', k, '=":{"failures":', k % 3 - 1, "=}}"), "map<string, struct<failures:int>>")).alias("ip", "s")).select("ip", F.greatest(F.lit(0), "s.failures").alias("failures"))
    return merge.with_state(seeds, state.filter("failures > 0"), "ip", {"failures": 0}).select("n_nationkey", "ip", "failures")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept progress and account snapshots, with defaults for what they lack."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    kept = F.from_json(_pick(k, _cat('={"version":', k, '=,"found":["a","b"],"done":true,"token":{"valid":true,"login":"u","checked_at":"t"}}'), "{broken", "{}"), "version long, found array<string>, done boolean, token struct<valid:boolean, login:string, checked_at:string, timeout:boolean>, ssh struct<valid:boolean, login:string, checked_at:string, timeout:boolean>")
    out = c.select("c_custkey", kept.alias("s"))
    token, ssh = reports.credential(F.col("s.token")), reports.credential(F.col("s.ssh"))
    return out.select("c_custkey", F.coalesce("s.version", F.lit(0)).alias("version"), F.coalesce(F.size("s.found"), F.lit(0)).alias("found"), F.coalesce("s.done", F.lit(False)).alias("done"), token["login"].alias("login"), token["checked"].alias("checked"), reports.account_verdict(token["valid"], ssh["valid"]).alias("verdict"))


def release_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version notes of a map, none where it isn't an object."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    notes = F.from_json(F.when(k % 3 != 0, _cat('={"1.0.', k, '=":"x","2.0.0":"', "n_name", '="}')).otherwise("[1]"), "map<string, string>")
    return n.select("n_nationkey", F.explode(notes).alias("version", "note"))


def skill_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that a project declares, then those of its folder under the name in their front matter; the first of a name counts."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    declared = F.array(F.lit("skills/a.md"), _cat("=b", k, "=.md"))
    names = F.transform(declared, lambda p: F.regexp_replace(paths.basename(p), r"\.md$", ""))
    front = parse.front_matter_name(F.when(k % 2 == 0, _cat("=---\nname: c", k, "=\n---\n")).otherwise("none"))
    return n.select("n_nationkey", F.array_join(F.array_union(names, F.array(F.lit("a"), F.coalesce(front, F.lit("plain")))), ",").alias("skills"))


def patched_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    mode = reports.patched(F.lit("warn"), _pick(k, "block", "nonsense", None, "skip"), allowed=["block", "warn", "skip"])
    size = reports.patched(F.lit(30), _pick(k, F.lit(500), F.lit(-5), F.lit(None).cast("int")), least=1, most=100)
    return c.select("c_custkey", mode.alias("mode"), size.alias("size"))


def found_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probed tools: the first of a name, those that were found by path, as a map."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    probes = n.select("n_regionkey", k.alias("ord"), _cat("=tool", k % 4).alias("name"), F.when(k % 3 != 0, _cat("=/bin/t", k)).alias("path"))
    first = windows.first_per_key(probes, ["n_regionkey", "name"], "ord").filter("path IS NOT NULL")
    # a region probes a fixed few tools
    return first.groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "path")))).alias("m")).select("n_regionkey", F.size("m").alias("tools"), F.element_at("m", F.lit("tool1")).alias("tool1"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    push = reports.push_outcome(k % 5 != 0, k % 7 == 0, k % 2 == 0, k % 3 != 0, _pick(k, F.lit(True), F.lit(False), F.lit(None).cast("boolean")), F.when(k % 10 == 0, "why"), k % 4 == 1)
    clone = reports.clone_outcome(k % 4 != 0, k % 3 == 0, F.when(k % 8 == 0, "e"))
    return e.select("event_id", push["status"].alias("push"), push["detail"].alias("push_detail"), clone["status"].alias("clone"), clone["detail"].alias("clone_detail"))


def parameter_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    params = F.array(F.struct(F.lit("a").alias("flag"), _pick(k, "array", "boolean", "number").alias("type"), F.col("n_name").alias("desc")), F.struct(F.lit("b").alias("flag"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("desc")))
    return n.select("n_nationkey", F.explode(reports.parameter_types(params)).alias("flag", "p")).select("n_nationkey", "flag", "p.type", "p.description")


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each look-up's answer from what was learned at most an hour before; unknown answers are never kept."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts", F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "purchase", "private").when(F.col("event_type") == "click", "public").alias("answer"))
    return timed.cached(e, "key", "ts", "answer", 3600, "event_id")


def poll_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How waiting for each user's runs ends, from polls in order: a result, no runs after a grace, or no result in time."""
    e = read(spark, sf_dir, "events")
    start = e.groupBy("user_id").agg(F.min("ts").alias("start"))
    polls = e.join(start, "user_id").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))).alias("elapsed"), F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "none").otherwise("pending").alias("seen"))
    return timed.wait_outcome(polls, "user_id", "elapsed", "seen", grace=60_000_000_000, timeout=600_000_000_000, tie="event_id")


def device_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's authorisation stands after its answers in order."""
    e = read(spark, sf_dir, "events")
    said = e.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "slow_down").when(F.col("event_type") == "purchase", "authorized").otherwise("pending").alias("answer"))
    return timed.device_state(said, "user_id", ["ts", "event_id"], "answer", base_ms=5000, step_ms=5000)


def line_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last forty of the last three hundred lines of each key, one text."""
    e = read(spark, sf_dir, "events").select("event_type", "event_id", _cat("=l", "event_id").alias("line"))
    kept = windows.last_n(e, "event_type", 40, F.desc("event_id"))
    return kept.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("shown"))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files that the stages of a run have changed, and the first and last of them."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), _cat("=f", F.col("l_partkey") % 50).alias("file"))
    return li.groupBy("run").agg(F.countDistinct("file").alias("files"), F.min("file").alias("first"), F.max("file").alias("last"))


def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return aggregate.histogram(p, F.col("p_brand"), "brand").join(p.groupBy(F.col("p_brand").alias("brand")).agg(F.sum("p_size").alias("functions")), "brand")


QUERIES = {
    f.__name__: f
    for f in (
        provider_lookup, endpoint_lookup, repo_partition, registry_by_cli, resume_points, replay_steps, index_by_basename, test_plan, cacheable_tests, file_sides, blocked_summary, dirty_lines, rewrite_report,
        visibility_map, version_agreement, dependency_rows, seed_lists, snapshots, release_notes, skill_names, patched_settings, found_tools, outcomes, parameter_maps, cached_answers, poll_outcomes, device_flows,
        line_ring, changed_files, source_totals,
    )
}

ORACLES = {
    "provider_lookup": "SELECT event_id, p.n_name AS provider FROM events LEFT JOIN (SELECT ['click', 'view', 'error', 'other'][n_nationkey % 4 + 1] AS event_type, arg_min(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1) p USING (event_type)",
    "endpoint_lookup": """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 1 THEN 'e' ELSE 'a' END WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'c' ELSE 'b' END WHEN 2 THEN CASE WHEN o_orderkey % 3 <> 1 THEN 'd' END END AS provider FROM orders
""",
    "repo_partition": "SELECT s_suppkey, s_suppkey % 4 = 2 AS mine, CASE WHEN s_suppkey % 4 = 0 THEN 'no origin' WHEN s_suppkey % 2 = 1 THEN 'foreign origin' END AS reason FROM supplier",
    "registry_by_cli": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN n_nationkey % 5 = 0 THEN 'git_' || lower(replace(n_name, ' ', '_')) END WHEN n_nationkey % 5 <> 0 THEN 'git_' || lower(replace(n_name, ' ', '_')) END AS name FROM nation",
    "resume_points": """
WITH m AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'no marker' WHEN 1 THEN 'other branch' ELSE CASE WHEN o_orderkey % 40 >= 25 THEN 'not on the chain' END END AS reason FROM orders)
SELECT o_orderkey, reason IS NULL AS resume, CASE WHEN reason IS NULL THEN o_orderkey % 40 END AS from_sha, reason FROM m
""",
    "replay_steps": """
WITH s AS (SELECT o_custkey AS chain, o_orderkey AS sha, o_totalprice - coalesce(lag(o_totalprice) OVER w, 0) AS added, row_number() OVER w AS step FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT chain, sha, step, round(added, 2) AS added FROM s WHERE sha > chain * 2
""",
    "index_by_basename": "SELECT p_partkey, s_nationkey FROM part LEFT JOIN supplier ON s_name = 'Supplier#' || lpad((p_partkey % 300)::VARCHAR, 9, '0')",
    "test_plan": """
WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'always' WHEN p_partkey % 3 = 0 THEN 'first' WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN 'hit' WHEN p_partkey % 10 = 0 THEN 'changed' ELSE 'dependency' END AS reason FROM part)
SELECT k AS p_partkey, reason <> 'hit' AS run, reason FROM r
""",
    "cacheable_tests": "SELECT p_partkey, p_partkey % 4 IN (0, 2) AS network FROM part",
    "file_sides": """
SELECT ['git', 'npm', ''][p_partkey % 3 + 1] AS side, count(*) FILTER (WHERE p_partkey % 9 <> 0) AS regular, count(*) FILTER (WHERE p_partkey % 9 <> 0 AND p_partkey % 4 = 0) AS skipped, count(*) FILTER (WHERE p_partkey % 9 = 0) AS archived FROM part GROUP BY 1
""",
    "blocked_summary": """
WITH r AS (SELECT c_nationkey, 'f' || (c_custkey % 12) || '.js' AS file, c_custkey % 90 AS line, ['blocker', 'error', 'warning', 'notice'][c_custkey % 4 + 1] AS severity, left(repeat('m', (c_custkey % 100)::INT), 80) AS message FROM customer),
b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY file, line, message) AS n, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY file) AS f FROM r WHERE severity IN ('blocker', 'error')),
x AS (SELECT c_nationkey, count(*) AS blocked, count(DISTINCT file) AS files, array_to_string(list_sort(list_distinct(list(file) FILTER (WHERE f <= 3))), ',') AS first_files, string_agg(file || ':' || line || ' ' || length(message), ',' ORDER BY n) FILTER (WHERE n <= 3) AS samples FROM b GROUP BY 1)
SELECT r.c_nationkey, count(*) FILTER (WHERE severity = 'blocker') AS blocker, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'notice') AS notice, count(*) AS total,
  any_value(coalesce(x.blocked, 0)) AS blocked, any_value(coalesce(x.files, 0)) AS files, any_value(coalesce(first_files, '')) AS first_files, any_value(coalesce(samples, '')) AS samples FROM r LEFT JOIN x USING (c_nationkey) GROUP BY 1
""",
    "dirty_lines": """
WITH s AS (SELECT *, s_suppkey % 3 AS c, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 ELSE 0 END AS a FROM supplier)
SELECT s_suppkey, '  ' || CASE WHEN c > 0 OR a > 0 THEN '* ' ELSE '- ' END || s_name || '  [' || CASE WHEN s_suppkey % 2 = 0 THEN 'main' ELSE '(empty)' END || ']' || CASE WHEN c > 0 THEN '  uncommitted ' || c ELSE '' END || CASE WHEN a > 0 THEN '  unpushed ' || a ELSE '' END AS line,
  count(*) FILTER (WHERE c > 0) OVER (PARTITION BY s_nationkey) AS dirty_repos FROM s
""",
    "rewrite_report": """
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '- ' || n_name || ': skipped, no origin' ELSE '- ' || n_name || ': main=' || CASE WHEN n_nationkey % 3 = 0 THEN 'none' ELSE (n_nationkey % 3) || CASE WHEN n_nationkey % 2 = 0 THEN ' pushed' ELSE '' END END || ', dev=none' END AS line,
  array_to_string(range(1, least(n_nationkey + 1, 10) + 1), chr(10)) || CASE WHEN n_nationkey > 9 THEN chr(10) || '+' || (n_nationkey - 9) ELSE '' END AS shown FROM nation
""",
    "visibility_map": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'private' ELSE ['public', 'private', 'unknown'][s_suppkey % 3 + 1] END AS visibility FROM supplier",
    "version_agreement": "SELECT s_nationkey, count(DISTINCT CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey % 2 ELSE 0 END) = 1 AS ok, count(DISTINCT CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey % 2 ELSE 0 END) AS versions FROM supplier GROUP BY 1",
    "dependency_rows": """
SELECT n_nationkey, 'a' AS name, '1.' || n_nationkey AS version, false AS dev FROM nation UNION ALL SELECT n_nationkey, 'b', CASE WHEN n_nationkey % 2 = 0 THEN '3.' || n_nationkey ELSE '2' END, n_nationkey % 2 = 0 FROM nation
""",
    "seed_lists": "SELECT n_nationkey, '10.0.0.' || n_nationkey AS ip, greatest(0, n_nationkey % 3 - 1)::INT AS failures FROM nation",
    "snapshots": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 0 END AS version, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS found, c_custkey % 3 = 0 AS done, CASE WHEN c_custkey % 3 = 0 THEN 'u' ELSE '' END AS login, c_custkey % 3 = 0 AS checked, CASE WHEN c_custkey % 3 = 0 THEN 'warn' ELSE 'err' END AS verdict FROM customer",
    "release_notes": "SELECT n_nationkey, '1.0.' || n_nationkey AS version, 'x' AS note FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, '2.0.0', n_name FROM nation WHERE n_nationkey % 3 <> 0",
    "skill_names": "SELECT n_nationkey, 'a,b' || n_nationkey || ',' || CASE WHEN n_nationkey % 2 = 0 THEN 'c' || n_nationkey ELSE 'plain' END AS skills FROM nation",
    "patched_settings": "SELECT c_custkey, ['block', 'warn', 'warn', 'skip'][c_custkey % 4 + 1] AS mode, [100, 1, 30][c_custkey % 3 + 1] AS size FROM customer",
    "found_tools": """
WITH p AS (SELECT n_regionkey, 'tool' || (n_nationkey % 4) AS name, CASE WHEN n_nationkey % 3 <> 0 THEN '/bin/t' || n_nationkey END AS path, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 4 ORDER BY n_nationkey) AS n FROM nation)
SELECT n_regionkey, count(*)::INT AS tools, max(path) FILTER (WHERE name = 'tool1') AS tool1 FROM p WHERE n = 1 AND path IS NOT NULL GROUP BY 1
""",
    "outcomes": """
WITH e AS (SELECT event_id AS k FROM events),
p AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'f' || CASE WHEN k % 10 = 0 THEN 'why' WHEN k % 4 = 1 THEN 'blocked' ELSE 'unfinished' END WHEN k % 7 = 0 THEN 'cdry run' WHEN k % 2 = 0 AND k % 3 = 1 THEN 'fremote not updated' WHEN k % 2 = 0 AND k % 3 = 2 THEN 'cpushed, not verified'
  WHEN k % 2 = 0 AND k % 3 = 0 THEN 'cpushed earlier commits' WHEN k % 3 = 0 THEN 'cno changes' ELSE 'ccommitted, not pushed' END AS p,
  CASE WHEN k % 4 = 0 THEN 'f' || CASE WHEN k % 8 = 0 THEN 'e' ELSE 'unknown' END WHEN k % 3 = 0 THEN 'fcanceled' ELSE 'ccloned' END AS c FROM e)
SELECT k AS event_id, CASE p[1] WHEN 'f' THEN 'failed' ELSE 'completed' END AS push, p[2:] AS push_detail, CASE c[1] WHEN 'f' THEN 'failed' ELSE 'completed' END AS clone, c[2:] AS clone_detail FROM p
""",
    "parameter_maps": "SELECT n_nationkey, 'a' AS flag, ['array', 'boolean', 'string'][n_nationkey % 3 + 1] AS type, n_name AS description FROM nation UNION ALL SELECT n_nationkey, 'b', 'string', '' FROM nation",
    "cached_answers": """
WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'private' WHEN 'click' THEN 'public' END AS a FROM events),
l AS (SELECT event_id, ts, last_value(a IGNORE NULLS) OVER w AS a, last_value(CASE WHEN a IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS since FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(since) < 3600000000 THEN a END AS answer FROM l
""",
    "poll_outcomes": """
WITH p AS (SELECT user_id, event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'view' THEN 'none' ELSE 'pending' END AS s FROM events),
d AS (SELECT *, CASE WHEN s = 'none' THEN CASE WHEN t >= 60000000000 THEN 'none' END WHEN s <> 'pending' THEN s WHEN t >= 600000000000 THEN 'timeout' END AS o FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM d WHERE o IS NOT NULL)
SELECT u.user_id, r.o AS outcome, r.t AS elapsed FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r ON r.user_id = u.user_id AND r.n = 1
""",
    "device_flows": """
WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'slow_down' WHEN 'purchase' THEN 'authorized' ELSE 'pending' END AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, min(n) FILTER (WHERE a = 'authorized') AS f FROM e GROUP BY 1)
SELECT e.user_id, CASE WHEN any_value(f.f) IS NULL THEN 'pending' ELSE 'authorized' END AS status, count(*) FILTER (WHERE f.f IS NULL OR n <= f.f) AS answers, 5000 + 5000 * count(*) FILTER (WHERE a = 'slow_down' AND (f.f IS NULL OR n <= f.f)) AS interval_ms FROM e JOIN f USING (user_id) GROUP BY 1
""",
    "line_ring": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) SELECT event_type, string_agg('l' || event_id, chr(10) ORDER BY event_id) AS shown FROM r WHERE n <= 40 GROUP BY 1
""",
    "changed_files": "SELECT l_suppkey AS run, count(DISTINCT l_partkey % 50) AS files, min('f' || (l_partkey % 50)) AS first, max('f' || (l_partkey % 50)) AS last FROM lineitem GROUP BY 1",
    "source_totals": "SELECT p_brand AS brand, count(*) AS n, sum(p_size)::BIGINT AS functions FROM part GROUP BY 1",
}
