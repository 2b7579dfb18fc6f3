"""Queries on the line formats of version control, manifests and test runners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks, parse, paths, shell, strings
from ..operators import graph, sets, text
from ..sources import tables, tagged, workspace
from . import texts

read = tables.read


def _cat(*parts) -> Column:
    """Columns by name or given, joined; other strings begin with = and are literals."""
    one = lambda p: F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else (F.col(p) if isinstance(p, str) else p).cast("string")
    return F.concat(*[one(p) for p in parts])


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    mode, kind = F.when(F.col("p_size") % 3 == 0, "100755").otherwise("100644"), F.when(F.col("p_partkey") % 7 == 0, "tree").otherwise("blob")
    line = F.when(F.col("p_partkey") % 11 == 0, "broken line").otherwise(_cat(mode, "= ", kind, "= ", F.md5("p_name"), "=\tsrc/", "p_brand", "=/", "p_partkey"))
    return p.select("p_partkey", parse.tree_entry(line).alias("e")).filter("e.type = 'blob'").select("p_partkey", "e.mode", "e.sha", "e.path")


def remote_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    listed = _cat("=origin\thttps://x.test/own/", "n_name", "=.git (fetch)\norigin\tgit@x.test:own/", "n_name", "=.git (push)\nnoise", F.when(F.col("n_nationkey") % 3 == 0, _cat("=\nup\thttps://y.test/a/", "n_name", "= (fetch)")).otherwise(""))
    lines = n.select("n_nationkey", F.posexplode(F.split(listed, "\n")).alias("i", "line")).select("n_nationkey", "i", parse.remote_entry(F.col("line")).alias("r")).filter("r IS NOT NULL")
    return lines.select("n_nationkey", "i", "r.*").groupBy("n_nationkey", "name").pivot("kind", ["fetch", "push"]).agg(F.max_by("url", "i"))


def remote_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first remote that names a repository, origin before the rest, and how many remotes point to the wanted one."""
    c = read(spark, sf_dir, "customer")
    origin = F.when(F.col("c_custkey") % 4 == 0, F.lit("nothing")).otherwise(_cat("=https://x.test/Own", F.col("c_custkey") % 3, "=/r.git"))
    remotes = c.select("c_custkey", F.posexplode(F.array(F.struct(F.lit("backup").alias("name"), F.lit("git@x.test:Back/r.git").alias("url")), F.struct(F.lit("origin").alias("name"), origin.alias("url")))).alias("i", "r")).select("c_custkey", "i", "r.name", strings.owner_repo(F.col("r.url")).alias("o"), F.col("r.url").rlike(r"(?i)[/:]own1/r(\.git)?/?$").alias("points"))
    rank = F.when(F.col("name") == "origin", -1).otherwise(F.col("i"))
    return remotes.groupBy("c_custkey").agg(F.min_by("o", F.when(F.col("o").isNotNull(), rank)).alias("o"), F.count_if("points").alias("pointing")).select("c_custkey", F.lower("o.owner").alias("owner"), "o.repo", "pointing")


def grep_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 4 == 0, "https://x.test/own/oldname.git").otherwise("the oldname project")
    line = F.when(F.col("o_orderkey") % 13 == 0, "no hit").otherwise(_cat("=docs/f", F.col("o_custkey") % 17, "=.md:", F.col("o_orderkey") % 1000 + 1, "=:  see ", said))
    hits = o.select(parse.grep_hit(line).alias("h")).filter("h IS NOT NULL").select("h.*")
    return hits.groupBy("file").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("text").rlike(r"(?i)x\.test[/:][^/\s:]+/oldname(\.git)?\b")).alias("url_hits"), F.min("line").alias("first_line"))


def mode_only_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    line = F.when(F.col("s_suppkey") % 3 == 0, _cat("= mode change 100644 => 100755 bin/", "s_name")).otherwise(_cat("= create mode 100644 bin/", "s_name"))
    return s.select("s_suppkey", parse.mode_change(line).alias("path")).filter("path IS NOT NULL")


def tree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    tree = _cat('={"truncated":', F.when(F.col("n_nationkey") % 10 == 3, "true").otherwise("false"), '=,"tree":[{"path":"a/', "n_name", '=","type":"blob","sha":"', F.md5("n_name"), '=","size":', "n_nationkey", '=},{"path":"a","type":"tree","sha":"0"},{"path":"b","type":"blob","sha":"1"}]}')
    return parse.tree_blobs(n.select("n_nationkey", tree.alias("t")), "t", "n_nationkey")


def manifest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    one = lambda file, body: F.struct(F.lit(file).alias("file"), body.alias("text"))
    package = F.when(k % 10 == 0, "{}").otherwise(_cat('={"version":" 3.', k, '=.0 "}'))
    made = F.array_compact(F.array(one("setup.cfg", _cat("=[metadata]\nversion = 1.2.", k, "= # x")), F.when(k % 2 == 0, one("package.json", package)), F.when(k % 3 == 0, one("pyproject.toml", _cat('=[project]\nversion = "0.1.', k, '="')))))
    files = s.select("s_suppkey", F.explode(made).alias("f")).select("s_suppkey", "f.file", "f.text")
    out = parse.project_version(files, "s_suppkey")
    return out.withColumn("mentioned", parse.version_mention(_cat("=release v", "version", "=, not 1.2")))


def env_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    said = _cat("=- cwd: /w/", "n_name", "=\n- tools：node=20 / git = 2.", "n_nationkey", "= / bad\nnot a line\n  - cwd： /x/", "n_nationkey")
    kv = n.select("n_nationkey", parse.key_values(said).alias("kv"))
    return kv.select("n_nationkey", F.element_at("kv", F.lit("cwd")).alias("cwd"), F.element_at(parse.tool_map(F.element_at("kv", F.lit("tools"))), F.lit("git")).alias("git"), F.size(parse.tool_map(F.element_at("kv", F.lit("tools")))).alias("tools"))


def json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    forms = F.array(_cat('={"summary":{"n":1},"props":', "props", "=}\n"), F.lit('{"summary":{}}\n{"summary":{}}'), F.lit('{"summary":3}'), F.lit('{"summary":{}} tail'), F.lit(" \n"), F.lit("[]"))
    said = F.get(forms, (F.col("event_id") % 6).cast("int"))
    return e.select("event_id", F.get_json_object(tagged.line_contract(said), "$.props.k").alias("k"), tagged.line_contract(said).isNotNull().alias("ok"))


def tap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    out = e.select("event_type", _cat("=ok 1\n# tests ", F.col("event_id") % 7, "=\n# pass ", F.col("event_id") % 5, "=\nnot # pass 9\n").alias("text"))
    return parse.tap_counters(out, "text", "event_type")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of parts, each importing that of half its number and one of five libraries."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    own = p.select(_cat("=src/p", k, "=.js").alias("path"), _cat("=import a from './p", F.floor(k / 2), '=\';\nconst b = require("../lib/q', k % 5, '=");\nimport("./missing.js"); import x from "bare";\nrequire("./p1.js" + x); import ("./p2.js", x);\n').alias("text"))
    return own.unionByName(spark.range(5).select(_cat("=lib/q", "id", "=.mjs").alias("path"), F.lit("").alias("text")))


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.import_edges(_sources(spark, sf_dir))


def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("src/p100.js",)], "node string")
    return graph.reach(parse.import_edges(_sources(spark, sf_dir)), start, 50)


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    url = F.when(k % 3 == 0, _cat("=https://u@Reg.test:81/npm", k, "=/")).when(k % 3 == 1, "http://reg.test").otherwise(" ")
    page = F.when(k % 2 == 0, _cat("=---\ntitle: x\nname: 'n", k, "='\n---\nbody")).otherwise("name: not in front")
    source = _cat("=const KNOWN_FLAGS = ['--f", k, "=', '--dry-run', \"--no\"];\nconst A = ['--x'];")
    return c.select("c_custkey", parse.registry_prefix(url).alias("prefix"), parse.registry_url(url, "https://default.test").alias("registry"), parse.front_matter_name(page).alias("name"), F.array_join(parse.entry_flags(source), ",").alias("flags"), parse.escaped_pattern(_cat("=a.b(", k, "=)*")).alias("escaped"))


def hook_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    body = F.when(k % 3 == 0, _cat("=#!/bin/absent", k, "=\n/home/u/none")).when(k % 3 == 1, _cat('=#!/bin/sh\nexec "/home/u', k, '=/run" x')).otherwise("#!/usr/bin/env node\n/usr/lib/x")
    existing = spark.createDataFrame([("/bin/sh",), ("/usr/bin/env",)], "path string").unionByName(s.filter(k % 2 == 0).select(_cat("=/home/u", k, "=/run").alias("path")))
    return parse.hook_faults(s.select(F.col("s_name").alias("name"), (k % 5 != 0).alias("executable"), body.alias("text")), existing)


def ignore_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    existing = n.select(F.col("n_name").alias("repo"), F.explode(F.array(F.lit("*.log"), F.when(k % 3 == 0, " node_modules ").otherwise("x"))).alias("line"))
    custom = n.select(F.col("n_name").alias("repo"), F.explode(F.array(F.lit("*.log"), F.lit(" "), _cat("=out", k % 2, "=/"))).alias("line"))
    return parse.ignore_additions(existing, ["node_modules/", "dist/"], custom)


def sensitive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    made = F.when(k % 5 == 0, "\ncookie='abcd'\nx.password: \"pw1\",\ncookie: 'efgh'").otherwise("")
    head = F.when(k % 20 == 0, "// skip-sensitive\n").otherwise("")
    path = F.when(k % 50 == 5, _cat("=d", k, "=/server.pem")).when(k % 50 == 10, _cat("=d", k, "=.png")).when(k % 50 == 15, _cat("=d", k, "=/github-token")).when(k % 50 == 20, _cat("=d", k, "=/.own-token")).otherwise(_cat("=d", k, "=.txt"))
    return text.sensitive_files(d.select(path.alias("path"), _cat(head, F.coalesce("text", F.lit("")), made).alias("text")), more_names=(".own-token",)).select("path", F.array_join("fields", ",").alias("fields"))


def category_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda n, *of: F.get(F.array(*[F.lit(x) for x in of]), (k % n).cast("int"))
    file = _cat(pick(4, "test/a", "scripts/b", "src/latest/c", "bin/cli.mjs"), F.when(k % 4 == 3, "").otherwise(".js"))
    rule, kind = pick(5, "Console-Log", "performance/x", "secret", "sync-fs", "empty-catch"), pick(3, "regex", "residue", "func")
    return e.select("event_id", text.category_exempt(file, rule, kind).alias("exempt"))


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    line = F.concat_ws("\x1f", F.md5(F.col("o_orderkey").cast("string")), _cat("=a", "o_custkey", "=@x.test"), F.when(F.col("o_orderkey") % 9 != 0, _cat("=c", "o_custkey", "=@x.test")))
    return workspace.delimited_log(o.select(line.alias("value")), ["sha", "author", "committer"])


def short_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    line = F.get(F.array(_cat("= M src/", k), _cat("=?? new/", k), _cat("=D  old/", k), _cat("=R  a/", k, "= -> b/", k), _cat('=A  "quoted ', k, '="'), F.lit("")), (k % 6).cast("int"))
    return workspace.porcelain_changes(p.select("p_brand", line.alias("text")), "text", "p_brand")


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    row = workspace.probe_row(_cat("=/w/", "s_name", "=/"), F.lit("main\n"), F.when(k % 2 == 0, "git@x.test:o/r.git\n").otherwise(""), F.when(k % 3 == 0, " M a\n?? b\n").otherwise("\n"), _cat("=last ", k), F.when(k % 5 == 0, "fork/main").otherwise(""), F.when(k % 4 == 0, "").otherwise(_cat(k % 7, "=\t", k % 3)))
    return s.select("s_suppkey", row.alias("r")).select("s_suppkey", "r.name", "r.changed", "r.has_remote", "r.upstream", "r.ahead", "r.behind")


def command_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    line = _cat("=./bin/run --name \"a ", k, "=\" 'b \\ c' d\\ e ''")
    w = shell.words(line)
    return s.select("s_suppkey", w.alias("w")).select("s_suppkey", F.size("w").alias("n"), shell.rendered(F.col("w")).alias("line"), shell.label(F.col("w")).alias("label"), shell.filled(F.lit("{a}-{b}"), {"a": "x"}).alias("filled"))


def marked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    page = F.when(k % 5 == 0, "no marks").otherwise(_cat("=# ", "n_name", "=\n<!-- a -->\n old ", k % 2, "=\n<!-- b -->\nend"))
    return n.select("n_nationkey", blocks.block(page, "<!-- a -->", "<!-- b -->").alias("block"), blocks.replaced(page, "<!-- a -->", "<!-- b -->", F.lit("new")).alias("page"), blocks.drifted(page, "<!-- a -->", "<!-- b -->", F.lit("old 1 ")).alias("drifted"))


def block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", _cat("n_name", "=|x").alias("name"))
    return blocks.table_lines(n, ["n_regionkey"], ["n_nationkey", "name"], "n_nationkey")


def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    return blocks.tree_counts(p.select(F.get(F.array(_cat("p_brand", "=/f"), _cat("p_brand", "=/s", k % 3, "=/f"), _cat("p_brand", "=/s", k % 3, "=/t/f"), F.lit("top")), (k % 4).cast("int")).alias("path")))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    path = F.when(k % 10 == 0, "top.js").otherwise(_cat("p_brand", "=/x/", k, "=.js"))
    return p.select("p_partkey", paths.basename(path).alias("base"), paths.dirname(path).alias("dir"), paths.joined(paths.dirname(path), F.lit("./../y.js")).alias("beside"), paths.side(path).alias("side"))


def flag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in a fixed order against those that are there: what is missing and what is extra, and the rest joined in order."""
    order = spark.createDataFrame([(i, f"REGION{i}") for i in range(7)], "ord int, name string")
    there = read(spark, sf_dir, "nation").select(_cat("=REGION", "n_regionkey").alias("name"), F.col("n_name").alias("body")).groupBy("name").agg(F.min("body").alias("body")).unionByName(spark.createDataFrame([("OTHER", "x")], "name string, body string"))
    side = sets.membership(order, there, "name")
    return side.join(order, "name", "left").join(there, "name", "left").select("name", "side", "ord", "body")


QUERIES = {
    f.__name__: f
    for f in (
        tree_listing, remote_map, remote_choice, grep_hits, mode_only_changes, tree_json, manifest_versions, env_block, json_contract, tap_totals, import_edges, import_closure, text_forms, hook_faults,
        ignore_additions, sensitive_files, category_exempt, commit_log, short_status, probe_rows, command_words, marked_blocks, block_tables, tree_levels, path_parts, flag_difference,
    )
}

_EDGES = """SELECT 'src/p' || p_partkey || '.js' AS src, 'src/p' || (p_partkey // 2) || '.js' AS dst FROM part WHERE p_partkey // 2 IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'src/p' || p_partkey || '.js', 'lib/q' || (p_partkey % 5) || '.mjs' FROM part"""

ORACLES = {
    "sensitive_files": f"""
WITH d AS (SELECT 'd' || doc_id || CASE WHEN doc_id % 50 = 5 THEN '/server.pem' WHEN doc_id % 50 = 10 THEN '.png' WHEN doc_id % 50 = 15 THEN '/github-token' WHEN doc_id % 50 = 20 THEN '/.own-token' ELSE '.txt' END AS path, CASE WHEN doc_id % 20 = 0 THEN '// skip-sensitive' || chr(10) ELSE '' END || coalesce(text, '')
  || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'cookie=''abcd''' || chr(10) || 'x.password: "pw1",' || chr(10) || 'cookie: ''efgh''' ELSE '' END AS text FROM documents),
r AS (SELECT path, string_split(text, chr(10)) AS l FROM d WHERE NOT ends_with(path, '.pem') AND NOT ends_with(path, '-token') AND NOT ends_with(path, '.png') AND strlen(text) <= 524288 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')),
l AS (SELECT path, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM r WHERE NOT regexp_matches(array_to_string(l[1:3], chr(10)), '(?i)skip-sensitive')),
c AS (SELECT path, line_no, regexp_replace(line, '^[#;/*\\s]+', '') AS c FROM l WHERE NOT regexp_matches(line, '(?i)skip-sensitive') AND NOT regexp_matches(line, '{text.EXAMPLE_LINE}')),
f AS (SELECT path, field, min(line_no) AS n FROM (SELECT path, line_no, {texts.sensitive_case()} AS field FROM c) WHERE field IS NOT NULL GROUP BY 1, 2)
SELECT path, string_agg(field, ',' ORDER BY n) AS fields FROM f GROUP BY 1 UNION ALL SELECT path, 'filename' FROM d WHERE ends_with(path, '.pem') OR ends_with(path, '-token')
""",
    "tree_listing": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '100755' ELSE '100644' END AS mode, md5(p_name) AS sha, 'src/' || p_brand || '/' || p_partkey AS path FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 0",
    "remote_map": """
SELECT n_nationkey, 'origin' AS name, 'https://x.test/own/' || n_name || '.git' AS fetch, 'git@x.test:own/' || n_name || '.git' AS push FROM nation WHERE n_name NOT LIKE '% %'
UNION ALL SELECT n_nationkey, 'up', 'https://y.test/a/' || n_name, NULL FROM nation WHERE n_nationkey % 3 = 0 AND n_name NOT LIKE '% %'
""",
    "remote_choice": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'back' ELSE 'own' || (c_custkey % 3) END AS owner, 'r' AS repo, (c_custkey % 4 <> 0 AND c_custkey % 3 = 1)::BIGINT AS pointing FROM customer",
    "grep_hits": "SELECT 'docs/f' || (o_custkey % 17) || '.md' AS file, count(*) AS hits, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS url_hits, min(o_orderkey % 1000 + 1)::INT AS first_line FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1",
    "mode_only_changes": "SELECT s_suppkey, 'bin/' || s_name AS path FROM supplier WHERE s_suppkey % 3 = 0",
    "tree_json": """
SELECT n_nationkey, 'a/' || n_name AS path, md5(n_name) AS sha, n_nationkey::BIGINT AS size FROM nation WHERE n_nationkey % 10 <> 3
UNION ALL SELECT n_nationkey, 'b', '1', 0 FROM nation WHERE n_nationkey % 10 <> 3
""",
    "manifest_versions": """
WITH v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'package.json' WHEN s_suppkey % 3 = 0 THEN 'pyproject.toml' ELSE 'setup.cfg' END AS source,
  CASE WHEN s_suppkey % 10 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN '3.' || s_suppkey || '.0' WHEN s_suppkey % 3 = 0 THEN '0.1.' || s_suppkey ELSE '1.2.' || s_suppkey END AS version FROM supplier)
SELECT *, version AS mentioned FROM v
""",
    "env_block": "SELECT n_nationkey, '/x/' || n_nationkey AS cwd, '2.' || n_nationkey AS git, 2 AS tools FROM nation",
    "json_contract": "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN json_extract_string(props, '$.k') END AS k, event_id % 6 = 0 AS ok FROM events",
    "tap_totals": "SELECT event_type, 'tests' AS key, sum(event_id % 7)::BIGINT AS total FROM events GROUP BY 1 UNION ALL SELECT event_type, 'pass', sum(event_id % 5)::BIGINT FROM events GROUP BY 1",
    "import_edges": _EDGES,
    "import_closure": f"""
WITH RECURSIVE e AS ({_EDGES}), r(node, distance) AS (SELECT 'src/p100.js', 0 UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node AND r.distance < 50 AND e.src <> e.dst)
SELECT node, min(distance)::INT AS distance FROM r GROUP BY 1
""",
    "text_forms": r"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '//reg.test:81/npm' || c_custkey || '/' WHEN 1 THEN '//reg.test/' ELSE '' END AS prefix,
  CASE c_custkey % 3 WHEN 0 THEN 'https://u@Reg.test:81/npm' || c_custkey WHEN 1 THEN 'http://reg.test' ELSE 'https://default.test' END AS registry,
  CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_custkey END AS name, '--f' || c_custkey || ',--dry-run' AS flags, 'a\.b\(' || c_custkey || '\)\*' AS escaped FROM customer
""",
    "hook_faults": "SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'interpreter' WHEN s_suppkey % 3 = 1 AND s_suppkey % 2 = 1 THEN 'path' END AS fault FROM supplier WHERE s_suppkey % 5 <> 0",
    "ignore_additions": """
SELECT n_name AS repo, 'node_modules/' AS line, 'baseline' AS kind FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT n_name, 'dist/', 'baseline' FROM nation UNION ALL SELECT n_name, 'out' || (n_nationkey % 2) || '/', 'custom' FROM nation
""",
    "category_exempt": """
WITH e AS (SELECT event_id, event_id % 4 AS f, lower(['Console-Log', 'performance/x', 'secret', 'sync-fs', 'empty-catch'][event_id % 5 + 1] || ' ' || ['regex', 'residue', 'func'][event_id % 3 + 1]) AS t FROM events)
SELECT event_id, (f = 0 AND regexp_matches(t, 'residue|console-log|sync-fs|empty-catch|performance')) OR (f IN (1, 3) AND regexp_matches(t, 'residue|console-log|sync-fs')) AS exempt FROM e
""",
    "commit_log": "SELECT md5(o_orderkey::VARCHAR) AS sha, 'a' || o_custkey || '@x.test' AS author, CASE WHEN o_orderkey % 9 <> 0 THEN 'c' || o_custkey || '@x.test' END AS committer FROM orders",
    "short_status": """
SELECT p_brand, ['M', 'A', 'D', 'A', 'A'][p_partkey % 6 + 1] AS status, ['src/', 'new/', 'old/', 'b/', 'quoted '][p_partkey % 6 + 1] || p_partkey AS path FROM part WHERE p_partkey % 6 < 5
""",
    "probe_rows": """
SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END AS changed, s_suppkey % 2 = 0 AS has_remote, CASE WHEN s_suppkey % 5 = 0 THEN 'fork/main' ELSE 'origin/main' END AS upstream,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 END::INT AS ahead, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 3 END::INT AS behind FROM supplier
""",
    "command_words": r"""
SELECT s_suppkey, 6 AS n, './bin/run --name "a ' || s_suppkey || '" "b \ c" "d e" ' AS line, 'bin/run' AS label, 'x-{b}' AS filled FROM supplier
""",
    "marked_blocks": """
SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN 'old ' || (n_nationkey % 2) END AS block,
  CASE WHEN n_nationkey % 5 = 0 THEN 'no marks' ELSE '# ' || n_name || chr(10) || '<!-- a -->' || chr(10) || 'new' || chr(10) || '<!-- b -->' || chr(10) || 'end' END AS page,
  NOT (n_nationkey % 5 <> 0 AND n_nationkey % 2 = 1) AS drifted FROM nation
""",
    "block_tables": r"""
SELECT n_regionkey, '| n_nationkey | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || '\|x |', chr(10) ORDER BY n_nationkey) AS lines FROM nation GROUP BY 1
""",
    "tree_levels": """
SELECT CASE WHEN p_partkey % 4 = 3 THEN 'top' ELSE p_brand END AS first, CASE WHEN p_partkey % 4 IN (1, 2) THEN 's' || (p_partkey % 3) END AS second,
  count(*) FILTER (WHERE p_partkey % 4 <> 2) AS files, count(*) FILTER (WHERE p_partkey % 4 = 2) AS deeper FROM part GROUP BY 1, 2
""",
    "path_parts": """
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'top.js' ELSE p_partkey || '.js' END AS base, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand || '/x' END AS dir,
  CASE WHEN p_partkey % 10 = 0 THEN 'y.js' ELSE p_brand || '/y.js' END AS beside, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_brand END AS side FROM part
""",
    "flag_difference": """
WITH o AS (SELECT i AS ord, 'REGION' || i AS name FROM range(7) AS t(i)), r AS (SELECT 'REGION' || n_regionkey AS name, min(n_name) AS body FROM nation GROUP BY 1 UNION ALL SELECT 'OTHER', 'x')
SELECT coalesce(o.name, r.name) AS name, CASE WHEN r.name IS NULL THEN 'left' WHEN o.name IS NULL THEN 'right' ELSE 'both' END AS side, ord::INT AS ord, body FROM o FULL JOIN r ON o.name = r.name
""",
}
