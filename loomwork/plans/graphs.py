"""Queries over graphs and trees that are made of the tables' columns: bounded walks, closures, histories of paths, marked directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import directories, graph, history
from ..sources import tables

read = tables.read


def bounded_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen parts that a queue visits from every ninety-seventh, over the parts that stand before them in orders."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    before = li.select(F.col("l_partkey").alias("node"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.lag("l_partkey").over(w).alias("parent")).filter("parent IS NOT NULL")
    parents = before.groupBy("node", "ord").agg(F.min("parent").alias("parent"))
    starts = read(spark, sf_dir, "part").filter(F.col("p_partkey") % 97 == 0).select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("node"))
    return graph.walk(starts, parents, 15)


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each part: it names the part, imports that of half its number, and the next one if it is of some types, which may import it back."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    text = lambda *cs: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in cs])
    half = text("import a from './p", F.floor(k / 2).cast("string"), "';\n")
    following = F.when(F.col("p_type").startswith("S"), text("const b = require( '../src/p", (k + 1).cast("string"), ".js' );\n")).otherwise("")
    back = F.when(F.col("p_size") % 4 == 0, text("await import('./p", (k - 1).cast("string"), "')\n")).otherwise("")
    broken = text("require('./p", (k + 2).cast("string"), "' + x); // not an import\n")
    return p.select(k, text("src/p", k.cast("string"), ".js").alias("path"), text("// ", F.col("p_name"), "\n", half, following, back, broken).alias("text"))


def closure_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every fiftieth file: a digest of all that it imports, directly or not, in circles or not."""
    files = _modules(spark, sf_dir)
    entries = files.filter(F.col("p_partkey") % 50 == 7).select(F.col("path").alias("entry"))
    return graph.closure_keys(files, parse.import_edges(files), entries, salt="v1")


def stale_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files run again after some of the files changed, and why: their own text did, or one behind it."""
    now = _modules(spark, sf_dir)
    text = F.when(F.col("p_partkey") % 31 == 5, F.concat("text", F.lit("// changed\n"))).otherwise(F.col("text"))
    was = now.filter(F.col("p_partkey") % 211 != 3).withColumn("text", text)
    entries = now.filter(F.col("p_partkey") % 20 == 5).select(F.col("path").alias("entry"))
    keys = lambda files: graph.closure_keys(files, parse.import_edges(files), entries, salt="v1")
    old = keys(was).select("entry", F.col("key").alias("was_key"), F.col("self").alias("was_self"))
    reason = F.when(F.col("key") == F.col("was_key"), "hit").when(F.col("was_self").isNull(), "first").when(F.col("self") != F.col("was_self"), "changed").otherwise("dependency")
    return keys(now).join(old.hint("merge"), "entry").select("entry", (reason != "hit").alias("run"), reason.alias("reason"))


def _order_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Steps, what they hold, and to how many parts both are dealt: as many as their rows need, so that no task's share grows with the tables."""
    o, li = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), read(spark, sf_dir, "lineitem")
    path = F.concat("l_returnflag", F.lit("/"), (F.col("l_partkey") % 7).cast("string"))
    held = li.select(F.col("l_orderkey").alias("o_orderkey"), path.alias("path"), F.col("l_linestatus").alias("mode"), (F.col("l_quantity") > 25).alias("sha"))
    parts = history.parts_for(spark, li.count())
    return o, held.repartition(parts, "o_orderkey").join(o.repartition(parts, "o_orderkey"), "o_orderkey"), parts


def path_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order of a customer adds, changes and removes against the one before it, from intervals of paths."""
    steps, held, parts = _order_trees(spark, sf_dir)
    spans = history.intervals(steps, held, "o_custkey", "o_orderkey", "path", ["mode", "sha"], parts)
    ends = steps.repartition(parts, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("steps"))
    return history.changes(spans, "o_custkey", "path", ["mode", "sha"], ends)


def replay_from_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by step that are left to replay, where customers' markers name an order of theirs or of someone else."""
    steps, held, parts = _order_trees(spark, sf_dir)
    steps = steps.repartition(parts, "o_custkey")
    spans = history.intervals(steps, held, "o_custkey", "o_orderkey", "path", ["mode", "sha"], parts)
    ends = steps.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("steps"))
    c = read(spark, sf_dir, "customer")
    middle = steps.join(c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey"))).alias("o_orderkey"))
    marked = middle.unionByName(c.filter("c_acctbal <= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("long").alias("o_orderkey")))
    done = history.resume_place(steps, marked, "o_custkey", "o_orderkey", parts)
    left = history.changes(spans, "o_custkey", "path", ["mode", "sha"], ends).join(done, "o_custkey").filter(F.col("step") > F.col("done")).repartition(parts, "o_custkey")
    return left.groupBy("o_custkey", "step").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("change") == "removed").alias("removed"))


def marked_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files by host and path, those of hosts or folders that aren't read left out, and which are shown only."""
    p = read(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1)
    files = p.select("page_id", path.alias("file"), F.octet_length("html").alias("bytes"))
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    marks = p.select(F.concat(folder, F.lit("/.samples")).alias("path"), (F.length("html") % 3).alias("size"), path.alias("of")).filter(F.length("of") % 4 == 0)
    hosts = p.select(F.concat(F.substring_index(path, "/", 1), F.lit("/.test")).alias("path"), (F.length("html") % 2).alias("size"), path.alias("of")).filter(F.length("of") % 9 == 0)
    listing = marks.unionByName(hosts).filter(~F.col("path").startswith("/")).select("path", "size")
    return directories.judged(files, listing, "file").select("page_id", "shown_only")


def collated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty names of each brand's parts and types, of either case, as readers order them."""
    p = read(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 3 == 0, F.initcap("p_name")).when(F.col("p_size") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name"))
    names = p.select("p_brand", name.alias("name")).unionByName(p.select("p_brand", F.lower("p_type").alias("name"))).distinct()
    return directories.collated(names, ["p_brand"], "name", 40)


QUERIES = {f.__name__: f for f in (bounded_walks, closure_keys, stale_tests, path_history, replay_from_marker, marked_directories, collated_names)}

_FILES = """SELECT p_partkey AS k, p_partkey // 2 AS half, CASE WHEN p_type LIKE 'S%' THEN p_partkey + 1 END AS nxt, CASE WHEN p_size % 4 = 0 THEN p_partkey - 1 END AS back,
  '// ' || p_name || chr(10) || 'import a from ''./p' || (p_partkey // 2) || ''';' || chr(10) || CASE WHEN p_type LIKE 'S%' THEN 'const b = require( ''../src/p' || (p_partkey + 1) || '.js'' );' || chr(10) ELSE '' END
  || CASE WHEN p_size % 4 = 0 THEN 'await import(''./p' || (p_partkey - 1) || ''')' || chr(10) ELSE '' END || 'require(''./p' || (p_partkey + 2) || ''' + x); // not an import' || chr(10) AS text FROM part"""
_DIFFS = """s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders),
t AS (SELECT o_custkey, step, l_returnflag || '/' || (l_partkey % 7) AS path, min({'m': l_linestatus, 's': l_quantity > 25}) AS st FROM s JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
n AS (SELECT o_custkey, max(step) AS steps FROM s GROUP BY 1),
d AS (SELECT b.o_custkey, b.step, b.path, CASE WHEN a.path IS NULL THEN 'added' ELSE 'changed' END AS change, b.st FROM t b LEFT JOIN t a ON a.o_custkey = b.o_custkey AND a.path = b.path AND a.step = b.step - 1 WHERE a.path IS NULL OR a.st <> b.st
  UNION ALL SELECT a.o_custkey, a.step + 1, a.path, 'removed', NULL FROM t a JOIN n USING (o_custkey) LEFT JOIN t b ON a.o_custkey = b.o_custkey AND a.path = b.path AND b.step = a.step + 1 WHERE a.step < steps AND b.path IS NULL)"""


def _keys(files: str, entries: str, name: str) -> str:
    """CTEs of closures and keys of files (k, half, nxt, back, text), under a name."""
    return f"""f{name} AS ({files}), x{name} AS (SELECT k, unnest([half, nxt, back]) AS t FROM f{name}), e{name} AS (SELECT DISTINCT x.k, x.t FROM x{name} x JOIN f{name} f ON f.k = x.t),
r{name}(entry, k) AS (SELECT p_partkey, p_partkey FROM part WHERE {entries} UNION SELECT r.entry, e.t FROM r{name} r JOIN e{name} e ON e.k = r.k),
k{name} AS (SELECT 'src/p' || entry || '.js' AS entry, count(*) AS files, sha256('v1' || chr(10) || string_agg('src/p' || r.k || '.js' || chr(10) || coalesce(sha256(text), '<missing>') || chr(10), '' ORDER BY 'src/p' || r.k || '.js')) AS key, max(CASE WHEN entry = r.k THEN sha256(text) END) AS self FROM r{name} r LEFT JOIN f{name} f ON f.k = r.k GROUP BY entry)"""


ORACLES = {
    "collated_names": """
WITH n AS (SELECT p_brand, CASE p_size % 3 WHEN 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') WHEN 1 THEN upper(p_name) ELSE p_name END AS name FROM part UNION SELECT p_brand, lower(p_type) FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY name COLLATE en, name) AS place FROM n)
SELECT * FROM r WHERE place <= 40
""",
    "bounded_walks": """
WITH RECURSIVE l AS (SELECT l_partkey AS node, l_orderkey * 8 + l_linenumber AS ord, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS parent FROM lineitem),
o AS (SELECT node, ord, min(parent) AS parent FROM l WHERE parent IS NOT NULL GROUP BY 1, 2),
p AS (SELECT node, list(parent ORDER BY ord) AS ps FROM o GROUP BY 1),
q(root, queue, seen) AS (SELECT p_partkey, [p_partkey], []::BIGINT[] FROM part WHERE p_partkey % 97 = 0
  UNION ALL SELECT root, CASE WHEN list_contains(seen, queue[1]) THEN queue[2:] ELSE list_concat(queue[2:], list_filter(coalesce(ps, []), lambda x: x <> queue[1] AND NOT list_contains(seen, x))) END, CASE WHEN list_contains(seen, queue[1]) THEN seen ELSE list_append(seen, queue[1]) END
  FROM q LEFT JOIN p ON p.node = queue[1] WHERE len(queue) > 0 AND len(seen) < 15),
e AS (SELECT root, seen, len(queue) > 0 AS truncated FROM q WHERE len(queue) = 0 OR len(seen) = 15)
SELECT root, unnest(seen) AS node, generate_subscripts(seen, 1) AS place, truncated FROM e
""",
    "closure_keys": f"WITH RECURSIVE {_keys(_FILES, 'p_partkey % 50 = 7', '1')} SELECT * FROM k1",
    "stale_tests": f"""
WITH RECURSIVE {_keys(_FILES, "p_partkey % 20 = 5", "1")}, {_keys(f"SELECT k, half, nxt, back, text || CASE WHEN k % 31 = 5 THEN '// changed' || chr(10) ELSE '' END AS text FROM ({_FILES}) WHERE k % 211 <> 3", "p_partkey % 20 = 5", "2")}
SELECT k1.entry, k1.key IS DISTINCT FROM k2.key AS run, CASE WHEN k1.key = k2.key THEN 'hit' WHEN k2.self IS NULL THEN 'first' WHEN k1.self <> k2.self THEN 'changed' ELSE 'dependency' END AS reason FROM k1 JOIN k2 USING (entry)
""",
    "path_history": f"WITH {_DIFFS} SELECT o_custkey, step, path, change, st.m AS mode, st.s AS sha FROM d",
    "replay_from_marker": f"""
WITH {_DIFFS},
m AS (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderkey % 5 <> 0) AS o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1),
z AS (SELECT n.o_custkey, coalesce(max(s.step), 0) AS done FROM n LEFT JOIN m USING (o_custkey) LEFT JOIN s ON s.o_custkey = m.o_custkey AND s.o_orderkey = m.o_orderkey GROUP BY 1)
SELECT o_custkey, step, count(*) AS changes, count(*) FILTER (WHERE change = 'removed') AS removed FROM d JOIN z USING (o_custkey) WHERE step > done GROUP BY 1, 2
""",
    "marked_directories": r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS path, length(html) AS n FROM pages),
q AS (SELECT page_id, list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')) AS s, path, n FROM p),
f AS (SELECT page_id, array_to_string(s[1:len(s) - 1], '/') AS dir, path, n FROM q),
d AS (SELECT DISTINCT array_to_string(list_filter(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda s: s NOT IN ('', '.')), '/') AS dir FROM f WHERE length(path) % 4 = 0 AND n % 3 = 0 AND path NOT LIKE '/%' AND path LIKE '%/%'),
t AS (SELECT DISTINCT string_split(path, '/')[1] AS dir FROM f WHERE length(path) % 9 = 0 AND n % 2 = 0 AND path NOT LIKE '/%' AND path <> '')
SELECT page_id, EXISTS (SELECT 1 FROM d WHERE f.dir = d.dir OR starts_with(f.dir, d.dir || '/')) AS shown_only FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE f.dir = t.dir OR starts_with(f.dir, t.dir || '/'))
""",
}
