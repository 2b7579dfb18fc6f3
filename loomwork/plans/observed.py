"""Parsers over lines that the tables' own texts, names, addresses and numbers make up, with whatever odd values these hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, strings
from ..operators import text
from ..sources import tables, tagged, workspace

read = tables.read


def _cat(*cs):
    return F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in cs])


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a search for a word in all lines of documents, by file: how many, the first and last line, and the longest hit."""
    d = read(spark, sf_dir, "documents").select(_cat(F.col("source"), "/", F.col("doc_id").cast("string"), ".txt").alias("path"), "text")
    found = text.lines_of(d, "text", "path").filter(F.contains("line", F.lit("und")) | F.contains("line", F.lit("the")))
    hits = found.select(parse.grep_hit(_cat(F.col("path"), ":", F.col("line_no").cast("string"), ":", F.col("line"))).alias("h")).filter("h IS NOT NULL").select("h.*")
    return hits.groupBy("file").agg(F.count(F.lit(1)).alias("hits"), F.min("line").alias("first"), F.max("line").alias("last"), F.max(F.length("text")).alias("longest"))


def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, changed and deleted files of each order, from a short status of its lines: two letters, names with spaces, quotes and renames."""
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    code = F.when(F.col("l_tax") < 0.02, "??").when(F.col("l_tax") < 0.04, _cat(" ", F.when(F.col("l_linestatus") == "O", "M").otherwise("D"))).when(F.col("l_tax") < 0.06, _cat(F.when(F.col("l_returnflag") == "A", "A").otherwise("R"), " ")).otherwise(F.concat("l_returnflag", "l_linestatus"))
    name = _cat(F.col("p_type"), "/", F.col("p_name"))
    path = F.when(F.col("l_returnflag") == "R", _cat('"', name, '"')).otherwise(name)
    line = _cat(code, " ", F.when(F.substring(code, 1, 1) == "R", _cat(F.col("p_brand"), " -> ")).otherwise(""), path)
    changes = workspace.porcelain_changes(li.select(F.col("l_orderkey"), line.alias("text")), "text", "l_orderkey")
    return changes.groupBy("l_orderkey").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in "AMD"], F.min("path").alias("first"), F.max("path").alias("last"))


def page_remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remotes whose addresses are those of pages, as they are: which lines are remotes, of what kind, with the address masked."""
    p = read(spark, sf_dir, "pages")
    kind = F.when(F.length("html") % 3 == 0, "fetch").when(F.length("html") % 3 == 1, "push").otherwise("pull")
    line = _cat("r", F.col("page_id").cast("string"), "\t", F.coalesce("url", F.lit("")), " (", kind, ")")
    rows = p.select("page_id", parse.remote_entry(line).alias("r")).filter("r IS NOT NULL")
    return rows.select("page_id", F.col("r.kind").alias("kind"), F.length("r.url").alias("chars"))


def log_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a log whose lines are orders: customers' names, dates and statuses with an unusual separator, some lines cut short."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sep = F.lit("\x1f")
    whole = F.concat(F.col("o_orderkey").cast("string"), sep, F.col("c_name"), sep, F.col("c_mktsegment"), sep, F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.when(F.col("o_totalprice") < 50_000, F.substring_index(whole, "\x1f", 2)).when(F.col("o_orderstatus") == "P", F.concat(whole, sep, F.lit("more"))).otherwise(whole)
    rows = workspace.delimited_log(o.select(line.alias("value")), ["sha", "name", "segment", "day"])
    return rows.select(F.col("sha").cast("long").alias("o_orderkey"), "name", "segment", "day")


def stated_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a part's first manifest states, from its price and size, quoted or bare, and the first one that its description mentions."""
    p = read(spark, sf_dir, "part")
    version = F.concat_ws(".", F.floor(F.col("p_retailprice") / 100).cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"))
    forms = [
        ("package.json", _cat('{"name": "', F.col("p_name"), '", "version": "', version, '"}'), F.col("p_brand").endswith("1")),
        ("Cargo.toml", _cat("[package]\nname = '", F.col("p_name"), "'\nversion = '", version, "'\n"), F.col("p_type").startswith("S")),
        ("setup.cfg", _cat("[metadata]\nversion= ", version, "  # ", F.col("p_type")), F.col("p_size") > 20),
        ("README.md", version, F.lit(True)),
    ]
    made = F.array_compact(F.array(*[F.when(there, F.struct(F.lit(file).alias("file"), body.alias("text"))) for file, body, there in forms]))
    out = parse.project_version(p.select("p_partkey", F.explode(made).alias("f")).select("p_partkey", "f.file", "f.text"), "p_partkey")
    said = _cat(F.col("p_name"), " v", version, ", before ", F.col("p_size").cast("string"), ".0.1")
    return out.join(p.select("p_partkey", parse.version_mention(said).alias("mentioned")), "p_partkey")


def event_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers on one line around events' own JSON: which keep the contract, and the number that they carry."""
    e = read(spark, sf_dir, "events")
    said = F.when(F.col("value") < 20, _cat('{"summary":', F.col("props"), "}\n")).when(F.col("value") < 60, _cat('{"summary":{"v":', F.col("value").cast("string"), '},"props":', F.col("props"), "}")).when(F.col("value") < 90, _cat(F.col("props"), "\n", F.col("props"))).otherwise(_cat('{"summary":', F.substring("props", 1, 6)))
    kept = tagged.line_contract(said)
    return e.select("event_id", kept.isNotNull().alias("ok"), F.coalesce(F.get_json_object(kept, "$.props.k"), F.get_json_object(kept, "$.summary.k")).alias("k"))


def mail_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner and repository of addresses of four forms that customers' names and segments make."""
    c = read(spark, sf_dir, "customer")
    who, what = F.regexp_replace("c_name", "#", "-"), F.lower("c_mktsegment")
    url = F.when(F.col("c_nationkey") % 5 == 0, _cat("git@Host.test:", who, "/", what, ".git")).when(F.col("c_nationkey") % 5 == 1, _cat("https://x:y@host.test/", who, "/", what)).when(F.col("c_nationkey") % 5 == 2, _cat("ssh://git@ssh.host.test:443/", who, "/", what, ".git/")).when(F.col("c_nationkey") % 5 == 3, who).otherwise(_cat("https://host.test/", what))
    return c.select("c_custkey", strings.owner_repo(url).alias("o")).select("c_custkey", "o.owner", "o.repo")


QUERIES = {f.__name__: f for f in (text_search, line_states, page_remotes, log_people, stated_versions, event_contracts, mail_names)}

ORACLES = {
    "text_search": r"""
WITH l AS (SELECT source || '/' || doc_id || '.txt' AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT file, count(*) AS hits, min(n)::INT AS first, max(n)::INT AS last, max(length(trim(line)))::INT AS longest FROM l WHERE contains(line, 'und') OR contains(line, 'the') GROUP BY file
""",
    "line_states": """
WITH j AS (SELECT l_orderkey, CASE WHEN l_tax < 0.02 THEN 'A' WHEN l_tax < 0.04 THEN CASE WHEN l_linestatus = 'O' THEN 'M' ELSE 'D' END WHEN l_tax < 0.06 THEN 'A' WHEN l_returnflag IN ('A', 'R') THEN 'A' END AS status, p_type || '/' || p_name AS path FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, count(*) FILTER (WHERE status = 'A') AS a, count(*) FILTER (WHERE status = 'M') AS m, count(*) FILTER (WHERE status = 'D') AS d, min(path) AS first, max(path) AS last FROM j WHERE status IS NOT NULL GROUP BY 1
""",
    "page_remotes": r"""
SELECT page_id, CASE length(html) % 3 WHEN 0 THEN 'fetch' ELSE 'push' END AS kind, length(url)::INT AS chars FROM pages WHERE length(html) % 3 < 2 AND url <> '' AND NOT regexp_matches(url, '\s')
""",
    "log_people": """
SELECT o_orderkey, c_name AS name, CASE WHEN o_totalprice >= 50000 THEN c_mktsegment END AS segment, CASE WHEN o_totalprice >= 50000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "stated_versions": """
WITH v AS (SELECT *, floor(p_retailprice / 100)::BIGINT || '.' || p_size || '.' || (p_partkey % 10) AS version FROM part),
s AS (SELECT p_partkey, version, CASE WHEN p_brand LIKE '%1' THEN 'package.json' WHEN p_type LIKE 'S%' THEN 'Cargo.toml' WHEN p_size > 20 THEN 'setup.cfg' END AS source FROM v)
SELECT p_partkey, source, version, version AS mentioned FROM s WHERE source IS NOT NULL
""",
    "event_contracts": """
SELECT event_id, value < 60 AS ok, CASE WHEN value < 60 THEN json_extract_string(props, '$.k') END AS k FROM events
""",
    "mail_names": """
SELECT c_custkey, CASE WHEN c_nationkey % 5 < 3 THEN replace(c_name, '#', '-') END AS owner, CASE WHEN c_nationkey % 5 < 3 THEN lower(c_mktsegment) END AS repo FROM customer
""",
}
