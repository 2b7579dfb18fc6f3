"""Queries on urls, texts and tagged files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import chain, code, text, windows
from ..sources import tables, tagged

read = tables.read


def sensitive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, and of some settings made of their ids."""
    d = read(spark, sf_dir, "documents")
    made = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\n  password: '"), F.col("doc_id").cast("string"), F.lit("pw',\n# api_key = \"<key>\"\ncookie=\"a b\"")))
    return text.sensitive_lines(d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.coalesce(made, F.lit(""))).alias("text")), "doc_id", "text")


def exempt_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("// skip-quality\n"), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("a\nb\nc\nd // skip-residue skip-sensitive\ne\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("regex", "semantic", "func-lines", "binary", "max-depth")]), (F.col("doc_id") % 5 + 1).cast("int"))
    rule = F.element_at(F.array(*[F.lit(k) for k in ("console-log", "security/hardcoded", "other")]), (F.col("doc_id") % 3 + 1).cast("int"))
    findings = d.select(F.col("doc_id").alias("file"), F.lit(4).alias("line"), kind.alias("kind"), rule.alias("rule"))
    return text.exempt(findings, files, text.markers(spark)).select("file", "kind", "rule", "exempt")


def exempt_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("regex", "semantic", "func-lines", "binary", "max-depth", "nothing")]), (F.col("event_id") % 6 + 1).cast("int"))
    rule = F.element_at(F.array(*[F.lit(k) for k in ("console-log", "security/hardcoded", "other", "i18n/text")]), (F.col("event_id") % 4 + 1).cast("int"))
    findings = e.select(kind.alias("kind"), rule.alias("rule")).distinct()
    return text.hint(findings, text.markers(spark), "skip-quality")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    repo = F.element_at(F.array(F.concat(F.lit("https://x.test/own"), F.col("page_id").cast("string"), F.lit("/repo.git")), F.concat(F.lit("git@x.test:own/r"), F.col("page_id").cast("string"), F.lit(".git")), F.lit("ssh://git@ssh.x.test:443/a/b.git"), F.lit("nothing")), (F.col("page_id") % 4 + 1).cast("int"))
    return p.select("page_id", strings.host(F.col("url")).alias("host"), strings.owner_repo(repo).alias("r")).select("page_id", "host", "r.owner", "r.repo", "r.form")


def mask_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", strings.masked_query(F.col("url")).alias("masked"))


def first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", strings.table_cell(strings.first_paragraph(F.col("text"))).alias("cell"))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON inside noisy text; every ninth row is broken."""
    noisy = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("[x "), F.col("props"), F.lit("}"))).otherwise(F.concat(F.lit("log: "), F.col("props")))
    found = tagged.first_json(noisy)
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").alias("k"))


def tagged_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    lines = tagged.write_lines({"region": region, "nation": nation})
    noise = spark.createDataFrame([(9, "", "{broken"), (9, "", " ")], "ord int, tag string, value string")
    back = tagged.read_lines(lines.unionByName(noise).select("value"))
    n = tagged.rows_of(back, "nation", "n_nationkey int, n_name string, n_regionkey int")
    r = tagged.rows_of(back, "region", "r_regionkey int, r_name string")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").crossJoin(tagged.skipped(back))


def commit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "feat").otherwise("")
    title = strings.commit_title(kind, F.lower("p_brand"), F.col("p_name")).alias("title")
    # six rows of a brand are ranked before anything is gathered
    first = windows.last_n(p.select("p_brand", "p_partkey", "p_name", title), "p_brand", 6, F.col("p_partkey"))
    bullet = F.when(F.col("place") > 1, F.struct("place", F.concat(F.lit("- "), "p_name").alias("b")))
    items = first.groupBy("p_brand").agg(F.max(F.when(F.col("place") == 1, F.col("title"))).alias("title"), F.array_sort(F.collect_list(bullet)).alias("b"))
    reasons = p.groupBy("p_brand").agg(F.countDistinct("p_type").cast("int").alias("reasons"))
    return items.join(reasons, "p_brand").select("p_brand", "title", F.array_join(F.transform("b", lambda x: x["b"]), "\n").alias("bullets"), "reasons")


def git_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "+08:00").otherwise("Z"))
    return o.select("o_orderkey", strings.git_date(F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(iso)).alias("git_date"))


def content_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", strings.fingerprint(F.col("text")).alias("fp"), strings.last_line(F.col("text")).alias("last"), strings.kebab(F.col("source")).alias("source"))


def stage_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [
        chain.Stage("trim", lambda d: d.withColumn("text", F.regexp_replace("text", r"[ \n]+$", ""))),
        chain.Stage("short", lambda d: d.filter(F.length("text") >= 500)),
        chain.Stage("broken", lambda d: d.select("nothing"), on_fail="warn"),
        chain.Stage("mark", lambda d: d.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))),
    ]
    return chain.run(read(spark, sf_dir, "documents").select("doc_id", "text"), stages, "doc_id")[1]


_SOURCE = """export function first(a) {
  if (a) { return "}"; }
}
const second = async (b) => {
  // }
  return b;
};
const third = x => x + 1;
function fourth() { return 1; }
"""


def function_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "nation").select(F.concat(F.lit("src/"), F.col("n_nationkey").cast("string"), F.lit(".js")).alias("path"), F.concat(F.repeat(F.lit("\n"), F.col("n_nationkey")), F.lit(_SOURCE)).alias("text"))
    return code.extract_functions(files)


QUERIES = {f.__name__: f for f in (sensitive_lines, exempt_findings, exempt_hints, url_parts, mask_url, first_paragraph, props_json, tagged_round_trip, commit_messages, git_dates, content_names, stage_receipts, function_extract)}


def sensitive_case() -> str:
    """The families as CASE branches; RE2 has no back-references, so each kind of quote has its own branch."""
    branches = []
    for name, keys, least in text.SENSITIVE_KEYS:
        for q in ("\"", "''", "`"):
            pattern = r"(?i)(?:^|[^A-Za-z0-9_])(?:" + "|".join(keys) + r")\s*[:=]\s*" + q + "([^" + q + "]*)" + q + r"\s*[,;)\]}\s]*$"
            value = f"trim(regexp_extract(c, '{pattern}', 1))"
            placeholder = text.PLACEHOLDER.replace("'", "''")
            branches.append(f"WHEN regexp_matches(c, '{pattern}') AND length({value}) >= {least} AND NOT regexp_matches({value}, '\\+|\\$\\{{') AND NOT regexp_matches({value}, '{placeholder}') THEN '{name}'")
    return f"CASE {' '.join(branches)} END"


def _sensitive_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '  password: ''' || doc_id || 'pw'',' || chr(10) || '# api_key = "<key>"' || chr(10) || 'cookie="a b"' ELSE '' END AS text FROM documents),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM d),
c AS (SELECT doc_id, line_no, regexp_replace(line, '^[#;/*\\s]+', '') AS c FROM l WHERE NOT regexp_matches(line, '(?i)skip-sensitive') AND NOT regexp_matches(line, '{text.EXAMPLE_LINE}')),
f AS (SELECT doc_id, line_no::INT AS line_no, {sensitive_case()} AS field FROM c)
SELECT * FROM f WHERE field IS NOT NULL
"""


_COVERS = "list_contains(m.kinds, {k}) AND (CASE WHEN list_contains(m.word_kinds, {k}) THEN len(list_filter(m.words, lambda w: contains(lower({r}), w))) > 0 WHEN {k} = 'regex' THEN len(list_filter(m.not_words, lambda w: contains(lower({r}), w))) = 0 ELSE true END)"


def _markers_sql() -> str:
    row = lambda i, m: f"({i}, 'skip-{m[0]}', {list(m[1])!r}::VARCHAR[], {list(m[2])!r}::VARCHAR[], {list(m[3])!r}::VARCHAR[], {list(m[4])!r}::VARCHAR[], {str(m[5]).lower()})"
    return "m(ord, marker, kinds, words, word_kinds, not_words, on_line) AS (VALUES " + ", ".join(row(i, m) for i, m in enumerate(text.MARKERS)) + ")"


ORACLES = {
    "sensitive_lines": _sensitive_sql(),
    "exempt_findings": f"""
WITH {_markers_sql()},
f AS (SELECT doc_id AS file, ['regex','semantic','func-lines','binary','max-depth'][doc_id % 5 + 1] AS kind, ['console-log','security/hardcoded','other'][doc_id % 3 + 1] AS rule,
  string_split(coalesce(CASE doc_id % 4 WHEN 0 THEN '// skip-quality' || chr(10) || text WHEN 1 THEN 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd // skip-residue skip-sensitive' || chr(10) || 'e' || chr(10) || coalesce(text, '') ELSE text END, ''), chr(10)) AS r FROM documents)
SELECT file, kind, rule, coalesce(bool_or(contains(array_to_string(r[1:3], chr(10)), m.marker) OR (m.on_line AND contains(coalesce(r[4], ''), m.marker))), false) AS exempt FROM f LEFT JOIN m ON {_COVERS.format(k='f.kind', r='f.rule')} GROUP BY 1, 2, 3
""",
    "exempt_hints": f"""
WITH {_markers_sql()}, f AS (SELECT DISTINCT ['regex','semantic','func-lines','binary','max-depth','nothing'][event_id % 6 + 1] AS kind, ['console-log','security/hardcoded','other','i18n/text'][event_id % 4 + 1] AS rule FROM events)
SELECT kind, rule, arg_min(m.marker, CASE WHEN m.marker = 'skip-quality' THEN 1000 ELSE m.ord END) AS hint FROM f LEFT JOIN m ON {_COVERS.format(k='f.kind', r='f.rule')} GROUP BY 1, 2
""",
    "url_parts": r"""
SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
  CASE page_id % 4 WHEN 0 THEN 'own' || page_id WHEN 1 THEN 'own' WHEN 2 THEN 'a' END AS owner, CASE page_id % 4 WHEN 0 THEN 'repo' WHEN 1 THEN 'r' || page_id WHEN 2 THEN 'b' END AS repo, CASE page_id % 4 WHEN 0 THEN 'https' WHEN 1 THEN 'scp' WHEN 2 THEN 'ssh443' END AS form FROM pages
""",
    "mask_url": r"""
SELECT page_id, regexp_replace(url, '([?&][^=&#]*(?:token|key|secret|password|auth|source)[^=&#]*=)[^&#]*', '\1***', 'gi') AS masked FROM pages
""",
    "first_paragraph": r"""
WITH p AS (SELECT doc_id, list_filter(string_split_regex(text, '\n[ \t]*\n'), lambda p: trim(translate(p, chr(10) || chr(9), '  ')) <> '')[1] AS p FROM documents)
SELECT doc_id, replace(trim(list_filter(string_split(p, chr(10)), lambda s: trim(s) <> '')[1]), '|', '\|') AS cell FROM p
""",
    "props_json": "SELECT event_id, json_extract_string(CASE WHEN event_id % 9 = 0 THEN NULL ELSE props END, '$.k') AS k FROM events",
    "tagged_round_trip": "SELECT n_nationkey, n_name, r_name, 1::BIGINT AS skipped FROM nation JOIN region ON n_regionkey = r_regionkey",
    "commit_messages": """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_brand, max(CASE WHEN n = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'feat(' || lower(p_brand) || '): ' || p_name ELSE p_name END END) AS title,
  coalesce(string_agg('- ' || p_name, chr(10) ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 6), '') AS bullets, count(DISTINCT p_type)::INT AS reasons FROM i GROUP BY 1
""",
    "git_dates": """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '0 +0000' ELSE floor(epoch(o_orderdate))::BIGINT::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN ' +0800' ELSE ' +0000' END END AS git_date FROM orders
""",
    "content_names": r"""
SELECT doc_id, left(sha256(text), 16) AS fp, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')[-1] AS last, lower(regexp_replace(source, '([A-Z])', '-\1', 'g')) AS source FROM documents
""",
    "stage_receipts": r"""
WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '[ \n]+$', '') AS t1 FROM documents), b AS (SELECT *, length(t1) >= 500 AS k FROM a)
SELECT 0 AS ord, 'trim' AS stage, 'ok' AS status, 0::BIGINT AS added, count(*) FILTER (WHERE t0 <> t1) AS modified, 0::BIGINT AS deleted, count(*) FILTER (WHERE t0 <> t1) AS total FROM b
UNION ALL SELECT 1, 'short', 'ok', 0, 0, count(*) FILTER (WHERE NOT k), count(*) FILTER (WHERE NOT k) FROM b
UNION ALL SELECT 2, 'broken', 'failed', 0, 0, 0, 0
UNION ALL SELECT 3, 'mark', 'ok', 0, count(*) FILTER (WHERE k AND doc_id % 2 = 0), 0, count(*) FILTER (WHERE k AND doc_id % 2 = 0) FROM b
""",
    "function_extract": """
SELECT 'src/' || n_nationkey || '.js' AS path, f.name, (n_nationkey + f.a)::INT AS start_line, (n_nationkey + f.b)::INT AS end_line, (f.b - f.a + 1)::INT AS lines
FROM nation, (VALUES ('first', 1, 3), ('second', 4, 7), ('third', 8, 8), ('fourth', 9, 9)) AS f(name, a, b)
""",
}
