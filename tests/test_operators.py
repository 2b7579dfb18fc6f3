"""Literal cases of merges, diffs, classification, windows, texts and graphs."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import paths, shell, strings
from loomwork.operators import chain, classify, code, diff, graph, merge, sets, text, windows
from loomwork.plans import texts as texts_plan
from loomwork.sources import tagged, workspace


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_overlay_keeps_left_rows_and_blank_visibility(spark):
    old = spark.createDataFrame([("a", "public"), ("b", "private")], "name string, vis string")
    new = spark.createDataFrame([("b", ""), ("c", "public")], "name string, vis string")
    assert rows(merge.overlay(old, new, "name", ["vis"])) == [("a", "public", "kept"), ("b", "private", "updated"), ("c", "public", "added")]
    same = merge.overlay(old, old, "name")
    assert rows(same.drop("origin")) == rows(old)


def test_update_only_drops_right_rows_and_counts_changes(spark):
    old = spark.createDataFrame([("a", "x"), ("b", None), ("d", "z")], "name string, vis string")
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "name string, vis string")
    assert rows(merge.update_only(old, new, "name", ["vis"])) == [("a", "x", False), ("b", "y", True), ("d", "z", False)]


def test_point_update_and_prune(spark):
    old = spark.createDataFrame([("a", "me"), ("b", "me"), ("c", "you"), ("d", None)], "name string, owner string")
    assert rows(merge.point_update(old, "name", "b", {"owner": F.lit("you")}))[1] == ("b", "you", True)
    assert not any(r[2] for r in rows(merge.point_update(old, "name", "zz", {"owner": F.lit("x")})))
    seen = spark.createDataFrame([("a",)], "name string")
    assert [r[2] for r in rows(merge.prune_scoped(old, seen, "name", "owner", "me"))] == [True, False, True, False]


def test_tree_diff_classes_and_identity(spark):
    schema = "path string, sha string, mode string"
    prev = spark.createDataFrame([("a", "1", "100644"), ("b", "2", "100644"), ("c", "3", "100644"), ("d", "4", "100644")], schema)
    cur = spark.createDataFrame([("a", "1", "100644"), ("b", "9", "100644"), ("c", "3", "100755"), ("e/f", "5", "100644")], schema)
    assert rows(diff.tree_diff(prev, cur)) == [("a", "keep", "same"), ("b", "download", "content"), ("c", "download", "mode"), ("d", "remove", "deleted"), ("e/f", "download", "added")]
    assert {r[1] for r in rows(diff.tree_diff(cur, cur))} == {"keep"}
    empty = prev.limit(0)
    assert [r[1] for r in rows(diff.tree_diff(empty, cur))] == ["download"] * 4


def test_failures(spark):
    cases = [
        ("remote: Repository not found.", None, "repo-not-found-or-no-access", "low"),
        ("fatal: could not read Username for 'https://x'", None, "auth-missing", "high"),
        ("git@x: Permission denied (publickey).", None, "auth-denied", "high"),
        ("Host key verification failed.", None, "host-key", "high"),
        ("Could not resolve host: x", None, "dns", "high"),
        ("! [rejected] main -> main (non-fast-forward)", None, "diverged", "high"),
        ("odd", 403, "protected", "high"),
        ("odd", None, "unknown", "low"),
        (None, None, "unknown", "low"),
    ]
    df = spark.createDataFrame([(i, t, s) for i, (t, s, *_) in enumerate(cases)], "i int, t string, s int")
    got = rows(df.select("i", classify.push_failure(F.col("t"), F.col("s")).alias("f")).select("i", "f.code", "f.confidence"))
    assert [g[1:] for g in got] == [(c[2], c[3]) for c in cases]


def test_run_summary(spark):
    runs = spark.createDataFrame([(1, "completed", "success", "a"), (1, "completed", "neutral", "b"), (2, "completed", "cancelled", "c"), (2, "completed", "success", "d"), (3, "in_progress", None, "e"), (3, "completed", "failure", "f"), (4, "completed", "skipped", "g")], "k int, s string, c string, n string")
    out = classify.run_summary(runs, ["k"], F.col("s"), F.col("c"), "n").select("k", "total", "pending", "failing", "ok", "conclusion", "failing_runs")
    assert rows(out, "k") == [(1, 2, 0, 0, 2, "success", []), (2, 2, 0, 1, 1, "failure", ["c"]), (3, 2, 1, 1, 0, "pending", ["f"]), (4, 1, 0, 0, 1, "success", [])]


def test_health_runs(spark):
    e = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("b", 3, False), ("c", 1, True)], "key string, at int, ok boolean")
    got = rows(windows.failure_runs(e, "key", ["at"], F.col("ok"), "at").select("key", "failures", "disabled"))
    assert got == [("a", 3, True), ("b", 1, False), ("c", 0, False)]


@pytest.mark.parametrize(
    ("line", "field"),
    [
        ("password: 'hunter2',", "password"),
        ("// api_key = \"abcdef123\"", "token/secret"),
        ("api_key = \"short\"", None),
        ("password = 'a' + b", None),
        ("password: process.env.PASS", None),
        ("cookie: `abcd`", "cookie"),
        ("password: 'changeme'", None),
        ("password: 'secret1' // skip-sensitive", None),
        ("example password: 'secret1'", None),
        ("username = 'bob' // set", None),
    ],
)
def test_sensitive_lines(spark, line, field):
    df = spark.createDataFrame([(line,)], "line string").select(text.sensitive_field(F.col("line")).alias("f"))
    assert df.first()["f"] == field


def test_layers_put_parents_first_and_keep_cycles(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdxy"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b"), ("d", "outside"), ("x", "y"), ("y", "x")], "node string, parent string")
    assert rows(graph.layers(nodes, edges)) == [("a", 0), ("b", 1), ("c", 2), ("d", 0), ("x", None), ("y", None)]


def test_reach_is_cycle_safe(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "node int")
    assert rows(graph.reach(edges, start, 3)) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_paths_and_strings(spark):
    assert one(spark, paths.within("/a/b", F.lit("/a/b/c"))) and not one(spark, paths.within("/a/b", F.lit("/a/bc")))
    assert one(spark, paths.ancestors(F.lit("a/b/c.txt"))) == ["a", "a/b"]
    assert one(spark, paths.ancestors(F.lit("c.txt"))) == []
    assert one(spark, strings.git_date(F.lit("2026-09-13T12:00:00+08:00"))) == "1789300800 +0800"
    assert one(spark, strings.git_date(F.lit("never"))) == "0 +0000"
    assert tuple(one(spark, strings.owner_repo(F.lit("git@x.test:o/r.git")))) == ("o", "r", "scp")
    assert one(spark, strings.owner_repo(F.lit("nothing"))) is None
    assert one(spark, strings.blob_sha1(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, strings.is_ipv4(F.lit("1.2.3.256"))) is False
    assert one(spark, strings.kebab(F.lit("onFail"))) == "on-fail" and one(spark, strings.camel(F.lit("on-fail"))) == "onFail"
    assert one(spark, strings.masked_query(F.lit("https://u:p@h/x?token=1&a=2#f"))) == "https://***@h/x?token=***&a=2#f"
    assert one(spark, sets.edited(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)), "add")) == [1, 2, 3]


def test_shell_words(spark):
    df = spark.createDataFrame([("run --x='a b' c\\ d",), (None,), ("",)], "line string").select(shell.words(F.col("line")).alias("w"))
    assert [r["w"] for r in df.collect()] == [["run", "--x=a b", "c d"], None, []]


def test_tagged_lines_round_trip_and_count_bad_ones(spark):
    repos = spark.createDataFrame([("a", None), ("b", "x\ny")], "name string, note string")
    lines = tagged.write_lines({"meta": spark.createDataFrame([(1,)], "version int"), "repo": repos})
    bad = spark.createDataFrame([("{broken",), ("",)], "value string")
    back = tagged.read_lines(lines.select("value").unionByName(bad))
    assert rows(tagged.rows_of(back, "repo", "name string, note string")) == rows(repos)
    assert tagged.skipped(back).first()["skipped"] == 1


def test_porcelain(spark):
    s = spark.createDataFrame([("?? new.txt\n M a.py\nR  old -> b/c.py\n D gone\n!! skip",)], "text string")
    assert rows(workspace.porcelain_changes(s)) == [("A", "b/c.py"), ("A", "new.txt"), ("D", "gone"), ("M", "a.py")]


def test_workspace_listing(spark, tmp_path):
    for d in ("one/.git", "two/sub/.git", "node_modules/x/.git"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "HEAD").write_text("ref")
    (tmp_path / "one/a.txt").write_text("hi")
    assert rows(workspace.listing(spark, str(tmp_path)).select("path", "size")) == [("one/a.txt", 2)]
    assert rows(workspace.repositories(spark, str(tmp_path))) == [("one",), ("two/sub",)]
    assert rows(workspace.repositories(spark, str(tmp_path), depth=1)) == [("one",)]
    ignored = spark.createDataFrame([("two",)], "path string")
    assert rows(workspace.repositories(spark, str(tmp_path), ignored=ignored)) == [("one",)]
    assert rows(workspace.texts(spark, str(tmp_path), "*.txt")) == [("one/a.txt", "hi")]


def test_chain_receipts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    stages = [chain.Stage("up", lambda d: d.withColumn("v", F.when(F.col("id") == 1, F.upper("v")).otherwise(F.col("v")))), chain.Stage("bad", lambda d: d.select("nope"), "skip"), chain.Stage("drop", lambda d: d.filter("id < 3"))]
    out, receipts = chain.run(df, stages, "id")
    assert rows(out) == [(1, "A"), (2, "b")]
    assert rows(receipts, "ord") == [(0, "up", "ok", 0, 1, 0, 1), (1, "bad", "skipped", 0, 0, 0, 0), (2, "drop", "ok", 0, 0, 1, 1)]
    again = chain.run(out, stages, "id")[1]
    assert [r[-1] for r in rows(again, "ord")] == [0, 0, 0]
    with pytest.raises(Exception, match="nope"):
        chain.run(df, [chain.Stage("bad", lambda d: d.select("nope"))], "id")


def test_functions_in():
    src = "function a() {\n  // }\n  return '}';\n}\nconst b = (x) => {\n};\nconst c = x => x;\n"
    assert code.functions_in(src) == [("a", 1, 4), ("b", 5, 6), ("c", 7, 7)]


def test_exempt_and_hint(spark):
    findings = spark.createDataFrame([("f", 4, "regex", "console-log"), ("f", 5, "regex", "console-log"), ("f", 4, "regex", "security/x"), ("g", 1, "func-lines", "r"), ("g", 1, "binary", "r")], "file string, line int, kind string, rule string")
    files = spark.createDataFrame([("f", "a\nb\nc\nd // skip-residue\ne"), ("g", "// skip-quality")], "file string, text string")
    got = {tuple(r)[:4]: r["exempt"] for r in text.exempt(findings, files, text.markers(spark)).collect()}
    assert got == {("f", 4, "regex", "console-log"): True, ("f", 5, "regex", "console-log"): False, ("f", 4, "regex", "security/x"): False, ("g", 1, "func-lines", "r"): True, ("g", 1, "binary", "r"): False}
    hints = {r["kind"] + " " + r["rule"]: r["hint"] for r in text.hint(findings.select("kind", "rule").distinct(), text.markers(spark), "skip-quality").collect()}
    assert hints["func-lines r"] == "skip-func-length" and hints["regex security/x"] == "skip-sensitive" and hints["regex console-log"] == "skip-residue"


def test_exempt_findings_reads_whole_texts(spark, tmp_path):
    far = "x" * 300
    texts = [f"{far} // skip-quality", f"a\n{far} skip-sensitive skip-residue skip-quality", "a\nb\nc\nd skip-quality", f"a\nb\nc\n{far} // skip-func-length skip-residue", f"a\nb\nc\nd\n{far} skip-quality", None, ""]
    docs = [(i, texts[i % len(texts)]) for i in range(420)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, t in docs:
        lines = {0: "// skip-quality\n" + t if t is not None else "", 1: "a\nb\nc\nd // skip-residue skip-sensitive\ne"}.get(i % 4, t or "").split("\n")
        kind, rule = ("regex", "semantic", "func-lines", "binary", "max-depth")[i % 5], ("console-log", "security/hardcoded", "other")[i % 3]
        exempt = False
        for name, kinds, needed, by_word, unwanted, on_line in text.MARKERS:
            fits = any(w in rule for w in needed) if kind in by_word else kind != "regex" or not any(w in rule for w in unwanted)
            places = ["\n".join(lines[:3]), *(lines[3:4] if on_line else [])]
            exempt |= kind in kinds and fits and any(f"skip-{name}" in p for p in places)
        want.add((i, kind, rule, exempt))
    assert set(map(tuple, texts_plan.exempt_findings(spark, str(tmp_path)).collect())) == want
