"""Literal cases of record projections, decisions and marked blocks."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import blocks, policy, records


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_decisions(spark):
    t = F.lit
    null = F.lit(None).cast("string")
    assert one(spark, policy.blocks(t("error")), policy.blocks(t("warn")), policy.blocks(null), policy.is_privacy_rule(t("secret-x"))) == [True, False, False, True]
    assert one(spark, *[policy.visibility_of(t(s), t(p)) for s, p in ((200, True), (200, False), (404, False), (500, False))]) == ["private", "public", "private", "unknown"]
    assert [tuple(x) for x in one(spark, policy.access_plan(t("public")), policy.access_plan(null))] == [("public", True, "https"), ("unknown", False, "ssh")]
    assert one(spark, *[policy.package_name_error(t(n)) for n in ("@a/b@1", "", "-x", "a/../b", "a b")]) == [None, "missing", "option", "traversal", "malformed"]
    assert one(spark, *[policy.unpublish_target_error(t(n), t(v), t(w)) for n, v, w in (("a", "1.2.3", False), ("", "", False), ("a b", "", True), ("a", "", False), ("a", "x", False), ("a", "", True))]) == [None, "no name", "bad name", "no version", "bad version", None]
    a, b, c = one(spark, policy.identity(t("n"), t("e"), t("l"), t("le"), ("f", "fe")), policy.identity(t(""), t("e"), t("l"), t("le"), ("f", "fe")), policy.identity(null, t("e"), null, null, ("f", "fe")))
    assert (tuple(a), tuple(b), tuple(c)) == (("n", "e", "repo-config", False, False), ("l", "e", "account", True, False), ("f", "e", "fallback", True, False))
    assert one(spark, policy.error_tail(t("Warning: Permanently added x\n hint: y\n fatal:   bad \n"))) == ["fatal: bad"]
    assert one(spark, policy.package_form(t(True), F.array()), policy.package_form(t(False), F.array(t("a"))), policy.package_form(t(False), F.array())) == ["library", "cli", "none"]
    assert one(spark, policy.entry_specs(t("p"), F.create_map(t("."), t(1), t("./x"), t(1), t("./package.json"), t(1)))) == [["p", "p/x"]]
    assert tuple(one(spark, policy.first_given(("file", null), ("config", t("on")), ("default", t("off"))))[0]) == ("on", "config")
    assert one(spark, policy.changed((t(1), t(1)), (null, null)), policy.changed((null, t("x")))) == [False, True]
    assert one(spark, policy.flag_arguments(F.create_map(t("paths"), F.array(t("a"), t(" "), t("b")), t("no"), F.array(t("z"))), F.create_map(t("paths"), t("--paths")))) == [["--paths", "a,b"]]
    assert one(spark, policy.mirrored(t("https://r/x"), ["https://r/"], "https://m"), policy.mirrored(t("https://q/x"), ["https://r/"], "https://m")) == ["https://m/https://r/x", "https://q/x"]


def test_records(spark):
    items = spark.sql("SELECT 1 AS number, 't' AS title, 'open' AS state, named_struct('login', 'u') AS user, array(named_struct('name', 'bug')) AS labels, 0 AS comments, '' AS created_at, '' AS updated_at, CAST(NULL AS string) AS pull_request UNION ALL SELECT 2, 't', 'open', named_struct('login', 'u'), array(), 0, '', '', 'x'")
    assert [tuple(r)[:5] for r in records.issues(items).collect()] == [(1, "t", "open", "u", ["bug"])]
    assert one(spark, records.page_size(F.lit(500)), records.page_size(F.lit(None).cast("int")), records.page_size(F.lit(0))) == [100, 30, 1]
    assert one(spark, records.total_length(F.lit("bytes 0-1/77"), F.lit("5")), records.total_length(F.lit(None).cast("string"), F.lit("5"))) == [77, 5]
    runs = spark.createDataFrame([(1, "", "title"), (2, None, None)], "id int, name string, display_title string").withColumns({c: F.lit("") for c in ("status", "conclusion", "html_url", "event", "head_sha")})
    assert [r["name"] for r in records.run_names(runs).orderBy("id").collect()] == ["title", "run 2"]


def test_blocks(spark):
    text, new = F.lit("a <!--b--> old <!--e--> z"), F.lit("new")
    got = one(spark, blocks.block(text, "<!--b-->", "<!--e-->"), blocks.replaced(text, "<!--b-->", "<!--e-->", new), blocks.drifted(text, "<!--b-->", "<!--e-->", F.lit("old")), blocks.replaced(F.lit("none"), "<!--b-->", "<!--e-->", new))
    assert got == ["old", "a <!--b-->\nnew\n<!--e--> z", False, "none"]
    rows = spark.createDataFrame([("f", "b", 2), ("f", "a|c", 1)], "file string, name string, line int")
    assert blocks.table_lines(rows, ["file"], ["name", "line"], "line").first()["lines"] == "| name | line |\n|---|---|\n| a\\|c | 1 |\n| b | 2 |"
    files = spark.createDataFrame([("a/b/c/d.py",), ("a/b/e.py",), ("a/f.py",), ("g.py",)], "path string")
    got = sorted(map(str, map(tuple, blocks.tree_counts(files).collect())))
    assert got == ["('a', 'b', 1, 1)", "('a', None, 1, 0)", "('g.py', None, 1, 0)"]
    with pytest.raises(ValueError, match="rows"):
        blocks.guarded(files.limit(1), files)
