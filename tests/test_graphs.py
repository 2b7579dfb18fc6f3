"""Walks, closures, histories, marked directories and wording against plain versions, with odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import parse, policy, wording
from loomwork.operators import classify, diff, directories, graph, history, scoped, sets, text
from loomwork.plans import graphs as graphs_plan


def queue_walk(parents, head, most):
    seen, queue, cut = [], [head], False
    while queue:
        if len(seen) >= most:
            cut = True
            break
        node = queue.pop(0)
        if node not in seen:
            seen.append(node)
            queue += [p for p in parents.get(node, []) if p not in seen]
    return [(head, n, i + 1, cut) for i, n in enumerate(seen)]


@pytest.mark.parametrize("most", [1, 4, 9, 50])
def test_walk_goes_as_a_queue_does(spark, most):
    rng = random.Random(most)
    parents = {n: [rng.randrange(14) for _ in range(rng.randrange(4))] for n in range(14)}  # merges, cycles, doubles, itself
    rows = [(n, k, p) for n, ps in parents.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "node long, ord long, parent long").withColumn("root", F.lit("clash"))
    starts = spark.createDataFrame([(h, h) for h in (0, 3, 7, 99)], "root long, node long")
    got = sorted(tuple(r) for r in graph.walk(starts, df.drop("root"), most).select("root", "node", "place", "truncated").collect())
    assert got == sorted(x for h in (0, 3, 7, 99) for x in queue_walk(parents, h, most))
    assert graph.walk(starts.limit(0), df, most).count() == 0


def test_closure_keys_change_with_what_lies_behind_a_file(spark):
    rng = random.Random(2)
    names = [f"f{n}" for n in range(12)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(18)] + [("f1", "gone")]
    files = {n: f"text {n}" for n in names if n != "f11"} | {"f3": None}

    def closure(n):
        seen, stack = set(), [n]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += [b for a, b in edges if a == x]
        return sorted(seen)

    def keys(content):
        df = spark.createDataFrame(list(content.items()), "path string, text string")
        e = spark.createDataFrame(edges, "src string, dst string")
        return {r["entry"]: r for r in graph.closure_keys(df, e, spark.createDataFrame([(n,) for n in names], "entry string"), salt="s").collect()}

    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got, changed = keys(files), keys(files | {"f5": "other"})
    for n in names:
        listed = "".join(f"{x}\n{sha(files[x]) if x in files else '<missing>'}\n" for x in closure(n))
        assert (got[n]["files"], got[n]["key"], got[n]["self"]) == (len(closure(n)), sha(f"s\n{listed}"), sha(files[n]) if n in files else None)
        assert (got[n]["key"] != changed[n]["key"]) == ("f5" in closure(n))


def test_every_step_of_a_history_is_the_diff_of_its_neighbours(spark):
    rng = random.Random(4)
    steps = [(c, s) for c in "ab" for s in range(10, 70, 10)] + [("c", 10)]
    held = [(c, s, p, rng.choice("xy")) for c, s in steps for p in "pqrs" if rng.random() < 0.6]
    held += [held[0], ("z", 10, "p", "x")]
    entries = spark.createDataFrame(held, "chain string, step long, path string, sha string")
    spans = history.intervals(spark.createDataFrame(steps, "chain string, step long"), entries, "chain", "step", "path", ["sha"])
    ends = spark.createDataFrame([("a", 6), ("b", 6), ("c", 1)], "chain string, steps long")
    got = sorted(tuple(r) for r in history.changes(spans, "chain", "path", ["sha"], ends).select("chain", "step", "path", "change").collect())
    want = []
    for chain, length in (("a", 6), ("b", 6), ("c", 1)):
        trees = [{}] + [{p: x for c, s, p, x in held if c == chain and s == 10 * k} for k in range(1, length + 1)]
        for k in range(1, length + 1):
            a, b = trees[k - 1], trees[k]
            want += [(chain, k, p, "added" if p not in a else "removed" if p not in b else "changed") for p in a.keys() | b.keys() if a.get(p) != b.get(p)]
            at = {(r["path"], r["sha"]) for r in history.tree_at(spans, F.lit(k)).filter(F.col("chain") == chain).collect()}
            assert at == set(b.items())
    assert got == sorted(want)
    marks = spark.createDataFrame([("a", 30), ("b", 35)], "chain string, step long")
    done = {r["chain"]: r["done"] for r in history.resume_place(spark.createDataFrame(steps, "chain string, step long"), marks, "chain", "step").collect()}
    assert done == {"a": 3, "b": 0, "c": 0}
    assert diff is not None


def test_directories_hand_their_marks_down(spark):
    listing = spark.createDataFrame([("a/.samples", 0), ("a/b/.samples", 3), ("t/x/.test", 0), ("q\\w/.samples", 0), ("a/b/c/.samples", 0)], "path string, size long")
    files = spark.createDataFrame([(p,) for p in ("a/f", "a/b/f", "a/b/c/d/f", "ab/f", "t/f", "t/x/y/f", "q/w/f", "a/../t/f", "../a/f", "./a/./f", "f", None)], "path string")
    got = {r["path"]: r["mark"] for r in directories.marked_by(files, listing, ".samples", "mark").collect()}
    assert got == {"a/f": "a", "a/b/f": "a", "a/b/c/d/f": "a/b/c", "ab/f": None, "t/f": None, "t/x/y/f": None, "q/w/f": "q/w", "a/../t/f": None, "../a/f": None, "./a/./f": "a", "f": None, None: None}
    root = spark.createDataFrame([(".samples", 0)], "path string, size long")
    assert {r["mark"] for r in directories.marked_by(files.filter("path LIKE 'a%'"), root, ".samples", "mark").collect()} == {""}
    judged = {(r["file"], r["shown_only"]) for r in directories.judged(files.withColumnRenamed("path", "file"), listing, "file").collect()}
    assert ("a/f", True) in judged and ("t/f", False) in judged and not [f for f, _ in judged if f == "t/x/y/f"]


def test_collated_names_are_in_readers_order(spark):
    df = spark.createDataFrame([("k", n) for n in ("Zeta", "alpha", "Beta", "äther", "北京", "安徽", "beta")], "by string, name string")
    got = [r["name"] for r in directories.collated(df, ["by"], "name", collation="zh").orderBy("place").collect()]
    assert got.index("alpha") < got.index("äther") < got.index("beta") < got.index("Beta") < got.index("Zeta") and got.index("安徽") < got.index("北京")
    assert directories.collated(df, ["by"], "name", 2).count() == 2
    listed = spark.createDataFrame([("w/a/f",), ("w/b/c/f",), ("w/.git/f",), ("w/f",), ("wx/d/f",)], "path string")
    assert sorted(r["name"] for r in directories.children(listed, "w").collect()) == ["a", "b"]
    assert sorted(r["name"] for r in directories.children(listed, "").collect()) == ["w", "wx"]


def test_mended_functions(spark):
    rows = spark.createDataFrame([(1, "Me@X.test", "b"), (2, "b", "ME@x.TEST"), (3, "me@x.test", "me@X.test"), (4, None, "b")], "id long, a string, c string")
    wanted = spark.createDataFrame([("me@x.test",), ("mE@x.test",)], "w string")
    assert sorted((r["id"], r["side"]) for r in sets.hit_sides(rows, "a", "c", wanted, "w").collect()) == [(1, "left"), (2, "right"), (3, "both")]
    said = spark.createDataFrame([("更新被拒绝，因为",), ("! [rejected] NON-fast-forward",), ("远程仓库包含您本地尚不存在的提交",), ("fine",), (None,)], "t string")
    assert [r[0] for r in said.select(policy.is_diverged(F.col("t"))).collect()] == [True, True, True, False, False]
    source = "import a from './a';\nrequire('./b' + x);\nrequire( './c' );\nimport('./d', y);\nimport ( \"./e\" )"
    assert spark.range(1).select(parse.relative_imports(F.lit(source))).first()[0] == ["./a", "./e", "./c"]
    names = spark.createDataFrame([("x/github-token",), ("x/.own",), ("k.pem",), ("token",)], "p string")
    assert [r[0] for r in names.select(text.sensitive_name(F.col("p"), (".own",))).collect()] == [True, True, True, False]
    runs = spark.range(2500).selectExpr("'g' AS g", "'completed' AS s", "'failure' AS c", "string(id) AS name").unionByName(spark.createDataFrame([("h", None, None, "x"), ("h", "", "success", "y"), ("h", "queued", None, "z")], "g string, s string, c string, name string"))
    summary = {r["g"]: r for r in classify.run_summary(runs, ["g"], F.col("s"), F.col("c"), "name").collect()}
    assert len(summary["g"]["failing_runs"]) == 2500 and (summary["h"]["pending"], summary["h"]["failing"], summary["h"]["ok"]) == (1, 1, 1)
    assert classify.failing_runs(runs, ["g"], F.col("s"), F.col("c"), "name").groupBy("g").count().orderBy("g").collect()[1]["count"] == 1


def test_wording(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(wording.scrubbed(F.lit("v1（用户许可）；；fix(要求 a)；"))) == "v1；fix"
    assert one(wording.scrubbed(F.lit(None).cast("string"))) == ""
    assert tuple(one(wording.slug(F.lit(" a.b/c_d ")))) == (True, "a.b", "c_d") and not one(wording.slug(F.lit("a/b/c")))["ok"] and not one(wording.slug(F.lit(None)))["ok"]
    assert wording.usable_trigger(" x+ ") == "x+" and wording.usable_trigger("(") == wording.DEFAULT_TRIGGER == wording.usable_trigger(None)
    assert one(wording.diagnosis(F.lit(None).cast("string"), F.lit("low"), F.lit("m"), F.lit(None).cast("array<string>"))) == "分类 unknown（推断，置信度低）：m"
    assert tuple(one(wording.listed_paths(F.lit('{"paths": [" a ", 3, null], "updatedBy": "x"}')))) == (["a", "3"], "", "x")
    assert tuple(one(wording.listed_paths(F.lit("{")))) == ([], "", "")


def test_scopes(spark):
    runs = spark.createDataFrame([("r",), ("s",), ("t",)], "run string")
    scopes = spark.createDataFrame([("r", "./src/"), ("r", "a.md"), ("s", "none")], "run string, path string")
    changed = spark.createDataFrame([("r", "src/x/y"), ("r", "srcs/z"), ("r", "a.md"), ("s", "b"), ("t", "c"), ("r", "src/x/y")], "run string, path string")
    got = sorted((tuple(r) for r in scoped.scoped_run(runs, scopes, changed).collect()), key=str)
    assert got == [("r", True, "a.md"), ("r", True, "src/x/y"), ("s", False, None), ("t", False, None)]


def test_triggers_stand_at_edges_of_ascii_words_as_in_sql(spark, tmp_path):
    import duckdb

    from loomwork.plans import wordings

    texts = ["énicht", "nichtß", "x nicht y", "xnicht", "_nicht", "NICHT", "éthemed", "themedü", "the med", "athemed", "theméd", "und", "Und", "", None, "nda é", "das\nNicht\n", "日themed本"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(db.execute(wordings.ORACLES["own_triggers"]).fetchall())
    assert sorted(map(tuple, wordings.own_triggers(spark, str(tmp_path)).collect())) == want
    assert [r[2] for r in want][:4] == ["blocked", "blocked", "blocked", "none"]


@pytest.mark.parametrize("few", [0, 1000])
def test_nothing_that_grows_is_broadcast_in_closures(spark, monkeypatch, few):
    plans, pinned = [], graph.pinned
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "pinned", lambda df: (plans.append(plan(df)), pinned(df))[1])
    monkeypatch.setattr(graph, "FEW", few)
    files = spark.createDataFrame([(f"s/p{i}.js", f"import a from './p{i // 2}';") for i in range(9)], "path string, text string")
    edges = parse.import_edges(files)
    keys = graph.closure_keys(files, edges, spark.createDataFrame([("s/p7.js",), ("x",)], "entry string"))
    assert {r["entry"]: r["files"] for r in keys.collect()} == {"s/p7.js": 4, "x": 1}
    met = graph.reach(edges, spark.createDataFrame([("s/p7.js",), (None,)], "node string"), 9)
    assert {(r["node"], r["distance"]) for r in met.collect()} == {("s/p7.js", 0), ("s/p3.js", 1), ("s/p1.js", 2), ("s/p0.js", 3), (None, 0)}
    assert len(plans) > 8 and not any("Broadcast" in p for p in [*plans, plan(keys), plan(edges)])


@pytest.mark.parametrize("many", [0, 2, 64])
def test_a_runs_files_are_dealt_as_they_are(spark, monkeypatch, many):
    monkeypatch.setattr(scoped, "MANY", many)
    runs = spark.createDataFrame([("r",), ("s",), ("t",), (None,)], "run string")
    scopes = spark.createDataFrame([("r", "./a/"), ("r", "b/c"), ("r", "b/c/"), ("r", "d"), ("s", "a"), ("s", ""), (None, "a"), ("t", None)], "run string, path string")
    changed = spark.createDataFrame([("r", "a/x"), ("r", "a/x"), ("r", "ab"), ("r", "b/c"), ("r", "b/d"), ("s", "b"), ("s", "/a//y"), ("t", "a"), (None, "a"), ("r", None), ("r", "")], "run string, path string")
    out = scoped.scoped_run(runs, scopes, changed)
    want = [("r", True, "a/x"), ("r", True, "b/c"), ("s", True, "/a//y"), ("t", False, None), (None, False, None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    if many == 64:
        assert "explode" not in out._jdf.queryExecution().executedPlan().toString()


def test_histories_are_dealt_to_more_parts_as_their_rows_grow(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, graphs_plan.replay_from_marker(spark, folder).collect()))
    entries = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(history, "ROWS_A_TASK", 500)
    dealt = graphs_plan.replay_from_marker(spark, folder)
    assert history.parts_for(spark, entries) == -(-entries // 500) > 4 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt.rdd.getNumPartitions() == -(-entries // 500)
    assert sorted(map(tuple, dealt.collect())) == want
