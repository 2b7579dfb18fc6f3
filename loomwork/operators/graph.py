"""Graphs of commits, imports and directories, as iterations over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import pinned

#: Nodes of a front that are looked up by name; edges are joined with larger ones.
FEW = 1000

# Sides that grow with the input bear the hint merge: what Spark takes for small in one round would be sent through the driver in each.


def reach(edges: DataFrame, start: DataFrame, depth: int, parent: str = "src", child: str = "dst", node: str = "node") -> DataFrame:
    """node and its least distance from the start nodes, up to depth steps along the edges. Cycles are harmless."""
    edges = pinned(edges.select(parent, child))  # else each step would make them anew
    seen = start.select(F.col(node)).distinct().withColumn("distance", F.lit(0))
    front = seen
    for step in range(1, depth + 1):
        names = [r[0] for r in front.select(node).take(FEW + 1)]
        if len(names) > FEW:
            found = front.join(edges.hint("merge"), F.col(node) == F.col(parent))
        else:
            found = edges.filter(F.col(parent).isin([n for n in names if n is not None]))
        following = found.select(F.col(child).alias(node)).distinct()
        front = pinned(following.join(seen.hint("merge"), node, "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def walk(starts: DataFrame, parents: DataFrame, most: int) -> DataFrame:
    """root, node, place and truncated: the first `most` nodes that a queue would visit from each start (root, node), parents (node, ord, parent) in their order.

    Places count from 1 in queue order. truncated says for all rows of a root whether something still
    stood in its queue when the last place was given, seen or not. Levels are taken together: the
    next level's order is that of the first place and ord from which a node is named, and no more
    of a root's level is kept than there are places left. Cycles and several ways to a node are harmless.
    """
    parents = pinned(parents.select("node", "ord", "parent"))
    named = F.min(F.struct("via", "ord")).alias("by")
    front = starts.select("root", "node").distinct().select("root", "node", F.struct(F.lit(0).cast("long").alias("via"), F.lit(0).cast("long").alias("ord")).alias("by"))
    seen, counts = None, None
    while True:
        order = F.row_number().over(Window.partitionBy("root").orderBy("by", "node"))
        front = front if counts is None else front.join(counts, "root", "left")
        before = F.lit(0) if counts is None else F.coalesce("had", F.lit(0))
        front = front.withColumn("n", order).withColumn("place", (F.col("n") + before).cast("long"))
        front = pinned(front.filter(F.col("place") <= most).select("root", "node", "place", "by"))
        if front.isEmpty():
            break
        seen = front if seen is None else pinned(seen.unionByName(front))
        counts = seen.groupBy("root").agg(F.max("place").alias("had"))
        following = front.select("root", F.col("place").alias("via"), "node").join(parents, "node").select("root", "via", F.col("ord").cast("long").alias("ord"), F.col("parent").alias("node"))
        front = following.join(seen.select("root", "node"), ["root", "node"], "left_anti").groupBy("root", "node").agg(named)
    if seen is None:
        return starts.select("root", "node", F.lit(0).cast("long").alias("place"), F.lit(False).alias("truncated")).limit(0)
    last = seen.filter(F.col("place") == most).select("root", F.col("by").alias("last_by"))
    pushed = seen.select("root", F.col("place").alias("via"), "node").join(parents, "node").join(last, "root")
    placed = seen.select("root", F.col("node").alias("parent"), F.col("place").alias("own"))
    queued = pushed.join(placed, ["root", "parent"], "left").filter(F.col("own").isNull() | (F.col("own") > F.col("via")))
    behind = (F.col("via") > F.col("last_by.via")) | ((F.col("via") == F.col("last_by.via")) & (F.col("ord") > F.col("last_by.ord")))
    cut = queued.filter(behind).select("root", F.lit(True).alias("cut")).distinct()
    return seen.join(cut, "root", "left").select("root", "node", "place", F.coalesce("cut", F.lit(False)).alias("truncated"))


def closures(edges: DataFrame, entries: DataFrame, src: str = "src", dst: str = "dst", entry: str = "entry") -> DataFrame:
    """(entry, node): for each entry all that is reached from it, itself included. Cycles are harmless.

    Each round follows the edges of what the last one found first, so every pair is made once for
    each way of its last step, and there are as many rounds as the farthest node has steps.
    """
    edges = pinned(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct())
    front = pinned(entries.select(F.col(entry).alias("entry"), F.col(entry).alias("node")).distinct())
    seen = front
    while True:
        following = front.join(edges.hint("merge"), "node").select("entry", F.col("next").alias("node")).distinct()
        front = pinned(following.join(seen.hint("merge"), ["entry", "node"], "left_anti"))
        if front.isEmpty():
            return seen.withColumnRenamed("entry", entry)
        seen = pinned(seen.unionByName(front))


def closure_keys(files: DataFrame, edges: DataFrame, entries: DataFrame, salt: str = "", path: str = "path", text: str = "text", entry: str = "entry") -> DataFrame:
    """entry, files, key and self of each entry: how many files its closure has, a digest of their sorted paths and contents, and one of its own content.

    The key changes when any file of the closure does, and with the salt (of a runtime or a format).
    Texts stay where they are: closures are joined with digests. Entries that aren't files have a key of none.
    """
    digests = files.select(F.col(path).alias("node"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"))
    pairs = closures(edges, entries, entry=entry).join(digests.hint("merge"), "node", "left")
    line = F.concat(F.col("node"), F.lit("\n"), F.coalesce("sha", F.lit("<missing>")), F.lit("\n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", line.alias("line")))), lambda x: x["line"]), "")
    own = F.max(F.when(F.col("node") == F.col(entry), F.col("sha")))
    return pairs.groupBy(entry).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.concat(F.lit(salt + "\n"), listed), 256).alias("key"), own.alias("self"))


def _chains(single: DataFrame) -> DataFrame:
    """(v, p, w) of nodes with one parent, moved up until p is no such node: the number of rounds is the logarithm of the longest chain. Nodes of cycles stay among themselves."""
    rounds = max(1, single.count()).bit_length() + 1
    up = single
    for _ in range(rounds):
        above = up.select(F.col("v").alias("p"), F.col("p").alias("p2"), F.col("w").alias("w2"))
        step = pinned(up.join(above, "p", "left").select("v", F.coalesce("p2", "p").alias("p"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.col("p2").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    return up


def layers(nodes: DataFrame, edges: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """node and layer: one more than its highest parent's. Parents that aren't nodes count as there; nodes on or behind cycles get null.

    Sorting by (layer nulls last, any order of one's own) puts parents before children. A node with one
    parent is a fixed number of steps below the first ancestor that has none or several, so that
    chains are taken out at once, and again where many merges' parents meet in one ancestor. What is left
    goes in rounds of those without open parents.
    """
    links = edges.select(F.col(node).alias("v"), F.col(parent).alias("p")).distinct().join(nodes.select(F.col(node).alias("p")).distinct(), "p", "left_semi")
    work = pinned(links.select("v", "p", F.lit(1).cast("long").alias("w")))
    every = pinned(nodes.select(F.col(node).alias("v")).distinct())
    taken: list[DataFrame] = []
    while True:
        count = pinned(work.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
        n_all, n_single = count.agg(F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
        if n_single * 4 <= n_all:  # few are left to take out, none at last
            break
        single = pinned(work.join(count.filter("n = 1").select("v"), "v", "left_semi"))
        chains = pinned(_chains(single))
        taken.append(chains)
        above = chains.select(F.col("v").alias("p"), F.col("p").alias("p2"), F.col("w").alias("w2"))
        merges = work.join(count.filter("n > 1").select("v"), "v", "left_semi").join(above, "p", "left")
        work = pinned(merges.select("v", F.coalesce("p2", "p").alias("p"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")).groupBy("v", "p").agg(F.max("w").alias("w")))
    below = work.select("v")
    for chains in taken:
        below = below.unionByName(chains.select("v"))
    done = pinned(every.join(below, "v", "left_anti").select("v", F.lit(0).cast("long").alias("layer")))
    while not work.isEmpty():
        known = work.join(done.select(F.col("v").alias("p"), "layer"), "p", "left")
        ready = known.groupBy("v").agg(F.max(F.col("layer") + F.col("w")).alias("layer"), F.count_if(F.col("layer").isNull()).alias("open")).filter(F.col("open") == 0)
        ready = pinned(ready.select("v", "layer"))
        if ready.isEmpty():
            break
        done = pinned(done.unionByName(ready))
        work = pinned(work.join(ready.select("v"), "v", "left_anti"))
    for chains in reversed(taken):
        done = pinned(done.unionByName(chains.join(done.select(F.col("v").alias("p"), "layer"), "p").select("v", (F.col("layer") + F.col("w")).alias("layer"))))
    return every.join(done, "v", "left").select(F.col("v").alias(node), F.col("layer").cast("int").alias("layer"))


def replay_plan(commits: DataFrame, sha: str = "sha", parents: str = "parents", seq: str = "seq") -> DataFrame:
    """seq, sha, the ordinals of a commit's parents in their order, and whether it is a merge."""
    each = commits.select(seq, sha, F.size(parents).alias("_n"), F.posexplode_outer(parents).alias("_i", "_p"))
    known = commits.select(F.col(sha).alias("_p"), F.col(seq).alias("_at"))
    joined = each.join(known, "_p", "left").groupBy(seq, sha).agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_i", "_at")))).alias("_l"), (F.max("_n") > 1).alias("is_merge"))
    return joined.select(seq, sha, F.transform("_l", lambda p: p["_at"]).alias("parent_seq"), "is_merge")
