"""Conversation prefix trie: every distinct sequence of first turns is a node, with its members, children and savings.

Equal conversations are one path with a count. Paths are dealt by the digest of their first turn, and
each bucket builds a trie of dictionaries with pointers inside applyInPandas and sums it in an
iterative postorder. A first-turn subtrie of too many turns isn't built in one task: the turns that
all its paths share are its spine, one row, and the paths are dealt again by the turn behind the
spine, round by round, until all subtries are small. A subtrie of one path is all spine, so no
depth is too large. Sums of the dealt subtries then climb the spines, last round first.

Turns travel as digests (16 bytes of SHA-256) and text lengths; texts stay where they are read. One
conversation's digests are one row: 24 bytes for each turn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pinned, stored, table
from .neardup import _salted

#: Turns, summed over paths, of a subtrie that one task builds at most, and of a bucket of subtries on average.
SUBTRIE_TURNS, BUCKET_TURNS = 50_000, 150_000

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, seq string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart; the role's length keeps role and text apart."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said, 256)), 1, 16)


def conversation_paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path) of a table of turns: path has the struct (d, c), digest and code points of the text, of each turn.

    Turns go by turn, null first, then by digest; repeated rows stay. A null role or text is empty.
    Rows without conv_id belong to no conversation and are left out. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", turn_digest(role, text).alias("d"), F.length(text).cast("long").alias("c")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["c"].alias("c"))).alias("path"))


def with_borrowed_heads(paths: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % family, where there are so many, and goes on with its own after its first h; h is crc32 of decimal c, modulo most.

    A donor has at most family takers, so the join can't skew.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = paths.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("donor"), F.slice("path", 1, most - 1).alias("head"))
    asked = paths.withColumn("donor", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
    joined = asked.join(heads, "donor", "left")
    lent = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("path", F.lit(1), F.lit(0)))
    return joined.select("conv_id", F.concat(lent, F.slice("path", F.col("h") + 1, F.size("path"))).alias("path"))


def _subtries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a bucket's subtries. A row is a path's turns from its subtrie's top on; the tops carry g and up."""
    kids: list[dict] = []
    n: list[int] = []
    least: list[int] = []
    depth: list[int] = []
    length: list[int] = []
    above: list = []
    ends: dict[int, str] = {}
    tops: dict[bytes, int] = {}
    head: dict[int, tuple] = {}

    def node(parent: int, at: int, chars: int) -> int:
        kids.append({})
        n.append(0)
        least.append(2**63 - 1)
        depth.append(at)
        length.append(chars)
        above.append(parent)
        return len(kids) - 1

    for g, up, parent, base, seq, ident, count, digests, chars in zip(*[rows[c] for c in ("g", "up", "parent", "base", "seq", "id", "n", "d", "c")], strict=True):
        own = tops
        key, at, pointers = g, -1, own
        for k, (d, c) in enumerate(zip(digests, chars, strict=True)):
            key = g if k == 0 else d
            nxt = pointers.get(key)
            if nxt is None:
                nxt = pointers[key] = node(at, base + k + 1, int(c))
                if k == 0:
                    head[nxt] = (g, up, parent)
            at, pointers = nxt, kids[nxt]
            n[at] += int(count)
            least[at] = min(least[at], ident)
        ends[at] = seq

    leaves, saved, out = [0] * len(kids), [0] * len(kids), []
    for top in tops.values():
        stack, order = [top], []
        while stack:  # parents before children; backwards it is a postorder
            at = stack.pop()
            order.append(at)
            stack.extend(kids[at].values())
        for at in reversed(order):
            leaves[at] += not kids[at]
            saved[at] += (n[at] - 1) * length[at]
            g, up, parent = head.get(at) or (None, None, least[above[at]])
            out.append((least[at], depth[at], parent, n[at], len(kids[at]), leaves[at], saved[at], ends.get(at), g, up))
            if at != top:
                leaves[above[at]] += leaves[at]
                saved[above[at]] += saved[at]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "seq", "g", "up"]
    return pd.DataFrame(out, columns=names)


def _digests(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each seq's chunks, which come in order; nothing but the running digest is held."""
    last, running = None, None
    for rows in chunks:
        done = []
        for seq, ids in zip(rows["seq"], rows["ids"], strict=True):
            if seq != last:
                if last is not None:
                    done.append((last, running.hexdigest()))
                last, running = seq, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["seq", "ends_sha256"])
    if last is not None:
        yield pd.DataFrame([(last, running.hexdigest())], columns=["seq", "ends_sha256"])


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of one seq, of a batch of rows sorted by seq and id, comma-joined."""
    for rows in batches:
        if len(rows):
            runs = rows.groupby("seq", sort=False)["conv_id"]
            yield pd.DataFrame({"seq": list(runs.groups), "first": runs.min().to_numpy(), "ids": runs.agg(lambda ids: ",".join(map(str, ids))).to_numpy()})


def ends_digests(sequences: DataFrame) -> DataFrame:
    """(seq, ends_sha256): the digest of the ascending, comma-joined conv_ids of each seq.

    Ids are sorted over ranges of (seq, conv_id) and joined there, batch by batch; a task that digests
    a very common seq reads one row for some thousands of ids and holds one at a time.
    """
    ranged = sequences.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    chunks = ranged.mapInPandas(_listed, "seq string, first long, ids string")
    return chunks.repartition("seq").sortWithinPartitions("seq", "first").mapInPandas(_digests, "seq string, ends_sha256 string")


def _shared_turns(lo: str, hi: str) -> Column:
    """How many first turns the least and the greatest path of a group share: those that all its paths share."""
    least = F.least(F.size(lo), F.size(hi))
    differ = F.filter(F.sequence(F.lit(1), least), lambda i: F.element_at(lo, i)["d"] != F.element_at(hi, i)["d"])
    return F.when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(least)


def _spine_nodes(spine: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of a round's spines, with the sums of the subtries below them."""
    below = tops.filter(F.col("up").isNotNull()).groupBy("up").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    full = spine.join(below.withColumnRenamed("up", "g"), "g", "left")
    turns = F.slice("lo", F.col("base") + 1, F.col("shared") - F.col("base"))
    each = full.select("g", "up", "parent", "base", "shared", "id", "n", "end_seq", "kids", "leaves", "saved", F.posexplode(F.transform(turns, lambda t: t["c"])).alias("pos", "chars"))
    last, first = F.col("pos") == F.col("shared") - F.col("base") - 1, F.col("pos") == 0
    down = Window.partitionBy("g").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(
        F.col("id").alias("conv_id"),
        (F.col("base") + F.col("pos") + 1).cast("long").alias("depth"),
        F.when(first, F.col("parent")).otherwise(F.col("id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.sum((F.col("n") - 1) * F.col("chars")).over(down) + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"),
        F.when(last, F.col("end_seq")).alias("seq"),
        F.when(first, F.col("g")).alias("g"),
        F.when(first, F.col("up")).alias("up"),
    )


def prefix_trie(paths: DataFrame, subtrie_turns: int = SUBTRIE_TURNS, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """The nodes of the trie of (conv_id, path), paths as conversation_paths makes them.

    A row for each node: conv_id (its smallest member), depth, parent_conv_id (that of its parent, null
    for the root), n_convs, n_children, n_leaves, saved_tokens (over its subtree, members but one times
    code points of the last text) and ends_sha256 (of the conv_ids that end there). A conversation
    without turns is a member of the root alone. No conversations, no rows. subtrie_turns bounds what
    one task builds; results don't depend on it. A conv_id that occurs in several rows counts as often.
    """
    seq = F.sha2(F.array_join(F.transform("path", lambda t: F.hex(t["d"])), ""), 256)
    sequences = stored(paths.select("conv_id", "path", seq.alias("seq")), "trie-sequences")
    once = sequences.groupBy("seq").agg(F.min("conv_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("path").alias("path"))
    once = stored(once, "trie-paths")
    least, turns = once.agg(F.min("id"), F.sum(F.size("path"))).first()

    digest, text = F.lit(None).cast("binary"), F.lit(None).cast("string")
    work = once.filter(F.size("path") > 0).select("seq", "id", "n", "path", F.lit(0).alias("base"), F.element_at("path", 1)["d"].alias("g"), digest.alias("up"), F.lit(least).cast("long").alias("parent"))
    small, spines = [], []
    while True:
        sizes = work.groupBy("g").agg(F.sum(F.size("path") - F.col("base")).alias("turns"))
        large = pinned(sizes.filter(F.col("turns") > subtrie_turns).select("g", F.lit(True).alias("large")))
        if large.isEmpty():
            small.append(work)
            break
        marked = _salted(work, large, "g", "seq", "left")
        small.append(marked.filter(F.col("large").isNull()).drop("large"))
        dealt = stored(marked.filter("large").drop("large"), "trie-large")
        spine = dealt.groupBy("g").agg(F.min(F.struct("path", "seq")).alias("lo"), F.max("path").alias("hi"), F.sum("n").alias("n"), F.min("id").alias("id"), F.min("base").alias("base"), F.min("up").alias("up"), F.min("parent").alias("parent"))
        spine = spine.select("g", "up", "parent", "base", "id", "n", F.col("lo.path").alias("lo"), "hi", F.col("lo.seq").alias("lo_seq")).withColumn("shared", _shared_turns("lo", "hi"))
        # a path that ends with the spine is the least one
        spine = stored(spine.withColumn("end_seq", F.when(F.size("lo") == F.col("shared"), F.col("lo_seq")).otherwise(text)).drop("hi", "lo_seq"), "trie-spines")
        spines.append(spine)
        below = _salted(dealt.drop("base", "up", "parent"), spine.select("g", "shared", F.col("id").alias("parent")), "g", "seq").filter(F.size("path") > F.col("shared"))
        turn = F.element_at("path", F.col("shared") + 1)["d"]
        work = stored(below.select("seq", "id", "n", "path", F.col("shared").alias("base"), F.substring(F.unhex(F.sha2(F.concat("g", turn), 256)), 1, 16).alias("g"), F.col("g").alias("up"), "parent"), "trie-work")

    rest = F.slice("path", F.col("base") + 1, F.size("path"))
    buckets = max(1, math.ceil((turns or 0) / bucket_turns))
    parts = [w.select("g", "up", "parent", "base", "seq", "id", "n", F.transform(rest, lambda t: t["d"]).alias("d"), F.transform(rest, lambda t: t["c"]).alias("c"), F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket")) for w in small]
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    nodes = stored(everything.groupBy("bucket").applyInPandas(_subtries, f"{_NODE}, g binary, up binary"), "trie-nodes")
    for spine in reversed(spines):
        nodes = nodes.unionByName(stored(_spine_nodes(spine, nodes.filter("g IS NOT NULL")), "trie-spine-nodes"))

    firsts = nodes.filter("g IS NOT NULL AND up IS NULL")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    all_ends = F.when(F.size("path") == 0, F.col("seq"))
    root = once.select("id", "n", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), all_ends.alias("seq"))
    root = root.unionByName(firsts.select(none.alias("id"), zero.alias("n"), F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), text.alias("seq")))
    root = root.agg(F.min("id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("kids").alias("n_children"), F.greatest(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("seq").alias("seq")).filter("conv_id IS NOT NULL")
    names = [f.split()[0] for f in _NODE.split(", ")]
    nodes = nodes.select(*names).unionByName(root.select("conv_id", zero.alias("depth"), none.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "seq"))
    # nodes where nothing ends don't take part in the join
    ended = nodes.filter("seq IS NOT NULL").join(ends_digests(sequences), "seq")
    return ended.drop("seq").unionByName(nodes.filter("seq IS NULL").drop("seq").withColumn("ends_sha256", F.lit(_EMPTY)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_borrowed_heads(conversation_paths(table(spark, sf_dir, "conversations"))))


#: crc32 of a list of bytes in SQL: the table of the reflected polynomial, from its rule.
CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), b)) AS k"
CRC = "xor(list_reduce({bytes}, lambda a, b: xor(a >> 8, k[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"

ORACLE = rf"""
WITH crc AS ({CRC_TABLE}),
t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS c FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'d': d, 'c': c}} ORDER BY turn NULLS FIRST, d) AS p FROM t GROUP BY conv_id),
h AS (SELECT conv_id, p, {CRC.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 6 AS h FROM o, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(o.p, [])[1:h], h.p[h + 1:]) AS p FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, len(p) AS own, d, array_to_string(list_transform(p[1:d], lambda x: x.d), ',') AS s, coalesce(p[d].c, 0) AS c FROM r, unnest(range(len(p) + 1)) AS u(d)),
n AS (SELECT s, d, min(conv_id) AS conv_id, count(*) AS n, max(c) AS c, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE own = d), '')) AS ends FROM m GROUP BY s, d),
a AS (SELECT n.*, array_to_string(string_split(s, ',')[1:d - 1], ',') AS up FROM n),
k AS (SELECT up, count(*) AS kids FROM a WHERE d > 0 GROUP BY up),
f AS (SELECT a.*, coalesce(kids, 0) AS kids FROM a LEFT JOIN k ON k.up = a.s),
b AS (SELECT array_to_string(string_split(s, ',')[1:j], ',') AS s, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * c) AS saved FROM f, unnest(range(d + 1)) AS u(j) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, CASE WHEN f.d > 0 THEN p.conv_id END AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN b ON b.s = f.s LEFT JOIN f p ON p.s = f.up
"""
