"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification and components.

Circulant MinHash (Li and Li, 2022) takes all coordinates from two permutations of the hashed
shingle universe: the first scatters a document's shingles, the second, shifted circularly by k,
gives coordinate k as its minimum. Rows of coordinates form bands; documents that share a band
bucket are candidates, and links are confirmed on full shingle sets.

Documents with equal sets are one node. A bucket doesn't emit its pairs: first each member is
verified against the leaders of its buckets that look most alike, and linked nodes merge. What is
left are members of buckets that hold several components; each node of the smaller component is
compared with all of the larger one, in blocks of bounded size that yield at most one link for a
node. So no link between candidates is lost, and a group of near copies costs about its size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, perhaps_among, pinned, slices, stored, table

UNIVERSE, COORDINATES, ROWS_PER_BAND = 1 << 18, 256, 4
#: Leaders that a node is verified against before its buckets are looked at in full.
LEADERS = 2
#: Components up to this size are compared pair by pair, larger ones in blocks.
SMALL, BLOCK_ROWS, BLOCK_SHINGLES = 16, 512, 500_000
#: Rows of a bucket that meet as many in one task.
BUCKET_ROWS = 512
_U = np.uint64

#: Bytes of text whose words are hashed at once, and places of characters in a table of powers.
CHUNK_BYTES, POWERS = 1 << 20, 1 << 12
#: Parts that the rows of one key are dealt to where a join would gather them in one task.
SALTS = 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def bands_for(percent: int, missed: float = 1e-6) -> int:
    """Bands so that a pair at the threshold shares none with a probability of less than missed."""
    return math.ceil(math.log(missed) / math.log(1 - (percent / 100) ** ROWS_PER_BAND))


def least_agreement(percent: int) -> int:
    """Of COORDINATES one-bit sketches, how many agree at the threshold at least: seven standard deviations below the mean."""
    p = (1 + percent / 100) / 2
    return math.floor(COORDINATES * p - 7 * math.sqrt(COORDINATES * p * (1 - p)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, by: int) -> np.ndarray:
    grown = np.full(max(1, n), by, _U)
    grown[0] = 1
    return np.multiply.accumulate(grown)


_LOW = _powers(POWERS + 1, 0x9E3779B97F4A7C15)


def _word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of a part of a text that cuts none."""
    b = np.frombuffer(raw, np.uint8)
    b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
    solid = (b != 32) & ((b < 9) | (b > 13))
    at = np.flatnonzero(solid)
    if not at.size:
        return np.zeros(0, _U)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = np.flatnonzero(first[at])
    lengths = np.diff(np.append(begins, at.size))
    offset = np.arange(at.size) - np.repeat(begins, lengths)
    values = (b[at].astype(_U) + _U(1)) * _LOW[offset % POWERS]
    if lengths.max() > POWERS:  # the power of a place is that of its block times that within it
        values *= _powers(int(lengths.max()) // POWERS + 1, int(_LOW[POWERS]))[offset // POWERS]
    return _mix(np.add.reduceat(values, begins) + lengths.astype(_U))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of size words, or of the one shorter sequence. Long texts are read in chunks."""
    raw, parts, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + CHUNK_BYTES)
        stop = cut.end() if cut else len(raw)
        parts.append(_word_hashes(raw[at:stop]))
        at = stop
    words = np.concatenate(parts) if parts else np.zeros(0, _U)
    if not words.size:
        return words
    n = min(size, len(words))
    total = np.zeros(len(words) - n + 1, _U)
    for j in range(n):
        total = (total ^ words[j : len(words) - n + 1 + j]) * _U(0xD6E8FEB86659FD93) + _U(n)
        total ^= total >> _U(32)
    return np.unique(_mix(total))


def signature(hashes: np.ndarray, seed: int = 1) -> np.ndarray:
    if seed not in _TABLES:
        rng = np.random.default_rng(seed)
        second = rng.permutation(UNIVERSE).astype(np.uint32)
        _TABLES[seed] = rng.permutation(UNIVERSE), np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:COORDINATES]]), COORDINATES)
    scatter, shifted = _TABLES[seed]
    places = scatter[hashes & _U(UNIVERSE - 1)]
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(places), 256):
        np.minimum(least, shifted[places[k : k + 256]].min(axis=0), out=least)
    return least


def _sketched(size: int, bands: int):
    def start():
        place = np.arange(bands, dtype=_U)

        def one(t: str | None):
            own = shingles(t, size)
            if not own.size:
                return 0, None, None, [], []
            sig = signature(own)
            rows = sig[: bands * ROWS_PER_BAND].reshape(bands, ROWS_PER_BAND).astype(_U)
            key = place
            for j in range(ROWS_PER_BAND):
                key = _mix(key * _U(0x9E3779B97F4A7C15) + rows[:, j])
            digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            bits = np.packbits((sig & 1).astype(bool)).view(np.int64)
            return len(own), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), key.view(np.int64).tolist(), bits.tolist()

        return one

    return start


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _salted(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """many joined with one, which has a row or few for each key, on key, where the rows of a key may be very many.

    They are dealt to SALTS parts by a hash of the column by; one is copied only to the parts that a key has.
    """
    many = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    # a distinct on each side of the shuffle leaves a row for each part of a key
    copies = many.select(key, "_salt").distinct().join(one, key)
    return many.join(copies.select(*[F.col(c).alias(c) for c in copies.columns]), [key, "_salt"], how).drop("_salt")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids that link on their full sets. One a, or b, may have many partners."""
    of = lambda c: perhaps_among(texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")), pairs, c)
    both = _salted(_salted(pairs, of("b"), "b", "a"), of("a"), "a", "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        import pyarrow as pa

        last, own = None, None
        for whole in batches:
            for batch in slices(whole, 2):
                good = []
                for s, t in zip(batch.column(2), batch.column(3), strict=True):
                    s = s.as_py()
                    if s != last:
                        last, own = s, shingles(s, size)
                    good.append(_linked(own, shingles(t.as_py(), size), percent))
                kept = batch.filter(pa.array(good, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left and right set, by products of indicator matrices over slices of the shared universe."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    at = [[np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in side] for side in (left, right)]
    for k in range(0, len(both), 4096):
        parts = []
        for side in at:
            m = np.zeros((len(side), min(4096, len(both) - k)), np.float32)
            for i, x in enumerate(side):
                m[i, x[(x >= k) & (x < k + 4096)] - k] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _forest(link: np.ndarray, joined: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the links between rows and columns, those that connect what isn't yet; the joined columns are connected from the start."""
    parent = list(range(sum(link.shape)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    known = (np.flatnonzero(joined) + len(link)).tolist()
    for i in known:
        parent[i] = known[0]
    for x, y in np.argwhere(link).tolist():
        a, b = root(x), root(y + len(link))
        if a != b:
            parent[a] = b
            yield x, y


def _block(size: int, percent: int):
    def run(key: tuple, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(xs) and len(ys):
            left, right = [shingles(t, size) for t in xs["text"]], [shingles(t, size) for t in ys["text"]]
            both = _overlaps(left, right).astype(np.int64)
            n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
            link = 100 * both >= percent * (n[:, None] + m[None, :] - both)
            a, b = xs["id"].to_numpy(), ys["id"].to_numpy()
            link &= a[:, None] != b[None, :]
            found = [(a[x], b[y]) for x, y in _forest(link, ys["inside"].to_numpy(dtype=bool))]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all nodes of the edges (a, b): the smallest id that is reachable.

    Each round takes the smallest label among a node and its neighbours and then, where that label
    has one itself, the label of the label; the number of rounds grows with the logarithm of the
    longest path in practice. A hub's neighbours and a component's nodes are dealt to SALTS parts.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    ends = pinned(ends)
    labels = pinned(ends.groupBy(F.col("u").alias("id")).agg(F.least("id", F.min("v")).alias("label")))
    while True:
        near = _salted(ends, labels.select(F.col("id").alias("v"), "label"), "v", "u").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = pinned(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        # labels that have a smaller one; mostly none, and then no node is asked for them
        roots = step.select(F.col("label").alias("id")).distinct().join(step.select("id", F.col("label").alias("far")), "id")
        roots = pinned(roots.filter(F.col("far") < F.col("id")).select(F.col("id").alias("label"), "far"))
        if not roots.isEmpty():
            labels = pinned(_salted(step, roots, "label", "id", "left").select("id", F.coalesce("far", "label").alias("label")))
        elif step.filter(F.col("old") != F.col("label")).isEmpty():
            return step.select("id", "label")
        else:
            labels = step.select("id", "label")


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """What components() gives for the edges behind labels and more (a, b) together: only components that more joins are labelled anew."""
    ends = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id"))).distinct()
    known = pinned(labels.join(ends, "id", "full").select("id", F.coalesce("label", "id").alias("label")))
    of = lambda c: known.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    between = more.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).filter("a <> b")
    joined = components(between).select(F.col("id").alias("label"), F.col("label").alias("least"))
    return pinned(_salted(known, joined, "label", "id", "left").select("id", F.coalesce("least", "label").alias("label")))


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches of two nodes allow a link."""
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(COORDINATES // 64)), F.lit(0))
    return sizes & (differ <= COORDINATES - least_agreement(percent))


_SKETCH = [f"s{i}" for i in range(COORDINATES // 64)]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs.

    Links are pairs of documents whose sets of shingles of size words have a Jaccard similarity of
    percent / 100 or more; component_id is the smallest doc_id reachable over links, kept whether it
    is the row's own. Empty and null texts have no shingles and no links. Rows of one doc_id are one
    document and count as linked. A null doc_id has a null component and is kept. Other columns of
    docs are ignored.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    sketches = stored(map_texts(docs, "text", ["doc_id"], "n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>", _sketched(size, bands_for(percent))), "neardup-sketches")
    usable = sketches.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    first = F.first(F.struct("bands", "sketch"))
    groups = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), first.alias("f"))
    groups = stored(groups.select("d1", "d2", "id", "n", "f.bands", *[F.get("f.sketch", F.lit(i)).alias(s) for i, s in enumerate(_SKETCH)]), "neardup-groups")
    nodes = groups.select("id", "n", *_SKETCH)

    # buckets of several nodes, each with a leader that differs from bucket to bucket
    entries = groups.select("id", F.explode("bands").alias("key"))
    leader = F.min(F.col("id").bitwiseXOR(F.col("key"))).bitwiseXOR(F.col("key"))
    leaders = entries.groupBy("key").agg(leader.alias("leader"), F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    # an exchange follows the join by key, so a hot bucket may be split; sizes and sketches stay with their rows from here on
    shared = stored(entries.join(leaders.select("key", "leader"), "key").join(nodes, "id"), "neardup-buckets")
    x, y = shared.filter(F.col("id") != F.col("leader")).select("id", "leader", "n", *_SKETCH).distinct().alias("x"), nodes.alias("y")
    seen = x.join(y, (F.col("y.id") == F.col("x.leader")) & _alike("x", "y", percent))
    differ = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in _SKETCH), F.lit(0))
    best = F.array_sort(F.collect_list(F.struct(differ.alias("differ"), F.col("leader"))))  # a node has no more leaders than bands
    star = seen.groupBy(F.col("x.id").alias("id")).agg(F.slice(best, 1, LEADERS).alias("best")).select("id", F.explode("best.leader").alias("leader"))
    pairs = stored(star.select(F.col("leader").alias("a"), F.col("id").alias("b")), "neardup-stars")

    # texts of all nodes that share a bucket, one row for each text of an id; other texts aren't shuffled
    ids = shared.select("id").distinct()
    near = perhaps_among(docs, shared.select(F.col("id").alias("doc_id")), "doc_id")
    texts = near.join(ids, near["doc_id"] == ids["id"]).groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("id", "text")
    texts = stored(texts, "neardup-texts")
    edges = _verified(pairs, texts, size, percent).unionByName(_same_id(usable, groups))
    edges = stored(edges, "neardup-edges")
    labels = components(edges)

    # buckets that hold several components
    named = shared.join(labels, "id", "left").select("id", "key", F.coalesce("label", "id").alias("label"), "n", *_SKETCH)
    open_ = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") != F.col("high")).select("key")
    rest = named.join(open_, "key")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    rest = _salted(rest, sizes, "label", "id", "left").select("id", "key", "label", F.coalesce("members", F.lit(1)).alias("members"), "n", *_SKETCH)
    rest = stored(rest, "neardup-open")
    # nodes that share a bucket with a large component are its pool; they are compared in blocks with it and each other
    large = F.max(F.when(F.col("members") > SMALL, F.struct("members", "label")))
    near = rest.select("id", "key", "label").join(rest.groupBy("key").agg(large.alias("big")).filter("big IS NOT NULL"), "key").filter(F.col("label") != F.col("big.label"))
    pool = stored(near.groupBy("id").agg(F.max("big").alias("big")).select("id", F.col("big.label").alias("family")), "neardup-pool")
    rest = rest.join(pool, "id", "left")
    one_family = F.when((F.min("family") == F.max("family")) & (F.count("family") == F.count(F.lit(1))), F.min("family"))
    # the pairs of a bucket are made in cells: its rows are dealt to parts, and each part meets each, in a task of its own
    parts = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("parts"))
    rest = stored(_salted(rest, parts, "key", "id"), "neardup-parts")
    held = rest.groupBy("key", "label", "parts").agg(F.min("members").alias("members"), F.min("n").alias("n"), one_family.alias("family"), *[F.min(s).alias(s) for s in _SKETCH])
    part = lambda by, seed: F.pmod(F.xxhash64(by, F.lit(seed)), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    x = rest.withColumn("row", part("id", 1)).withColumn("column", every).alias("x")
    y = held.withColumn("column", part("label", 2)).withColumn("row", every).alias("y")
    smaller = (F.col("x.members") < F.col("y.members")) | ((F.col("x.members") == F.col("y.members")) & (F.col("x.label") < F.col("y.label")))
    fits = F.when(F.col("y.members") == 1, _alike("x", "y", percent)).otherwise(F.lit(True))
    pooled = F.coalesce((F.col("x.family") == F.col("y.family")) | (F.col("x.family") == F.col("y.label")), F.lit(False))
    against = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.column") == F.col("y.column")) & smaller & fits & ~pooled).select(F.col("x.id").alias("id"), F.col("y.label").alias("label"), F.col("y.members").alias("members")).distinct()
    against = stored(against, "neardup-against")
    members = nodes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # one after the other, as the driver holds threads and plans of all exchanges of a query at once
    few = stored(_few(against, nodes, members, percent), "neardup-few")
    few = stored(_verified(few, texts, size, percent), "neardup-more")
    many = stored(_many(against, pool, members, texts, size, percent), "neardup-more")
    labels = merged(labels, few.unionByName(many))

    named = groups.join(labels, "id", "left").select("d1", "d2", F.coalesce("label", "id").alias("component_id"))
    out = sketches.join(named, ["d1", "d2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(usable: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between an id that has rows of several sets and the nodes of those sets."""
    several = usable.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter(F.col("low") != F.col("high")).select("doc_id")
    rows = usable.select("doc_id", "d1", "d2").join(several, "doc_id").join(groups.select("d1", "d2", "id"), ["d1", "d2"])
    return rows.filter(F.col("doc_id") != F.col("id")).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def _few(against: DataFrame, nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs with the members of small components."""
    few, x, y = against.filter(F.col("members") <= SMALL), nodes.alias("x"), members.alias("y")
    joined = few.join(x, few["id"] == F.col("x.id")).join(y, (few["label"] == F.col("y.label")) & _alike("x", "y", percent))
    return joined.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"))


def _many(against: DataFrame, pool: DataFrame, members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of pools and other nodes with large components, and within pools, in blocks of bounded size."""
    asking = against.filter(F.col("members") > SMALL).select("id", "label").unionByName(pool.select("id", F.col("family").alias("label"))).distinct()
    asking = stored(asking, "neardup-asking")
    inside = members.select("id", "label", "n").join(asking.select("label").distinct(), "label").withColumn("inside", F.lit(True))
    outside = pool.select("id", F.col("family").alias("label")).join(members.select("id", "n"), "id").select("label", "id", "n").withColumn("inside", F.lit(False))
    asked = stored(inside.select("label", "id", "n", "inside").unionByName(outside), "neardup-asked")
    sizes = asked.groupBy("label").agg(F.count(F.lit(1)).alias("asked"), F.max("n").alias("top")).join(asking.groupBy("label").agg(F.count(F.lit(1)).alias("asking")), "label")
    rows = F.greatest(F.lit(8), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_SHINGLES / F.col("top"))))
    plan = stored(sizes.select("label", F.ceil(F.col("asking") / rows).alias("x_blocks"), F.ceil(F.col("asked") / rows).alias("y_blocks")), "neardup-plan")
    deal = lambda blocks, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    by = ["label", "x", "y"]
    # a text is looked up once and then copied to its blocks
    xs = asking.join(plan, "label").join(perhaps_among(texts, asking, "id"), "id").select("label", "id", "text", deal("x_blocks", 1).alias("x"), every("y_blocks").alias("y"))
    ys = asked.join(plan, "label").join(perhaps_among(texts, asked, "id"), "id").select("label", "id", "inside", "text", deal("y_blocks", 2).alias("y"), every("x_blocks").alias("x"))
    xs = xs.select(*[F.col(c).alias(c) for c in (*by, "id", "text")])
    ys = ys.select(*[F.col(c).alias(c) for c in (*by, "id", "inside", "text")])
    return xs.groupBy(*by).cogroup(ys.groupBy(*by)).applyInPandas(_block(size, percent), "a long, b long")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.to_id),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN c ON c.doc_id = w.doc_id
"""
