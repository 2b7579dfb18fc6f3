"""Spelling variants: words one edit apart, by two-dimensional range reporting over wavelet trees.

Words of one length are points: their rank in forward order and their rank in reverse order. For an
edit at one position, the words that share what stands before it are an interval of the forward
order, those that share what stands behind it an interval of the reverse order, and a wavelet tree
over the reverse ranks in forward order reports the points in both. Replacements ask the tree of the
word's own length, insertions that of the next one; deletions are insertions of the other word.

The vocabulary is dealt to groups: an edit in the second half leaves the first half as it is, and the
other way round, so a word meets its neighbours among the words that share a half. A group that is
too large is cut in the same way at the middle of the window that is left, round by round; in the
end a window is one place and its group no larger than the alphabet. A pair has one place of
replacement, or one leftmost place of insertion, so it is reported in one group, once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, pinned, stored, table
from .neardup import _salted
from .trie import CRC, CRC_TABLE

#: Words that share all outside a window are cut further if they have more bytes than this, times places of the window in units of 16; lighter groups share trees of about so many.
GROUP_BYTES = 4_000_000
#: (query, place) pairs, and bytes of words, of one slice while a tree is asked.
ASK_ROWS, ASK_BYTES = 200_000, 8_000_000

_RUN = r"[A-Za-zÀ-ÿ]+"


def damaged_words(docs: DataFrame, every: int = 97) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z lower-cased, and how often each occurs.

    Where every divides the crc32 of "<doc_id>:<run>", the run's code point at crc32 % length is
    taken out. Null texts have no runs; a null doc_id is written as nothing. A run that loses its
    only code point is no word.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(_RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class WaveletTree:
    """Reports, for intervals of places and intervals of values, the values found in both; all queries at once, level by level.

    The bits of the values are kept from the highest on, in the order that sorting by the higher bits
    gives; counts of zeros before each place lead from a level to the next.
    """

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.split = [], []
        for k in reversed(range(self.depth)):
            bit = (values >> k) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0)]))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of each value in low..high (exclusive) at a place in left..right (exclusive)."""
        live = np.flatnonzero((left < right) & (low < high))
        query, left, right, base = live, left[live], right[live], np.zeros(len(live), np.int64)
        for level in range(self.depth):
            zeros, split, half = self.zeros[level], self.split[level], 1 << (self.depth - 1 - level)
            l0, r0 = zeros[left], zeros[right]
            parts = []
            for a, b, c in ((l0, r0, base), (split + left - l0, split + right - r0, base + half)):
                ok = (a < b) & (c < high[query]) & (c + half > low[query])
                parts.append((query[ok], a[ok], b[ok], c[ok]))
            query, left, right, base = (np.concatenate(x) for x in zip(*parts, strict=True))
        times = right - left  # values are distinct ranks, so one each
        return np.repeat(query, times), np.repeat(base, times)


def _matrix(words: list[str], width: int, size: int) -> np.ndarray:
    """Bytes of words of one length, a row each: one byte for a code point where all are below 256, else four."""
    codec = "latin-1" if size == 1 else "utf-32-be"
    return np.frombuffer("".join(words).encode(codec, "surrogatepass" if size > 1 else "strict"), np.uint8).reshape(len(words), width * size)


def _interval(ordered: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Where rows' first keep bytes stand in the ordered byte strings."""
    low, high = np.zeros((len(rows), ordered.itemsize), np.uint8), np.full((len(rows), ordered.itemsize), 255, np.uint8)
    low[:, :keep] = high[:, :keep] = rows[:, :keep]
    kind = ordered.dtype
    return np.searchsorted(ordered, low.view(kind).ravel(), "left"), np.searchsorted(ordered, high.view(kind).ravel(), "right")


def near_in_group(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form_n, form) of a group's words that have near words in it: how many, and the largest n and least word of them.

    Rows: word, n, of (length of the tree's words), low and high (the window). Words of length of are
    points and ask for replacements, those one shorter ask for insertions.
    """
    none = pd.DataFrame({"word": pd.Series([], dtype=str), "n_near": pd.Series([], dtype="int64"), "form_n": pd.Series([], dtype="int64"), "form": pd.Series([], dtype=str)})
    width, low, high = (int(rows[c].iloc[0]) for c in ("of", "low", "high"))
    words, n = rows["word"].to_numpy(dtype=object), rows["n"].to_numpy(dtype=np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    own, short = np.flatnonzero(lengths == width), np.flatnonzero(lengths == width - 1)
    if not len(own) or len(words) < 2:
        return none
    size = 1 if all(ord(c) < 256 for c in set("".join(words))) else 4
    points = _matrix(list(words[own]), width, size)
    kind = f"S{width * size}"
    flipped = points.reshape(len(own), width, size)[:, ::-1].reshape(len(own), -1).copy()
    forward, backward = np.argsort(points.copy().view(kind).ravel(), kind="stable"), np.argsort(flipped.view(kind).ravel(), kind="stable")
    ahead, behind = points[forward].copy().view(kind).ravel(), flipped[backward].copy().view(kind).ravel()
    rank = np.empty(len(own), np.int64)
    rank[backward] = np.arange(len(own))
    tree = WaveletTree(rank[forward])

    left_ids, right_ids = [], []
    for ids, gap in ((own, 1), (short, 0)):
        step = max(1, min(ASK_ROWS // max(1, high - low), ASK_BYTES // (width * size)))
        for k in range(0, len(ids), step):
            asking = ids[k : k + step]
            rows_f = _matrix(list(words[asking]), width - 1 + gap, size)
            rows_b = rows_f.reshape(len(asking), -1, size)[:, ::-1].reshape(len(asking), -1)
            bounds = []
            for i in range(low, high):  # the first i code points, and those behind the place
                tail = width - 1 - i
                bounds.append((*_interval(ahead, rows_f, i * size), *_interval(behind, rows_b, tail * size)))
            asked = [np.concatenate(x) for x in zip(*bounds, strict=True)]
            query, value = tree.report(*asked)
            place, asker = low + query // len(asking), asking[query % len(asking)]
            target = backward[value]
            if gap:
                fits = asker < own[target]  # each pair of replacements once, and no word with itself
            else:
                cells = points.reshape(len(own), width, size)
                fits = (place == 0) | np.any(cells[target, place] != cells[target, np.maximum(place - 1, 0)], axis=1)  # leftmost place
            left_ids.append(asker[fits])
            right_ids.append(own[target[fits]])
    a, b = np.concatenate(left_ids), np.concatenate(right_ids)
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    if not len(one):
        return none
    spelled = np.argsort(np.argsort(words.astype(str), kind="stable"), kind="stable") if len(words) else words
    best = np.lexsort((spelled[other], -n[other], one))
    heads = best[np.unique(one[best], return_index=True)[1]]
    counts = np.bincount(one, minlength=len(words))
    return pd.DataFrame({"word": words[one[heads]], "n_near": counts[one[heads]], "form_n": n[other[heads]], "form": words[other[heads]]})


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the group: what a word has outside its window, with the tree's length and the window."""
    before = F.substring("word", F.lit(1), F.col("low"))
    behind = F.substring(F.col("word"), F.length("word") - (F.col("of") - F.col("high")) + 1, F.col("of") - F.col("high"))
    return rows.withColumn("key", F.xxhash64("of", "low", "high", before, behind))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice, with the halves of its window."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    cut = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return _keyed(rows.withColumn("w", F.explode(cut)).select("word", "n", "of", "w.low", "w.high").filter("low < high"))


def near_words(words: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(word, n_near, form_n, form) of the words, given as (word, n), that have near ones: the count, and the largest n with the least such word.

    Two words are near if one replaced, inserted or deleted code point makes one of them the other.
    Words are distinct; null and empty words take no part. group_bytes bounds what one task holds;
    results don't depend on it.
    """
    size = F.length("word")
    both = F.explode(F.array(size, size + 1)).alias("of")
    start = words.filter("word <> ''").select("word", F.col("n").cast("long").alias("n"), both)
    work = _halves(start.select("word", "n", "of", F.lit(0).alias("low"), F.col("of").alias("high")))
    # the weight of a row: its bytes and, for long windows, its places
    weight = F.col("of").cast("long") * F.greatest(F.lit(1), F.floor((F.col("high") - F.col("low")) / 16))
    small, total = [], 0
    while True:
        has_points = F.max((F.length("word") == F.col("of")).cast("int"))
        sizes = work.groupBy("key").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("rows"), F.max(F.col("high") - F.col("low")).alias("places"), has_points.alias("points"))
        heavy = (F.col("weight") > group_bytes) & (F.col("places") > 1)
        large = pinned(sizes.filter(heavy).select("key", ((F.col("rows") > 1) & (F.col("points") == 1)).alias("go_on")))
        total += sizes.filter(~heavy).agg(F.sum("weight")).first()[0] or 0
        if large.isEmpty():
            small.append(work)
            break
        marked = stored(_salted(work, large, "key", "word", "left"), "spelling-groups")
        small.append(marked.filter("go_on IS NULL").drop("go_on"))
        work = _halves(marked.filter("go_on").drop("go_on"))  # words alone in a heavy group have no near ones there
    everything = small[0]
    for part in small[1:]:
        everything = everything.unionByName(part)
    # groups of one window share trees: a pair found in such a tree has one key, for it agrees outside the window
    buckets = max(1, math.ceil(total / group_bytes))
    dealt = everything.groupBy("of", "low", "high", F.pmod(F.col("key"), F.lit(buckets)).alias("bucket"))
    found = dealt.applyInPandas(near_in_group, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")


def variant_groups(words: DataFrame, times: int = 2, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n, a row for each of the words (word, n).

    form is the near word of largest n, of those the least in code-point order, if that n is at least
    times the word's own; else it and form_n are null. root is where following forms from the word
    ends. times is over 1, so n grows along forms and nothing goes round. No words, no rows.
    """
    near = near_words(words, group_bytes)
    joined = words.select("word", F.col("n").cast("long").alias("n")).join(near, "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    formed = joined.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n"))
    formed = stored(formed, "spelling-forms")
    # pointers double: n at least doubles along a form, so a chain has few links and takes fewer rounds still
    chains = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = pinned(_salted(chains, onward, "root", "word", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        chains = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return formed.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = damaged_words(table(spark, sf_dir, "documents")).filter((F.length("word") >= 5) & (F.col("n") >= 3))
    return variant_groups(stored(words, "spelling-words"))


ORACLE = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
r AS (SELECT doc_id, r, count(*) AS n FROM t GROUP BY 1, 2),
b AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM r),
h AS (SELECT r, n, {CRC.format(bytes="list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)")} AS h FROM b, crc),
d AS (SELECT CASE WHEN h % 97 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT DISTINCT word, n, i, word[1:i - 1] AS a, word[i + 1:] AS z FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
e AS (SELECT x.word AS u, y.word AS v, y.n FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT w.word, p.word, p.n FROM w JOIN p ON w.word = p.a || p.z
  UNION SELECT p.word, w.word, w.n FROM w JOIN p ON w.word = p.a || p.z),
g AS (SELECT u, count(*) AS n_near, max(n) AS m, arg_min(v, {{'n': -n, 'v': v}}) AS v FROM e GROUP BY u),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * w.n THEN v END AS form, CASE WHEN m >= 2 * w.n THEN m END::BIGINT AS form_n FROM w LEFT JOIN g ON g.u = w.word),
c(word, cur) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.cur WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.cur AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f l ON l.word = c.cur WHERE l.form IS NULL
"""
