"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The items of a bounded number of words are sent to every executor, whose Python workers build the
automaton of them; documents stream through it a word at a time, following suffix links on a
mismatch, so that at each word the length of the longest match with any item is known. A match of
`window` words or more ends an occurrence of a window of the items under that state; items shorter
than the window count as a whole. Benchmarks over `shard_words` words are cut into shards, which take
their turn: one shard is on the driver and one automaton in a worker at a time, and what the shards
hit is written down and merged per document.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, map_texts, stored, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = str.maketrans(UPPER, LOWER)
WINDOW = 10
#: Words of items in one automaton; about 400 bytes for each in an executor's Python.
SHARD_WORDS = 200_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_LOWER)) if text else []


class Automaton:
    """States are numbered from 0, the root. step: words that lead on; link: suffix link; size: longest string."""

    def __init__(self, items: Iterable[tuple[object, list[str]]], window: int = WINDOW) -> None:
        self.window = window
        self.step: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        kept = [(key, seq) for key, seq in items if seq]
        for _, seq in kept:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        self.ids: dict[int, dict[object, None]] = {}  # of the states of windows
        self.short: list[tuple[tuple[int, object], ...]] = [()] * len(self.step)
        for key, seq in kept:
            if len(seq) < window:
                state = 0
                for word in seq:
                    state = self.step[state][word]
                self.short[state] += ((len(seq), key),)
            else:
                for state, n in self.walk(seq):
                    if n >= window:
                        self.ids.setdefault(self._window_state(state), {})[key] = None
        # shorter items that end wherever a longer string does
        for state in sorted(range(1, len(self.step)), key=self.size.__getitem__):
            if self.short[self.link[state]]:
                self.short[state] += self.short[self.link[state]]
        self.at = [self._window_state(s) if self.size[s] >= window else -1 for s in range(len(self.step))]
        self.least = min([window, *(len(seq) for _, seq in kept)])

    def _extend(self, last: int, word: str) -> int:
        step, link, size = self.step, self.link, self.size
        if word in step[last]:
            q = step[last][word]
            return q if size[q] == size[last] + 1 else self._clone(last, word, q)
        cur = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = cur
            p = link[p]
        if p >= 0:
            q = step[p][word]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word: str, q: int) -> int:
        step, link, size = self.step, self.link, self.size
        new = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = new
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = new
            p = link[p]
        return new

    def _window_state(self, state: int) -> int:
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, seq: list[str]) -> Iterator[tuple[int, int]]:
        """The state and the length of the longest match at each word."""
        step, link, size = self.step, self.link, self.size
        state = n = 0
        for word in seq:
            to = step[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = step[state].get(word)
                n = size[state]
            if to is None:
                state = n = 0
            else:
                state, n = to, n + 1
            yield state, n

    def hits(self, seq: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Merged word intervals [start, end) of occurrences, and the items that have them."""
        step, link, size, at, short, least = self.step, self.link, self.size, self.at, self.short, self.least
        spans: list[list[int]] = []
        states: set[int] = set()
        keys: set = set()
        root = step[0]
        state = n = 0
        for i, word in enumerate(seq):
            to = step[state].get(word)
            if to is None:
                if not state:
                    continue
                while True:
                    state = link[state]
                    to = step[state].get(word)
                    if to is not None or not state:
                        break
                n = size[state]
                if to is None:
                    n = 0
                    continue
            state = to
            n += 1
            if n < least:
                continue
            most = 0
            if n >= self.window:
                most = self.window
                states.add(at[state])
            for k, key in short[state]:
                if k <= n:
                    keys.add(key)
                    most = max(most, k)
            if most:
                start = i + 1 - most
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        for s in states:
            keys.update(self.ids[s])
        return [tuple(s) for s in spans], keys


#: The automaton that this Python worker built last, by the name of its shard.
_BUILT: dict[str, Automaton] = {}


def _shards(benchmark: DataFrame, text: str, item_id: str, shard_words: int, window: int = WINDOW) -> list[DataFrame]:
    """(id, w) of the items in tables of bounded size; items without words or id are left out. Words are made and counted by Spark.

    An item of more words than a shard holds is cut into pieces that overlap by a window less one word.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(_SPARK_WORD), F.lit(0)).alias("w")).filter((F.size("w") > 0) & F.col("id").isNotNull())
    total = items.agg(F.sum(F.size("w").cast("long"))).first()[0] or 0
    if total <= shard_words:
        return [items]
    most = max(shard_words, window)
    starts = F.sequence(F.lit(0), F.size("w") - most, F.lit(most - window + 1))
    begins = F.array_distinct(F.concat(starts, F.array(F.size("w") - most)))
    pieces = F.when(F.size("w") > most, F.transform(begins, lambda i: F.slice("w", i + 1, most))).otherwise(F.array("w"))
    n = math.ceil(total / shard_words)
    cut = items.select("id", F.posexplode(pieces).alias("piece", "w")).select("id", "w", F.pmod(F.xxhash64("id", "piece"), F.lit(n)).alias("shard"))
    cut = stored(cut, "decontaminate-items")
    return [cut.filter(F.col("shard") == k).select("id", "w") for k in range(n)]


class _Sent:
    """The items of one shard, broadcast. built() returns their automaton on executors, made once in each Python worker."""

    def __init__(self, shard: DataFrame, window: int) -> None:
        items = [(r["id"], r["w"]) for r in shard.collect()]
        self.sent = shard.sparkSession.sparkContext.broadcast(items)
        sent, tag = self.sent, uuid.uuid4().hex

        def built() -> Automaton:
            if tag not in _BUILT:
                _BUILT.clear()
                _BUILT[tag] = Automaton(sent.value, window)
            return _BUILT[tag]

        self.built = built


def _by_shard(shards: list[DataFrame], window: int, hits) -> list[DataFrame]:
    """What hits(built, number) finds with each shard in turn, written down before the shard is let go."""
    out = []
    for n, shard in enumerate(shards):
        own = _Sent(shard, window)
        out.append(stored(hits(own.built, n), "decontaminate-hits"))
        own.sent.destroy()
    return out


def _hits(docs: DataFrame, keep: list[str], text: str, built) -> DataFrame:
    def start():
        auto = built()

        def one(t: str | None):
            seq = words(t)
            spans, ids = auto.hits(seq)
            return len(seq), [list(s) for s in spans], sorted(ids)

        return one

    return map_texts(docs, text, keep, "n_words long, spans array<array<int>>, items array<string>", start)


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the intervals and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, spans (merged word intervals of occurrences) and items (their ids as strings, sorted), a row per row.

    Null and empty texts have no words; items without words or id are no items. Items with one text
    are each counted. An empty benchmark hits nothing. Columns of docs other than doc_id and text are ignored.
    """
    shards = _shards(benchmark, text, item_id, shard_words, window)
    rows = docs.select("doc_id", text)
    if len(shards) == 1:
        return _hits(rows, ["doc_id"], text, _Sent(shards[0], window).built)
    # a row is named by doc_id and two hashes of its text; repeated rows are alike and keep their number
    named = rows.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(text, F.lit(1)))
    # the first shard keeps all rows, the others those that they hit
    each = _by_shard(shards, window, lambda built, n: _hits(named, ["doc_id", "_h1", "_h2"], text, built).filter((F.size("spans") > 0) | F.lit(n == 0)).withColumn("first", F.lit(n == 0)))
    # repeated rows are hit alike, so that a set holds as many lists as there are shards at most
    distinct = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    one = reduce(DataFrame.unionByName, each).groupBy("doc_id", "_h1", "_h2").agg(F.max("n_words").alias("n_words"), distinct("spans").alias("s"), distinct("items").alias("items"), F.count_if("first").alias("n"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return one.select("doc_id", "n_words", _merged(F.col("s")).alias("spans"), "items", copies.alias("_c")).drop("_c")


def _merged(s: Column) -> Column:
    """Sorted intervals, with those that meet or overlap joined."""
    none = F.array().cast("array<array<int>>")

    def step(acc, s):
        last = F.get(acc, F.size(acc) - 1)
        longer = F.array(F.get(last, F.lit(0)), F.greatest(F.get(last, F.lit(1)), s[1]))
        return F.when((F.size(acc) > 0) & (F.get(last, F.lit(1)) >= s[0]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.when(F.size(s) == 0, none).otherwise(F.aggregate(s, none, step))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text: str = "text", item_id: str = "item_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with the occurrences cut out of the texts; documents hit in more than max_coverage of their words go.

    Coverage is judged once, on the given text, over all items. Cutting repeats until nothing is hit,
    also where a cut brings words together. The number of shards doesn't change the result. Null texts
    stay null, and columns keep their names and order, whatever they are.
    """
    columns = docs.columns
    shards = _shards(benchmark, text, item_id, shard_words, window)
    if len(shards) > 1:
        return _clean_by_shards(docs, shards, window, max_coverage, text)
    built = _Sent(shards[0], window).built
    cut_, gone = _free("_cut", columns), _free("_gone", columns)

    def start():
        auto = built()

        def one(t: str | None):
            seq = words(t)
            spans = auto.hits(seq)[0]
            if sum(b - a for a, b in spans) > max_coverage * max(1, len(seq)):
                return None, True
            while spans:
                t = remove(t, spans)
                spans = auto.hits(words(t))[0]
            return t, False

        return one

    cut = map_texts(docs, text, columns, f"`{cut_}` string, `{gone}` boolean", start).filter(~F.col(f"`{gone}`"))
    return cut.select(*[F.col(f"`{cut_}`").alias(text) if c == text else F.col(f"`{c}`") for c in columns])


def _free(name: str, columns: list[str]) -> str:
    """A column name like the given one that no column has."""
    while name in columns:
        name += "_"
    return name


def _clean_by_shards(docs: DataFrame, shards: list[DataFrame], window: int, max_coverage: float, text: str) -> DataFrame:
    """clean() in rounds: what all shards hit is merged for each text and cut at once; texts that were cut go to the next round."""
    given, done, first = docs.columns, [], True
    docs = docs.select(*[F.col(f"`{c}`").alias("text" if c == text else f"c{i}") for i, c in enumerate(given)])  # so that no name clashes
    columns, text = docs.columns, "text"
    cut = F.udf(remove, "string")
    while True:
        named = docs.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(text, F.lit(1)))
        each = reduce(DataFrame.unionByName, _by_shard(shards, window, lambda built, n: _hits(named, ["_h1", "_h2"], text, built).filter(F.size("spans") > 0)))
        # copies of a text are hit alike, so that a set holds as many lists as there are shards at most
        one = each.groupBy("_h1", "_h2").agg(F.max("n_words").alias("_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("_s"))
        n_hit = F.aggregate("_s", F.lit(0), lambda n, s: n + s[1] - s[0])
        hit = one.select("_h1", "_h2", "_n", _merged(F.col("_s")).alias("_s")).select("_h1", "_h2", "_s", (F.lit(first) & (n_hit > max_coverage * F.col("_n"))).alias("_gone"))
        hit = stored(hit, "decontaminate-hits")
        done.append(named.join(hit, ["_h1", "_h2"], "left_anti").select(*[F.col(f"`{c}`") for c in columns]))
        if hit.isEmpty():
            return reduce(DataFrame.unionByName, done).toDF(*given)
        left = named.join(hit.filter(~F.col("_gone")), ["_h1", "_h2"])
        docs = stored(left.select(*[cut(text, "_s").alias(c) if c == text else F.col(f"`{c}`") for c in columns]), "decontaminate-cut")
        first = False


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
g AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM w, ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
h AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON g.k = win.k AND g.s = win.s),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
