"""Exact top-k search by inner product: KD-trees per shard, searched best-first.

A coarse tree of median splits, fitted to a bounded sample, cuts the space into cells; each vector
falls into one, and the cells' tight boxes, over all vectors, are the only thing that the driver
holds. A cell of many vectors is dealt to several shards, each small enough for one task, with a
KD-tree of its own: its splits are at the median of the widest component and each node keeps the
tight box of its points. The most that a query can score in a box is the sum of the larger product
at each component's two ends. Nodes are visited in the order of that bound until it falls below the
query's kth score so far.

Queries go in three waves: to their own cell, then to the few cells of the largest bounds, then to
all the others whose bound still reaches the kth score known by then. A task holds one shard and one
block of queries, never more; a shard is moved once for each full block that asks it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Vectors in a cell on average, and cells at most; vectors and queries in a task; rows of a leaf.
CELL_ROWS, CELLS, SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8_192, 1_024, 32_768, 4_096, 128
#: Numbers that the coarse tree is fitted on, and that the boxes hold, at most.
SAMPLE_NUMBERS, BOX_NUMBERS = 2_000_000, 500_000
#: Cells that a query asks in the second wave.
NEAR = 8
_LONG = 2**63 - 1


class KDTree:
    """points: one integer vector a row. Nodes are numbered from the root, 0; leaves hold rows[start:end] of the reordered points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(points))
        low, high, self.kids, self.rows = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            own = points[self.order[start:end]]
            node, lo, hi = len(low), own.min(axis=0), own.max(axis=0)
            low.append(lo)
            high.append(hi)
            self.kids.append([-1, -1])
            self.rows.append((start, end))
            if parent >= 0:
                self.kids[parent][side] = node
            wide = hi - lo
            axis = int(wide.argmax()) if wide.size else 0
            if end - start > leaf and wide.size and wide[axis] > 0:
                half = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], half)]
                todo += [(start, start + half, node, 0), (start + half, end, node, 1)]
        self.low, self.high, self.points = np.array(low), np.array(high), points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each query can score in each node's box."""
        none = np.zeros_like(queries)
        return np.maximum(queries, none) @ self.high.T + np.minimum(queries, none) @ self.low.T


def search(tree: KDTree, ids: np.ndarray, uids: np.ndarray, queries: np.ndarray, own: np.ndarray, kth: list, k: int) -> Iterator[tuple[int, int, int]]:
    """(number of the query, place of the candidate, score) of the best k of each query that score kth or more, own row left out."""
    ids, uids = ids[tree.order], uids[tree.order]
    bounds = tree.bounds(queries)
    for n, query in enumerate(queries):
        bound, least, best = bounds[n], kth[n], []  # best: (score, -vec_id, place), smallest first
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if least is not None and -most < least:
                break
            a, b = tree.kids[node]
            if a >= 0:
                for child in (a, b):
                    if least is None or bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            start, end = tree.rows[node]
            scores = tree.points[start:end] @ query
            good = uids[start:end] != own[n]
            if least is not None:
                good &= scores >= least
            places = np.flatnonzero(good)
            if len(places) > k:
                places = places[np.lexsort((ids[start:end][places], -scores[places]))[:k]]
            for i in places:
                entry = (scores[i], -int(ids[start + i]), start + int(i))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k and (least is None or best[0][0] > least):
                least = best[0][0]
        for score, _, place in best:
            yield n, place, int(score)


def _numbers(*series: pd.Series) -> list[np.ndarray]:
    """Matrices of float64 where all inner products between them are exact in it, else of Python integers."""
    whole = [np.stack(s.to_numpy()).astype(np.int64) for s in series]
    reach = max(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in whole)
    exact = reach * reach * max(1, whole[0].shape[1]) < 2**53
    return [x.astype(np.float64 if exact else object) for x in whole]


def _searcher(k: int):
    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            points, asked = _numbers(vectors["v"], queries["v"])
            tree = KDTree(points)
            ids, uids, own = vectors["vec_id"].to_numpy(), vectors["uid"].to_numpy(), queries["uid"].to_numpy()
            kth = [None if pd.isna(x) else int(x) for x in queries["kth"]]
            qids = queries["vec_id"].to_numpy()
            ids_in, uids_in = ids[tree.order], uids[tree.order]
            out = [(qids[n], own[n], ids_in[p], uids_in[p], max(-_LONG, min(_LONG, s))) for n, p, s in search(tree, ids, uids, asked, own, kth, k)]
        return pd.DataFrame(out, columns=["query_id", "quid", "vec_id", "uid", "score"])

    return run


_FOUND = "query_id long, quid long, vec_id long, uid long, score long"


class Cells:
    """Coarse trees by dimension: cell numbers of vectors, from 0; a dimension without a tree is one cell."""

    def __init__(self, sample: dict[int, np.ndarray], cells: int) -> None:
        total = sum(map(len, sample.values()))
        self.trees: dict[int, list] = {}
        self.size: dict[int, int] = {}
        for dim, points in sample.items():
            self.size[dim] = 0
            self.trees[dim] = self._split(dim, points, max(1, round(cells * len(points) / total)))

    def _split(self, dim: int, points: np.ndarray, cells: int) -> list:
        wide = points.max(axis=0) - points.min(axis=0) if points.size else np.zeros(0)
        if cells > 1 and wide.size and wide.max() > 0:
            axis = int(wide.argmax())
            at = float(np.median(points[:, axis]))
            left = points[:, axis] < at
            if not left.any():
                at = float(np.nextafter(points[:, axis].min(), np.inf))
                left = points[:, axis] < at
            return [axis, at, self._split(dim, points[left], cells // 2), self._split(dim, points[~left], cells - cells // 2)]
        self.size[dim] += 1
        return [self.size[dim] - 1]

    def of(self, dim: int, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(self.trees[dim], np.arange(len(points)))] if dim in self.trees else []
        while todo:
            node, rows = todo.pop()
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                left = points[rows, node[0]] < node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def _by_dim(v: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each dimension in a batch, the rows that have it, and their vectors in float64."""
    dims = v.map(len).to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, np.stack(v.iloc[rows].to_numpy()).astype(np.float64)


def _fitted(rows: DataFrame, n: int, cell_rows: int) -> Cells:
    """From a random sample of SAMPLE_NUMBERS components; the result of the search doesn't depend on it."""
    widest = rows.agg(F.max("dim")).first()[0] or 1
    cells = max(1, min(CELLS, math.ceil(n / cell_rows), BOX_NUMBERS // (2 * widest)))
    if cells == 1:
        return Cells({}, 1)
    most = max(1, SAMPLE_NUMBERS // widest)
    sample = rows.select("v").filter(F.xxhash64("uid", F.lit(11)) < int(2**64 * min(1.0, most / n) - 2**63)) if n > most else rows.select("v")
    got = sample.limit(2 * most).toPandas()
    return Cells({dim: points for dim, _, points in _by_dim(got["v"])}, cells)


def _celled(rows: DataFrame, cells: Cells) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            for dim, at, points in _by_dim(batch["v"]):
                cell[at] = sent.value.of(dim, points)
            yield batch.assign(cell=cell)

    return rows.mapInPandas(run, "vec_id long, v array<bigint>, dim int, uid long, asks boolean, cell int")


def _boxes(rows: DataFrame, cells: Cells) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension with a tree: the cells that hold vectors, and the least and the largest of each component there."""
    known = rows.filter(F.col("dim").isin(*cells.trees)) if cells.trees else rows.limit(0)
    ends = known.select("dim", "cell", F.posexplode("v").alias("i", "x")).groupBy("dim", "cell", "i").agg(F.min("x").alias("low"), F.max("x").alias("high")).toPandas()
    out = {}
    for dim, part in ends.sort_values(["cell", "i"]).groupby("dim"):
        out[int(dim)] = part["cell"].to_numpy()[:: int(dim)], part["low"].to_numpy(np.float64).reshape(-1, int(dim)), part["high"].to_numpy(np.float64).reshape(-1, int(dim))
    return out


def _asked(asking: DataFrame, boxes: dict, first: int, last: int | None) -> DataFrame:
    """A row of a query for each cell other than its own whose bound reaches the query's kth (in decimal), of those from place first to last in the order of bounds."""
    sent = asking.sparkSession.sparkContext.broadcast(boxes)

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.iloc[at : at + 256]
                for dim, rows, q in _by_dim(batch["v"]):
                    if dim not in sent.value:
                        continue
                    names, low, high = sent.value[dim]
                    most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    # what float64 may have lost
                    most += 1 + 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
                    own = batch.iloc[rows]
                    most[names[None, :] == own["cell"].to_numpy()[:, None]] = -np.inf
                    place = (-most).argsort(axis=1, kind="stable").argsort(axis=1)
                    kth = np.array([-np.inf if x is None else float(x) for x in own["kth"]])
                    wanted = (most >= kth[:, None]) & (place >= first) & (most > -np.inf)
                    if last is not None:
                        wanted &= place < last
                    n, c = np.nonzero(wanted)
                    yield own.iloc[n].assign(to_cell=names[c].astype(np.int32))

    return asking.mapInPandas(run, "vec_id long, v array<bigint>, dim int, uid long, cell int, kth string, to_cell int")


def _part(parts: str, seed: int) -> Column:
    """The part of so many that a row falls into."""
    return F.pmod(F.xxhash64("uid", F.lit(seed)), F.col(parts)).cast("int")


def _plan(asked: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    """dim, to_cell, shards and blocks of the cells that are asked: queries of all cells that ask one are dealt to blocks of block_rows."""
    blocks = asked.groupBy("dim", "to_cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    return blocks.join(sizes.select("dim", F.col("cell").alias("to_cell"), "shards"), ["dim", "to_cell"])


def _moved(points: DataFrame, plan: DataFrame) -> DataFrame:
    """The vectors of the cells that are asked, once for each block of queries: a shard's tree is built once for BLOCK_ROWS queries, whatever cells they are from."""
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    met = points.withColumnRenamed("cell", "to_cell").join(F.broadcast(plan), ["dim", "to_cell"])
    columns = met.select("dim", "to_cell", "shard", every, "vec_id", "v", "uid")
    return columns.select(*[F.col(c).alias(c) for c in columns.columns])


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component; null for null vectors and those with null or non-finite components."""
    x = F.transform(embedding, lambda e: e.cast("double"))
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(~F.coalesce(odd, F.lit(True)), F.transform(x, lambda e: F.floor(e * 256)))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors where queries holds, the k best of all other rows.

    vectors: vec_id and v, an array<bigint>. Rows with a null id or vector take no part. Only vectors
    of one length are compared. Ties go to the smaller vec_id; a repeated row is another row, and as
    a query is asked again. Scores beyond a bigint are held at its ends. Fewer than k others: all.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("uid"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = stored(rows, "topk-vectors")
    cells = _fitted(rows, rows.count(), cell_rows)
    rows = stored(_celled(rows, cells), "topk-cells")
    # a row for each cell, of which there are few
    sizes = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    points = rows.join(F.broadcast(sizes), ["dim", "cell"]).select("dim", "cell", _part("shards", 0).alias("shard"), "vec_id", "v", "uid")
    asking = rows.filter("asks").select("vec_id", "v", "dim", "uid", "cell")

    def wave(asked: DataFrame) -> DataFrame:
        """asked: queries, each with to_cell and kth."""
        plan = _plan(asked, sizes, block_rows)
        every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
        left = _moved(points, plan)
        right = asked.join(F.broadcast(plan), ["dim", "to_cell"]).select("dim", "to_cell", every, _part("blocks", 1).alias("block"), "vec_id", "v", "uid", "kth")
        by = ["dim", "to_cell", "shard", "block"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_searcher(k), _FOUND)

    found = [stored(wave(asking.withColumn("kth", F.lit(None).cast("string")).withColumn("to_cell", F.col("cell"))), "topk-home")]
    boxes = _boxes(rows, cells)
    if any(len(names) > 1 for names, _, _ in boxes.values()):
        for first, last in ((0, NEAR), (NEAR, None)):
            so_far = reduce(DataFrame.unionByName, found).groupBy(F.col("quid").alias("uid")).agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("s"))
            kth = so_far.select("uid", F.when(F.size("s") == k, F.get("s", F.lit(k - 1)).cast("string")).alias("kth"))
            known = asking.join(kth, "uid", "left").select("vec_id", "v", "dim", "uid", "cell", "kth")
            found.append(stored(wave(_asked(known, boxes, first, last)), "topk-wave"))
    best = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.uid AS quid, c.vec_id, c.uid, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id, uid)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
