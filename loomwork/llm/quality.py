"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each indicator is scaled by the log-count ratio of the classes (Wang and Manning, 2012), each text
then by its norm, and a linear hinge-loss model is fitted by dual coordinate descent (Hsieh et al.,
2008). A logistic curve fitted to out-of-fold margins turns margins into probabilities.

n-grams are of three kinds: one to three shapes of consecutive tokens, where a shape keeps case,
digits and signs of a token and whether the token, or the line, repeats the one before; and the
lower-cased words. They are hashed, which bounds the model; a text is read whole: a token without
end, as in scripts without spaces or junk, is also read as pieces that are tokens of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, stored, table

BUCKETS = 1 << 18
#: Labelled rows, and bytes of their n-grams, that the model is fitted on at most, taken in the order of a hash of doc_id.
SAMPLE, SAMPLE_BYTES = 6_000, 128_000_000
THRESHOLD = 0.3
#: Bytes of what a Python worker remembers of tokens, and those of an entry beside the token's characters.
CACHE, _ENTRY = 24_000_000, 250
#: Tokens of more characters are read in pieces: up to 20 word characters and the signs after them.
LONG, _PIECE = 200, re.compile(r"\w{1,20}\W{0,20}|\W{1,20}")

_RUNS = [(re.compile(p), to) for p, to in ((r"[^\W\d_a-zß-öø-ÿ]+", "A"), (r"[a-zß-öø-ÿ]+", "a"), (r"\d+", "0"), (r"(\W)\1+", r"\1\1"))]


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Grams:
    """text to the sorted distinct buckets of its n-grams; shape and word hashes of tokens are remembered, in bounded bytes."""

    def __init__(self, cache: int = CACHE) -> None:
        self.most = self.room = cache
        self.tokens: dict[str, tuple[int, int]] = {}
        self.start, self.end, self.line, self.same_line, self.same = map(_hash, ("^", "$", "\n", "\n=", "="))

    def _token(self, word: str) -> tuple[int, int]:
        got = self.tokens.get(word)
        if got is None:
            shape = word
            for pattern, to in _RUNS:
                shape = pattern.sub(to, shape)
            got = _hash("s " + shape), _hash("w " + word.lower())
            self.room -= _ENTRY + 4 * len(word)
            if self.room < 0:
                self.tokens.clear()
                self.room = self.most
            self.tokens[word] = got
        return got

    def _pieces(self, line: str, words: set[int]) -> Iterator[str]:
        """The line's tokens, long ones in pieces; the whole of a long one adds its hash and isn't remembered."""
        for word in line.split():
            if len(word) <= LONG:
                yield word
            else:
                words.add(_hash("w " + word.lower()))
                yield from (m[0] for m in _PIECE.finditer(word))

    def __call__(self, text: str | None) -> np.ndarray:
        shapes, words, lines = [self.start], set(), set()
        token = self._token
        for line in (text or "").split("\n"):
            name = hash(line)
            shapes.append(self.same_line if name in lines else self.line)
            lines.add(name)
            last = None
            for word in self._pieces(line, words):
                shape, own = token(word)
                shapes.append(self.same if word == last else shape)
                words.add(own)
                last = word
        shapes.append(self.end)
        one = _mix(np.array(shapes, np.uint64) + np.uint64(1))
        two = _mix(one[:-1] * np.uint64(3) + one[1:])
        three = _mix(two[:-1] * np.uint64(5) + one[2:])
        found = np.concatenate([one, two, three, np.fromiter(words, np.uint64, len(words))])
        return np.unique(found % np.uint64(BUCKETS)).astype(np.int32)


class Model:
    """scale: what each indicator counts; weight: of the hinge-loss model, for scaled indicators; curve: of the probability."""

    def __init__(self, scale: np.ndarray, weight: np.ndarray, bias: float, curve: tuple[float, float]) -> None:
        self.scale, self.square, self.product = scale, scale.astype(np.float64) ** 2, scale.astype(np.float64) * weight
        self.bias, self.curve = bias, curve

    def margin(self, x: np.ndarray) -> float:
        norm = float(self.square[x].sum()) ** 0.5
        return float(self.product[x].sum()) / (norm or 1.0) + self.bias

    def score(self, x: np.ndarray) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + float(np.exp(-np.clip(a * self.margin(x) + b, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, BUCKETS), smooth)
    for x, y in zip(rows, labels, strict=True):
        counts[y, x] += 1
    seen = counts.sum(axis=0) > 2 * smooth
    counts /= counts.sum(axis=1, keepdims=True)
    return np.where(seen, np.log(counts[1] / counts[0]), 0.0).astype(np.float32)


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum cost * hinge, each class weighing as much, by coordinate descent in the dual."""
    rng = np.random.default_rng(seed)
    weight, bias = np.zeros(BUCKETS), 0.0
    values = []
    for x in rows:
        v = scale[x]
        values.append(v / np.float32(np.linalg.norm(v) or 1.0))
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / len(labels)
    upper = cost * 0.5 / np.maximum(share, 1e-9)[labels]
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (float(weight[x] @ v) + bias) - 1.0
            now = min(max(alpha[i] - gradient / (float(v @ v) + 1.0), 0.0), upper[i])
            if now != alpha[i]:
                move = (now - alpha[i]) * sign[i]
                weight[x] += move * v
                bias += move
                alpha[i] = now
    return weight, bias


def logistic(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), by Newton's method with halved steps, smoothed targets and a small ridge."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1).astype(np.float64)

    def loss(theta: np.ndarray) -> float:
        z = x @ theta
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * theta @ theta)

    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        move = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * theta)
        now = loss(theta)
        while loss(theta - move) > now and abs(move).max() > 1e-10:
            move /= 2
        theta = theta - move
        if abs(move).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> Model:
    """Without both classes the model scores each text as the smoothed share of label 1."""
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS), 0.0, (0.0, float(np.log(share / (1 - share)))))
    fold, margins = np.arange(len(rows)) % folds, np.zeros(len(rows))
    for k in range(folds):
        train = np.flatnonzero(fold != k)
        part = [rows[i] for i in train]
        if len(set(labels[train].tolist())) < 2:
            continue
        scale = log_count_ratio(part, labels[train])
        held = Model(scale, *dual_descent(part, scale, labels[train]), (1.0, 0.0))
        for i in np.flatnonzero(fold == k):
            margins[i] = held.margin(rows[i])
    scale = log_count_ratio(rows, labels)
    return Model(scale, *dual_descent(rows, scale, labels), logistic(margins, labels))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, use, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """doc_id, text and y of at most sample labelled documents for which use(doc_id) holds, one row each.

    The labels are cut to the sample before they meet the documents. Null ids and labels other than
    0 and 1 aren't used; of repeated rows the smallest label and text are.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & use(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", text).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(text).alias("text"), F.min("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, use, label: str = "quality", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """n-grams are made on the executors; at most sample rows, and at most_bytes of bucket numbers, reach the driver, in the order of a hash of doc_id."""

    def start():
        grams = Grams()
        return lambda t: (grams(t).tobytes(),)

    made = stored(map_texts(training_rows(docs, labels, label, use, sample), "text", ["doc_id", "y"], "x binary", start).withColumn("h", F.xxhash64("doc_id")), "quality-grams")
    sizes = sorted(made.select("h", "doc_id", F.length("x")).collect())
    fit_in = int(np.searchsorted(np.cumsum([n for _, _, n in sizes]), most_bytes, "right"))
    if fit_in < len(sizes):
        made = made.filter(F.struct("h", "doc_id") < F.struct(F.lit(sizes[fit_in][0]), F.lit(sizes[fit_in][1])))
    rows = sorted(made.collect(), key=lambda r: r["doc_id"])  # few enough to be sorted here; orderBy() would run the Python function twice
    return fit_rows([np.frombuffer(r["x"], dtype=np.int32) for r in rows], np.array([r["y"] for r in rows], dtype=np.int64))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns keep of docs (default: all) and the score of each whole text. Null and empty texts are scored by their n-grams of nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        grams, m = Grams(), sent.value
        return lambda t: (m.score(grams(t)),)

    return map_texts(docs, text, keep or [c for c in docs.columns if c != name], f"`{name}` double", start)


def fold(doc_id, parts: int):
    """crc32 of doc_id as text, modulo parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), lambda i: fold(i, 5) != 0)
    out = scored(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
