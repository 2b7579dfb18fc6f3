"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins an embedding of the word and the mean of embeddings of its character n-grams,
both hashed. Two gated recurrent layers (Cho et al., 2014) read a window forwards and backwards,
attention weighs their states, and a linear unit gives the window's logit. A text scores by the
largest logit over all its overlapping windows, through a logistic curve fitted on texts left out of
training.

Labels are of texts, not of windows. Training windows are those that hold the words and beginnings
of words with the largest log-odds for the label: of toxic texts as positives, of others as hard
negatives beside random ones. Everything that reaches the driver is bounded by the sample's size.
"""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, slices, stored, table
from .quality import fold, logistic

#: All windows are scored; those that the network is first trained on are picked at a wider stride, which makes them differ.
WINDOW, STRIDE, PICK_STRIDE = 32, 1, 16
#: A run of more word characters is read in overlapping pieces, each a word.
LONG, OVERLAP = 64, 32
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 13
#: Labelled texts of each class that the model is fitted on at most, in the order of a hash of doc_id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1_500, 3_000
EPOCHS, BATCH, RATE = 4, 256, 0.01
#: Rounds in which windows of clean texts with a logit above the bound are added to the training.
MINED, MINE_ABOVE = 3, -4.0
THRESHOLD = 0.3
#: Words whose projected inputs each Python worker remembers, and windows that it runs at once.
CACHE, AT_ONCE = 100_000, 2_048
CUES = 1 << 16
#: Windows of repeated phrases made of each clean window in training; one of them is trained on, the others where the network is wrong.
TILED = 4

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    if max(map(len, found), default=0) <= LONG:
        return found
    return [p for w in found for p in ([w] if len(w) <= LONG else (w[i : i + LONG] for i in range(0, len(w) - OVERLAP, LONG - OVERLAP)))]


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def char_grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's character trigrams, with its ends marked, and of its beginnings of three to six; and how many each word has."""
    marked = [f"<{w or ' '}>" for w in vocabulary]
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array(list(map(len, marked))) - 2
    at = np.cumsum(lengths + 2) - lengths - 2
    many = np.clip(lengths - 2, 0, 4)
    begins = np.cumsum(lengths + many) - lengths - many
    flat = np.empty(int((lengths + many).sum()), np.uint64)
    # the trigram at place k of a word is its kth
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = np.repeat(at, lengths) + inside
    flat[np.repeat(begins, lengths) + inside] = (c[first] * np.uint64(31) + c[first + 1]) * np.uint64(1_000_003) + c[first + 2]
    for n in range(3, 7):
        has = np.flatnonzero(lengths >= n)
        total = np.full(len(has), n, np.uint64)
        for j in range(n):
            total = total * np.uint64(1_000_003) + c[at[has] + 1 + j]
        flat[begins[has] + lengths[has] + n - 3] = total * np.uint64(7) + np.uint64(n)
    flat = (flat ^ (flat >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((flat ^ (flat >> np.uint64(32))) % np.uint64(CHAR_BUCKETS)).astype(np.int64), lengths + many


def cues(word: str) -> list[int]:
    """What log-odds are counted of: the word, and its beginnings of four and five."""
    return [_hash(w) % CUES for w in (word, "^" + word[:4], "^" + word[:5])]


def window_starts(n: int, stride: int = STRIDE) -> list[int]:
    """Starts of overlapping windows that together cover all n words; one window for none."""
    return [*range(0, max(n - WINDOW, 0), stride), max(n - WINDOW, 0)] if n > WINDOW else [0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _soft(x: np.ndarray) -> np.ndarray:
    """Softsign; halved and moved it is the gates' function, at a fifth of the cost of the logistic one."""
    return x / (1 + np.abs(x))


class Network:
    """Parameters by name. Inputs to recurrence are projected beforehand, once for each distinct word."""

    def __init__(self, seed: int = 3) -> None:
        rng, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {"word": draw(WORD_BUCKETS, WORD_DIM, by=0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM, by=0.3), "v": draw(2 * h, by=0.1), "w": draw(2 * h, by=0.3), "b": np.full(1, -4, np.float32)}
        for way in "fb":
            self.p |= {f"{way}x": draw(d, 3 * h, by=d**-0.5), f"{way}0": np.zeros(3 * h, np.float32), f"{way}g": draw(h, 2 * h, by=h**-0.5), f"{way}c": draw(h, h, by=h**-0.5)}
        self.curve = (1.0, 0.0)

    def inputs(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat, sizes = char_grams(vocabulary)
        return np.array([_hash(w) % WORD_BUCKETS for w in vocabulary]), flat, np.cumsum(sizes) - sizes, sizes

    def embed(self, inputs) -> np.ndarray:
        word, flat, begins, sizes = inputs
        chars = np.add.reduceat(self.p["char"][flat], begins) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][word], chars.astype(np.float32)], axis=1)

    def run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, window, HIDDEN) of one direction over projected inputs; masked steps hand the state on."""
        h, n, g, c = HIDDEN, x.shape[1], self.p[f"{way}g"], self.p[f"{way}c"]
        states, now = np.empty((x.shape[0], n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(x.shape[0]) if way == "f" else range(x.shape[0] - 1, -1, -1):
            gates = 0.5 + 0.5 * _soft(x[t, :, : 2 * h] + now @ g)
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + (r * now) @ c)
            if keep is not None:
                keep.append((t, now, z, r, new))
            now = now + (z * mask[t]) * (new - now)
            states[t] = now
        return states

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.exp(np.clip(states @ self.p["v"], -30, 30)) * mask[:, :, 0]
        share = e / np.maximum(e.sum(axis=0), 1e-20)
        pooled = np.einsum("tn,tnh->nh", share, states)
        return pooled @ self.p["w"] + self.p["b"][0], share, pooled

    def scan(self, way: str, x, n: int, steps: int, mask: np.ndarray | None = None) -> np.ndarray:
        """As run(), for scoring: what each state of n windows adds to attention and logit, (time, window, 2).

        x(t) gives the inputs at step t as scoring_inputs() has them, (3, window, HIDDEN). A window's
        units lie side by side: products of few columns are several times as fast as those of few rows.
        """
        h = HIDDEN
        gate, cell = [np.ascontiguousarray(self.p[f"{way}g"][:, k : k + h]) for k in (0, h)], -self.p[f"{way}c"]
        half = slice(0, h) if way == "f" else slice(h, 2 * h)
        heads = np.stack([self.p["v"][half], self.p["w"][half]], axis=1)
        gates, size = np.empty((2, n, h), np.float32), np.empty((2, n, h), np.float32)
        now, new, kept = (np.zeros((n, h), np.float32) for _ in range(3))
        out = np.empty((steps, n, 2), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            own = x(t)
            np.matmul(now, gate[0], out=gates[0])
            np.matmul(now, gate[1], out=gates[1])
            gates += own[:2]
            np.abs(gates, out=size)
            size += 1
            gates /= size
            gates += 1  # twice the gates
            np.multiply(gates[1], now, out=kept)
            np.matmul(kept, cell, out=new)
            new += own[2]
            # tanh, by the faster exp; an overflow is its end
            np.exp(new, out=new)
            new += 1
            np.divide(2, new, out=new)
            new -= 1
            new -= now
            new *= gates[0]
            new *= 0.5
            if mask is not None:
                new *= mask[t][:, None]
            now += new
            np.matmul(now, heads, out=out[t])
        return out

    def scoring_inputs(self, way: str, x: np.ndarray) -> np.ndarray:
        """Projected inputs of embedded words for scan(): those of the state's candidate by -2, as its exp takes them."""
        own = x @ self.p[f"{way}x"] + self.p[f"{way}0"]
        own[:, 2 * HIDDEN :] *= -2
        return own

    def logits(self, x, n: int, steps: int, mask: np.ndarray | None = None) -> np.ndarray:
        """Logits of n windows; x(way, t) as in scan(), mask (time, window) says where there are words."""
        with np.errstate(over="ignore"):
            both = self.scan("f", lambda t: x("f", t), n, steps, mask) + self.scan("b", lambda t: x("b", t), n, steps, mask)
        e = np.exp(np.clip(both[:, :, 0], -30, 30))
        if mask is not None:
            e *= mask
        return (e * both[:, :, 1]).sum(axis=0) / np.maximum(e.sum(axis=0), 1e-20) + self.p["b"][0]

    def gradients(self, ids: np.ndarray, labels: np.ndarray, inputs) -> tuple[float, dict]:
        """Mean logistic loss of windows (time, window) of places in inputs, -1 where there is no word, and its gradients."""
        h = HIDDEN
        mask = (ids >= 0)[:, :, None].astype(np.float32)
        used, place = np.unique(np.maximum(ids, 0), return_inverse=True)
        place = place.reshape(ids.shape)
        word, flat, begins, sizes = inputs
        spans = [np.arange(begins[u], begins[u] + sizes[u]) for u in used]
        own_sizes = sizes[used]
        own = (word[used], flat[np.concatenate(spans)], np.cumsum(own_sizes) - own_sizes, own_sizes)
        x = self.embed(own)
        kept: dict[str, list] = {"f": [], "b": []}
        states = [self.run(way, (x @ self.p[f"{way}x"] + self.p[f"{way}0"])[place], mask, kept[way]) for way in "fb"]
        both = np.concatenate(states, axis=2)
        logit, share, pooled = self.pool(both, mask)
        p = _sigmoid(np.clip(logit, -30, 30))
        loss = -np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9))
        d = ((p - labels) / len(labels)).astype(np.float32)
        out = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        d_pool = d[:, None] * self.p["w"]
        d_share = np.einsum("nh,tnh->tn", d_pool, both)
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        out["v"] = np.einsum("tn,tnh->h", d_e, both)
        d_both = share[:, :, None] * d_pool + d_e[:, :, None] * self.p["v"]
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            g, c = self.p[f"{way}g"], self.p[f"{way}c"]
            d_states, d_now = d_both[:, :, k * h : (k + 1) * h], np.zeros((ids.shape[1], h), np.float32)
            d_in = np.zeros((*ids.shape, 3 * h), np.float32)
            out[f"{way}g"], out[f"{way}c"] = np.zeros_like(g), np.zeros_like(c)
            for t, before, z, r, new in reversed(kept[way]):
                d_now = d_now + d_states[t]
                m = mask[t]
                d_new = d_now * z * m * (1 - new * new)
                d_z = d_now * (new - before) * m * (1 - np.abs(2 * z - 1)) ** 2 / 2
                d_rh = d_new @ c.T
                d_r = d_rh * before * (1 - np.abs(2 * r - 1)) ** 2 / 2
                gates = np.concatenate([d_z, d_r], axis=1)
                out[f"{way}c"] += (r * before).T @ d_new
                out[f"{way}g"] += before.T @ gates
                d_in[t] = np.concatenate([gates, d_new], axis=1)
                d_now = d_now * (1 - z * m) + d_rh * r + gates @ g.T
            per_word = np.zeros((len(used), 3 * h), np.float32)
            np.add.at(per_word, place.ravel(), d_in.reshape(-1, 3 * h))
            out[f"{way}x"], out[f"{way}0"] = x.T @ per_word, per_word.sum(axis=0)
            d_x += per_word @ self.p[f"{way}x"].T
        out["word"] = (own[0], d_x[:, :WORD_DIM])
        out["char"] = (own[1], np.repeat(d_x[:, WORD_DIM:] / own_sizes[:, None], own_sizes, axis=0))
        return float(loss), out

    def train(self, windows: list[list[str]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> list[float]:
        """Adam on all parameters, embeddings included; the loss of each epoch."""
        vocabulary = sorted({w for x in windows for w in x}) or [""]
        number = {w: i for i, w in enumerate(vocabulary)}
        inputs = self.inputs(vocabulary)
        ids = np.full((WINDOW, len(windows)), -1)
        for n, x in enumerate(windows):
            ids[: len(x), n] = [number[w] for w in x]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, step, losses = np.random.default_rng(seed), 0, []
        for _ in range(epochs):
            total, order = 0.0, rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                loss, grads = self.gradients(ids[:, own], labels[own], inputs)
                total += loss * len(own)
                step += 1
                for name, grad in grads.items():
                    if isinstance(grad, tuple):
                        rows, place = np.unique(grad[0], return_inverse=True)
                        dense = np.zeros((len(rows), grad[1].shape[1]), np.float32)
                        np.add.at(dense, place, grad[1])
                    else:
                        rows, dense = slice(None), grad
                    m = first[name][rows] = 0.9 * first[name][rows] + 0.1 * dense
                    v = second[name][rows] = 0.99 * second[name][rows] + 0.01 * dense * dense
                    self.p[name][rows] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            losses.append(total / max(1, len(windows)))
        return losses


class _Places(dict):
    """Rows of words in a table, from 1, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self) + 1
        return row


class Scorer:
    """Largest window logits of texts, many windows at a time; projected inputs of words are remembered.

    Windows begin at each word, so that at a step those of neighbouring words read neighbouring rows:
    texts are laid end to end and a step is one slice of them. Windows across two texts aren't counted.
    """

    def __init__(self, net: Network) -> None:
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.place, self.learned = _Places(), 0
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)  # row 0: no word; forwards, then backwards

    def _placed(self, held: list[tuple[int, list[str]]]) -> list[tuple[int, np.ndarray]]:
        return [(n, np.fromiter(map(self.place.__getitem__, seq), np.int64, len(seq))) for n, seq in held]

    def _learn(self) -> None:
        """Fills the table's rows of words that were placed since the last call, many texts' at once."""
        new = list(islice(self.place, self.learned, None))
        if not new:
            return
        h, x = HIDDEN, self.net.embed(self.net.inputs(new))
        at, end = self.learned + 1, len(self.place) + 1
        if end > len(self.table):
            more = np.zeros((max(end, len(self.table)), 6 * h), np.float32)
            self.table = np.concatenate([self.table, more])
        for k, way in enumerate("fb"):
            self.table[at:end, 3 * h * k : 3 * h * (k + 1)] = self.net.scoring_inputs(way, x)
        self.learned = len(self.place)

    def _rows(self, places: np.ndarray):
        """x(way, t) of windows that begin at each of the places but the last WINDOW - 1."""
        n = len(places) - WINDOW + 1
        x = np.ascontiguousarray(self.table[places].reshape(-1, 6, HIDDEN).transpose(1, 0, 2))
        return lambda way, t: x[slice(0, 3) if way == "f" else slice(3, 6), t : t + n]

    def _long(self, places: np.ndarray) -> np.ndarray:
        """Logits of the windows at each place of a run of words, the last WINDOW - 1 left out."""
        n = len(places) - WINDOW + 1
        return np.concatenate([self.net.logits(self._rows(places[k : min(n, k + AT_ONCE) + WINDOW - 1]), min(n, k + AT_ONCE) - k, WINDOW) for k in range(0, n, AT_ONCE)])

    def _short(self, many: list[np.ndarray]) -> np.ndarray:
        """Logits of texts of WINDOW words at most, a window each."""
        places = np.zeros((len(many), WINDOW), np.int64)
        for n, own in enumerate(many):
            places[n, : len(own)] = own
        x = np.ascontiguousarray(self.table[places].reshape(len(many), WINDOW, 6, HIDDEN).transpose(1, 2, 0, 3))
        mask = np.ascontiguousarray((places > 0).T).astype(np.float32)
        return self.net.logits(lambda way, t: x[t][slice(0, 3) if way == "f" else slice(3, 6)], len(many), WINDOW, mask)

    def logits(self, texts) -> list[tuple[float, int]]:
        """For each text, whatever its length, the largest logit and the first word of its window; texts are taken as they come."""
        best: list[tuple[float, int]] = []
        held: list[tuple[int, list[str]]] = []

        def flush() -> None:
            placed = self._placed(held)
            if len(self.place) > CACHE and self.learned:
                self._forget()
                placed = self._placed(held)
            self._learn()
            short, long = [x for x in placed if len(x[1]) <= WINDOW], [x for x in placed if len(x[1]) > WINDOW]
            if short:
                for (n, _), value in zip(short, self._short([p for _, p in short]).tolist(), strict=True):
                    best[n] = value, 0
            if long:
                values, at = self._long(np.concatenate([p for _, p in long])), 0
                for n, p in long:
                    own = values[at : at + len(p) - WINDOW + 1]
                    first = int(own.argmax())
                    best[n] = float(own[first]), first
                    at += len(p)
            held.clear()

        size = 0
        for n, text in enumerate(texts):
            seq = words(text)
            best.append((float("-inf"), 0))
            held.append((n, seq))
            size += max(len(seq), WINDOW)
            if size >= 4 * AT_ONCE:
                flush()
                size = 0
        if held:
            flush()
        return best


#: The scorer that this Python worker made last, by the name of the network it was sent.
_SCORERS: dict[str, Scorer] = {}


def _scorer(spark: SparkSession, net: Network):
    """A function for executors that returns the scorer, made once in each Python worker."""
    sent, tag = spark.sparkContext.broadcast(net), uuid.uuid4().hex

    def made() -> Scorer:
        if tag not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[tag] = Scorer(sent.value)
        return _SCORERS[tag]

    return made


def _sample(docs: DataFrame, labels: DataFrame, label: str, use, text: str) -> tuple[DataFrame, float]:
    """doc_id, text, y of the bounded sample, and by how much its log-odds of the label exceed those of all usable labels."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & use(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {1: TOXIC_SAMPLE, 0: CLEAN_SAMPLE}
    parts = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]) for y in (1, 0)]
    ids = parts[0].unionByName(parts[1])
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    shift = float(np.log((min(n1, most[1]) + 1) / (min(n0, most[0]) + 1)) - np.log((n1 + 1) / (n0 + 1)))
    texts = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return stored(texts, "toxicity-sample"), shift


def _log_odds(sample: DataFrame) -> np.ndarray:
    def start():
        return lambda t: (sorted({c for w in set(words(t)) for c in cues(w)}),)

    each = map_texts(sample, "text", ["y"], "cues array<int>", start).select("y", F.explode("cues").alias("cue"))
    counts = np.zeros((2, CUES))
    for r in each.groupBy("cue").agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n")).collect():
        counts[:, r["cue"]] = r["n"] - r["n1"], r["n1"]
    n = sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    total = {r["y"]: r["n"] for r in n}
    share = (counts + 0.5) / np.array([[total.get(0, 0) + 1.0], [total.get(1, 0) + 1.0]])
    # a cue counts as far as it is seen; one or two texts prove little
    return (np.log(share[1] / share[0]) * np.minimum(1, counts.sum(axis=0) / 8)).astype(np.float32)


def pick_windows(seq: list[str], odds: np.ndarray, toxic: bool, seed: int) -> list[list[str]]:
    """Training windows of one text: two of the largest log-odds, and for texts that aren't toxic one at random."""
    starts = window_starts(len(seq), PICK_STRIDE)
    known = {w: float(max(odds[c] for c in cues(w))) for w in set(seq)}
    worth = [max((known[w] for w in seq[s : s + WINDOW]), default=0.0) for s in starts]
    order = sorted(range(len(starts)), key=lambda i: -worth[i])
    chosen = [i for i in order[: 1 if toxic else 2]]
    if toxic and len(order) > 1 and worth[order[1]] > 0.9 * worth[order[0]]:
        chosen.append(order[1])
    if not toxic:
        chosen.append(int(np.random.default_rng(seed & 0x7FFFFFFF).integers(len(starts))))
    return [seq[starts[i] : starts[i] + WINDOW] for i in chosen]


def repeated(windows: list[list[str]], seed: int = 11) -> list[list[str]]:
    """TILED windows for each given one, of a few of its words said over and over.

    A state that is fed one phrase without end goes where no ordinary window takes it.
    """
    rng, out = np.random.default_rng(seed), []
    for w in windows:
        for at in rng.integers(len(w), size=TILED) if w else ():
            phrase = w[at : at + int(rng.integers(1, 5))]
            out.append((phrase * WINDOW)[:WINDOW])
    return out


def fit(docs: DataFrame, labels: DataFrame, use, label: str = "toxic", text: str = "text") -> Network:
    """Four fifths of the sample train the network, the rest the curve. Without both classes the score is the share of label 1."""
    sample, shift = _sample(docs, labels, label, use, text)
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    odds = docs.sparkSession.sparkContext.broadcast(_log_odds(sample.filter(~held)))

    def start(toxic: bool):
        def begin():
            cue = odds.value
            return lambda t: (pick_windows(words(t), cue, toxic, _hash(t or "")),)

        return begin

    rows = []
    for toxic in (False, True):
        part = sample.filter(~held & (F.col("y") == int(toxic)))
        rows += map_texts(part, "text", ["doc_id", "y"], "windows array<array<string>>", start(toxic)).collect()
    rows.sort(key=lambda r: (r["y"], r["doc_id"]))  # few enough to be sorted here; orderBy() would run the Python function twice
    windows = [list(w) for r in rows for w in r["windows"]]
    y = np.array([r["y"] for r in rows for _ in r["windows"]], dtype=np.float32)
    net = Network()
    if len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        net.curve = (0.0, float(np.log(share / (1 - share))))
        return net
    tiles = repeated([w for w, toxic in zip(windows, y, strict=True) if not toxic])
    tiles += [[]] * (len(windows) // 50 + 1)  # no words are clean
    windows, y = windows + tiles[::TILED], np.concatenate([y, np.zeros(len(tiles[::TILED]), np.float32)])
    net.train(windows, y)
    # windows of clean texts, of repeated phrases and of nothing that the network takes for toxic join the training
    clean = sample.filter(~held & (F.col("y") == 0)).select("doc_id", "text")
    for n in range(MINED):
        mined = sorted(hardest(clean, net).collect(), key=lambda r: r["doc_id"])
        windows += [list(r["window"]) for r in mined if r["logit"] > MINE_ABOVE]
        windows += [t for t, (logit, _) in zip(tiles, Scorer(net).logits(map(" ".join, tiles)), strict=True) if logit > MINE_ABOVE]
        y = np.concatenate([y, np.zeros(len(windows) - len(y), np.float32)])
        net.train(windows, y, epochs=2, seed=6 + n)
    held_out = logits(sample.filter(held).select("doc_id", "text", "y"), net, keep=["doc_id", "y"]).collect()
    held_out.sort(key=lambda r: r["doc_id"])
    a, b = logistic(np.array([r["logit"] for r in held_out]), np.array([r["y"] for r in held_out], dtype=np.int64)) if len({r["y"] for r in held_out}) == 2 else (1.0, 0.0)
    net.curve = (a, b - shift)
    return net


def hardest(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """doc_id, and the window of each text with the largest logit."""
    made = _scorer(docs.sparkSession, net)

    def start():
        scorer = made()

        def one(t: str | None):
            value, first = scorer.logits([t])[0]
            return value, words(t)[first : first + WINDOW]

        return one

    return map_texts(docs, text, ["doc_id"], "logit double, window array<string>", start)


def logits(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (default: all) and logit, the largest of all windows of the whole text.

    Null and empty texts have the logit of a window without words. Repeated rows stay, each with its
    text's logit. A column called logit is replaced unless kept. No rows, no rows.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    keep = keep or [c for c in docs.columns if c != "logit"]
    made = _scorer(docs.sparkSession, net)
    kept = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    out = StructType([*[kept.schema[c] for c in keep], StructField("logit", DoubleType())])

    def run(batches):
        import pyarrow as pa

        scorer = made()
        for whole in batches:
            at = whole.schema.get_field_index
            for batch in slices(whole, at(text)):
                values = [value for value, _ in scorer.logits(v.as_py() for v in batch.column(at(text)))]
                yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in keep], pa.array(values, pa.float64())], names=out.names)

    return kept.mapInArrow(run, out)


def probability(logit: Column, net: Network) -> Column:
    a, b = net.curve
    return 1 / (1 + F.exp(-(F.lit(a) * logit + F.lit(b))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"), lambda i: fold(i, 4) != 2)
    out = logits(docs, net, keep=["doc_id"]).withColumn("score", probability(F.col("logit"), net))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
