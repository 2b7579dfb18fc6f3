"""Quality and toxicity on held-out rows, odd rows, and the pipeline's stages on a small corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def _texts(rng, n, junk):
    words = ["the", "river", "under", "stone", "walks", "green", "never", "house", "with", "light"]
    out = []
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        out.append(" ".join(w + rng.choice(["%%%", "###", "$$$"]) for w in own) if k % 3 == 0 and junk else " ".join(own).capitalize() + ".")
    return out


def test_quality_tells_junk_and_scores_odd_texts(spark):
    rng = random.Random(1)
    rows = [(n, t) for n, t in enumerate(_texts(rng, 240, True))] + [(900, None), (901, ""), (902, "x" * 50000), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(n, int(n % 3 != 0)) for n in range(0, 240, 2)] + [(0, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, lambda i: F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model, keep=["doc_id"]).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[n] >= 0.3) == (n % 3 != 0) for n in range(1, 240, 2))
    assert quality.scored(docs.limit(0), model).count() == 0
    one_class = quality.fit(docs, labels.filter("quality = 1"), lambda i: F.lit(True))
    assert one_class.score(quality.Grams()("x")) > 0.5
    nothing = quality.fit(docs, labels.limit(0), lambda i: F.lit(True))
    assert nothing.score(quality.Grams()("x")) == pytest.approx(0.5)


def test_quality_reads_long_tokens_to_their_end():
    rng = random.Random(2)
    texts = _texts(rng, 240, True)
    grams = quality.Grams()
    model = quality.fit_rows([grams(t) for t in texts], np.array([int(n % 3 != 0) for n in range(240)]))
    run = "".join(rng.choice("abcdefgh") for _ in range(400))
    good, bad = run + "theriverunderstone" * 20, run + "river%%%stone###house$$$" * 20
    assert model.score(grams(bad)) < model.score(grams(good))
    assert all(len(w) <= quality.LONG for w in grams.tokens)


def test_dual_descent_separates_what_can_be():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.append(rng.integers(10, 1000, 20), 1 + (n % 2))).astype(np.int32) for n in range(200)]
    labels = np.arange(200) % 2
    scale = quality.log_count_ratio(rows, labels)
    model = quality.Model(scale, *quality.dual_descent(rows, scale, labels), (1.0, 0.0))
    assert all((model.margin(x) > 0) == bool(y) for x, y in zip(rows, labels, strict=True))


def test_gradients_are_the_slopes_of_the_loss():
    net = toxicity.Network(seed=1)
    vocabulary = ["alpha", "beta", "gamma"]
    inputs = net.inputs(vocabulary)
    rng = np.random.default_rng(2)
    ids = rng.integers(-1, 3, (5, 4))
    labels = np.array([0, 1, 1, 0], np.float32)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    _, grads = net.gradients(ids, labels, inputs)
    for name in ("fg", "bc", "fx", "b0", "v", "w", "b"):
        at = tuple(0 for _ in net.p[name].shape)
        keep, step = net.p[name][at], 1e-3
        net.p[name][at] = keep + step
        up = net.gradients(ids, labels, inputs)[0]
        net.p[name][at] = keep - step
        down = net.gradients(ids, labels, inputs)[0]
        net.p[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        covered = {w for s in toxicity.window_starts(n) for w in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


def test_every_window_and_the_whole_of_a_run_are_scored():
    assert toxicity.window_starts(100) == list(range(69)) and toxicity.window_starts(33) == [0, 1]
    run = "".join(random.Random(3).choice("abcdefgh_") for _ in range(1000))
    for n in (64, 65, 96, 97, 1000):
        pieces = toxicity.words(run[:n])
        assert all(len(p) <= 64 for p in pieces) and all(any(run[i : i + 30] in p for p in pieces) for i in range(n - 29))
    scorer = toxicity.Scorer(toxicity.Network(seed=1))
    a, b = run[:500] + "vile" + run[504:], run
    assert scorer.logits([a]) != scorer.logits([b])
    grams = lambda t: set(toxicity.char_grams(toxicity.words(t))[0].tolist())
    assert len(grams("clean_" * 60 + "vile") - grams("clean_" * 60)) >= 3
    flat, sizes = toxicity.char_grams(["a", "", "abcdefgh", "abc", "é\U0001f600"])
    assert sizes.tolist() == [1, 1, 12, 4, 2] and len(flat) == 20
    assert set(toxicity.char_grams(["abcxyz"])[0]) & set(toxicity.char_grams(["abcdef"])[0])  # the beginning of three, and the first trigrams


def test_scoring_in_slices_is_what_the_network_gives():
    rng, vocabulary = random.Random(5), [f"w{i}" for i in range(50)]
    net = toxicity.Network(seed=2)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 34, 100, 5000)]
    want = []
    for t in texts:
        seq = t.split()
        starts = toxicity.window_starts(len(seq))
        inputs = net.inputs(vocabulary)
        ids = np.full((toxicity.WINDOW, len(starts)), -1)
        for k, s in enumerate(starts):
            own = [vocabulary.index(w) for w in seq[s : s + toxicity.WINDOW]]
            ids[: len(own), k] = own
        mask, x = (ids >= 0)[:, :, None].astype(np.float32), net.embed(inputs)
        states = [net.run(way, (x @ net.p[f"{way}x"] + net.p[f"{way}0"])[np.maximum(ids, 0)], mask) for way in "fb"]
        want.append(net.pool(np.concatenate(states, axis=2), mask)[0])
    for _ in range(2):
        got = toxicity.Scorer(net).logits(texts)
        for (value, first), own in zip(got, want, strict=True):
            assert value == pytest.approx(own.max(), abs=1e-4) and own[first] == pytest.approx(own.max(), abs=1e-4)


def test_words_of_many_texts_are_learned_at_once_and_forgotten(monkeypatch):
    net, calls = toxicity.Network(seed=2), []
    embed = net.embed
    monkeypatch.setattr(net, "embed", lambda inputs: (calls.append(1), embed(inputs))[1])
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(50)]
    scorer = toxicity.Scorer(net)
    want = scorer.logits(texts)
    assert len(calls) == 1
    monkeypatch.setattr(toxicity, "CACHE", 30)
    monkeypatch.setattr(toxicity, "AT_ONCE", 16)
    got = toxicity.Scorer(net).logits(texts)
    assert [g[0] for g in got] == pytest.approx([w[0] for w in want], abs=1e-5)
    assert scorer.logits(texts[:1])[0][0] == pytest.approx(want[0][0], abs=1e-5)


def test_toxicity_learns_words_and_beginnings_of_words(spark):
    rng = random.Random(4)
    rows = []
    for n, t in enumerate(_texts(rng, 400, False)):
        w = t.split()
        if n % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", f"grock{rng.choice('abcdefgh')}{rng.choice('xyz')}"]))
        rows.append((n, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "the river " * 20000), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("logit", F.lit("clash"))
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(0, 300)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, lambda i: F.lit(True))
    out = toxicity.logits(docs, net, keep=["doc_id"]).withColumn("p", toxicity.probability(F.col("logit"), net))
    got = {r["doc_id"]: r["p"] for r in out.collect()}
    assert len(got) == len(rows) and all(0 <= p <= 1 for p in got.values())
    right = sum((got[n] >= 0.3) == (n % 4 == 0) for n in range(300, 400))
    assert right >= 96
    assert got[900] == got[901] < 0.3 and got[902] < 0.3
    assert toxicity.logits(docs.limit(0), net).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0.5 * len(before) < len(ids) < len(before)
    last = pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert len(last) == len(ids) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)
    odd = spark.createDataFrame([(1, None, "en", None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (None, "a b", "en", "s", 3)], docs.schema)
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, odd, SF).count() >= 3
        assert stage(spark, odd.limit(0), SF).count() == 0
