"""Decontamination, near duplicates, byte-level BPE and top-k against plain versions, with odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import bpe, decontaminate, neardup, topk

from . import brute

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_what_the_library_makes(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()
    n, written, back = codec.write(text)
    assert (n, written, back) == (len(ids), ",".join(map(str, ids)), text.encode())


def test_bpe_of_long_runs_and_small_memory(codec, library):
    small = bpe.Codec(codec.ranks, public_tokenizers.PATTERN)
    small.ids.most = small.ids.room = 64
    for text in ("a" * 5000, "ab" * 3000, " the cat sat" * 50, "\n" * 300, "é" * 700, "0" * 999):
        assert small.encode(text) == library.encode_ordinary(text) == small.encode(text)


def test_bpe_rows(spark, library):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    made = bpe.codec(spark, PATH, public_tokenizers.PATTERN)
    out = bpe.encode(df, made)
    got = sorted((str(r["doc_id"]), tuple(r["ids"])) for r in out.collect())
    assert got == sorted((str(i), tuple(library.encode_ordinary(t or ""))) for i, t in rows)
    back = bpe.decode(out, made).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
    assert bpe.encode(df.limit(0), made).count() == 0


def _contaminated(rng):
    word = lambda: rng.choice("abcdefg")
    items = [(n, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14, 25])))) for n in range(12)] + [(90, None), (91, items_text := "one two THREE four"), (92, items_text)]
    docs = [(n, " ".join(word() for _ in range(rng.randrange(60)))) for n in range(30)]
    for n in range(15):
        a, b = rng.choice(docs)[1] or "", rng.choice(items)[1] or ""
        docs.append((100 + n, f"{a}\n{b.upper()} é {a}"))
    return items, [*docs, (7, docs[7][1]), (None, "one Two three-four"), (200, None), (201, "")]


def test_contamination_matches_plain_version(spark):
    items, docs = _contaminated(random.Random(3))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *brute.contamination(t, items)) for i, t in docs)
    for shard_words in (decontaminate.SHARD_WORDS, 40):
        found = decontaminate.find(d, b, shard_words=shard_words)
        got = sorted((str(r["doc_id"]), r["n_words"], sum(e - s for s, e in r["spans"]), r["items"]) for r in found.collect())
        assert got == want
    assert decontaminate.find(d.limit(0), b).count() == 0
    assert {r["n"] for r in decontaminate.find(d, b.limit(0)).select(F.size("spans").alias("n")).collect()} == {0}


def test_cleaned_texts_hold_no_window(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "few words here")]
    rows = [(1, "Start alpha beta gamma delta epsilon zeta eta theta iota kappa end " + "filler words " * 30), (2, "nothing of it"), (3, items[0][1]), (4, None), (5, "few few words here words here " + "x y " * 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = {r["doc_id"]: r for r in decontaminate.clean(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 4, 5} and out[2]["text"] == rows[1][1] and out[4]["text"] is None
    assert out[1]["text"].startswith("Start ") and " end " in out[1]["text"]
    assert all(brute.contamination(r["text"], items)[1] == 0 for r in out.values())


def test_cleaning_does_not_depend_on_the_number_of_shards(spark):
    word = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    one, two, free = word("p", 12), word("q", 12), word("f", 16)
    # 30 % and 30 % of the words; and a cut of either item joins the halves of the other
    rows = [(1, " ".join([*one, *free[:8], *two, *free[8:]])), (2, " ".join([*free, *free, *one[:6], *two, *one[6:], *free])), (3, " ".join([*free, *free, *two[:6], *one, *two[6:], *free])), (2, "same id"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    items = [(n, " ".join(one if n % 2 else two)) for n in range(8)]
    items += [(10 + n, " ".join(word(f"z{n}x", 12))) for n in range(8)]
    for n_items in (2, 16):
        own = items[:n_items]
        b = spark.createDataFrame(own, "item_id long, text string")
        want = sorted(map(str, decontaminate.clean(docs, b).collect()))
        got = decontaminate.clean(docs, b, shard_words=12)
        assert got.columns == docs.columns and sorted(map(str, got.collect())) == want
        assert all(brute.contamination(r["text"], own)[1] == 0 for r in got.collect()) and 1 not in {r["doc_id"] for r in got.collect()}
    assert len(decontaminate._shards(b, "text", "item_id", 12)) > 1


def _copies(rng, families, size, changes):
    docs = []
    for f in range(families):
        base = [f"w{f}x{rng.randrange(400)}" for _ in range(80)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(changes)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            docs.append(" ".join(own))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_match_plain_version(spark, size, percent):
    rng = random.Random(size)
    docs = _copies(rng, 3, 45, 6)
    docs += [(500, None), (501, ""), (502, "two words"), (503, "Two  WORDS"), (504, "two"), (505, docs[0][1]), (506, docs[0][1].upper()), (507, " \t\n")]
    df = spark.createDataFrame([*docs, (0, docs[0][1]), (None, docs[1][1])], "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    want = brute.near_components(docs, size, percent)
    got = neardup.near_duplicates(df, size, percent).collect()
    assert len(got) == len(docs) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] == len(brute.shingle_set(dict(docs)[r["doc_id"]], size))


def test_large_families_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    docs = _copies(random.Random(9), 2, 60, 9)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.near_components(docs, 3, 85)


def test_no_documents_and_one_id_with_two_texts(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (9, "g h i j k l")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert {r["component_id"] for r in got} == {1}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 2**63, 150).astype(np.uint64)])
    same = (neardup.signature(np.unique(a)) == neardup.signature(np.unique(b))).mean()
    assert abs(same - 850 / 1150) < 0.12


def _top(rows, k):
    out = []
    for n, (i, v) in enumerate(rows):
        if i is not None and i % 50 == 0 and v is not None:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for m, (j, w) in enumerate(rows) if m != n and j is not None and w is not None and len(w) == len(v)]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_texts_are_looked_up_before_they_are_copied_to_blocks(spark):
    against = spark.createDataFrame([(i, 1000, 20) for i in range(40)], "id long, label long, members long")
    pool = spark.createDataFrame([(100, 1000)], "id long, family long")
    members = spark.createDataFrame([(1000 + i, 1000, 5) for i in range(20)] + [(100, 100, 5)], "id long, label long, n long")
    texts = spark.createDataFrame([(i, "a b c d") for i in [*range(40), 100, *range(1000, 1020)]], "id long, text string")
    found = neardup._many(against, pool, members, texts, 3, 85)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    asking, asked = plan.split("explode(sequence")[1:3]
    # copying stands above every join of its side: none is left over it, as it was when each copy was joined with its text
    assert plan.index("explode(sequence") < plan.index("Join ")
    assert "Join " in asking and "Join " in asked
    # one set in 61 rows: whatever is linked is linked with a member of the component
    assert {r["a"] for r in found.collect()} == {*range(40), 100}


def test_labels_that_more_edges_merge(spark):
    edges, more = [(1, 2), (5, 6), (6, 7), (20, 21)], [(7, 2), (9, 6), (30, 31)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = neardup.merged(neardup.components(frame(edges)), frame(more))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, neardup.components(frame(edges + more)).collect()))
    same = neardup.merged(neardup.components(frame(edges)), frame([]))
    assert {r["id"]: r["label"] for r in same.collect()} == {1: 1, 2: 1, 5: 5, 6: 5, 7: 5, 20: 20, 21: 20}


@pytest.mark.parametrize(("shard_rows", "cell_rows"), [(1000, 1000), (40, 1000), (1000, 6), (9, 20)])
def test_top_k_matches_plain_version(spark, shard_rows, cell_rows):
    rng = random.Random(2)
    rows = [(n, [rng.randrange(-300, 300) for _ in range(6)]) for n in range(160)]
    rows += [(200 + n, [100] * 6) for n in range(30)] + [(50, rows[50][1]), (None, [1] * 6), (300, None), (400, [5, 5]), (350, [7, -7]), (450, [9])]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, cell_rows=cell_rows, shard_rows=shard_rows, block_rows=3).collect())
    assert got == _top(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_stay_exact(spark):
    big = 2**40
    rows = [(50, [big, -3]), (1, [big, 5]), (2, [big, 6]), (3, [-big, 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = [tuple(r)[2] for r in topk.top_k(df, F.col("vec_id") == 50, 2).orderBy("rank").collect()]
    assert got == [1, 2]


def test_odd_components_take_no_part(spark):
    rows = [(0, [0.5, -0.5]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, None), (5, [0.001, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", topk.quantised(F.col("e")).alias("v"))
    assert {r["vec_id"]: r["v"] for r in df.collect()} == {0: [128, -128], 1: None, 2: None, 3: None, 4: None, 5: [0, -1]}


def test_a_shard_moves_once_for_each_block_that_asks_it(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.integers(-99, 99, 8).tolist(), 8, i, i % 5 == 0, i % 10) for i in range(400)], "vec_id long, v array<bigint>, dim int, uid long, asks boolean, cell int")
    sizes = df.groupBy("dim", "cell").agg(F.lit(2).alias("shards"))
    points = df.withColumn("shard", F.pmod("uid", F.lit(2)).cast("int"))
    asked = df.filter("asks").select("dim", "uid", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("to_cell"))  # all ask all cells
    for block_rows, times in ((80, 1), (79, 2), (20, 4)):
        moved = topk._moved(points, topk._plan(asked, sizes, block_rows))
        assert {r["count"] for r in moved.groupBy("uid").count().collect()} == {times}


def test_recurring_pieces_are_merged_and_decoded_once(codec, monkeypatch):
    own = bpe.Codec(codec.ranks, public_tokenizers.PATTERN)
    made, decode = [], own.decode
    monkeypatch.setattr(own, "decode", lambda ids: (made.append(1), decode(ids))[1])
    for text in ("zqx\0zqx é zqx é\0", "zqx é", "", "x" * 40 + "\0" + "qz" * 33 * 33, "a b " * 60_000):
        ids = codec.encode(text)
        assert own.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert len(made) == len({p for t in ("zqx\0zqx é zqx é\0", "x" * 40 + "\0" + "qz" * 33 * 33, "a b a b ") for p in own.split.findall(t)})


def test_no_query_of_near_duplicates_holds_too_many_exchanges(spark):
    """The driver holds the threads and plans of all exchanges of a query at once."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(12))) for i in range(60)], "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsCount()
    assert neardup.near_duplicates(docs, 3, 80).count() == 60
    made = [store.executionsList(began, 1000).apply(k) for k in range(store.executionsCount() - began)]
    nodes = [store.planGraph(e.executionId()).allNodes() for e in made]
    exchanges = [sum("Exchange" in own.apply(k).name() and "Reused" not in own.apply(k).name() for k in range(own.size())) for own in nodes]
    assert max(exchanges) <= 12, sorted(exchanges)[-3:]


def test_only_texts_that_share_a_bucket_are_shuffled(spark, monkeypatch):
    rng = random.Random(12)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(300)]
    docs.append((300, docs[7][1] + " end"))
    store, stored, moved = spark._jsparkSession.sharedState().statusStore(), neardup.stored, []

    def watched(df, name):
        began = store.executionsCount()
        out = stored(df, name)
        if name == "neardup-texts":
            spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            for n in range(store.executionsCount() - began):
                ident = store.executionsList(began, 1000).apply(n).executionId()
                values, nodes = store.executionMetrics(ident), store.planGraph(ident).allNodes()
                own = [nodes.apply(k).metrics() for k in range(nodes.size())]
                counts = [m.apply(k).accumulatorId() for m in own for k in range(m.size()) if m.apply(k).name() == "shuffle records written"]
                moved.extend(int(values.apply(c).replace(",", "")) for c in counts if values.contains(c))
        return out

    monkeypatch.setattr(neardup, "stored", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"]: r["component_id"] for r in got} == {**{i: i for i in range(300)}, 300: 7}
    # the two near copies, a row of the bitmap for each of them and what else shares a bucket; not all 301 texts
    assert moved and max(moved) < 100, moved
