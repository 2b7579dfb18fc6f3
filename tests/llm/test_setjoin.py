"""The Jaccard join by token groups against all pairs, with groups of few sets and with hot groups of copies."""

import random

import numpy as np
import pytest

from loomwork.llm import setjoin
from loomwork.llm.queries import QUERIES

from . import brute


def _docs(seed: int) -> list[tuple]:
    rng, docs = random.Random(seed), []
    word = lambda: f"w{rng.randrange(3000)}"
    common = " ".join(f"licence{k}" for k in range(40))
    base = [word() for _ in range(120)]
    for i in range(60):  # near copies at all distances, some linked over others only
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = word()
        docs.append((i, " ".join(own[: rng.choice([120, 120, 118, 112])])))
    for i in range(100, 140):
        docs.append((i, f"{common} {' '.join(word() for _ in range(rng.randrange(1, 30)))}"))
    docs += [(i, "The same TEXT here, again") for i in range(200, 240)]
    for i in range(300, 330):
        docs.append((i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 8)))))
    # 19 shingles and 18 of them with or without a last one: 18/20 and 19/20
    line = [f"t{k}" for k in range(21)]
    docs += [(400, " ".join(line)), (401, " ".join(line[:20])), (402, " ".join([*line[:20], "x"])), (403, " ".join(line[1:]))]
    docs += [(404, " ".join(f"u{k}" for k in range(5000))), (405, " ".join(f"u{k}" for k in range(4600)))]
    docs += [(500, None), (501, ""), (None, docs[0][1]), (None, None), (7, docs[7][1]), (8, "another text of this id"), (502, "another text of this id")]
    rng.shuffle(docs)
    return docs


def _want(docs: list[tuple]) -> list[tuple]:
    """All pairs; rows of one id are linked."""
    rows = [(n, i, t) for n, (i, t) in enumerate(docs)]
    label = {n: n for n, _, _ in rows}
    sets = {n: brute.shingle_set(t, 3) for n, _, t in rows}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for n, i, _ in rows:
        for m, j, _ in rows[:n]:
            a, b = sets[n], sets[m]
            if i is not None and j is not None and a and b and (i == j or 100 * len(a & b) >= 90 * len(a | b)):
                x, y = root(n), root(m)
                label[max(x, y)] = min(x, y)
    least = {}
    for n, i, _ in rows:
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return sorted(((i, len(sets[n]), None if i is None else least[root(n)]) for n, i, _ in rows), key=str)


def _found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize(("group", "leaders", "hot"), [(setjoin.GROUP, setjoin.LEADERS, setjoin.HOT_DOCUMENTS), (2, 0, 3), (1, 0, 1_000)])
def test_no_link_is_lost_however_sets_are_grouped(spark, group, leaders, hot):
    docs = _docs(group)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS gid", "'clash' AS id", "2 AS n")
    got = setjoin.jaccard_components(df.repartition(5), 3, 90, group=group, leaders=leaders, hot_documents=hot)
    assert _found(got) == _want(docs)


def test_empty_table_and_query(spark, tmp_path):
    docs = _docs(77)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _found(setjoin.jaccard_components(df.limit(0), 3, 90)) == []
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert _found(QUERIES["op13_jaccard_join"](spark, str(tmp_path))) == _want(docs)


def test_sets_that_link_share_the_leading_tokens_they_must():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, 1 + n // 10))):
            b = np.delete(b, rng.integers(len(b))) if len(b) > 1 and rng.random() < 0.5 else np.union1d(b, rng.integers(0, 1 << 60, 1).astype(np.uint64))
        hot = np.stack([x := np.sort(rng.choice(a, len(a) // 3, replace=False)), rng.permutation(len(x)).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            shared = len(np.intersect1d(setjoin.leading(a, hot, 90), setjoin.leading(b, hot, 90)))
            assert shared >= min(setjoin.lead(len(a), 90)[1], setjoin.lead(len(b), 90)[1])


def test_inner_overlaps_are_the_sizes_of_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, s).astype(np.uint64)) for s in (1, 50, 5000, 9000, 8000)]
    assert setjoin.inner_overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_texts_are_hashed_together_as_they_are_alone():
    import pyarrow as pa

    from loomwork.llm import neardup

    rng = random.Random(6)
    texts = ["", None, "a", " a b", "a b c d", None, "x" * 5000, "", "Äb\tcd\x0bé", "ef GH ij kl", ""]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randrange(60))) for _ in range(200)]
    column = pa.array(texts)
    for size in (1, 3, 5):
        for part in (column, column.slice(3, 90), column.slice(1, 1), pa.array(["x y " * 300_000, "a b c"])):
            got = setjoin.shingle_sets(part, size)
            assert all(np.array_equal(a, neardup.shingles(t.as_py(), size)) for a, t in zip(got, part, strict=True))


def test_packed_sets_contain_what_they_must():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 100, 5000):
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        bits, steps = setjoin.packed(own)
        assert setjoin.contained(own, bits, steps) == len(own)
        assert setjoin.contained(rng.integers(0, 1 << 63, 3000).astype(np.uint64), bits, steps) < 30


def test_sets_below_the_threshold_of_one_passage_make_no_table_of_pairs(spark, monkeypatch):
    # any two differ in one or two words of forty, which is too much; what groups hold in all looks like more
    words = lambda i, j, last: " ".join([*(f"w{k}" for k in range(13)), f"a{i}", *(f"v{k}" for k in range(13)), f"b{j}", *(f"u{k}" for k in range(11)), last])
    docs = spark.createDataFrame([(10 * i + j, words(i, j, "end")) for i in range(10) for j in range(10)] + [(100, words(0, 0, "other"))], "doc_id long, text string")
    sizes, stored = [], setjoin.stored

    def counted(df, name):
        out = stored(df, name)
        sizes.append((out.count(), name))
        return out

    monkeypatch.setattr(setjoin, "stored", counted)
    got = setjoin.jaccard_components(docs, 3, 90, group=16).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**{n: n for n in range(100)}, 100: 0}
    # rows for sets and groups, of which there are ten at most, but none for two sets
    assert max(n for n, name in sizes if name not in ("setjoin-matrix", "setjoin-mixed", "setjoin-groups")) < 1010


def test_tokens_of_many_sets_meet_in_cells(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "OFTEN", 8)
    monkeypatch.setattr(setjoin, "CELL_SETS", 16)
    monkeypatch.setattr(setjoin, "CELL_GROUPS", 4)
    rng = random.Random(5)
    entries = {(rng.randrange(12), i, 1000 + i // 2) for i in range(120) for _ in range(4)}
    rows = [(t, i, g, 40 + i % 5, 40, 44, i % 7, 1 + i % 3) for t, i, g in sorted(entries)]
    frame = spark.createDataFrame(rows, "token long, id long, gid long, n long, low long, high long, label long, weight long")
    met = []
    cells = setjoin._shared_in_cells
    monkeypatch.setattr(setjoin, "_shared_in_cells", lambda df, percent: (met.append(out := cells(df, percent)), out)[1])
    got = sorted(map(tuple, setjoin._asking(frame, 90, "all").collect()))
    tokens, top, rank = {}, {}, {}
    for t, i, g, n, _, _, label, weight in rows:
        tokens.setdefault(("id", i), set()).add(t)
        tokens.setdefault(("gid", g), set()).add(t)
        top[g] = max(top.get(g, (0, 0)), (weight, label))
        rank[i] = (weight, label)
    both = {(i, g): len(tokens["id", i] & tokens["gid", g]) for i in rank for g in top if 1000 + i // 2 != g and top[g] > rank[i]}
    need = lambda n: 1 + (n - -(-n * 90 // 100) + 1) // 2
    assert got == sorted(x for x, k in both.items() if k >= min(need(40 + x[0] % 5), need(40)))
    # all tokens are of more than eight sets: a pair is a row once, whatever it shares
    assert met[0].count() == sum(k > 0 for k in both.values())
