"""Spelling variants against plain versions: words one edit apart, groups cut to single places, forms and roots."""

import random
import re
import zlib

import numpy as np
import pytest

from loomwork.llm import spelling
from loomwork.llm.queries import QUERIES

from . import brute


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def plain(words: dict) -> list[tuple]:
    forms, out = {}, []
    for w, n in words.items():
        by = [(-words[v], v) for v in words if near(w, v)]
        best = min(by, default=None)
        forms[w] = best[1] if best and -best[0] >= 2 * n else None
        out.append((w, n, len(by)))

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted((w, forms[w] or "", root(w), n, k, words[forms[w]] if forms[w] else -1) for w, n, k in out)


def found(df) -> list[tuple]:
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((r[0], r[1] or "", r[2], r[3], r[4], -1 if r[5] is None else r[5]) for r in rows)


def _vocabulary(seed: int, letters: str) -> dict:
    rng, words = random.Random(seed), {}
    for _ in range(150):
        words["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))] = rng.choice([1, 2, 3, 4, 8, 8, 40])
    for w in list(words)[:60]:  # a crowd that shares its beginning
        words["sharedsharedshared" + w] = rng.randrange(1, 30)
    return words


@pytest.mark.parametrize(("letters", "group_bytes"), [("ab", spelling.GROUP_BYTES), ("abé", 200), ("aÿü", 1), ("aß語𝄞", 300)])
def test_variants_are_the_plain_ones_however_groups_are_cut(spark, letters, group_bytes):
    words = _vocabulary(group_bytes, letters)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variant_groups(df, group_bytes=group_bytes)) == plain(words)


def test_very_long_words_and_none(spark):
    long = "ab" * 30_000
    words = {long: 9, long[:-1]: 4, long[:40_000] + "c" + long[40_001:]: 2, "x" * 60_000: 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variant_groups(df)) == plain(words)
    assert found(spelling.variant_groups(df.limit(0))) == []


def test_wavelet_tree_reports_points_of_both_intervals():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 7, 64, 100):
        values = rng.permutation(size)
        a, b, c, d = (rng.integers(0, size + 1, 200) for _ in range(4))
        query, value = spelling.WaveletTree(values).report(a, b, c, d)
        want = [(q, v) for q in range(200) for v in values[a[q] : max(a[q], b[q])] if c[q] <= v < d[q]]
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == sorted((q, int(v)) for q, v in want)


def test_query_counts_whole_texts(spark, tmp_path):
    rng = random.Random(11)
    stock = ["Wasser", "Wassen", "wassér", "Straße", "Strasse", "house", "houses", "ÀÀÀÀÀ", "four", "x×y÷z"]
    docs = [(i, " ".join(rng.choice(stock) + rng.choice(["", "", "s", "7", "_"]) for _ in range(rng.randrange(0, 80)))) for i in range(60)]
    docs += [(1, docs[1][1]), (None, "House house HOUSE"), (70, None), (71, ""), (72, "Wasser " * 30_000)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS word", "1 AS n").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            counts[w] = counts.get(w, 0) + 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    assert found(QUERIES["op12_spelling"](spark, str(tmp_path))) == want
