"""The conversation prefix trie against a plain version, with subtries dealt again round by round."""

import hashlib
import random
import zlib

import pytest

from loomwork.llm import trie
from loomwork.llm.queries import QUERIES


def plain(paths: dict) -> list[tuple]:
    """Nodes of {conv_id: tuple of (role, text)}."""
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members) for k in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(own) if len(paths[c]) == len(key)).encode()).hexdigest()
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(kids), leaves, saved, ends))
    return sorted(out, key=str)


def rebuilt(rows: list[tuple]) -> dict:
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    return {c: tuple(own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + p[zlib.crc32(str(c).encode()) % 6 :]) for c, p in own.items()}


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def _rows(seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for c in range(60):
        p = [rng.choice("ab") for _ in range(rng.randrange(1, 7))]
        rows += [(c, k, rng.choice(["user", "user", None]), x) for k, x in enumerate(p)]
    hot = [(200 + c, k, "user", f"same {k}") for c in range(40) for k in range(5 + c // 20)]  # a third of all, beyond one first turn
    odd = [(None, 0, "user", "x"), (300, None, "user", None), (300, None, "user", None), (301, 3, None, ""), (302, 1, "é", "x" * 70_000), (303, 1, "a", "b"), (303, 1, "a", "c"), (305, 5, "tool", "\x00")]
    return [*rows, *hot, *odd]


@pytest.mark.parametrize("turns", [trie.SUBTRIE_TURNS, 40, 1])
def test_trie_is_the_plain_one_however_it_is_dealt(spark, turns):
    rows = _rows(turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS n_convs", "'clash' AS seq", "'clash' AS d")
    paths = trie.with_borrowed_heads(trie.conversation_paths(df))
    want = plain(rebuilt(rows))
    assert found(trie.prefix_trie(paths, subtrie_turns=turns, bucket_turns=100)) == want


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(c, k, "user", f"{k}") for c in (100, 200) for k in range(300)] + [(200, 300, "user", "more")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = trie.conversation_paths(df)
    by_conv = {c: tuple(("user", t) for x, _, _, t in rows if x == c) for c in (100, 200)}
    assert found(trie.prefix_trie(paths, subtrie_turns=10)) == plain(by_conv)
    assert found(trie.prefix_trie(paths.limit(0))) == []


def test_query_reads_its_whole_table(spark, tmp_path):
    rows = _rows(9)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == plain(rebuilt(rows))
