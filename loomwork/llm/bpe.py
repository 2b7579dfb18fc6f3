"""Byte-level BPE encoding and decoding by ranked merges over a segment tree.

Each match of the splitting pattern is encoded separately. A segment tree over its byte positions
holds at each leaf the rank of the pair that starts there, and at each node the leftmost position of
its smallest rank. A merge takes the root's position, joins that part with the next live one, and
sets the ranks of the pairs at and before it: three point updates, each logarithmic in the length. Nodes have FAN children.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain, islice
from sys import getsizeof

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: Bytes of each generation of what a Python worker remembers of pieces, those of an entry beside its objects, and characters of a text in hand at once.
CACHE, _ENTRY, AT_ONCE = 40_000_000, 110, 200_000
_NONE = 1 << 62
#: Children of a node of the tree, so that short pieces have its root alone.
FAN = 32


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always the leftmost pair of smallest rank is merged, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    end = list(range(1, n + 1))  # of the live part that starts here
    before = list(range(-1, n - 1))  # start of the live part before
    get = ranks.get
    leaves = [_NONE] * n  # rank * n + position; the minimum is the leftmost of the smallest rank
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            leaves[i] = rank * n + i
    above, top = [], leaves
    while len(top) > FAN:
        top = [min(top[k : k + FAN]) for k in range(0, len(top), FAN)]
        above.append(top)
    while (least := min(top)) != _NONE:
        i = least % n
        j = end[i]
        end[i] = stop = end[j]
        leaves[j] = leaves[i] = _NONE
        if stop < n:
            before[stop] = i
            rank = get(piece[i : end[stop]])
            if rank is not None:
                leaves[i] = rank * n + i
        p = before[i]
        if p >= 0:
            rank = get(piece[p:stop])
            leaves[p] = _NONE if rank is None else rank * n + p
        if above:
            for k in (j, i, p) if p >= 0 else (j, i):
                low = leaves
                for nodes in above:
                    k //= FAN
                    least = min(low[k * FAN : k * FAN + FAN])
                    if nodes[k] == least:
                        break
                    nodes[k], low = least, nodes
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Memory:
    """What make(key) gives, remembered in two generations of bounded bytes.

    When the young one is full it becomes the old one, whose keys are found again as they recur.
    """

    def __init__(self, make, most: int = CACHE) -> None:
        self.make, self.most, self.room = make, most, most
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            cost = _ENTRY + getsizeof(key) + getsizeof(got)
            if cost > self.most // 8:
                return got
            self.room -= cost
            if self.room < 0:
                self.old, self.young, self.room = self.young, {}, self.most - cost
            self.young[key] = got
        return got

    def all(self, keys: list) -> list:
        got = list(map(self.young.get, keys))
        if None in got:
            got = [self.get(k) if g is None else g for k, g in zip(keys, got, strict=True)]
        return got


class Codec:
    """Ranks, their inverse, and the ids of pieces as far as they are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.ids = Memory(lambda piece: tuple(merge(piece.encode("utf-8"), self.ranks)))
        self.forms = Memory(self._form)

    def _form(self, piece: str) -> bytes:
        """The ids of a piece in decimal, each with a comma behind it, a NUL, and the bytes that they decode to."""
        ids = merge(piece.encode("utf-8"), self.ranks)
        return b"%d," * len(ids) % tuple(ids) + b"\0" + self.decode(ids)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, those of a long one in parts."""
        if len(text) <= AT_ONCE:
            yield self.split.findall(text)
            return
        found = self.split.finditer(text)
        while pieces := [m[0] for m in islice(found, AT_ONCE // 8)]:
            yield pieces

    def parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, those of a long one in parts."""
        for pieces in self.pieces(text):
            yield list(chain.from_iterable(self.ids.all(pieces)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def write(self, text: str) -> tuple[int, str, bytes]:
        """The number of ids, the ids in decimal, comma-joined, and the bytes that they decode to."""
        ids = self.encode(text)
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """As write(), with hexadecimal digests in place of both strings, which aren't held whole for a long text."""
        n, decimal, back = 0, hashlib.sha256(), hashlib.sha256()
        for pieces in filter(None, self.pieces(text)):
            numbers, decoded = map(b"".join, zip(*[f.split(b"\0", 1) for f in self.forms.all(pieces)], strict=True))
            decimal.update((b"," if n else b"") + numbers[:-1])
            back.update(decoded)
            n += numbers.count(b",")
        return n, decimal.hexdigest(), back.hexdigest()


#: The codec that this Python worker made last, by the name of the ranks it was sent.
_CODECS: dict[str, Codec] = {}


def codec(spark: SparkSession, ranks_path: str, pattern: str):
    """A function for executors that returns the codec. The rank file is read on the driver and broadcast; it doesn't grow with the data."""
    sent, tag = spark.sparkContext.broadcast(load_ranks(ranks_path)), uuid.uuid4().hex

    def made() -> Codec:
        if tag not in _CODECS:
            _CODECS.clear()
            _CODECS[tag] = Codec(sent.value, pattern)
        return _CODECS[tag]

    return made


def default_codec(spark: SparkSession):
    import public_tokenizers

    return codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def encode(docs: DataFrame, made, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (default: all) with ids array<int>. Null and empty texts have none; rows stay as they are."""

    def start():
        c = made()
        return lambda t: (c.encode(t) if t else [],)

    return map_texts(docs, text, keep or [c for c in docs.columns if c != "ids"], "ids array<int>", start)


def decode(coded: DataFrame, made, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all) and decoded, the bytes of the ids. Null ids give no bytes; an id without a token is an error."""

    def start():
        c = made()
        return lambda x: (c.decode(x or []),)

    return map_texts(coded, ids, keep or [c for c in coded.columns if c != "decoded"], "decoded binary", start)


def round_trip(docs: DataFrame, made, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (default: all) with ids array<int> and round_trip, whether the ids decode to the text, in one pass.

    A null or empty text has no ids and decodes to itself. Repeated rows stay. No rows, no rows.
    """

    def start():
        c = made()

        def one(t: str | None):
            ids = c.encode(t or "")
            return ids, c.decode(ids) == (t or "").encode("utf-8")

        return one

    return map_texts(docs, text, keep or [c for c in docs.columns if c not in ("ids", "round_trip")], "ids array<int>, round_trip boolean", start)


def digests(docs: DataFrame, made, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep with n_tokens, the digest of the ids and that of the bytes that they decode to.

    A null text is an empty one: no tokens, and the digests of nothing. Repeated rows stay, and so do
    columns that the result's names clash with, if kept.
    """

    def start():
        c = made()
        return lambda t: c.digest(t or "")

    return map_texts(docs, text, keep or docs.columns, "n_tokens long, ids_sha256 string, decoded_sha256 string", start)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_codec(spark), keep=["doc_id"])
