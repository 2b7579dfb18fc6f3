"""Exact n-gram Jaccard join by a token-group matrix.

Rows are sorted by slots of their least hash, size class and least hashes, so that similar sets lie side by side, and cut into
groups of at most GROUP sets. A group compares its sets with each other as it is made, and stores
the union of its tokens. The rest of the join is between sets (queries) and other groups:

* The matrix is asked with a query's leading tokens, in one global order that puts tokens of many
  documents last. Sets that link share a known number of their leading tokens; a group where the
  query finds fewer is out.
* For the groups left, the whole query is counted against the whole union, which bounds the
  similarity to any member. Only groups that can still hold a partner are opened, and a query is
  verified against their members on full sets.

Components need no pair inside a component. Equal sets are one member, links within groups merge
most copies at once, one representative of each component asks first, and then every set asks the
groups that hold members of other, larger components. No link between components is left out, and a
large group of near copies doesn't emit its pairs.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, lean, stored, table
from .neardup import _LOW, _mix, _overlaps, _powers, _salted, components, merged, shingles

#: Sets of a group, and their tokens in all, unless one has more alone.
GROUP, GROUP_TOKENS = 64, 500_000
#: Sets that later groups of the same least hash are held against as they are made.
LEADERS = 16
#: Tokens of so many documents are put last in the order, the most frequent HOT_MOST at most. This moves work, not results.
HOT_DOCUMENTS, HOT_MOST = 32, 1_000_000
#: Tokens of a partition that are counted at once.
COUNTED = 1_000_000
#: Bytes of texts that are hashed together.
TOGETHER_BYTES = 1 << 20
#: Bits by which texts that aren't asked for are kept out of a shuffle: two megabytes, whatever the data.
ID_BITS = 1 << 24
#: Queries that meet a group's union in one task.
ASKING = 256
#: Leading tokens of more sets than that count their shares in cells, of so many queries by so many groups.
OFTEN, CELL_SETS, CELL_GROUPS = 256, 256, 64

_U = np.uint64
_NOTHING = np.zeros(0, _U)


def _linked(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def lead(n: int, percent: int) -> tuple[int, int]:
    """How many leading tokens a set of n needs, and how many of them it shares with any set of its size class that links."""
    spare = n - -(-n * percent // 100) + 1
    least = 1 + spare // 2
    return spare + least - 1, least


def _least_shared(n: Column, percent: int) -> Column:
    return F.lit(1) + F.floor((n - F.ceil(n * percent / F.lit(100)) + 1) / 2)


_GROWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(b: np.ndarray, solid: np.ndarray, first: np.ndarray) -> np.ndarray:
    """neardup's hash of each word, from differences of running sums; solid marks bytes of words, first the first ones."""
    begins = np.flatnonzero(first)
    if not begins.size:
        return _NOTHING
    if not _GROWN:
        base = int(_LOW[1])
        _GROWN[0] = _powers(TOGETHER_BYTES + 1, base), _powers(TOGETHER_BYTES + 1, pow(base, -1, 1 << 64))
    power, inverse = _GROWN[0]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    letters = b + np.uint8(1) + ((b >= 65) & (b <= 90)).view(np.uint8) * np.uint8(32)  # no byte of UTF-8 is 255
    sums = np.zeros(len(b) + 1, _U)
    np.cumsum(letters * power[: len(b)], out=sums[1:])
    return _mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(_U))


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """neardup.shingles() of each text of an Arrow string array, hashed together; a long text goes alone, in chunks."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) < 2 or ends[-1] - ends[0] > TOGETHER_BYTES:
        return [shingles(t.as_py(), size) for t in texts]
    data = texts.buffers()[2]
    b = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    begins_at = ends[:-1] - ends[0]
    solid = (b != 32) & ((b < 9) | (b > 13))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = begins_at[begins_at < len(b)]
    first[heads] = solid[heads]
    words, starts = word_hashes(b, solid, first), np.flatnonzero(first)
    owner = np.searchsorted(begins_at, starts, "right") - 1  # of equal begins the last one, which has the bytes
    last = len(words) - size + 1
    out: list = [_NOTHING] * len(texts)
    count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    if last > 0:
        total = np.zeros(last, _U)
        for j in range(size):
            total = (total ^ words[j : last + j]) * _U(0xD6E8FEB86659FD93) + _U(size)
            total ^= total >> _U(32)
        whole = owner[:last] == owner[size - 1 :]
        total, of = _mix(total[whole]), owner[:last][whole]
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            total[cuts[k] : cuts[k + 1]].sort()
        new = np.ones(len(total), bool)
        new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
        kept, of = total[new], of[new]
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            out[k] = kept[cuts[k] : cuts[k + 1]]
    for k in np.flatnonzero((count > 0) & (count < size)):
        out[k] = shingles(texts[int(k)].as_py(), size)
    return out


def _keys(size: int, percent: int):
    """Rows by kind: 0 a document and what it is sorted by (size class, two least hashes, digest), 1 a token and in how many documents of a part it is.

    Tokens are counted in parts of COUNTED, and those seen once there aren't reported; a token of a
    considerable share of all documents is.
    """

    def run(batches):
        import pyarrow as pa

        names = ["kind", "doc_id", "text", "cls", "m1", "m2", "d1", "d2", "token", "n"]
        held, count = [], 0

        def flush():
            token, times = np.unique(np.concatenate(held), return_counts=True)
            some = times > 1
            n = int(some.sum())
            nulls = [pa.nulls(n, t) for t in (ids, pa.large_string() if big else pa.string(), pa.int32(), *[pa.int64()] * 4)]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *nulls, pa.array(token[some].view(np.int64)), pa.array(times[some].astype(np.int64))], names=names)

        for whole in batches:
            ids, big = whole.schema.field("doc_id").type, pa.types.is_large_string(whole.schema.field("text").type)
            for batch in slices(whole, whole.schema.get_field_index("text"), TOGETHER_BYTES):
                rows = []
                for own in shingle_sets(batch.column("text"), size):
                    if not own.size:
                        rows.append((-1, 0, 0, 0, 0))
                        continue
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    cls = int(math.log(len(own)) / math.log(100 / percent)) if percent < 100 else len(own)
                    second = int(_mix(own ^ _U(0x9E3779B97F4A7C15)).min())
                    rows.append((cls, int(own[0]) - 2**63, second - 2**63, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
                    held.append(own)
                    count += len(own)
                n = batch.num_rows
                made = [pa.array(column, pa.int32() if k == 0 else pa.int64()) for k, column in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int32()), *[pa.array([], pa.int64())] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("doc_id"), batch.column("text"), *made, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                if count >= COUNTED:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return run


def frequent_tokens(keys: DataFrame, documents: int = HOT_DOCUMENTS) -> np.ndarray:
    """Tokens of many documents, as (token, rank) sorted by token; rank grows with the count. At most HOT_MOST reach the driver."""
    counted = keys.filter("kind = 1").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= documents).orderBy(F.desc("n"), "token").limit(HOT_MOST).toPandas()
    tokens = top["token"].to_numpy(dtype=np.int64).view(_U)
    ranks = np.arange(len(tokens))[::-1].astype(_U)
    order = np.argsort(tokens)
    return np.stack([tokens[order], ranks[order]])


def leading(own: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """The leading tokens of a sorted set: rare ones by hash, then frequent ones by rank."""
    need, _ = lead(len(own), percent)
    if hot.shape[1]:
        at = np.minimum(np.searchsorted(hot[0], own), hot.shape[1] - 1)
        is_hot = hot[0][at] == own
        rare = own[~is_hot]
        if len(rare) < need:
            own = np.concatenate([rare, own[is_hot][np.argsort(hot[1][at[is_hot]])]])
        else:
            own = rare
    return own[:need]


def inner_overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets, by products of indicators of the tokens that several of them have."""
    where = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    column = np.cumsum(several) - 1
    keep = several[inverse]
    rows, cols, width = where[keep], column[inverse[keep]], int(several.sum())
    out = np.diag([float(len(s)) for s in sets]).astype(np.float32)
    shared = np.zeros_like(out)
    for k in range(0, width, 4096):
        part = (cols >= k) & (cols < k + 4096)
        m = np.zeros((len(sets), min(4096, width - k)), np.float32)
        m[rows[part], cols[part] - k] = 1
        shared += m @ m.T
    np.fill_diagonal(shared, 0)
    return out + shared


def packed(tokens: np.ndarray) -> tuple[int, bytes]:
    """A sorted set of hashes as bits and steps of two bytes: their leading bits alone, and more than they are where a step would be longer. What it contains, the set may; what it doesn't, the set doesn't."""
    bits = min(48, max(16, 13 + len(tokens).bit_length()))
    values = np.unique(tokens >> _U(64 - bits)).astype(np.int64)
    steps = np.diff(values, prepend=0)
    more = np.maximum(steps - 1, 0) // 65535
    place = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    fillers = np.repeat(values - steps, more) + 65535 * place
    return bits, np.diff(np.sort(np.concatenate([values, fillers])), prepend=0).astype(np.uint16).tobytes()


def contained(own: np.ndarray, bits: int, steps: bytes) -> int:
    """How many of the hashes a packed set may contain."""
    values = np.cumsum(np.frombuffer(steps, np.uint16).astype(np.int64))
    asked = (own >> _U(64 - bits)).astype(np.int64)
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    return int((values[at] == asked).sum())


_MADE = "kind int, gid long, id long, member long, other long, d1 long, d2 long, n long, low long, high long, lead array<long>, bits int, tokens binary"


def _grouped(size: int, percent: int, hot, most: int, most_leaders: int):
    """Cuts sorted rows into groups. Kinds of rows: 0 a document and its member, 1 a link, 2 a member and its leading tokens, 3 a group and the union of its tokens."""

    def run(batches):
        import pyarrow as pa

        frequent = hot.value
        out = {f.split()[0]: [] for f in _MADE.split(", ")}
        types = {"kind": pa.int32(), "lead": pa.list_(pa.int64()), "bits": pa.int32(), "tokens": pa.binary()}
        state = {"gid": TaskContext.get().partitionId() << 32, "held": 0}
        members: list[tuple] = []  # id, digest, set
        run_of, leaders = None, []  # class and least hash; leaders of their run of groups
        last_digest, last_member, last_cls = None, None, None

        def put(**x):
            for name, column in out.items():
                column.append(x.get(name))
            state["held"] += 1 + len(x.get("lead", ())) + len(x.get("tokens", ())) // 8

        def batch():
            arrays = [pa.array(column, types.get(name, pa.int64())) for name, column in out.items()]
            made = pa.RecordBatch.from_arrays(arrays, names=list(out))
            for column in out.values():
                column.clear()
            state["held"] = 0
            return made

        def close():
            if not members:
                return
            gid, sets = state["gid"], [m[2] for m in members]
            state["gid"] += 1
            root = list(range(len(members)))
            if len(members) > 1:
                both, n = inner_overlaps(sets).astype(np.int64), np.array([len(s) for s in sets])
                link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
                for x, y in np.argwhere(np.triu(link, 1)).tolist():
                    a, b = x, y
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        put(kind=1, member=members[x][0], other=members[y][0])
            for x in range(len(members)):
                if root[x] != x or int(sets[x][0]) != run_of[1]:
                    continue
                for ident, other in leaders:
                    if _linked(len(np.intersect1d(sets[x], other, assume_unique=True)), len(sets[x]), len(other), percent):
                        put(kind=1, member=ident, other=members[x][0])
                        break
                else:
                    if len(leaders) < most_leaders:
                        leaders.append((members[x][0], sets[x]))
            low, high = min(map(len, sets)), max(map(len, sets))
            for (ident, digest, own) in members:
                put(kind=2, gid=gid, id=ident, d1=digest[0], d2=digest[1], n=len(own), low=low, high=high, lead=leading(own, frequent, percent).view(np.int64).copy())  # else the whole set stays
            bits, steps = packed(np.unique(np.concatenate(sets)))
            put(kind=3, gid=gid, low=low, high=high, bits=bits, tokens=steps)
            members.clear()

        total = 0
        for whole in batches:
            for part in slices(whole, whole.schema.get_field_index("text"), TOGETHER_BYTES):
                ids, cls, d1, d2 = (part.column(c).to_pylist() for c in ("doc_id", "cls", "d1", "d2"))
                for ident, c, digest, own in zip(ids, cls, zip(d1, d2, strict=True), shingle_sets(part.column("text"), size), strict=True):
                    if ident is None or c < 0:
                        put(kind=0, id=ident, n=len(own))
                        continue
                    if digest != last_digest or c != last_cls:
                        if c != last_cls or len(members) >= most or total + len(own) > GROUP_TOKENS:
                            close()
                            total = 0
                            if (c, int(own[0])) != run_of:
                                run_of = (c, int(own[0]))
                                leaders.clear()
                        members.append((ident, digest, own))
                        total += len(own)
                        last_digest, last_member, last_cls = digest, ident, c
                    put(kind=0, id=ident, member=last_member, n=len(own))
                    if state["held"] > 200_000:
                        yield batch()
        close()
        yield batch()

    return run


def _shared(batches):
    """Of (token, gid, id) sorted by token and gid, the rows of tokens that several groups have. A token's rows are held until a second group comes."""
    import pyarrow as pa

    names, kept, mixed = ["token", "gid", "id"], None, False  # rows of the last token so far, if not passed on; whether they are
    for whole in batches:
        token, gid, ident = (whole.column(c).to_numpy() for c in names)
        if not len(token):
            continue
        if kept is not None and len(kept[0]):
            token, gid, ident = (np.concatenate(x) for x in zip(kept, (token, gid, ident), strict=True))
        elif kept is not None and mixed and token[0] != last:
            mixed = False
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        several = np.minimum.reduceat(gid, begins) != np.maximum.reduceat(gid, begins)
        if mixed and kept is not None and token[0] == last:
            several[0] = True
        times = np.diff(np.append(begins, len(token)))
        passed = np.repeat(several, times)
        last, mixed = token[-1], bool(several[-1])
        open_ = slice(len(token), len(token)) if mixed else slice(begins[-1], len(token))
        kept = (token[open_], gid[open_], ident[open_])
        yield pa.RecordBatch.from_arrays([pa.array(x[passed]) for x in (token, gid, ident)], names=names)


def _bounded(size: int, percent: int):
    def run(asked: pd.DataFrame, unions: pd.DataFrame) -> pd.DataFrame:
        """(id, gid) of the queries whose similarity to some member of the group may suffice."""
        kept = []
        for gid, low, high, bits, steps in zip(*[unions[c] for c in ("gid", "low", "high", "bits", "tokens")], strict=True):
            for ident, text in zip(asked["id"], asked["text"], strict=True):
                own = shingles(text, size)
                n, both = len(own), contained(own, bits, steps)
                # the best member has the shared tokens and, if it must be larger, some of its own
                best = (min(both, high), max(n, 1)) if both >= low else (both, n + low - both)
                if 100 * best[0] >= percent * best[1]:
                    kept.append((ident, gid))
        return pd.DataFrame(kept, columns=["id", "gid"]).astype("int64").drop_duplicates()

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the ids, a row for each different text of an id.

    A bitmap of ID_BITS hashed ids, broadcast in rows of four kilobytes, keeps most other texts out of
    the shuffle; the join decides.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    bits = ids.select(place("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    near = docs.withColumn("p", place("doc_id")).withColumn("bucket", F.bitmap_bucket_number("p")).withColumn("at", F.bitmap_bit_position("p").cast("int"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = near.join(F.broadcast(bits), "bucket").filter(F.getbit(byte, F.col("at") % 8) == 1).select("doc_id", "text")
    found = near.join(ids, near["doc_id"] == ids["id"])
    return found.groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("id", "text")


def _members_linked(size: int, percent: int):
    def run(asked: pd.DataFrame, inside: pd.DataFrame) -> pd.DataFrame:
        """Links (a, b) of queries b with members a of larger components, by full sets; one for each two components is enough."""
        found: dict[tuple, tuple] = {}
        if len(asked) and len(inside):
            sides = [[shingles(t, size) for t in side["text"]] for side in (asked, inside)]
            n, m = [np.array([len(s) for s in side]) for side in sides]
            own, other = [pd.MultiIndex.from_frame(side[["weight", "label"]]).to_list() for side in (asked, inside)]
            ranks = {x: k for k, x in enumerate(sorted({*own, *other}))}
            x, y = [np.array([ranks[r] for r in side]) for side in (own, other)]
            may = (x[:, None] < y[None, :]) & (100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :]))
            rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
            if len(rows):
                both = _overlaps([sides[0][k] for k in rows], [sides[1][k] for k in columns]).astype(np.int64)
                link = may[np.ix_(rows, columns)] & (100 * both >= percent * (n[rows][:, None] + m[columns][None, :] - both))
                a, b = inside["id"].to_numpy()[columns], asked["id"].to_numpy()[rows]
                for k, j in np.argwhere(link).tolist():
                    found.setdefault((x[rows[k]], y[columns[j]]), (a[j], b[k]))
        return pd.DataFrame(list(found.values()), columns=["a", "b"]).astype("int64")

    return run


def _opened(asking: DataFrame, entries: DataFrame, members: DataFrame, unions: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of queries with members of larger components in the groups that they ask, given as (id, gid): bounds first, then full sets.

    Only members that share leading tokens with something are verified: no other can link. Queries meet
    a group's union, and then its members' sets, in blocks of ASKING: no pair is made a row of a table.
    """
    by, every = ["gid", "block"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    # blocks are dealt before texts come, so that a text moves once less
    planned = lambda df: df.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("blocks"))
    plan = planned(asking)
    queries = _salted(asking, plan, "gid", "id").select("id", "gid", block)
    queries = _salted(queries, _texts(docs, asking.select("id").distinct()), "id", "gid").select("id", "gid", "block", "text")
    matrix = unions.join(plan, "gid").select("gid", "low", "high", "bits", "tokens", every)
    open_ = queries.groupBy(*by).cogroup(matrix.groupBy(*by)).applyInPandas(_bounded(size, percent), "id long, gid long")
    open_ = stored(open_.distinct(), "setjoin-open")

    plan = planned(open_)
    known = members.select("id", "label", "weight").distinct()
    inside = entries.select("gid", "id", "label", "weight").distinct().join(plan, "gid")
    texts = stored(_texts(docs, open_.select("id").unionByName(inside.select("id")).distinct()), "setjoin-texts")
    asked = _salted(_salted(open_, plan, "gid", "id").select("id", "gid", block), known, "id", "gid").select("id", "gid", "block", "label", "weight")
    asked = _salted(asked, texts, "id", "gid").select("id", "gid", "block", "label", "weight", "text")
    inside = inside.join(texts, "id").select("id", "gid", "label", "weight", "text", every)
    links = asked.groupBy(*by).cogroup(inside.groupBy(*by)).applyInPandas(_members_linked(size, percent), "a long, b long")
    return stored(links.distinct(), "setjoin-links")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", group: int = GROUP, leaders: int = LEADERS, hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """doc_id, n_shingles and component_id, a row for each row of docs.

    Links are pairs of documents whose sets of shingles of size words have a Jaccard similarity of
    percent / 100 or more, all of them; component_id is the smallest doc_id reachable over links.
    Null and empty texts have no shingles and no links. Rows of one doc_id are one document and count
    as linked. A null doc_id has a null component and links with nothing. Other columns are ignored.
    group, leaders and hot_documents move work; results don't depend on them.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    spark = docs.sparkSession
    lean(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys_at = f"{shared_dir(spark)}/loomwork/setjoin-keys-{uuid.uuid4().hex}"
    keys = docs.mapInArrow(_keys(size, percent), f"kind int, doc_id {kind}, text string, cls int, m1 long, m2 long, d1 long, d2 long, token long, n long")
    keys.write.parquet(keys_at)
    keys = spark.read.schema(keys.schema).parquet(keys_at)
    hot = spark.sparkContext.broadcast(frequent_tokens(keys, hot_documents))
    # as many slots of the least hash as partitions, so that long texts, which are of the last classes, lie in all of them
    slots = 1 << int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()
    slot = F.pmod(F.xxhash64("m1"), F.lit(slots)).alias("slot")
    order = ["slot", "cls", "m1", "m2", "d1", "d2", "doc_id"]
    ranged = keys.filter("kind = 0").select(slot, *order[1:], "text").repartitionByRange(*order).sortWithinPartitions(*order)
    made = stored(ranged.mapInArrow(_grouped(size, percent, hot, group, leaders), _MADE), "setjoin-groups")
    _gone(spark, keys_at)
    of = lambda k: made.filter(F.col("kind") == k)
    rows, links = of(0).select("id", "member", "n"), of(1).select(F.col("member").alias("a"), F.col("other").alias("b"))
    members, unions = of(2).select("gid", "id", "n", "low", "high", "d1", "d2"), of(3).select("gid", "low", "high", "bits", "tokens")

    # equal sets of several partitions, and several sets of one id
    firsts = members.groupBy("d1", "d2").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z").drop("z")
    links = links.unionByName(members.join(firsts, ["d1", "d2"]).filter("a <> id").select("a", F.col("id").alias("b")))
    twofold = rows.filter("member IS NOT NULL").groupBy("id").agg(F.min("member").alias("a"), F.max("member").alias("z")).filter("a <> z").drop("z")
    links = links.unionByName(rows.join(twofold, "id").filter("a <> member").select("a", F.col("member").alias("b")).distinct())
    links = stored(links, "setjoin-links")

    # the matrix: leading tokens that several groups have
    entries = of(2).select(F.explode("lead").alias("token"), "gid", "id")
    entries = entries.repartition("token").sortWithinPartitions("token", "gid").mapInArrow(_shared, "token long, gid long, id long")
    entries = stored(entries, "setjoin-matrix").join(members.select("gid", "id", "n", "low", "high"), ["gid", "id"])

    labels = components(links)
    for step in ("representatives", "all"):
        weights = labels.groupBy("label").agg(F.count(F.lit(1)).alias("weight"))
        weighed = stored(_salted(labels, weights, "label", "id"), "setjoin-labels")
        named = lambda df: df.join(weighed, "id", "left").withColumn("label", F.coalesce("label", "id")).withColumn("weight", F.coalesce("weight", F.lit(1)))  # noqa: E731, B023
        mixed = stored(_several_labels(named(entries)), "setjoin-mixed")
        asking = stored(_asking(mixed, percent, step), "setjoin-asking")
        labels = merged(labels, _opened(asking, mixed, named(members), unions, docs, size, percent))
    out = _salted(rows.filter("member IS NOT NULL"), labels.select(F.col("id").alias("member"), "label"), "member", "id", "left")
    out = out.select("id", "n", F.coalesce("label", "member").alias("c"))
    out = out.unionByName(rows.filter("member IS NULL").select("id", "n", F.col("id").alias("c")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def _gone(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder from which a later one has been stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _several_labels(entries: DataFrame) -> DataFrame:
    """The entries of tokens whose sets are of several components."""
    several = entries.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a <> z").select("token")
    return entries.join(several, "token")


def _asking(entries: DataFrame, percent: int, step: str) -> DataFrame:
    """(id, gid): the groups that a set asks, for they share enough of its leading tokens and hold members of larger components, by weight and label.

    Representatives first: of each token, one set of each component asks one group of the token's
    largest component. This merges what is alike before all sets ask all groups.
    """
    rank = F.struct("weight", "label")
    fits = (100 * F.least(F.col("n"), F.col("high")) >= percent * F.greatest(F.col("n"), F.col("low"))) & (F.col("gid") != F.col("own"))
    if step == "representatives":
        one = entries.groupBy("token", "label").agg(F.min(F.struct("id", "n", F.col("gid").alias("own"), "weight")).alias("e"))
        top = entries.groupBy("token").agg(F.max(F.struct("weight", "label", "gid", "low", "high")).alias("t"))
        met = one.select("token", "label", "e.*").join(top.select("token", F.col("t.label").alias("top"), "t.gid", "t.low", "t.high"), "token")
        met = met.filter(fits & (F.col("label") != F.col("top")))
    else:
        often = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > OFTEN).select("token")
        often = stored(often, "setjoin-often")
        seldom = entries.join(often, "token", "left_anti")
        held = seldom.groupBy("token", "gid").agg(F.max(rank).alias("top"), F.min("low").alias("low"), F.min("high").alias("high"))
        queries = seldom.select("token", "id", "n", F.col("gid").alias("own"), rank.alias("rank"))
        met = queries.join(held, "token").filter(fits & (F.col("top") > F.col("rank")))
    met = met.select("id", "gid", "n", "low", F.lit(1).cast("long").alias("shared"))
    if step != "representatives":
        met = met.unionByName(_shared_in_cells(entries.join(often, "token"), percent))
    shared = met.groupBy("id", "gid").agg(F.sum("shared").alias("shared"), F.min("n").alias("n"), F.min("low").alias("low"))
    # tokens that the two of a link share have two labels and lie in two groups, so all of them are in the last step's count
    enough = F.col("shared") >= F.least(_least_shared(F.col("n"), percent), _least_shared(F.col("low"), percent))
    return shared.filter(enough).select("id", "gid")


def _cell(percent: int):
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """How many tokens each query shares with each group of a larger component that fits its size."""
        names = ["id", "gid", "n", "low", "shared"]
        if not len(asked) or not len(held):
            return pd.DataFrame(columns=names).astype("int64")
        sides = asked.groupby(["id", "own"], as_index=False).agg({"n": "min", "weight": "min", "label": "min"}), held.groupby("gid", as_index=False).agg({"low": "min", "high": "max"})
        top = held.sort_values(["weight", "label"]).groupby("gid", as_index=False).last()
        x = pd.MultiIndex.from_frame(sides[0][["id", "own"]]).get_indexer(pd.MultiIndex.from_frame(asked[["id", "own"]]))
        y = pd.Index(sides[1]["gid"]).get_indexer(held["gid"])
        count = np.zeros((len(sides[0]), len(sides[1])), np.int64)
        of = held.assign(y=y).groupby("token")["y"].unique()
        for token, own in asked.assign(x=x).groupby("token")["x"].unique().items():
            if token in of.index:
                count[np.ix_(own, of[token])] += 1
        q, g = ({c: side[c].to_numpy() for c in side} for side in sides)
        w, label, n = (q[c][:, None] for c in ("weight", "label", "n"))
        fits = 100 * np.minimum(n, g["high"]) >= percent * np.maximum(n, g["low"])
        larger = (top["weight"].to_numpy() > w) | ((top["weight"].to_numpy() == w) & (top["label"].to_numpy() > label))
        i, j = np.nonzero((count > 0) & fits & larger & (q["own"][:, None] != g["gid"]))
        return pd.DataFrame(dict(zip(names, (q["id"][i], g["gid"][j], q["n"][i], g["low"][j], count[i, j]), strict=True)))

    return run


def _shared_in_cells(entries: DataFrame, percent: int) -> DataFrame:
    """(id, gid, n, low, shared): queries and groups of larger components, and how many of the entries' tokens they share.

    For tokens of many sets: queries are dealt to parts and groups to blocks, and each part meets each block
    that has a token of its own in a task, so that a query is a row for each block and not for each group.
    """
    sizes = entries.agg(F.count_distinct("id").alias("sets"), F.count_distinct("gid").alias("groups")).first()
    parts, blocks = max(1, -(-sizes["sets"] // CELL_SETS)), max(1, -(-sizes["groups"] // CELL_GROUPS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    queries = entries.select("token", "id", F.col("gid").alias("own"), "n", "weight", "label", deal("id", parts).alias("part"))
    top = F.max(F.struct("weight", "label"))
    held = entries.groupBy("token", "gid").agg(top.alias("top"), F.min("low").alias("low"), F.max("high").alias("high"))
    held = held.select("token", "gid", "low", "high", "top.weight", "top.label", deal("gid", blocks).alias("block"))
    asked = queries.join(held.select("token", "block").distinct(), "token")
    held = held.join(queries.select("token", "part").distinct(), "token")
    asked, held = [df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (asked, held)]
    by = ["part", "block"]
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(_cell(percent), "id long, gid long, n long, low long, shared long")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.to_id),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN c ON c.doc_id = w.doc_id
"""
