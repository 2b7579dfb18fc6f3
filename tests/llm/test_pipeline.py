"""Each stage of the pipeline against a plain version on a small corpus, with odd rows and clashing columns."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from loomwork.llm import bpe, decontaminate, quality

from . import brute

SF = "/root/testdata/sf0.001"
STAGE = dict(pipeline.STAGES)


def _odd(spark, docs):
    """Some documents, with nulls, an empty text, a repeated row, an id with two texts, and columns of clashing names."""
    few = docs.filter("doc_id < 60")
    odd = spark.createDataFrame([(1000, None, "en", "s", 0), (1001, "", None, None, None), (None, "a b c", "en", "s", 3), (1002, "one text of an id", "en", "s", 1), (1002, "another text of it", "en", "s", 1)], docs.schema)
    rows = few.unionByName(few.filter("doc_id = 7")).unionByName(odd)
    for name in ("score", "found", "_gone", "_cut", "_h1", "pii"):
        rows = rows.withColumn(name, F.lit(name))
    return spark.createDataFrame(rows.collect(), rows.schema)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_quality_keeps_what_the_model_accepts(spark):
    docs = _odd(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, grams = quality.fit(docs, labels, lambda i: F.lit(True)), quality.Grams()
    want = sorted(str(r) for r in docs.collect() if model.score(grams(r["text"])) >= quality.THRESHOLD)
    got = STAGE["quality"](spark, docs, SF)
    assert got.columns == docs.columns and _rows(got) == want
    assert STAGE["quality"](spark, docs.limit(0), SF).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = _odd(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    rows = docs.collect()
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[r["doc_id"]] = min(least.get(r["doc_id"], r), r, key=lambda x: tuple((v is not None, v) for v in x))
    component = brute.near_components([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], 5, 80)
    want = sorted([str(r) for i, r in least.items() if component[i] == i] + [str(r) for r in rows if r["doc_id"] is None])
    got = STAGE["near_duplicates"](spark, docs, SF)
    assert got.columns == docs.columns and _rows(got) == want


def test_passages_of_the_benchmark_go(spark):
    docs = _odd(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = STAGE["decontamination"](spark, docs, SF)
    assert got.columns == docs.columns
    kept = got.collect()
    assert all(brute.contamination(r["text"], items)[1] == 0 for r in kept)
    clean = [str(r) for r in docs.collect() if brute.contamination(r["text"], items)[1] == 0]
    mostly = [r for r in docs.collect() if (hit := brute.contamination(r["text"], items))[1] > 0.5 * max(1, hit[0])]
    assert set(clean) <= set(map(str, kept)) and len(kept) == docs.count() - len(mostly)


def test_personal_data_is_replaced(spark):
    docs = _odd(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    got = STAGE["pii"](spark, docs, SF)
    assert got.columns == docs.columns and got.count() == docs.count()
    before = {(r["doc_id"], r["n_chars"]): r["text"] for r in docs.collect()}
    for r in got.collect():
        assert not brute.pii(r["text"])
        text = before[r["doc_id"], r["n_chars"]] if r["doc_id"] != 1002 else r["text"]
        found = brute.pii(text)
        assert (r["text"] == text) or found
        assert (r["text"] or "").count("<EMAIL>") >= min(1, sum(s[3] == "email" for s in found))


def test_tokens_are_the_library_s(spark):
    docs = _odd(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted(str((r["doc_id"], library.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    got = STAGE["tokens"](spark, docs, SF).collect()
    assert sorted(str((r["doc_id"], r["ids"])) for r in got) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_long_items_are_cut_with_overlap(spark):
    words = [f"w{i}" for i in range(95)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short item")], "item_id long, text string")
    rows = [(k, " ".join(["x", *words[k : k + 10], "y"])) for k in range(86)] + [(100, " ".join(words[:9])), (101, "a short item here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (sum(e - s for s, e in r["spans"]), r["items"]) for r in decontaminate.find(docs, items, shard_words=20).collect()}
    assert all(got[k] == (10, ["1"]) for k in range(86)) and got[100] == (0, []) and got[101] == (2, ["2"])
