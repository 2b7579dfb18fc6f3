"""From raw documents to token ids, in five stages that each keep what they are given unless they say so.

run() writes each stage's result as Parquet to the shared folder and reads it again as the next
stage's documents, so a lost executor costs a stage's tasks at most. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, common, decontaminate, neardup, pii, quality

#: Near duplicates by shingles of five words at a Jaccard similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def _free(name: str, docs: DataFrame) -> str:
    """A column name like the given one that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. Null texts are judged as empty ones."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), lambda i: F.lit(True))
    name = _free("score", docs)
    scored = quality.scored(docs, model, name=name)
    return scored.filter(F.col(f"`{name}`") >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates; null ids stay. Of rows of one id the first by all columns stays."""
    found = neardup.near_duplicates(docs, SHINGLE, PERCENT).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = common.stored(found.filter(F.col("doc_id").isNotNull() & (~F.col("kept") | (F.col("n") > 1))), "pipeline-copies")
    once = docs.join(found.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = docs.join(found.filter("kept").select("doc_id"), "doc_id", "left_semi")
    least = again.groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return once.unionByName(least.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the benchmark's passages out of the texts; documents that are mostly such passages go.

    Null and empty texts hold none and stay as they are; repeated rows and null ids stay, each cut alike.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that give it away, in the texts.

    Null texts stay null. Repeated rows and null ids stay; a text counts once however often it is repeated.
    """
    name = _free("found", docs)
    found = pii.find_pii(docs, name=name)
    text = pii.sanitised(F.col("text"), F.col(f"`{name}`"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids and n_tokens of each document, and whether the ids decode to its text. A null text is an empty one; repeated rows stay."""
    coded = bpe.round_trip(docs, bpe.default_codec(spark), keep=["doc_id", "source", "lang"])
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("pii", without_pii),
    ("tokens", tokenised),
]

#: The classifier and the merges can't be written as SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
