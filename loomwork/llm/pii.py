"""PII: patterns, and information-theoretic sanitisation of the terms around what they find.

The patterns' finds are the protected entities. A term near an entity e discloses it as far as
seeing the term t makes e expected: with N different texts, n(e) of them holding e, n(t) holding t and
n(t, e) holding t near e, the pointwise mutual information log(N n(t,e) / (n(t) n(e))) as a share of
e's own information log(N / n(e)). A share of 1 gives e away. Terms over the upper threshold are
removed where they stand near e, terms over the lower one are generalised to their word shape.
Copies of one text count once. Every pair is weighed, also where the entity stands in one text alone:
n(t, e) of n(t) and n(e) texts meeting by chance must be improbable, which for a pair of one text is
the term's own information, log(N / n(t)), or else several different texts must hold the pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, matches, parts, perhaps_among, replaced, spans_text, stored, table

# \G lets a match begin where the last one ended; else a match can begin only where a run of its
# first class does, which keeps long runs linear. Possessive groups are matched without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")

WINDOW_CHARS = 80
TERM = r"\p{L}++"
#: A pair is evidence when chance would make it with a probability of 2 ** -CHANCE_BITS at most, or when so many different texts hold it.
CHANCE_BITS, MIN_SUPPORT = 5.0, 3
GENERALISE_AT, REMOVE_AT = 0.75, 0.9
#: Terms near finds that are broadcast to the count of all words; longer lists are joined after it.
FEW_TERMS = 100_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(back, F.lit(0), lambda a, d: a + d) % 10 == 0


def _is_card(m: Column) -> Column:
    return F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(F.lit(False))


def base_spans(text: Column) -> list[Column]:
    """The matches of each pattern that count; failing ones are used up, not tried again."""
    keeps = (
        (EMAIL, lambda m: F.lit(True)),
        (IP, lambda m: F.forall(F.split(m, r"\."), lambda p: F.try_to_number(F.right(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), F.lit(4)), F.lit("9999")).between(0, 255) & (F.length(F.ltrim(p, F.lit("0"))) <= 3))),
        (CARD, _is_card),
        (PHONE, lambda m: F.length(_digits(m)).between(10, 15)),
    )
    return [labelled(matches(parts(text, pattern), keep), KINDS[k], k) for k, (pattern, keep) in enumerate(keeps)]


def _near(text: Column, s: Column) -> Column:
    """All terms within WINDOW_CHARS of a span: array<struct<start,end,value>>."""
    left_at = F.greatest(s["start"] - WINDOW_CHARS, F.lit(0))
    left = F.substring(text, left_at + 1, s["start"] - left_at)
    right = F.substring(text, s["end"] + 1, F.lit(WINDOW_CHARS))
    # a word that the window cuts is none
    left_terms = F.filter(matches(parts(left, TERM), lambda m: F.lit(True)), lambda t: (left_at == 0) | (t["start"] > 0))
    right_terms = F.filter(matches(parts(right, TERM), lambda m: F.lit(True)), lambda t: (F.length(right) < WINDOW_CHARS) | (t["end"] < WINDOW_CHARS))
    moved = lambda terms, by: F.transform(terms, lambda t: F.struct((t["start"] + by).alias("start"), (t["end"] + by).alias("end"), F.lower(t["value"]).alias("value")))
    return F.concat(moved(left_terms, left_at), moved(right_terms, s["end"]))


def _hashes(col: Column) -> list[Column]:
    return [F.xxhash64(col).alias("_h1"), F.xxhash64(col, F.lit(1)).alias("_h2")]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base (the pattern spans), near (terms around each) and two hashes of the text that name its copies."""
    col = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_base", F.concat(*base_spans(col))).withColumns({"_h1": _hashes(col)[0], "_h2": _hashes(col)[1]})
    around = F.transform("_base", lambda s: F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), _near(col, s).alias("terms")))
    return out.withColumn("_near", F.when(F.size("_base") == 0, F.array().cast("array<struct<entity:string,terms:array<struct<start:int,end:int,value:string>>>>")).otherwise(around))


def _chance_bits() -> Column:
    """-log2 of a bound of the probability that n_te or more texts hold both by chance: (n_t n_e / n) ** n_te / n_te!, with Stirling's formula."""
    k = F.col("n_te").cast("double")
    return k * F.log2(k * F.col("n") / (F.col("n_t") * F.col("n_e"))) - k * F.lit(math.log2(math.e)) + F.log2(2 * math.pi * k) / 2


def disclosing(scanned: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, share) of the pairs that are evidence and have a share of GENERALISE_AT or more, over all different texts."""
    mentions = scanned.filter(F.size("_near") > 0).select("_h1", "_h2", F.explode("_near").alias("m")).select("_h1", "_h2", "m.entity", F.transform("m.terms", lambda t: t["value"]).alias("terms"))
    # one row for each text, entity and term
    holding = mentions.select("_h1", "_h2", "entity", F.explode("terms").alias("term")).distinct()
    pairs = holding.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    entities = mentions.select("_h1", "_h2", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = stored(pairs.join(entities, "entity"), "pii-pairs")
    # a text counts once: all rows are counted and those beyond a text's first taken off, so that only texts with copies are shuffled
    texts = docs.select(*_hashes(F.coalesce(F.col(text), F.lit(""))), F.col(text).alias("text"))
    several = scanned.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    copied = perhaps_among(texts, several, "_h1", "_h2").groupBy("_h1", "_h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    counted = texts.select("text", F.lit(1).cast("long").alias("by")).unionByName(copied.select("text", (1 - F.col("rows")).alias("by")))
    words = counted.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]++"))).alias("term"), "by").filter(F.length("term") > 0)
    terms = pairs.select("term").distinct()
    if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS:  # a bounded list goes to all tasks, so that no other word is shuffled
        words = words.join(F.broadcast(terms), "term", "left_semi")
    # counted before they meet the pairs, so that what a join makes doesn't grow with both
    n_t = words.groupBy("term").agg(F.sum("by").alias("n_t"))
    total = scanned.select("_h1", "_h2").distinct().agg(F.count(F.lit(1)).alias("n"))
    share = 1 - F.log(F.greatest(F.col("n_t"), "n_te") / F.col("n_te")) / F.log(F.col("n") / F.col("n_e"))
    found = pairs.join(n_t, "term").join(F.broadcast(total)).filter((F.col("n") > F.col("n_e")) & ((F.col("n_te") >= MIN_SUPPORT) | (_chance_bits() >= CHANCE_BITS)))
    return found.select("entity", "term", share.alias("share")).filter(F.col("share") >= GENERALISE_AT)


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, name: str = "pii") -> DataFrame:
    """The columns keep of docs (default: all) and, under name, array<struct<start,ord,end,kind,value>> by start, in code points.

    Spans of kind term are those within WINDOW_CHARS of a find that disclose it; their value is remove
    or generalise. Terms inside pattern spans aren't added. Null and empty texts have no spans; no row
    is dropped or merged. A column that has the name is replaced; other names don't matter.
    """
    keep = tuple(c for c in (keep or docs.columns) if c != name)
    inner = {c: "text" if c == text else f"c{i}" for i, c in enumerate(keep)}
    docs = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(to) for c, to in inner.items() if c != text])
    scanned = stored(scan(docs).select(*inner.values(), "_base", "_near", "_h1", "_h2"), "pii-scan")
    pairs = disclosing(scanned, docs)
    mine = scanned.filter(F.size("_near") > 0).select("_h1", "_h2", F.explode("_near").alias("m")).select("_h1", "_h2", "m.entity", F.explode("m.terms").alias("t"))
    hits = mine.join(pairs, (mine["entity"] == pairs["entity"]) & (mine["t.value"] == pairs["term"]))
    action = F.when(F.max("share") >= REMOVE_AT, "remove").otherwise("generalise")
    spans = hits.groupBy("_h1", "_h2", F.col("t.start").alias("start"), F.col("t.end").alias("end")).agg(action.alias("value"))
    one = F.struct("start", F.lit(4).alias("ord"), "end", F.lit("term").alias("kind"), "value")
    # bounded by WINDOW_CHARS for each find of one text
    by_text = spans.groupBy("_h1", "_h2").agg(F.collect_list(one).alias("_terms"))
    with_near = scanned.filter(F.size("_near") > 0).join(by_text, ["_h1", "_h2"], "left")
    rest = scanned.filter(F.size("_near") == 0).withColumn("_terms", F.lit(None).cast(by_text.schema["_terms"].dataType))
    both = with_near.unionByName(rest)
    terms = F.coalesce("_terms", F.array().cast(by_text.schema["_terms"].dataType))
    free = F.filter(terms, lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return both.select(*[F.col(to).alias(c) for c, to in inner.items()], F.array_sort(F.concat("_base", free)).alias(name))


def sanitised(text: Column, found: Column) -> Column:
    """The text with finds replaced by <KIND>, removed terms by <TERM>, generalised ones by their shape, such as Xx or x."""

    def by(s: Column) -> Column:
        word = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        shape = F.regexp_replace(F.regexp_replace(word, r"\p{Lu}+", "X"), r"\p{Ll}+", "x")
        return F.when(s["value"] == "generalise", shape).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))

    return replaced(text, found, by)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("pii", lambda s: s["ord"] < 4)
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"))
