"""Secret scans: patterns, and character Markov models of random strings and of ordinary identifiers.

The models are first-order chains over the characters of tokens, add-one smoothed, counted natively
from labelled samples. A token's mean log-likelihood ratio per character says whether it looks drawn
at random; tokens over the threshold are spans of kind markov, unless they touch a pattern's span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, matches, parts, replaced, spans_text, table

ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]++"
#: Runs of 32 and more; shorter runs would only be dropped later.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: What the models judge: runs of token characters of this length at least.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "markov")
#: Nats per character by which a token must look more random than ordinary.
THRESHOLD = 0.35

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_K = len(_ALPHABET)
#: Code point to place in the alphabet.
_PLACE = [_ALPHABET.find(chr(i)) if chr(i) in _ALPHABET else 0 for i in range(128)]


#: Of these words ordinary identifiers are made, by the rules of training_samples().
WORDS = """
    access account action address agent amount anchor append area array async attribute backup base binary block body
    branch bridge build byte callback cancel category channel check class client code color column commit compare
    connect constant content context control copy count current cursor data date debug default delete device directory
    document domain download edge element encode engine entry error event execute export field file final find flag
    format frame gateway global group handle header history host identifier image index input insert integer internal
    job journal label language layer length level limit link loader local lock manager mapping memory message model
    module monitor network node number object option order output package page parent parser path pattern payload
    pixel platform policy pool prefix process profile property protocol proxy query random range record remote render
    report request response result retry role route rule runtime schema scope screen section segment server service
    setting shape shared size socket stack start status storage stream style submit support switch system table target
    template test thread timeout tooltip total trace transaction transform trigger type update upload user validate
    value version view volume watch weight width window wrapper write
""".split()


def training_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(label, token): 1 for random strings in the usual encodings, 0 for ordinary identifiers; n of each kind of either, the same in every session.

    Random strings are digests of 0..n-1 in base64, url-safe base64, hexadecimal and letters with digits. Ordinary
    ones join two to four words, with a number at times, in the usual ways: with _ - / or nothing between, in camel,
    lower and upper case; runs of one character and of decimal digits are ordinary too.
    """
    ids = spark.range(n).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 512).alias("h"), "id")
    b64 = F.regexp_replace(F.base64(F.unhex("h")), r"\s", "")
    coded = F.when(F.col("id") % 4 == 0, F.substring("h", 1, 40)).when(F.col("id") % 4 == 1, b64).when(F.col("id") % 4 == 2, F.translate(b64, "+/=", "-_")).otherwise(F.upper(F.regexp_replace(b64, "[+/=]", "")))
    random = ids.select(F.lit(1).alias("label"), coded.alias("token"))
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    some = F.slice(F.array(*[pick(k) for k in range(4)]), F.lit(1), (F.col("id") % 3 + 2).cast("int"))
    number = F.when(F.col("id") % 5 == 0, (F.col("id") % 100).cast("string")).otherwise("")
    camel = F.array_join(F.transform(some, F.initcap), "")
    forms = F.array(*[F.concat(F.array_join(some, by), number) for by in ("_", "-", "/", "")], *[F.upper(F.array_join(some, by)) for by in ("-", "/", "")], camel, F.concat(F.substring(F.array_join(some, ""), 1, 1), F.substring(camel, F.lit(2), F.length(camel))), F.concat(F.upper(F.array_join(some, "_")), number))
    letter = F.substring(F.lit(_ALPHABET), (F.col("id") % _K + 1).cast("int"), F.lit(1))
    plain = F.array(F.repeat(letter, F.lit(40)), F.regexp_replace(F.sha2(F.col("id").cast("string"), 512), "[a-f]", ""))
    ordinary = spark.range(n).select(F.explode(F.concat(forms, plain)).alias("token"))
    return random.unionByName(ordinary.select(F.lit(0).alias("label"), "token"))


def fit(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of characters, row by row: at most 2 * 67 * 67 counts reach the driver."""
    pairs = samples.filter(F.length("token") > 1).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    logp = {}
    for label in (0, 1):
        for a in _ALPHABET:
            row = [counts.get((label, a + b), 0) + 1 for b in _ALPHABET]
            logp[label, a] = [math.log(x / sum(row)) for x in row]
    return [r - o for a in _ALPHABET for r, o in zip(logp[1, a], logp[0, a], strict=True)]


def mean_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character of a token of at least two characters of the alphabet."""
    table_, place = F.lit(model), F.lit(_PLACE)
    codes = F.transform(F.split(token, ""), lambda c: F.get(place, F.ascii(c)))
    step = lambda acc, c: F.struct(c.alias("p"), F.when(acc["p"] < 0, acc["s"]).otherwise(acc["s"] + F.get(table_, acc["p"] * _K + c)).alias("s"))
    start = F.struct(F.lit(-1).alias("p"), F.lit(0.0).alias("s"))
    return F.aggregate(codes, start, step, lambda acc: acc["s"] / (F.length(token) - 1))


def base_spans(text: Column) -> list[Column]:
    """The matches of each pattern that count; failing ones are used up, not tried again."""
    value = lambda m: F.regexp_extract(m, r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 1)
    assign = matches(parts(text, ASSIGN), lambda m: F.length(value(m)) >= 8)
    access = matches(parts(text, ACCESS), lambda m: F.length(m) >= 16)
    hexa = matches(parts(text, HEX), lambda m: F.length(m) >= 32)
    return [labelled(found, kind, k) for k, (kind, found) in enumerate(zip(KINDS, (assign, access, hexa), strict=False))]


def find_secrets(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with secrets: array<struct<start,ord,end,kind,value>> in code points, by start.

    Null and empty texts have none. Rows, their order within partitions and all columns stay; a
    column named secrets is replaced.
    """
    col = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumn("secrets", F.concat(*base_spans(col)))
    tokens = labelled(matches(parts(col, TOKEN), lambda m: mean_ratio(m, model) > threshold), "markov", 3)
    free = F.filter(tokens, lambda t: ~F.exists("secrets", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return base.withColumn("secrets", F.array_sort(F.concat("secrets", free)))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by <KIND>; of spans that overlap, the first names the hole."""
    return replaced(text, found, lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), fit(training_samples(spark)))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["ord"] < 3)
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"))
