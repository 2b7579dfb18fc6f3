"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK, _STAND_IN = "\x00", "\x01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z alone, so that code points keep their number and place."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set for checkpoints. A local session without either gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomwork-"))
    return spark.sparkContext.getCheckpointDir()


#: Bytes of one Arrow batch, which a task and its Python worker hold at once.
BATCH_BYTES = 8_000_000
#: Characters of a plan's description; the driver keeps those of its last thousand queries, and iterations make many.
PLAN_CHARS = 10_000


def lean(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have BATCH_BYTES and descriptions of plans PLAN_CHARS at most; smaller settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.maxPlanStringLength", PLAN_CHARS)):
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(name, str(most))


def collected(spark: SparkSession) -> None:
    """Collects the driver's garbage: Spark drops shuffle files and broadcasts only when the driver has forgotten them, as spark.cleaner.periodicGC.interval does each half hour."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    lean(spark)
    path = f"{shared_dir(spark)}/loomwork/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    collected(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of perhaps_among(): two megabytes, whatever the data.
ID_BITS = 1 << 24


def perhaps_among(df: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    """The rows of df whose key is among those of ids, and few others.

    A bitmap of ID_BITS hashed keys, broadcast in rows of four kilobytes, keeps most other rows out of
    a shuffle; what follows decides.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(ID_BITS)).alias("_place")
    bits = ids.select(place).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    near = df.select("*", place).select("*", F.bitmap_bucket_number("_place").alias("_bucket"), F.bitmap_bit_position("_place").cast("int").alias("_at"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return near.join(F.broadcast(bits), "_bucket").filter(F.getbit(byte, F.col("_at") % 8) == 1).select(*df.columns)


def pinned(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, for small tables of iterative steps."""
    shared_dir(df.sparkSession)
    lean(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(text: Column, pattern: str) -> Column:
    """The text cut at the matches of a Java pattern: array of gap, match, gap, ..., gap.

    One pass of the regular expression. NUL marks the cuts; a NUL of the text is first replaced
    by another character, so the pattern may name neither. Lengths are kept.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, _STAND_IN)
    return F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


#: Parts whose matches are gathered in one step before a text's are put together.
BLOCK = 512


def matches(cut: Column, keep) -> Column:
    """array<struct<start,end,value>> of the matches in parts(), in code points, for which keep(value) holds.

    The fold goes by blocks, so that a text of very many matches isn't copied once for each of them.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    none = F.array().cast(kind)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        found = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value"))
        hit = (acc["i"] % 2 == 1) & F.coalesce(keep(part), F.lit(False))
        out = F.when(hit, F.concat(acc["out"], F.array(found))).otherwise(acc["out"])
        return F.struct((acc["i"] + 1).alias("i"), end.alias("at"), out.alias("out"))

    def block(acc: Column, k: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), acc["at"].alias("at"), none.alias("out"))
        own = F.aggregate(F.slice(cut, k * BLOCK + 1, BLOCK), zero, step)
        return F.aggregate(F.array(own), acc, lambda a, o: F.struct(o["at"].alias("at"), F.concat(a["out"], F.array(o["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / BLOCK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    # a text without a match, the common case, skips the fold
    return F.when(F.size(cut) < 2, none).otherwise(F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"])))


def replaced(text: Column, found: Column, by) -> Column:
    """The text with each span of found, sorted by start, replaced by by(span); of spans that overlap, the first one's text fills the hole."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        hole = F.when(s["start"] >= acc["at"], by(s)).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, hole).alias("out"))

    def block(acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(found, k * BLOCK + 1, BLOCK), F.struct(acc["at"].alias("at"), F.lit("").alias("out")), step)
        return F.aggregate(F.array(own), acc, lambda a, o: F.struct(o["at"].alias("at"), F.concat(a["out"], F.array(o["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(blocks, start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) == 0, text).otherwise(whole)


def labelled(found: Column, kind: str, order: int) -> Column:
    """Adds the kind and its place in the list of kinds to the structs of matches()."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")
        ),
    )


def spans_text(found: Column) -> Column:
    """kind:start:end of an array of labelled matches, by start and then kind, comma-joined."""
    by_start = F.array_sort(found)
    return F.array_join(F.transform(by_start, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


#: Characters of text that a Python worker turns into objects at once; a longer text goes alone.
SLICE_CHARS = 4_000_000


def slices(batch, column: int, most: int = SLICE_CHARS):
    """An Arrow batch in slices of consecutive rows with at most so many bytes (strings) or elements (lists) in a column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc
    import pyarrow.types as pt

    own = batch.column(column)
    size = pc.list_value_length if pt.is_list(own.type) or pt.is_large_list(own.type) else pc.binary_length
    ends = np.cumsum(pc.fill_null(size(own), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def map_texts(df: DataFrame, text: str, keep: list[str], fields: str, start) -> DataFrame:
    """The columns keep of df, untouched, and the fields that a Python function makes of each text.

    start() is called once for each partition and returns the function from a text (or None) to a
    tuple of the fields. Arrow batches pass between Spark and Python and are worked on in slices of
    bounded size; a partition isn't held whole.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    lean(df.sparkSession)
    kept = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    made = df.sparkSession.createDataFrame([], fields).schema
    out = StructType([*[kept.schema[c] for c in keep], *made.fields])
    types = [f.type for f in to_arrow_schema(made)]

    def run(batches):
        one = start()
        for whole in batches:
            at = whole.schema.get_field_index
            for batch in slices(whole, at(text)):
                rows = [one(t.as_py()) for t in batch.column(at(text))]
                columns = [batch.column(at(c)) for c in keep]
                columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    return kept.mapInArrow(run, out)
