"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A layout is known by the hash of its sorted nested field paths. For tables the paths come from the
schema; for JSON records from each record's own variant schema, so that one column may mix prompt
pairs, instructions and message lists. Both are hashed by the same function. Each known fingerprint has a mapping, a Column expression that
yields array<struct<role,text>>; records of unknown layout give no turns and are returned as such.

The template writes <|im_start|>role, a line feed, the text and <|im_end|> with a line feed. A
control string inside a role or text gets one more backslash after its first character; taking one
away reads it back, whatever the text held before.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tagged import whole_json
from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: What texts may not contain raw: first character, any backslashes, the rest.
_ESCAPED = r"([<\[])(\\*+)(\|(?:im_start|im_end|system|user|assistant|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"
_UNESCAPED = r"([<\[])\\(\\*+)(\|(?:im_start|im_end|system|user|assistant|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"
#: Turns whose texts are joined in one step before a conversation is put together.
CHUNK = 256

_TURNS = "array<struct<role:string,text:string>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPED, "$1$2$3")


def escaped_role(role: Column) -> Column:
    """A role is one line: a backslash is written as backslash b, a line feed as backslash n, so that each backslash has a b or n behind it."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


# Fingerprints and mappings


def record_shape(record: Column) -> Column:
    """The nested field paths of one JSON record, natively: its variant schema without scalar types."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(F.regexp_replace(shape, r": (?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\([0-9,]+\))", ""), r"`", "")


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def _get(path: str, kind: str = "string") -> Callable[[Column], Column]:
    return lambda v: F.try_variant_get(v, path, kind)


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _pairs(*named: tuple[str, str]) -> Callable[[Column], Column]:
    return lambda v: F.array(*[_turn(role, _get(path)(v)) for role, path in named])


def _listed(path: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Column], Column]:
    def turns(v: Column) -> Column:
        items = _get(path, f"array<struct<{role}:string,{text}:string>>")(v)

        def one(m: Column) -> Column:
            who = m[role]
            for given, canonical in (names or {}).items():
                who = F.when(m[role] == given, F.lit(canonical)).otherwise(who)
            return _turn(F.coalesce(who, F.lit("")), m[text])

        return F.transform(items, one)

    return turns


def _instruction(v: Column) -> Column:
    task, more = _get("$.instruction")(v), F.coalesce(_get("$.input")(v), F.lit(""))
    return F.array(_turn("user", F.when(more == "", task).otherwise(F.concat_ws("\n\n", task, more))), _turn("assistant", _get("$.output")(v)))


#: Shape of a layout and its mapping, in the form that record_shape() gives.
MAPPINGS: dict[str, Callable[[Column], Column]] = {
    "OBJECT<completion, prompt>": _pairs(("user", "$.prompt"), ("assistant", "$.completion")),
    "OBJECT<prompt, response>": _pairs(("user", "$.prompt"), ("assistant", "$.response")),
    "OBJECT<prompt, response, system>": _pairs(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")),
    "OBJECT<answer, question>": _pairs(("user", "$.question"), ("assistant", "$.answer")),
    "OBJECT<instruction, output>": _instruction,
    "OBJECT<input, instruction, output>": _instruction,
    "OBJECT<messages: ARRAY<OBJECT<content, role>>>": _listed("$.messages", "role", "content"),
    "ARRAY<OBJECT<content, role>>": _listed("$", "role", "content"),
    "OBJECT<conversations: ARRAY<OBJECT<from, value>>>": _listed("$.conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
}
#: Shape of a table of turns, in the same form, and the column of each canonical field.
TABLES: dict[str, dict[str, str]] = {
    "OBJECT<conv_id, role, text, turn>": {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"},
    "OBJECT<content, conversation_id, index, role>": {"conv_id": "conversation_id", "turn": "index", "role": "role", "text": "content"},
}


def table_shape(schema: T.StructType, fields: set[str]) -> str:
    """The nested field paths of a schema's columns among fields, as record_shape() writes those of a record."""

    def shape(t: T.DataType) -> str:
        if isinstance(t, T.StructType):
            inner = ((f.name, shape(f.dataType)) for f in sorted(t, key=lambda f: f.name))
            return "OBJECT<" + ", ".join(f"{n}: {s}" if s else n for n, s in inner) + ">"
        return f"ARRAY<{shape(t.elementType)}>" if isinstance(t, T.ArrayType) else ""

    return shape(T.StructType([f for f in schema if f.name in fields]))


def _known(spark: SparkSession, shapes) -> dict[str, int]:
    """Fingerprints of the shapes of the mappings, a fixed few."""
    return {r["shape"]: r["fp"] for r in spark.createDataFrame([(s,) for s in shapes], "shape string").select("shape", fingerprint(F.col("shape")).alias("fp")).collect()}


def record_turns(records: DataFrame, key: str, record: str) -> DataFrame:
    """(conv_id, turn, role, text) of JSON records of mixed layouts.

    Null or broken JSON, text behind a record, and layouts without a mapping, give one row with null turn, role and text,
    so that no record is lost unseen.
    """
    known = _known(records.sparkSession, MAPPINGS)
    parsed = records.select(F.col(key).alias("conv_id"), whole_json(F.col(record)).alias("record")).select("conv_id", F.try_parse_json("record").alias("v"), fingerprint(record_shape(F.col("record"))).alias("fp"))
    turns = F.lit(None).cast(_TURNS)
    for shape, mapping in MAPPINGS.items():
        turns = F.when(F.col("fp") == known[shape], mapping(F.col("v")).cast(_TURNS)).otherwise(turns)
    return parsed.select("conv_id", F.posexplode_outer(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def table_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table of turns: the fingerprint of its schema's paths selects the mapping; columns that no layout names are ignored.

    A table that has the fields of a layout and some that another one names is known by those of the
    first layout in order whose fingerprint is found.
    """
    every = {f for names in TABLES.values() for f in names.values()}
    views = [every, *(set(names.values()) for names in TABLES.values())]
    shapes = list(dict.fromkeys([*TABLES, *(table_shape(rows.schema, v) for v in views)]))
    hashes = _known(rows.sparkSession, shapes)
    mappings = {hashes[shape]: names for shape, names in TABLES.items()}
    for view in views:
        names = mappings.get(hashes[table_shape(rows.schema, view)])
        if names:
            return rows.select(*[F.col(src).alias(to) for to, src in names.items()])
    raise ValueError(f"no mapping for a table with the fields {sorted(rows.columns)}")


# Formatting and reading back


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conv_id: formatted, and loss as the (start, length) of learned texts in it, in code points.

    Turns go by turn, then role and text; nulls first. A null role or text is empty. Repeated rows
    stay. A null conv_id is a conversation of its own. Turns are joined in chunks of CHUNK turn
    numbers before chunks are joined, and places are counted in each chunk first, so that a long
    conversation costs in proportion to its length.
    """
    one = turns.select("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))

    def written(t: Column) -> Column:
        head = F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
        body = F.concat(escaped(t["text"]), F.lit(f"{END}\n"))
        return F.struct(t["role"].alias("role"), F.concat(head, body).alias("piece"), (F.length(head) + F.length(body)).cast("long").alias("n"), F.length(head).cast("long").alias("lead"))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda t: t["piece"]), "")

    def placed(items: Column, starts, length) -> Column:
        """Struct of the items' length in all, and their learned places, moved by the length of what stands before each."""
        empty = F.array().cast("array<array<struct<start:bigint,length:bigint>>>")
        zero = F.struct(F.lit(0).cast("long").alias("n"), empty.alias("loss"))
        step = lambda acc, t: F.struct((acc["n"] + length(t)).alias("n"), F.concat(acc["loss"], F.array(F.transform(starts(t), lambda s: F.struct((s["start"] + acc["n"]).alias("start"), s["length"].alias("length"))))).alias("loss"))
        return F.aggregate(items, zero, step, lambda acc: F.struct(acc["n"].alias("n"), F.flatten(acc["loss"]).alias("loss")))

    def learned(t: Column) -> Column:
        own = F.array(F.struct(t["lead"].alias("start"), (t["n"] - t["lead"] - len(END) - 1).alias("length")))
        return F.when(t["role"].isin(*learn), own).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))

    chunks = one.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", "chunk", F.transform("t", written).alias("t"))
    # turns of one number are one chunk, however many: they are counted in slices as well
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / CHUNK).cast("int")), lambda k: placed(F.slice("t", k * CHUNK + 1, CHUNK), learned, lambda t: t["n"]))
    whole = lambda items: placed(items, lambda c: c["loss"], lambda c: c["n"])
    chunks = chunks.select("conv_id", F.struct("chunk", joined(F.col("t")).alias("piece"), whole(slices).alias("p")).alias("c"))
    convs = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    loss = whole(F.transform("c", lambda c: c["p"]))["loss"]
    return convs.select("conv_id", joined(F.col("c")).alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation, unescaped."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    rest = F.slice(blocks, 2, F.greatest(F.lit(0), F.size(blocks) - 1))

    def one(b: Column) -> Column:
        line = F.instr(b, "\n")
        text = F.substring(b, line + 1, F.length(b) - line - len(END) - 1)
        return F.struct(unescaped_role(F.substring(b, F.lit(1), line - 1)).alias("role"), unescaped(text).alias("text"))

    return F.transform(rest, one)


def _messages(said: str) -> str:
    return json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, _messages(said))], "conv_id long, record string")
    turns = table_turns(table(spark, sf_dir, "conversations")).unionByName(record_turns(extra, "conv_id", "record"))
    out = format_turns(turns).select("conv_id", "formatted", "loss", read_back(F.col("formatted")).alias("back"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), masked.alias("m"), F.length("formatted").cast("long").alias("formatted_chars")
    ).select("conv_id", "n_turns", "turns_sha256", F.length("m").cast("long").alias("loss_chars"), F.sha2("m", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length('<|im_start|>') + length(replace(role, '\', '\\')) + 1 + length('<|im_end|>') + 1
  + length(regexp_replace(text, '([<\[])(\\*)(\|(?:im_start|im_end|system|user|assistant|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
